"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from notelake.llm import alignment, classifier, compaction, imatch, jaccard_join, katz, mixing, packing, quality_rules, recompression, simhash, suffix, url_filter
from notelake.session import table


def _on(name, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def _labelled(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_suffix_array": _on("documents", suffix.dedup),
    "op2_imatch": _on("documents", imatch.fingerprinted),
    "op3_simhash": _on("documents", simhash.grouped),
    "op4_packing": _on("documents", packing.pack),
    "op5_recompression": _on("documents", recompression.dedup),
    "op6_mixing": _on("documents", mixing.mix_report),
    "op7_url_filter": _on("pages", url_filter.judge),
    "op8_classifier": _labelled(classifier.classify),
    "op9_quality_rules": _labelled(quality_rules.judged),
    "op10_katz": _on("documents", katz.score),
    "op11_compaction": _on("clicks", compaction.compacted),
    "op12_alignment": _on("documents", alignment.align),
    "op13_jaccard_join": _on("documents", jaccard_join.grouped),
}
ORACLE = {"op6_mixing": mixing.ORACLE, "op7_url_filter": url_filter.ORACLE}
