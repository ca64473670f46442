"""Stages of the pipeline against plain versions, on hard cases and on the smallest tables."""

import corpus_pipeline
import pytest

from notelake.llm import mixing, suffix
from tests.llm import brute


def test_text_after_suffix_dedup(spark):
    rows = brute.hard_cases(3)
    df = spark.createDataFrame(rows, brute.DDL)
    got = suffix.deduplicated(df)
    assert got.columns == df.columns
    want = [(i, k.decode("utf-8", "ignore")) for i, _, removed, _, k in brute.byte_windows(rows, first=True) if not removed or k.decode("utf-8", "ignore").strip()]
    assert sorted((repr(r.doc_id), r.text or "") for r in got.collect()) == sorted((repr(i), t) for i, t in want)
    assert {r.source for r in got.collect()} == {r[3] for r in rows}


def test_mix_keeps_columns(spark):
    rows = brute.hard_cases(3)
    df = spark.createDataFrame(rows, brute.DDL)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = {}
    for r in mixing.mix_report(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.words(r.text))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, sf).cache()
        seen.append((name, docs.count()))
        if name != "best-fit packing":
            assert docs.columns == columns
    assert all(n > 0 for _, n in seen), seen
    assert seen[0][1] > 120


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_run_end_to_end(spark):
    """run() gives the pieces of whole documents, each document's pieces in a row, in sequences without gaps."""
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.start == 2048 * r.piece and 1 <= r.length <= 2048
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 2048
    ids = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in got} <= ids


@pytest.mark.parametrize("null_ids", [False, True])
def test_stages_take_hard_and_empty_tables(spark, tmp_path, null_ids):
    rows = brute.hard_cases(2)
    rows = [(None, *r[1:]) for r in rows] if null_ids else rows
    spark.createDataFrame([(3 * i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = spark.createDataFrame(rows, brute.DDL).selectExpr("*", "timestamp'2024-01-02 03:04:03.456789' as at", "double('nan') as bad", "x'00ff' as raw")
    for docs in (more, more.limit(0)):
        columns, n = docs.schema.simpleString(), docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path)).persist()
            assert docs.schema.simpleString() == columns, name
            assert n == 0 or docs.filter("raw = x'00ff' and at = timestamp'2024-01-02 03:04:03.456789'").count() == docs.count() > 0, name
        assert (corpus_pipeline.pack(spark, docs, str(tmp_path)).count() > 0) == (n > 0)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
