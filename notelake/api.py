"""The engine as functions: index, search, status, get, suggestions, evaluation."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.models import Embedder
from notelake.functions.text import Tokenizer
from notelake.operators import evaluate as E
from notelake.operators import search as S
from notelake.operators import store as ST
from notelake.plans import index as I
from notelake.session import WRITTEN, cleared
from notelake.sources import sinks, vault

log = logging.getLogger("notelake")


def index(spark: SparkSession, root: str, store: str, path: str | None = None, embed: Callable[[Column], Column] | Embedder | None = None, tokenizer: Tokenizer | None = None) -> dict[str, int]:
    """Index a folder of notes, or one file of it; counts of ingested, unchanged, skipped, failed and pruned files. A note that the model fails for fails no other."""
    ST.check_capabilities(spark)
    since = len(WRITTEN)
    st = ST.Store(store)
    upgrade(spark, store, tokenizer)
    found = vault.files(spark, root, everything=path is not None, valid=False)
    if path is not None:
        found = found.filter(F.col("path") == path)
    found = found.persist()
    skipped = found.filter("content is null").count()
    files = found.filter("content is not null").select("path", "content", "mtime")
    if path is not None and files.isEmpty():
        found.unpersist()
        return {"ingested": 0, "unchanged": 0, "skipped": skipped, "errors": 0, "pruned": 0}
    if st.version(spark) is None:
        files = files.drop("mtime")
        tables, failed = I.built(files, embed, tokenizer=tokenizer, stored=True)
        errors = 0
        if failed is not None:
            errors, files = failed.count(), files.join(failed, "path", "left_anti")
            for r in failed.limit(I.REPORTED).collect():
                log.warning("not indexed: %s: %s", r["path"], r["failure"])
        st.publish(spark, tables | {"files": files, "suggestions": spark.createDataFrame([], ST.SUGGESTIONS)})
        counts = {"new": files.count(), "errors": errors}
    else:
        # files that can't be read stay as they were indexed
        old = st.read_all(spark)
        unread = old["files"].join(found.filter("content is null").select("path", "mtime"), "path").select("path", "content", "mtime")
        changes, counts = I.changed(old, files.unionByName(unread), path is None, embed, tokenizer=tokenizer)
        if changes:
            st.change(spark, changes)
    found.unpersist()
    cleared(spark, since)
    out = {"ingested": counts.get("new", 0) + counts.get("changed", 0), "unchanged": counts.get("unchanged", 0), "skipped": skipped, "errors": counts.get("errors", 0), "pruned": counts.get("gone", 0) if path is None else 0}
    log.info("indexed %s: %s", root, out)
    return out


def upgrade(spark: SparkSession, store: str, tokenizer: Tokenizer | None = None) -> bool:
    """Bring an index of an older schema to this one, with the tables that it lacks; whether there was anything to do."""
    st = ST.Store(store)
    done = st.migrate(spark)
    if st.version(spark) is None or not {"chunks", "sources"} <= st.manifest(spark)["tables"].keys():
        return done
    if more := I.missing_tables(st.read_all(spark), tokenizer):
        st.publish(spark, more)
    return done or bool(more)


def hashing_query(spark: SparkSession) -> Callable[[str], list | None]:
    """The vector of a query by the default embedder, None where it has no token."""
    def embed(query: str) -> list | None:
        v = spark.createDataFrame([(query,)], "q string").select(I.hashing_embedder()(F.col("q")).alias("v")).first()["v"]
        return v if any(v) else None

    return embed


def opened(spark: SparkSession, store: str, tokenizer: Tokenizer | None = None) -> tuple[S.Index, dict[str, DataFrame]]:
    tables = ST.Store(store).read_all(spark)
    return I.opened(tables, tokenizer), tables


def results(spark: SparkSession, store: str, query: str, rerank: bool = True, embed_query: Callable[[str], list | None] | Embedder | None = None, reranker: S.Reranker | Column | None = None, **spec) -> DataFrame:
    """The best notes for one query with their lines. embed_query and reranker may be any model; one that fails leaves its channel or order out."""
    idx, tables = opened(spark, store)
    vector = S.safe_embed(embed_query.query if isinstance(embed_query, Embedder) else embed_query or hashing_query(spark), query)
    scorer = (S.overlap_scorer() if reranker is None else reranker) if rerank else None
    return I.with_lines(S.search(idx, [(1, query, vector)], S.Spec(**spec), scorer), tables["files"], tables["chunks"])


def search(spark: SparkSession, store: str, query: str, as_json: bool = False, rerank: bool = True, **more) -> str:
    """The best notes for one query, as text or JSON."""
    began, since = time.time(), len(WRITTEN)
    rows = results(spark, store, query, rerank, **more)
    if as_json:
        found = sinks.as_json(rows).first()
        out = found["json"] if found else sinks.EMPTY
    else:
        out = "\n".join(r["line"] for r in sinks.as_lines(rows).orderBy("position").collect()) or "No results."
    cleared(spark, since)
    log.info("searched %r in %.2f s", query, time.time() - began)
    return out


def status(spark: SparkSession, root: str, store: str) -> dict[str, int]:
    """Counts of the index, and how many files are new, stale or missing."""
    st = ST.Store(store)
    t = st.read_all(spark)
    suggestions = t["suggestions"] if "suggestions" in t else spark.createDataFrame([], ST.SUGGESTIONS)
    out = ST.stats(t["sources"], t["chunks"], t["edges"], suggestions).first().asDict()
    fresh = {r["state"]: r["n"] for r in ST.freshness(vault.files(spark, root), t["sources"]).groupBy("state").agg(F.count("*").alias("n")).collect()}
    return {k: int(v) for k, v in out.items()} | {k: fresh.get(k, 0) for k in ("new", "stale", "missing")}


def status_json(spark: SparkSession, root: str, store: str) -> str:
    return sinks.status_json(status(spark, root, store))


def suggest(spark: SparkSession, store: str, rows: DataFrame) -> None:
    """Add pending suggestions (source_note_id, target_note_id, score, reason)."""
    st = ST.Store(store)
    old = st.read(spark, "suggestions") if st.has(spark, "suggestions") else spark.createDataFrame([], ST.SUGGESTIONS)
    st.publish(spark, {"suggestions": ST.suggested(old, rows)})


def decide(spark: SparkSession, store: str, suggestion_id: int, decision: str) -> None:
    """Approve or reject a pending suggestion."""
    if decision not in ("approved", "rejected"):
        raise ValueError(f"a decision is approved or rejected, not {decision!r}")
    st = ST.Store(store)
    st.publish(spark, {"suggestions": ST.resolved_suggestions(st.read(spark, "suggestions"), spark.createDataFrame([(suggestion_id, decision)], "suggestion_id long, decision string"))})


def rename(spark: SparkSession, store: str, old_path: str, new_path: str) -> None:
    """Tell the index that a file moved: number, uid, chunks and links stay."""
    st = ST.Store(store)
    moves = spark.createDataFrame([(old_path, new_path)], "old_path string, new_path string")
    t = st.read_all(spark, "sources", "files")
    st.publish(spark, {n: ST.renamed(df, moves) for n, df in t.items()})


def get(spark: SparkSession, root: str, path: str, line: int | None = None, count: int | None = None, context: int | None = None) -> str | None:
    row = vault.windows(vault.files(spark, root, everything=True), path, line, count, context).first()
    return None if row is None else row["lines"]


def evaluate(spark: SparkSession, store: str, items: list[dict], config: str = "A", rerank: bool = True, out: str | None = None, **spec) -> dict:
    """Run a query set against an index: the report with metrics by query, their means, by tag, and latencies; written as JSON if out is given."""
    specs = vault.query_specs(spark, items)
    idx, _ = opened(spark, store)
    embed = hashing_query(spark)
    scorer = S.overlap_scorer() if rerank else None
    report = E.report(idx, specs, S.Spec(**spec), lambda q: S.safe_embed(embed, q), scorer, config)
    if out:
        sinks.write_report(spark, report, out)
    return report
