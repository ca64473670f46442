"""Retrieval metrics as column expressions over arrays of hits and expected paths, their aggregates, and the runner that makes reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.operators import fuse, search


def expected_set(expected: Column) -> Column:
    return F.array_remove(F.array_distinct(expected), "")


def hit_ranks(hits: Column, expected: Column, k: int = 10) -> Column:
    """Ranks (from 1) of the first occurrence of each expected hit among the first k; repeated hits keep their places."""
    head, want = F.slice(hits, 1, max(0, k)), expected_set(expected)
    return F.filter(F.transform(head, lambda h, i: F.when(F.array_contains(want, h) & (F.array_position(head, h) == i + 1), i + 1)), lambda x: x.isNotNull())


def recall_at_k(hits: Column, expected: Column, k: int = 10) -> Column:
    n = F.size(expected_set(expected))
    return F.when((n > 0) & F.lit(k > 0), F.size(hit_ranks(hits, expected, k)) / n).otherwise(F.lit(0.0))


def reciprocal_rank(hits: Column, expected: Column, k: int = 10) -> Column:
    r = hit_ranks(hits, expected, k)
    return F.when(F.size(r) > 0, F.lit(1.0) / F.array_min(r)).otherwise(F.lit(0.0))


def precision_at_k(hits: Column, expected: Column, k: int = 10) -> Column:
    return F.size(hit_ranks(hits, expected, k)) / F.lit(float(k)) if k > 0 else F.lit(0.0)


def average_precision_at_k(hits: Column, expected: Column, k: int = 10) -> Column:
    r = F.array_sort(hit_ranks(hits, expected, k))
    n = F.least(F.size(expected_set(expected)), F.lit(k))
    total = F.aggregate(F.transform(r, lambda x, i: (i + 1) / x), F.lit(0.0), lambda s, x: s + x)
    return F.when((n > 0) & F.lit(k > 0), total / n).otherwise(F.lit(0.0))


def dcg_at_k(gains: Column, k: int = 10) -> Column:
    """The sum of (2^gain - 1) / log2(rank + 1) over positive gains."""
    parts = F.transform(F.slice(gains, 1, max(0, k)), lambda g, i: F.when(g > 0, (F.pow(F.lit(2.0), g) - 1) / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def ndcg_at_k(hits: Column, expected: Column, relevance: Column | None = None, k: int = 10) -> Column:
    """Expected paths have grade 1; relevance (map path -> grade) overrides and may add paths. Repeated hits gain nothing."""
    want = expected_set(expected)
    grades = F.map_from_arrays(want, F.transform(want, lambda _: F.lit(1.0)))
    if relevance is not None:
        kept = F.map_filter(grades, lambda p, _: ~F.map_contains_key(relevance, p))
        grades = F.map_concat(kept, relevance)
    head = F.slice(hits, 1, max(0, k))
    gains = F.transform(head, lambda h, i: F.when(F.array_position(head, h) == i + 1, F.coalesce(F.try_element_at(grades, h), F.lit(0.0))).otherwise(F.lit(0.0)))
    ideal = dcg_at_k(F.reverse(F.array_sort(F.map_values(grades))), k)
    return F.when(ideal > 0, dcg_at_k(gains, k) / ideal).otherwise(F.lit(0.0))


def last_expected_rank(hits: Column, expected: Column, k: int = 10) -> Column:
    return F.array_max(hit_ranks(hits, expected, k))


def row_metrics(hits: Column, expected: Column, relevance: Column | None = None) -> list[Column]:
    return [
        recall_at_k(hits, expected).alias("recall_at_10"), reciprocal_rank(hits, expected).alias("mrr"), precision_at_k(hits, expected, 5).alias("precision_at_5"),
        average_precision_at_k(hits, expected).alias("ap_at_10"), ndcg_at_k(hits, expected, relevance).alias("ndcg_at_10"), last_expected_rank(hits, expected).cast("long").alias("last_rank"),
    ]


METRICS = ("recall_at_10", "mrr", "precision_at_5", "ap_at_10", "ndcg_at_10")


def means(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Mean of each metric (and of latency_ms, if there) and the number of rows; 0 where there are none."""
    out = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in (*METRICS, "latency_ms") if m in rows.columns]
    return (rows.groupBy(by) if by else rows).agg(F.count("*").alias("n"), *out)


def means_by_tag(rows: DataFrame) -> DataFrame:
    """A row counts in each of its tags; rows without tags don't count."""
    return means(rows.withColumn("tag", F.explode(F.array_distinct("tags"))), "tag")


def percentile(rows: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """Nearest rank: the sorted value at min(floor(q * n), n - 1), for q at most 0 the least and at least 1 the greatest.

    By window ranks, so a group is sorted and spilled by Spark rather than gathered into an array.
    """
    q = min(max(q, 0.0), 1.0)
    n, at = F.count(value).over(Window.partitionBy(*by)), F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1
    return rows.filter(F.col(value).isNotNull()).withColumn("_n", n).withColumn("_at", at).filter(F.col("_at") == F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)).select(*by, F.col(value).alias("percentile"))


def rerank_histogram(rows: DataFrame, column: str = "resolved_rerank_k") -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def run(index: search.Index, specs: DataFrame, spec: search.Spec, embed: Callable[[str], list | None], reranker=None, config: str = "A") -> DataFrame:
    """(query_id, query, tags, hits, metrics) for a query set (``vault.query_specs``), all queries in one plan.

    A: search as it is. C: each query and its expansions, fused by reciprocal ranks (queries without expansions are an error).
    """
    if config not in ("A", "C"):
        raise ValueError(f"there is no config {config!r}")
    asked = specs.select("query_id", "query", "expansion").orderBy("query_id").collect()  # a query set is small by nature
    if config == "C" and (bare := [r["query"] for r in asked if not r["expansion"]]):
        raise ValueError(f"no expansions for {bare[0]!r}")
    each = [(r["query_id"], i, q) for r in asked for i, q in enumerate([r["query"], *(r["expansion"] if config == "C" else [])])]
    spark = specs.sparkSession
    of = spark.createDataFrame([(n, s, i) for n, (s, i, _) in enumerate(each)], "query_id long, set_id long, query_idx int")
    found = search.search(index, [(n, q, embed(q)) for n, (_, _, q) in enumerate(each)], spec, reranker)
    found = found.join(F.broadcast(of), "query_id").select("set_id", "query_idx", F.col("position").alias("rank"), "path")
    if config == "C":
        found = fuse.fuse_paths(found, limit=spec.top_k)
    hits = found.groupBy(F.col("set_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("h"))
    rows = specs.join(hits, "query_id", "left").withColumn("hits", F.coalesce(F.transform("h", lambda x: x["path"]), F.array().cast("array<string>")))
    return rows.select("query_id", "query", "tags", "expected_paths", "hits", *row_metrics(F.col("hits"), F.col("expected_paths"), F.col("relevance")))


def expected_ranks(index: search.Index, specs: DataFrame, spec: search.Spec, embed: Callable[[str], list | None]) -> DataFrame:
    """(query_id, path, known, bm25, vector, title, metadata, indegree, rrf): where the first stage has each expected path; null where nowhere."""
    asked = specs.select("query_id", "query").orderBy("query_id").collect()
    got = search.channels(index, [(r["query_id"], r["query"], embed(r["query"])) for r in asked], spec)
    fused = fuse.ranked(got["fused"], [F.desc("score"), "source_id"], "rrf")
    wide = got["ranks"].select("query_id", "source_id", "channel", "rank").unionByName(fused.select("query_id", "source_id", "channel", "rank"))
    names = ("bm25", "vector", "title", "metadata", "indegree", "rrf")
    wide = wide.groupBy("query_id", "source_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(c) for c in names])
    want = specs.select("query_id", F.explode(F.array_distinct("expected_paths")).alias("path"))
    known = index.sources.select("path", "source_id").join(F.broadcast(want), "path", "right")
    return known.join(wide, ["query_id", "source_id"], "left").select("query_id", "path", F.col("source_id").isNotNull().alias("known"), *names)


def nearest_rank(values: list[float], q: float) -> float:
    ordered = sorted(values)
    return ordered[min(int(min(max(q, 0.0), 1.0) * len(ordered)), len(ordered) - 1)] if ordered else 0.0


def report(index: search.Index, specs: DataFrame, spec: search.Spec, embed: Callable[[str], list | None], reranker=None, config: str = "A", timed: bool = False) -> dict:
    """Metrics of every query, their means, means by tag, first-stage ranks and latencies, as a dictionary for JSON.

    Queries run as one batch and share its time evenly; timed=True runs them one after another and times each.
    """
    ids, began, latency = [r["query_id"] for r in specs.select("query_id").orderBy("query_id").collect()], time.time(), {}
    if timed:
        parts = []
        for i in ids:
            at = time.time()
            parts += run(index, specs.filter(F.col("query_id") == i), spec, embed, reranker, config).collect()
            latency[i] = (time.time() - at) * 1000
    else:
        parts = run(index, specs, spec, embed, reranker, config).collect()
        latency = dict.fromkeys(ids, (time.time() - began) * 1000 / max(1, len(ids)))
    rows = sorted((r.asDict() | {"latency_ms": latency[r["query_id"]]} for r in parts), key=lambda r: r["query_id"])
    mean = lambda own: {f"mean_{m}": sum(r[m] for r in own) / len(own) if own else 0.0 for m in (*METRICS, "latency_ms")}
    tags = sorted({t for r in rows for t in r["tags"]})
    ranks: dict[int, list] = {}
    for r in expected_ranks(index, specs, spec, embed).collect():
        ranks.setdefault(r["query_id"], []).append({k: v for k, v in r.asDict().items() if k != "query_id"})
    budget = "auto" if spec.rerank_k == "auto" else int(spec.rerank_k)
    return {
        "config": config, "n_queries": len(rows), "with_reranker": reranker is not None, "reranking": {"enabled": reranker is not None, "rerank_k": budget, "metadata_expansion": spec.metadata},
        "aggregate": mean(rows) | {f"p{int(q * 100)}_latency_ms": nearest_rank(list(latency.values()), q) for q in (0.5, 0.95)},
        "by_tag": {t: {"n": len(own)} | mean(own) for t in tags if (own := [r for r in rows if t in r["tags"]])},
        "results": [r | {"first_stage": ranks.get(r["query_id"], [])} for r in rows],
    }
