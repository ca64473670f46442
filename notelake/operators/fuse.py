"""Ranks, reciprocal rank fusion and post-filters, all keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_RRF = 60


def best_chunk(hits: DataFrame, score: str) -> DataFrame:
    """Of (query_id, source_id, chunk_id, score): the chunk with the least score for each source, ties by chunk."""
    return hits.groupBy("query_id", "source_id").agg(F.min(F.struct(score, "chunk_id")).alias("b")).select("query_id", "source_id", F.col("b.chunk_id").alias("chunk_id"), F.col(f"b.{score}").alias(score))


def ranked(rows: DataFrame, order: list, channel: str | None = None) -> DataFrame:
    """(query_id, source_id, rank): consecutive ranks from 1."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "source_id", "rank")
    return out if channel is None else out.withColumn("channel", F.lit(channel))


def rrf(ranks: DataFrame, weights: dict[str, float], k: int = K_RRF) -> DataFrame:
    """(query_id, source_id, score) from long (query_id, source_id, channel, rank): the sum of weight / (k + rank)."""
    weight = F.element_at(F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))]), F.col("channel"))
    return ranks.groupBy("query_id", "source_id").agg(F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score"))


def folder_filter(path: Column, folder: str | None) -> Column:
    return F.lit(True) if not folder else path.startswith(folder if folder.endswith("/") else folder + "/")


def tags_filter(tags: Column, wanted) -> Column:
    """Rows that have all wanted tags."""
    return F.lit(True) if not wanted else F.forall(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(tags, t))


def fuse_paths(results: DataFrame, k: int = K_RRF, limit: int = 10) -> DataFrame:
    """Several queries' ranked paths (set_id, query_idx, rank, path) fused for each set; ties by first seen."""
    score = F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score")
    fused = results.groupBy("set_id", "path").agg(score, F.min(F.struct("query_idx", "rank")).alias("seen"))
    order = Window.partitionBy("set_id").orderBy(F.desc("score"), "seen", "path")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("set_id", "rank", "path", "score")
