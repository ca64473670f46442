"""Mixing sources to target weights.

Tokens are summed per source (partial sums first, so a hot source is harmless), targets are filled by weight under a
cap, and each document gets floor(rate) copies plus one hash-seeded Bernoulli copy with probability frac(rate).

Edge cases: null text has size 0; null source is a source of its own, last in the order; null doc_id draws as the text
``null``; repeated rows draw alike, as the draw depends on doc_id alone; a source of size 0 has target 0; an empty
table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.text import kept_columns, n_words
from notelake.session import written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
BROADCAST_ROWS = 100_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source_size, target) per source, from (key, size): min(cap * size, level * weight), summing to all sizes.

    Sources sorted by cap * size / weight: the capped ones come first, so a running sum finds the level. The table has
    one row per source, so these windows order sources, never documents.
    """
    order = Window.orderBy(F.col("key.none"), F.col("key.source"))
    rows = sizes.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("k", F.row_number().over(order) - 1)
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("k"))
    before, everywhere = fill.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everywhere), "all_w": F.sum("w").over(everywhere),
        "c": F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)), "v": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    level = (F.col("total") - F.col("c")) / (F.col("all_w") - F.col("v"))
    rows = rows.withColumn("fits", level * F.col("w") < F.col("source_size") * cap)
    rows = rows.withColumn("level", F.min(F.when(F.col("fits"), F.struct("c", level.alias("x")))).over(everywhere)["x"])
    capped = F.col("level").isNull() | (F.col("level") * F.col("w") >= F.col("source_size") * cap)
    return rows.select("key", "source_size", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with probability frac(rate): a draw of 32 bits of md5(seed, key)."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")
    return (F.floor(rate) + (draw.cast("double") / F.lit(4294967296.0) < rate - F.floor(rate)).cast("int")).cast("long")


def source_key(name: str = "source") -> Column:
    return F.struct(F.col(name).isNull().alias("none"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("source"))


def planned(docs: DataFrame, sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs (with key, size, doc_id) joined with its source's size and target, and the number of its copies.

    The table of sources is broadcast only where it was counted to be small; beyond that AQE splits a hot source.
    """
    per_source = written(targets(sizes, weights, cap), "mix-sources")
    if per_source.count() <= BROADCAST_ROWS:
        per_source = F.broadcast(per_source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return docs.join(per_source, "key").withColumn("copies", copies(rate, F.col("doc_id"), seed))


def mix_report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, and the words that the mix takes of it."""
    sizes = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("key"), n_words().alias("size")), "mix-sizes")
    return planned(sizes, sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(documents: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves: each row repeated as often as planned, with its columns unchanged."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), source_key().alias("key"), n_words().alias("size"), F.col("doc_id"))
    out = planned(rows, rows.select("key", "size"), weights, cap, seed).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return kept_columns(out.select("row.*"), documents)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, k % 3 + 1 AS w FROM s),
a AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(source_size * 3) OVER f, 0) AS c, coalesce(sum(w) OVER f, 0) AS v
  FROM w WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT arg_min(CAST(total - c AS DOUBLE) / CAST(all_w - v AS DOUBLE), c) AS level FROM a
  WHERE CAST(total - c AS DOUBLE) / CAST(all_w - v AS DOUBLE) * w < source_size * 3),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR level * w >= source_size * 3 THEN CAST(source_size * 3 AS DOUBLE) ELSE level * w END AS target FROM a, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
