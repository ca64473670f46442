"""URL filter: host and path rules first, then a Bloom filter cascade with exact answers on the corpus's keys.

The key universe is every distinct host and host+path of the corpus. Level 1 encodes the listed keys; level 2 the
universe's keys that are not listed and pass level 1; level 3 the listed keys that pass level 2; and so on until no
key passes wrongly. A key is listed if the first level that it fails is even. Probing is arithmetic on bit
arrays held in scalar subqueries: no join, no Python.

Keys are dealt by hash to shards, and each shard has a cascade of its own, so that no level passes about SHARD_BYTES however
long the list is. All sizes go the same way: pages are probed with one shard after another, and each shard looks at the keys
that belong to it. Every pass but the last is written, so memory holds one shard's levels.

Edge cases: null urls and urls without ``://`` have empty host and path and are never listed; an empty table gives an
empty result; an empty list lets everything pass; further columns are passed over; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.session import dropped, written

# Fixed values: (rule, host, path, verdict).
RULES = (("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow"))
BITS_PER_KEY, HASHES, SHARD_BYTES, MAX_LEVELS = 12, 8, 16 << 20, 40
WRONG = 0.004  # share of other keys that pass a level wrongly, rounded up
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The struct (rule, verdict) of the longest fitting rule, null where none fits."""
    out = None
    for rule, h, p, verdict in sorted(rules, key=lambda r: -len(r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    a, b = (F.pmod(F.xxhash64(key, F.lit(x)), F.lit(bits)) for x in (level, ~level))
    return [(a + b * F.lit(i)) % F.lit(bits) for i in range(HASHES)]


def _passes(key: Column, level: int, bits: int, words: Column) -> Column:
    out = F.lit(True)
    for p in _positions(key, level, bits):
        word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _level(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the level's bits as an array of longs, gathered by bit_or per word of 64 bits (bits / 64 words in all)."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    at = at.select(F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    words = at.union(spark.range(bits // 64).select("id", F.lit(0).cast("long"))).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return words.agg(F.sort_array(F.collect_list(F.struct("word", "bit"))).getField("bit").alias("words"))


def _bits(n: int) -> int:
    return max(64, 64 * math.ceil(n * BITS_PER_KEY / 64))


def cascade(inside: DataFrame, outside: DataFrame) -> list[tuple[int, DataFrame]]:
    """The levels (bits, one-row DataFrame) that tell distinct keys inside from distinct keys outside, exactly."""
    levels: list[tuple[int, DataFrame]] = []
    encode, against, n, made = inside, outside, inside.count(), []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end; raise BITS_PER_KEY")
        bits = _bits(n)
        row = written(_level(encode, len(levels), bits), "url-level")
        levels.append((bits, row))
        wrong = written(against.filter(_passes(F.col("key"), len(levels) - 1, bits, row.scalar())), "url-wrong")
        made.append(wrong)
        encode, against, n = wrong, encode, wrong.count()
    dropped(*made)
    return levels


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def shards_for(n_listed: int, n_others: int, shard_bytes: int = SHARD_BYTES) -> int:
    """So many that no level is expected to pass shard_bytes."""
    return max(1, math.ceil(max(n_listed, WRONG * n_others) * BITS_PER_KEY / 8 / shard_bytes))


def is_listed(key: Column, levels: list[tuple[int, DataFrame]]) -> Column:
    """True if the first level that the key fails is even-numbered (or, passing all, their number is odd)."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        bits, row = levels[i]
        out = F.when(_passes(key, i, bits, row.scalar()), out).otherwise(F.lit(i % 2 == 1))
    return out


def corpus_keys(urls: DataFrame) -> DataFrame:
    """Distinct keys of (host, path) rows: each host, and each host with its path."""
    return urls.filter("host <> ''").select(F.explode(F.array("host", F.concat("host", "path"))).alias("key")).distinct()


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict. listed: keys (host, or host+path) to block; by default ``stand_in_list``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), path_of().alias("path"))
    universe = written(corpus_keys(rows), "url-keys")
    listed = (stand_in_list(universe) if listed is None else listed).select("key").distinct()
    # a key that the corpus lacks is never asked for
    flags = universe.withColumn("of", F.lit(0)).unionByName(listed.withColumn("of", F.lit(1))).groupBy("key").agg(F.min("of").alias("a"), F.max("of").alias("b"))
    flags = written(flags.filter("a = 0").select("key", (F.col("b") == 1).alias("inside")), "url-flags")
    counts = {r["inside"]: r["n"] for r in flags.groupBy("inside").agg(F.count("*").alias("n")).collect()}
    shards = shards_for(counts.get(True, 0), counts.get(False, 0), shard_bytes)
    rows = rows.withColumn("hit", F.lit(False))
    page = F.concat("host", "path")
    for shard in range(shards if counts.get(True) else 0):
        own = flags.filter(shard_of(F.col("key"), shards) == shard)
        levels = cascade(own.filter("inside").select("key"), own.filter("not inside").select("key"))
        probe = lambda key: (shard_of(key, shards) == shard) & is_listed(key, levels)  # noqa: B023, E731
        rows = rows.withColumn("hit", F.col("hit") | ((F.col("host") != "") & (probe(F.col("host")) | probe(page))))
        if shard < shards - 1:
            before, rows = rows, written(rows, "url-probed")
            if shard:
                dropped(before)
    dropped(universe)
    rows = rows.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def stand_in_list(universe: DataFrame) -> DataFrame:
    """The block list of the registered query, as the tables hold none: keys of spam hosts, and one key in sixteen by md5."""
    return universe.filter(F.col("key").startswith("spam") | (F.substring(F.md5("key"), 1, 1) == "0"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host <> '' AND (starts_with(host, 'spam') OR substr(md5(host), 1, 1) = '0' OR substr(md5(host || path), 1, 1) = '0') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
