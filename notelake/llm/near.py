"""Near copies for the pipeline: pairs that share four fifths of their five-word shingles, one document kept of each component.

Candidates meet in two ways and are then verified by the exact Jaccard of their sets of shingles, so no link is wrong:

* SimHash of five-word shingles, by the ball hashing of ``simhash`` (RADIUS bits), which meets the closest copies only: at a
  Jaccard of 0.8 two fingerprints differ in about ten bits, and balls of that radius don't fit any disk;
* BANDS bands of ROWS minimum hashes, of which a pair of Jaccard J shares one with probability 1 - (1 - J^ROWS)^BANDS
  (0.9996 at 0.8), for the rest.

A bucket of up to SMALL texts is compared in all pairs. A larger one is a region of the exact Jaccard join (``jaccard_join``), which finds every link in it with bounded memory: in one task up to
REGION texts, around pivots and in pairs of blocks beyond. Of buckets with the same texts (by two 64-bit sums) one is joined. So no pair that shares a bucket is lost, whatever the bucket's size. Texts are told apart by 128 bits (MD5; of 1e12 texts two
share them with odds of 1e-15), so exact copies enter the search once; each distinct text has a number, by which links are kept.

Of each component the row of the least doc_id stays, null ids last; of equal ids the one whose text has the least hash, of
equal texts the least by its columns. Null ids, empty texts and texts of white space only (copies of one another) take part like any other.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm import jaccard_join, simhash
from notelake.llm.graph import components
from notelake.llm.text import batch_of, bytes_col, kept_columns, slices, values
from notelake.session import written

WORDS, LEAST, BANDS, ROWS, SMALL, REGION = 5, 0.8, 20, 5, 32, 2048
RANDOM = np.random.default_rng(7).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64, endpoint=False)
XOR, TIMES, MIX = RANDOM[0], RANDOM[1] | np.uint64(1), RANDOM[2] | np.uint64(1)
SIGNED = pa.schema([("hash", pa.binary()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("buckets", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def text_hash() -> Column:
    return F.unhex(F.md5(bytes_col()))


def buckets(h: np.ndarray) -> np.ndarray:
    """One bucket for each band of minimum hashes."""
    least = np.full(len(XOR), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 2048):
        least = np.minimum(least, ((h[at : at + 2048, None] ^ XOR) * TIMES).min(axis=0))
    return ((least ^ (least >> np.uint64(31))) * MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def signed(documents: DataFrame) -> DataFrame:
    """Per distinct text: hash, key (a number), its first row's (id is null, id), the SimHash, and buckets, as a written table."""

    def run(batches):
        for batch in slices(batches):
            fps, found = [], []
            for t in values(batch, "text"):
                h = simhash.shingles(t, WORDS)
                fps.append(simhash.of_shingles(h))
                found.append(np.r_[buckets(h), np.uint64(fps[-1])].view(np.int64))
            yield batch_of(SIGNED, batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(found, SIGNED.field("buckets").type))

    rows = documents.select(text_hash().alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), bytes_col())
    signs = rows.mapInArrow(run, "hash binary, doc_id long, fp long, buckets array<long>")
    one = signs.groupBy("hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"), F.min("fp").alias("fp"), F.min("buckets").alias("buckets"))
    return written(one.withColumn("key", F.monotonically_increasing_id()), "near-signs")


def candidates(signs: DataFrame, documents: DataFrame, least: float = LEAST, small: int = SMALL, region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs (u, v) of keys, u <> v, of small buckets and linked fingerprints, yet to be verified; the links of large buckets, which are exact)."""

    def pairs(batches):
        for batch in batches:
            for keys in batch.column(0).to_pylist():
                keys.sort()
                both = np.array(list(itertools.combinations(keys, 2)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], schema=PAIRS)

    spread = signs.select("key", F.posexplode("buckets").alias("band", "bucket"))
    several = written(spread.groupBy("band", "bucket").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"sum_{i}") for i in (1, 2)]).filter("n > 1"), "near-buckets")
    members = spread.join(several.filter(F.col("n") <= small), ["band", "bucket"])
    every = members.groupBy("band", "bucket").agg(F.collect_list("key").alias("keys")).select("keys").mapInArrow(pairs, "u long, v long")
    # the large ones: one of those that hold the same texts
    one = several.filter(F.col("n") > small).groupBy("n", "sum_1", "sum_2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket")
    large = written(spread.join(one, ["band", "bucket"]).select(F.xxhash64("band", "bucket").alias("region"), F.col("key").alias("node")), "near-large")
    sets = gram_sets(documents, signs.select("hash", F.col("key").alias("node")).join(large.select("node").distinct(), "node", "left_semi"))
    placed = written(large.join(sets.filter("n > 0").select("node", "n"), "node").select("region", "node", "n"), "near-placed")
    held = jaccard_join.links(placed, sets, round(100 * least), limit=region)
    none = sets.filter("n = 0").select("node")  # texts of white space only: all are copies of the first
    held = held.union(none.select(F.col("node").alias("u"), F.lit(none.agg(F.min("node")).first()[0]).cast("long").alias("v")).filter("u <> v"))
    own = written(signs.groupBy("fp").agg(F.min("key").alias("key")), "near-fps")
    linked = simhash.links(own.select("fp"))
    ends = linked.join(own.select(F.col("fp").alias("u"), F.col("key").alias("a")), "u").join(own.select(F.col("fp").alias("v"), F.col("key").alias("b")), "v")
    ball = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return every.union(ball).distinct(), held


def gram_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, grams), a written table: the sets of shingles of the texts of wanted (hash, node)."""

    def run(batches):
        for batch in slices(batches):
            found = [np.unique(simhash.shingles(t, WORDS)).view(np.int64) for t in values(batch, "text")]
            ends = np.cumsum([0, *map(len, found)])
            yield batch_of(SETS, batch.column(0), np.diff(ends), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found))))

    texts = documents.select(text_hash().alias("hash"), bytes_col()).join(wanted, "hash").groupBy("node").agg(F.first("text").alias("text"))
    return written(texts.mapInArrow(run, "node long, n long, grams array<long>"), "near-sets")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def verified(pairs: DataFrame, documents: DataFrame, signs: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose sets of shingles have that Jaccard similarity or more."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, held, keep = batch.slice(at, 200), {}, []

                def of(k, t):
                    if k not in held:
                        held[k] = np.unique(simhash.shingles(t, WORDS))
                    return held[k]

                us, vs, a, b = (part.column(i).to_pylist() for i in range(4))
                for u, v, x, y in zip(us, vs, a, b, strict=True):
                    keep.append(jaccard(of(u, x), of(v, y)) >= least)
                yield part.select(["u", "v"]).filter(pa.array(keep))

    used = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    used = signs.select("hash", "key").join(used, "key", "left_semi")
    texts = documents.select(text_hash().alias("hash"), bytes_col()).groupBy("hash").agg(F.first("text").alias("text"))
    texts = written(texts.join(used, "hash").select("key", "text"), "near-texts")
    of = lambda end, name: texts.select(F.col("key").alias(end), F.col("text").alias(name))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def one_of_each(documents: DataFrame, least: float = LEAST, small: int = SMALL, region: int = REGION) -> DataFrame:
    """One row of each component of near copies, columns unchanged."""
    signs = signed(documents)
    rest, held = candidates(signs, documents, least, small, region)
    roots = components(held.union(verified(written(rest, "near-pairs"), documents, signs, least)))
    rooted = signs.select("hash", "key", "first").join(roots, F.col("key") == F.col("node"), "left").select("hash", "first", F.coalesce("root", "key").alias("root"))
    keep = rooted.groupBy("root").agg(F.min(F.struct("first", "hash")).alias("best")).select(F.col("best.hash").alias("_hash"))
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    by_text = documents.groupBy(text_hash().alias("_hash")).agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), whole.alias("row"))).alias("_best"))
    return kept_columns(by_text.join(keep, "_hash", "left_semi").select("_best.row.*"), documents)
