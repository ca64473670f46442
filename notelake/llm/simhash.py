"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS differing bits have a half of 32 bits that differs in at most RADIUS // 2, and these two halves
have a common variant within half of that. So each distinct fingerprint emits, for either half, all variants within a
quarter of RADIUS (1 + 32 of each, 66 in all, against 2,081 for a ball of half the radius on 64 bits), the variants are
shuffled, and pairs that meet are verified on all 64 bits. Links are exactly those of the full ball.

A variant with over HOT fingerprints isn't compared within itself: its fingerprints emit the full ball of half the
radius on 64 bits, where everything that meets is within RADIUS, so each group links to its least member without
any comparison and at linear cost. Smaller groups emit a spanning forest of their links, never all pairs.

Exact copies share a fingerprint and never enter the search twice. Components come from distributed stars.

Edge cases: null and empty texts, and texts of white space only, have fingerprint zero and are linked like any other;
fewer than four words are one shingle; null ids take part, a component of null ids alone has a null id; repeated rows
are copies; an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.graph import components
from notelake.llm.text import batch_of, docs, slices, values
from notelake.session import written

SHINGLE, SEED, RADIUS, HOT = 4, 42, 4, 2048
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("hot", pa.bool_())])


def shingles(text: bytes, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's shingles of k words in order; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(at[:-k].tolist(), (at[k:] - 1).tolist())), np.uint64, len(words) - k + 1)


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash as an unsigned 64-bit number."""
    return of_shingles(shingles(text, k, seed))


def of_shingles(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 4096):
        ones += np.unpackbits(h[part : part + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, k) for t in values(batch, "text")], np.uint64)
            yield batch_of(PRINTS, batch.column(0), pa.array(fps.view(np.int64)))

    return docs(documents).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of that many bits with at most radius bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], np.uint64)


def _meet(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links within one group."""
    us, vs, rest = [], [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                got = rest[near]
                us += [x] * len(got)
                vs += got.tolist()
                front += list(got)
                rest = rest[~near]
    return us, vs


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp), enough to connect all that are within radius, and no others."""
    spread = ball(32, radius // 4)

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                fp = batch.column(0).slice(at, 1000).to_numpy().view(np.uint64)
                halves = ((fp >> np.uint64(32))[:, None] ^ spread, ((fp & np.uint64(0xFFFFFFFF))[:, None] ^ spread) | np.uint64(1 << 32))
                key = np.concatenate(halves, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, key.shape[1]).view(np.int64))], ["key", "fp"])

    def meet(batches):
        held_k, held_f, hot_key = np.empty(0, np.int64), np.empty(0, np.int64), None

        def linked(k, f):
            """Of whole groups sorted by key."""
            f = f.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(k)])
            us, vs, hots = [], [], []
            two = starts[sizes == 2]
            near = np.bitwise_count(f[two] ^ f[two + 1]) <= radius
            us += f[two[near]].tolist()
            vs += f[two[near] + 1].tolist()
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                if n > hot:
                    hots += f[s : s + n].tolist()
                else:
                    a, b = _meet(f[s : s + n], radius)
                    us += a
                    vs += b
            pairs = np.unique(np.array([us + hots, vs + hots, [0] * len(us) + [1] * len(hots)], np.uint64).T, axis=0) if us or hots else np.empty((0, 3), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)), pa.array(pairs[:, 2] == 1)], schema=EDGES)

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if hot_key is not None:  # what follows of a group already given out as hot
                same = k == hot_key
                if same.any():
                    yield pa.RecordBatch.from_arrays([pa.array(f[same]), pa.array(f[same]), pa.array(np.ones(same.sum(), bool))], schema=EDGES)
                    k, f = k[~same], f[~same]
                if len(k):
                    hot_key = None
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            if not len(k):
                continue
            whole = np.searchsorted(k, k[-1])
            held_k, held_f = k[whole:], f[whole:]
            yield linked(k[:whole], f[:whole])
            if len(held_k) > hot:
                hot_key = held_k[0]
                yield pa.RecordBatch.from_arrays([pa.array(held_f), pa.array(held_f), pa.array(np.ones(len(held_f), bool))], schema=EDGES)
                held_k, held_f = held_k[:0], held_f[:0]
        yield linked(held_k, held_f)

    one = prints.select("fp")
    found = written(one.mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long, hot boolean"), "simhash-links")
    return found.filter("not hot").select("u", "v").union(full_ball(found.filter("hot").select(F.col("u").alias("fp")).distinct(), radius))


def full_ball(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The same edges by the ball of half the radius on all 64 bits: all that meet are within radius."""
    masks = ball(64, radius // 2)

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20):
                fp = batch.column(0).slice(at, 20).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(fp, len(masks)).view(np.int64))], ["variant", "fp"])

    spread = prints.mapInArrow(emit, "variant long, fp long")
    least = spread.groupBy("variant").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").select("variant", "least")
    return spread.join(least, "variant").filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def grouped(documents: DataFrame, k: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    prints = written(fingerprints(documents, k), "simhash-prints")
    own = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(own, radius, hot))
    rooted = own.join(roots, own.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
