"""Block exchange: exact global answers on billions of hashed keys at a few bytes each.

Documents are gathered into blocks of bounded bytes. A block's sorted distinct keys are dealt to parts by hash and packed
(differences, byte planes, zstd) into one row for each part, so a shuffle moves few and small rows. Each part merges the rows of all
blocks, and its answers return to the blocks, in the order of the keys asked. A key that half of all documents hold
costs one entry for each block, not for each document, and no part or block grows with such a key.

Order: rows stand by (doc_id, tie, text), null ids first. The tie is 0, but for ids that several different texts share it is the hash of
the text, so "first" means the same however rows lie in blocks and partitions; rows equal in id and text are interchangeable.
Null ids have a negative tie, which tells them from the least long.

A key is its part's number and, inside the part, 48 bits (fewer beyond 65,536 parts): 48 + log2(parts) bits in all, 64 at 65,536 parts. What must be equal for certain
carries 64 more bits (``check``) or its content.

Table columns: block, part, data. Negative parts are what the block keeps for itself: -1 its state, -2 its texts.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import docs, slices, values
from notelake.session import dropped, shared_dir, tidied, written

SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
DDL = "block long, part int, data binary"
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 20_000
NO_ID = -(1 << 63)
MOST_BROADCAST = 100_000


def pack(a: np.ndarray, level: int = 1) -> bytes:
    """Any one-dimensional array, by byte planes."""
    import zstandard

    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=level).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, the most frequent first; each value's place among them): small numbers for what is common, which packs best."""
    table, at, n = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return table[order], rank[at] if len(at) else np.empty(0, np.int32)


def squeezed(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def expanded(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def frame(*parts: bytes) -> bytes:
    return b"".join([struct.pack("<I", len(parts)), *(struct.pack("<Q", len(p)) for p in parts), *parts])


def unframe(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    out, at = [], 4 + 8 * n
    for (size,) in struct.iter_unpack("<Q", data[4:at]):
        out.append(data[at : at + size])
        at += size
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit sums (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def key_bits(parts: int) -> int:
    """Bits of a key inside its part."""
    return min(48, 64 - (parts - 1).bit_length())


def part_keys(h: np.ndarray, parts: int) -> np.ndarray:
    """The part above, bits of the hash below, from 64-bit hashes; sorting by it sorts by part. parts < 2 ** 24."""
    bits = key_bits(parts)
    return ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)) << np.uint64(bits) | h & np.uint64((1 << bits) - 1)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part starts in sorted part keys."""
    return np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(key_bits(parts)))


def deltas(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def undelta(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys of one part; the part's own bits come with the first."""
    return deltas(keys)


def unpack_keys(data: bytes) -> np.ndarray:
    return undelta(data, np.uint64)


def dealt(keys: np.ndarray, parts: int, columns: tuple, shift: int = 0) -> list[tuple[int, bytes]]:
    """(part, frame of keys and columns) rows of sorted keys; columns: (packer, array)."""
    at = cuts(keys, parts)
    return [(p + shift, frame(pack_keys(keys[s:e]), *(f(c[s:e]) for f, c in columns))) for p, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]


def per_part(got: list[tuple[int, bytes]], keys: np.ndarray, parts: int, shift: int = 0) -> list[bytes]:
    """The answers, in the order of the sorted keys asked."""
    at, by = cuts(keys, parts), dict(got)
    return [by[p + shift] for p, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]


def texts_frame(ids: np.ndarray, texts: list[bytes]) -> bytes:
    import zstandard

    return frame(pack(ids), pack(np.fromiter(map(len, texts), np.int64, len(texts))), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))


def framed_texts(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    import zstandard

    ids, sizes, blob = unframe(data)
    joined, at = zstandard.ZstdDecompressor().decompress(blob), 0
    texts = []
    for n in unpack(sizes, np.int64).tolist():
        texts.append(joined[at : at + n])
        at += n
    return unpack(ids, np.int64), texts


def rows_of(block: int, found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about 8 MB."""
    start = held = 0
    for i, (_, data) in enumerate([*found, (0, b"")]):
        if i == len(found) or (held and held + len(data) > 8 << 20):
            if part := found[start:i]:
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array([p for p, _ in part], pa.int32()), pa.array([d for _, d in part], pa.binary())], schema=SCHEMA)
            start, held = i, 0
        held += len(data)


def placed(documents: DataFrame, ordered: bool, more: list) -> DataFrame:
    """doc_id, text, tie and more columns. ordered: ties of ids are found, by a shuffle of ids and hashes alone."""
    h = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    rows = docs(documents, *more)
    none = F.when(F.col("doc_id").isNull(), F.lit(-1) - h)
    if ordered:
        tied = docs(documents).filter("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b").select("doc_id", F.lit(True).alias("is_tied"))
        tied = written(tied, "tied-ids")
        if n := tied.count():
            names = [c for c in rows.columns if c != "doc_id"]
            rows = rows.join(F.broadcast(tied) if n <= MOST_BROADCAST else tied, "doc_id", "left").select("doc_id", *names, none.when(F.col("is_tied"), h).otherwise(F.lit(0)).alias("tie"))
            return rows
        dropped(tied)
    return rows.withColumn("tie", none.otherwise(F.lit(0)).cast("long"))


def is_null(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    return (ids == NO_ID) & (ties < 0)


def asked(documents: DataFrame, ask: Callable[..., list[tuple[int, bytes]]], ordered: bool = True, riders: list | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ask(ids, ties, texts) of each block gives its (part, data) rows. Rows come by (id, tie, text), null ids as NO_ID.

    riders: further columns that go with each text, as a fourth argument (an Arrow table in the same order).
    """
    rows = placed(documents, ordered, riders or [])

    def run(batches):
        from pyspark import TaskContext

        at, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        others: list[pa.RecordBatch] = []

        def given():
            order = sorted(range(len(held)), key=lambda i: held[i][:3])
            ids, ties, texts, _ = zip(*(held[i] for i in order), strict=True)
            more = [pa.Table.from_batches(others).take([held[i][3] for i in order])] if riders else []
            return rows_of(at + k, ask(np.array(ids, np.int64), np.array(ties, np.int64), list(texts), *more))

        for batch in slices(batches):
            ids = [NO_ID if i is None else i for i in values(batch, "doc_id")]
            held += zip(ids, values(batch, "tie"), values(batch, "text"), range(len(held), len(held) + len(ids)), strict=True)
            if riders:
                others.append(batch.select([n for n in batch.schema.names if n not in ("doc_id", "text", "tie")]))
            if sum(len(x[2]) for x in held) >= block_bytes or len(held) >= BLOCK_ROWS:
                yield from given()
                held, others, k = [], [], k + 1
                trimmed()
        if held:
            yield from given()

    return rows.mapInArrow(run, DDL)


def answered(table: DataFrame, parts: int, answer: Callable[[int, list[tuple[int, bytes]]], list[tuple[int, bytes]]]) -> DataFrame:
    """answer(part, [(block, data)]) gives (block, data) rows of that part. table: what is asked."""

    def run(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for block, part, data in zip(*(values(batch, c) for c in ("block", "part", "data")), strict=True):
                by.setdefault(part, []).append((block, data))
        trimmed()
        for part in list(by):
            out = answer(part, sorted(by.pop(part), key=lambda x: x[0]))
            for at in range(0, len(out), 64):
                chunk = out[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in chunk], pa.int64()), pa.array([part] * len(chunk), pa.int32()), pa.array([d for _, d in chunk], pa.binary())], schema=SCHEMA)

    return table.repartitionById(parts, F.col("part")).mapInArrow(run, DDL)


def by_block(table: DataFrame, answers: DataFrame, f: Callable[[bytes, list[tuple[int, bytes]]], pa.Table | list[tuple[int, bytes]]], ddl: str = DDL) -> DataFrame:
    """table: what blocks keep. f(kept data, [(part, answer)] by part) of each block gives a table of ddl, or (part, data) rows for the next round."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        got = sorted(zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True), key=lambda x: x[0])
        out = f(got[0][1], got[1:])
        trimmed()
        return pa.Table.from_batches(rows_of(block, out), SCHEMA) if isinstance(out, list) else out

    return table.union(answers.filter("block >= 0")).groupBy("block").applyInArrow(run, ddl)


def trimmed() -> None:
    """Give memory that blocks have freed back to the system; executors run several of these workers."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def saved(table: DataFrame, tag: str, *kinds: str) -> list[DataFrame]:
    """What is asked, what blocks keep (and their texts, if named), written once into folders, so that each can go when nothing needs it."""
    spark, path = table.sparkSession, f"{shared_dir(table.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    kind = F.when(F.col("part") >= 0, "asked").when(F.col("part") == -1, "kept").otherwise("texts")
    table.withColumn("kind", kind).write.partitionBy("kind").parquet(path)
    jvm, out = spark._jvm, []
    for name in ("asked", "kept", *kinds):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/kind={name}")
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
        out.append(spark.read.schema(DDL).parquet(f"{path}/kind={name}"))
    tidied(out[0])
    return out


def merged(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several key lists: (distinct keys, each entry's distinct index, each distinct key's first entry, ends of the lists)."""
    every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
    of = np.empty(len(every), np.int64)
    of[order] = np.cumsum(new) - 1
    return s[new], of, order[new], np.cumsum([len(k) for k in keys])
