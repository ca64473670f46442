"""Suffix-array dedup of byte strings by longest-previous-factor arrays.

A position's longest previous factor is the longest string starting there that also starts earlier. It comes from the suffix
array: of the suffixes before and behind it in suffix order, the nearest with a smaller text position, each with the least common
prefix on the way. Suffixes are ordered by their first LENGTH bytes, so factors are clipped at LENGTH, and a
string is a later copy just where the factor reaches it. (That any other copy exists, earlier or later, is the
greatest of both neighbours' common prefixes reaching LENGTH.)

Suffixes must meet to be ordered. Each is dealt by its anchor: the rightmost least hash among the K-byte strings inside its
first LENGTH bytes, which equal suffixes share. Consecutive suffixes with one anchor travel as one text:
1. by the block exchange, every text asks how often its anchor occurs. An anchor that occurs once ends the matter, and texts
   that are equal as a whole, by 128 bits of hash, are copies of the first of them, so a copied document sends no text at all;
2. one text of each content is sent and the suffixes of an anchor are ordered by their bytes. An anchor under which more
   than HOT contents stand (the edges of a passage that many documents share) can be of any size, and so no part may hold it: its
   suffixes are dealt on by 128 bits of hash over their LENGTH bytes, equal suffixes meeting as before;
3. the answers return to the blocks, which cut the covered bytes.
Of 1e15 strings, any two different ones agree in 128 bits with odds of 1.5e-9.

keep="none" removes every byte covered by a string that also starts anywhere else; keep="first" only where it starts earlier,
by (doc_id, place), so the first copy stays. Strings are judged on the input.

Edge cases: null text is empty; texts under LENGTH bytes stay whole; null ids come first; of different texts with one id, that
of the lower hash comes first, however rows are partitioned; periodic texts match themselves; repeated rows are copies; spans
may cut a UTF-8 character, as bytes are what is compared (``deduplicated`` widens the kept text to whole characters by
dropping broken ones); an empty table gives an empty result; ``dedup`` passes further columns over and ``deduplicated`` keeps
them, whatever their names and types. A text is never split: memory grows with the longest one, by about ten times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm import exchange as X
from notelake.session import dropped, parts_for, tidied, written

LENGTH, K, HOT, CHUNK = 200, 64, 256, 60_000
TOTAL, HOLDS, MIXED, IS_HOT = 1, 2, 4, 8
BYTE = np.random.default_rng(8).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.random.default_rng(64).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
OUTPUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
OUTPUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors, in suffix order. place: distinct text positions; common: prefix shared with the suffix before, 0 for the first.

    One pass with a stack of suffixes that wait for the next smaller position; what leaves it has met the smaller positions on both sides.
    """
    out = np.zeros(len(place), np.int64)
    waiting: list[tuple[int, int, int]] = []  # rank, position, common prefix with the smaller position before
    for r, (p, c) in enumerate(zip([*place.tolist(), -1], [*common.tolist(), 0])):
        while waiting and p < waiting[-1][1]:
            top, _, before = waiting.pop()
            out[top] = max(before, c)
            c = min(before, c)
        waiting.append((r, p, c))
    return out


def factors(suffixes: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes cut at length bytes: (longest previous factor, longest factor shared with any other), both clipped at length."""
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
    table = np.frombuffer(b"".join([suffixes[i] for i in order.tolist()]), np.uint8).reshape(len(order), length)
    differs = table[1:] != table[:-1]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    before, both = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    before[order] = previous_factors(place[order], common)
    both[order] = np.maximum(common, np.r_[common[1:], 0])
    return before, both


def anchored(data: bytes, lens: np.ndarray, length: int = LENGTH, k: int = K):
    """Runs of suffix starts with one anchor: (anchor hash, first start, number of starts, document)."""
    h = BYTE[np.frombuffer(data, np.uint8)]
    size, level = 1, 1
    while 2 * size <= k:  # hashes of strings of twice the length, up to k
        h = X.mixed(h[:-size] * STEP[level] + h[size:]) if len(h) > size else h[:0]
        size, level = 2 * size, level + 1
    span = length - k + 1  # k-byte strings inside a suffix's first bytes
    n = len(data) - length + 1
    none = np.empty(0, np.int64)
    if n < 1 or lens.max() < length:
        return none.astype(np.uint64), none, none, none
    valid = (np.arange(len(data)) + length <= np.repeat(np.cumsum(lens), lens))[:n]
    low, width = h, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    doc = np.repeat(np.arange(len(lens)), lens)[:n]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (h[span : span + n - 1] == low[1:]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new & valid)
    run = np.cumsum(new) - 1
    count = np.bincount(run[valid], minlength=run[-1] + 1)[run[at]]
    return low[at], at, count, doc[at]


def wide_hashes(data: bytes, starts: np.ndarray, sizes) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each string, as two columns."""
    from xxhash import xxh3_128_digest

    found = np.frombuffer(b"".join([xxh3_128_digest(data[s : s + n]) for s, n in zip(starts.tolist(), sizes)]), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by columns, the first weighing most; whether each row in that order starts a group of equal ones)."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, new


class Block:
    """One block's runs, their distinct contents in the order asked, and each content's first run.

    Found once, then kept in packed form: starts, counts and content of each run, and the contents' keys.
    """

    PIECE = 512 << 10  # bytes hashed at a time, so that arrays stay in the processor's caches

    def __init__(self, ids, ties, texts, kept: bytes | None = None):
        self.data = b"".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lens)
        if kept is None:
            return
        at, count, of, keys = X.unframe(kept)
        self.at, self.count, self.of, self.keys = np.cumsum(X.unpack(at, np.int64)), X.unpack(count, np.int32).astype(np.int64), X.unpack(of, np.int32), np.cumsum(X.unpack(keys, np.uint64), dtype=np.uint64)
        self.found(ids, ties)

    def found(self, ids, ties):
        self.first = np.empty(len(self.keys), np.int64)
        self.first[self.of[::-1]] = np.arange(len(self.of))[::-1]
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.ids, self.ties = ids[self.doc[self.first]], ties[self.doc[self.first]]

    @classmethod
    def of_texts(cls, ids, ties, texts, parts, length) -> Block:
        b = cls(ids, ties, texts)
        lens = np.diff(b.ends, prepend=0)
        found, start = [], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + lens[end] <= cls.PIECE):
                size += int(lens[end])
                end += 1
            base = int(b.ends[start] - lens[start])
            low, at, count, _ = anchored(b.data[base : base + size], lens[start:end], length)
            found.append((low, at + base, count))
            start = end
        low, b.at, b.count = (np.concatenate(x) for x in zip(*found, strict=True))
        keys = X.part_keys(X.mixed(low), parts)
        content = wide_hashes(b.data, b.at, (b.count + length - 1).tolist())
        order, new = grouped(keys, *content)
        b.of = np.empty(len(keys), np.int64)
        b.of[order] = np.cumsum(new) - 1
        one = order[new]
        b.keys, b.content, b.times = keys[one], [c[one] for c in content], np.bincount(b.of, minlength=len(one))
        b.found(ids, ties)
        return b

    def packed(self) -> bytes:
        return X.frame(X.deltas(self.at), X.pack(self.count.astype(np.int32)), X.pack(self.of.astype(np.int32)), X.deltas(self.keys))


def twice(times: np.ndarray) -> bytes:
    return X.pack(np.minimum(times, 2).astype(np.uint8))


def repeats(documents: DataFrame, finish, ddl: str, keep: str = "none", length: int = LENGTH, hot: int = HOT, parts: int | None = None, riders: list | None = None) -> DataFrame:
    """finish(ids, none, texts, covered, riders) of each block gives a table of ddl; covered marks the bytes to remove, none the null ids.

    riders: further columns that go with each text.
    """
    parts = parts or parts_for(documents, 32)

    def ask(ids, ties, texts, more=None):
        b = Block.of_texts(ids, ties, texts, parts, length)
        columns = (*((X.pack, c) for c in b.content), (twice, b.times), (X.deltas, b.ids), (X.pack, b.ties))
        return [(-2, X.frame(X.texts_frame(ids, texts), X.pack(ties), b"" if more is None else table_bytes(more))), (-1, b.packed()), *X.dealt(b.keys, parts, columns)]

    def read(frames, types):
        """The columns of all frames behind one another."""
        return [np.concatenate([X.unpack(f[k], t) if t is not None else X.undelta(f[k], np.int64) for f in frames]) for k, t in types.items()]

    def anchors(part, got):
        """Of each content: TOTAL if it occurs twice or more, HOLDS if first here, MIXED if others share its anchor, IS_HOT if many."""
        frames = [X.unframe(d) for _, d in got]
        keys = [X.unpack_keys(f[0]) for f in frames]
        anchor, ends = np.concatenate(keys), np.cumsum(list(map(len, keys)))
        c, c2, times, ids, ties = read(frames, {1: np.uint64, 2: np.uint64, 3: np.uint8, 4: None, 5: np.int64})
        order, new = grouped(anchor, c, c2)
        inside = np.lexsort((np.arange(len(ids)), ties, ids, c2, c, anchor))
        _, starts = grouped(anchor)
        group = np.cumsum(starts) - 1
        contents = np.bincount(group[new], minlength=int(starts.sum()))[group]
        of = np.cumsum(new) - 1
        code = np.zeros(len(ids), np.uint8)
        code[order] = (np.bincount(of, times[order])[of] > 1) * TOTAL + (contents > 1) * MIXED + (contents > hot) * IS_HOT
        code[inside[new]] += HOLDS
        return [(block, X.pack(x)) for (block, _), x in zip(got, np.split(code, ends[:-1]))]

    def opened(own, runs):
        framed, ties, more = X.unframe(own)
        (ids, texts), ties = X.framed_texts(framed), X.unpack(ties, np.int64)
        return ids, ties, texts, more, Block(ids, ties, texts, runs)

    def send(own, got):
        """own: the texts; got: the runs, then the codes."""
        ids, ties, texts, _, b = opened(own, got[0][1])
        code = np.concatenate([np.empty(0, np.uint8), *(X.unpack(d, np.uint8) for _, d in got[1:])])
        rows = [(-1, X.frame(got[0][1], X.pack(code)))]
        wide = (code & HOLDS > 0) & (code & MIXED > 0)
        texts_of = np.flatnonzero(wide & (code & IS_HOT == 0))
        at = X.cuts(b.keys[texts_of], parts)
        for p, (s, e) in enumerate(zip(at[:-1], at[1:])):
            if e > s:
                some = texts_of[s:e]
                run = b.first[some]
                pieces = [b.data[x : x + n] for x, n in zip(b.at[run].tolist(), (b.count[run] + length - 1).tolist())]
                rows.append((p, X.frame(X.pack_keys(b.keys[some]), X.pack(b.at[run]), X.texts_frame(b.ids[some], pieces), X.pack(b.ties[some]))))
        hots = np.sort(b.first[wide & (code & IS_HOT > 0)])
        keys, check, first, _, times = _windows(b, hots)
        doc = b.doc[hots][_run_of(b.count[hots])[first]] if len(keys) else np.empty(0, np.int64)
        return rows + X.dealt(keys, parts, ((X.pack, check), (twice, times), (X.deltas, ids[doc]), (X.pack, ties[doc])), parts)

    def _run_of(count):
        return np.repeat(np.arange(len(count)), count)

    def _starts(at, count):
        return np.repeat(at - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(at) else np.empty(0, np.int64)

    def _windows(b, runs):
        """Distinct windows of the runs' suffixes: keys, checks, first occurrence, each suffix's window, how often."""
        at = _starts(b.at[runs], b.count[runs])
        h, check = wide_hashes(b.data, at, [length] * len(at))
        keys = X.part_keys(h, parts)
        order, new = grouped(keys, check)
        of = np.empty(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        one = order[new]  # the sort is stable, so this is the first
        return keys[one], check[one], one, of, np.bincount(of, minlength=len(one))

    def suffixes(part, got):
        if part >= parts:
            frames = [X.unframe(d) for _, d in got]
            own = [X.unpack_keys(f[0]) for f in frames]
            keys, ends = np.concatenate(own), np.cumsum(list(map(len, own)))
            check, times, ids, ties = read(frames, {1: np.uint64, 2: np.uint8, 3: None, 4: np.int64})
            order, new = grouped(keys, check)
            inside = np.lexsort((np.arange(len(ids)), ties, ids, check, keys))
            of = np.cumsum(new) - 1
            code = np.zeros(len(ids), np.uint8)
            code[order] = (np.bincount(of, times[order])[of] > 1) * TOTAL
            code[inside[new]] += HOLDS
            return [(block, X.pack(x)) for (block, _), x in zip(got, np.split(code, ends[:-1]))]
        keys, texts, places, counts = [], [], [], []
        for block, (_, data) in enumerate(got):
            k, at, framed, ties = X.unframe(data)
            ids, pieces = X.framed_texts(framed)
            keys.append(X.unpack_keys(k))
            texts += pieces
            places += zip(ids.tolist(), X.unpack(ties, np.int64).tolist(), [block] * len(ids), X.unpack(at, np.int64).tolist())
            counts.append(len(ids))
        _, anchor, _, ends = X.merged(keys)
        rank = np.empty(len(texts), np.int64)
        rank[sorted(range(len(texts)), key=places.__getitem__)] = np.arange(len(texts))
        many = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
        answers: list = [b""] * len(texts)
        order = np.argsort(anchor, kind="stable")
        edges = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1], True])
        chunk: list[int] = []
        for g in range(len(edges) - 1):
            chunk += order[edges[g] : edges[g + 1]].tolist()
            if many[chunk].sum() >= CHUNK or g == len(edges) - 2:
                cut = [texts[i][j : j + length] for i in chunk for j in range(many[i])]
                place = np.concatenate([(rank[i] << 40) + np.arange(many[i]) for i in chunk])
                before, both = factors(cut, place, length)
                code = (before >= length) * HOLDS + (both >= length) * TOTAL
                for i, x in zip(chunk, np.split(code, np.cumsum(many[chunk])[:-1])):
                    answers[i] = x.astype(np.uint8)
                chunk = []
        return [(block, X.pack(np.concatenate(answers[e - n : e]))) for (block, _), n, e in zip(got, counts, ends)]

    def cut(own, got):
        """own: the texts; got: the runs with their codes, then the answers."""
        runs, code = X.unframe(got[0][1])
        ids, ties, texts, more, b = opened(own, runs)
        code, got = X.unpack(code, np.uint8), got[1:]
        own = code[b.of]
        is_first = np.zeros(len(b.at), bool)
        is_first[b.first] = True
        is_first &= own & HOLDS > 0
        whole = ~is_first if keep == "first" else own & TOTAL > 0
        starts = [_starts(b.at[whole], b.count[whole])]
        wide = (code & HOLDS > 0) & (code & MIXED > 0)
        sent = b.first[wide & (code & IS_HOT == 0)]
        if len(sent):
            answer = np.concatenate([X.unpack(d, np.uint8) for d in X.per_part(got, b.keys[wide & (code & IS_HOT == 0)], parts)])
            starts.append(_starts(b.at[sent], b.count[sent])[answer & (HOLDS if keep == "first" else TOTAL) > 0])
        hots = np.sort(b.first[wide & (code & IS_HOT > 0)])
        if len(hots):
            keys, _, first, of, _ = _windows(b, hots)
            answer = np.concatenate([X.unpack(d, np.uint8) for d in X.per_part(got, keys, parts, parts)])
            at = _starts(b.at[hots], b.count[hots])
            if keep == "first":
                stays = np.zeros(len(at), bool)
                stays[first[answer & HOLDS > 0]] = True
                starts.append(at[~stays])
            else:
                starts.append(at[answer[of] & TOTAL > 0])
        edge = np.zeros(len(b.data) + 1, np.int64)
        for at in starts:
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        return finish(ids, X.is_null(ids, ties), texts, np.cumsum(edge)[:-1] > 0, pa.ipc.open_stream(more).read_all() if more else None)

    asks, first, texts = X.saved(X.asked(documents, ask, keep == "first", riders), "suffix-anchors", "texts")
    codes = tidied(written(X.answered(asks, parts, anchors), "suffix-codes"))
    dropped(asks)
    asks, second = X.saved(X.by_block(texts.union(first), codes, send), "suffix-texts")
    dropped(first, codes)
    answers = tidied(written(X.answered(asks, 2 * parts, suffixes), "suffix-answers"))
    dropped(asks)
    return X.by_block(texts.union(second), answers, cut, ddl)


def table_bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def dedup(documents: DataFrame, keep: str = "none", length: int = LENGTH, hot: int = HOT, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(ids, none, texts, covered, _):
        removed, spans, hashes, at = [], [], [], 0
        for t in texts:
            own = covered[at : at + len(t)]
            at += len(t)
            removed.append(int(own.sum()))
            spans.append(int((own & ~np.r_[False, own[:-1]]).sum()) if removed[-1] else 0)
            hashes.append(hashlib.sha256(np.frombuffer(t, np.uint8)[~own].tobytes() if removed[-1] else t).hexdigest())
        return pa.Table.from_arrays([pa.array(ids, mask=none), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())], schema=OUTPUT)

    return repeats(documents, finish, OUTPUT_DDL, keep, length, hot, parts)


def deduplicated(documents: DataFrame, keep: str = "first", length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """documents with the repeated bytes cut from text, columns unchanged; n_chars, if there, is counted anew.

    A cut may split a UTF-8 character; what is left of it is dropped. A row whose text was cut to nothing or to white
    space goes; rows that were empty before stay, those of null text as they are. The other columns ride beside the text
    in Arrow form under names of their own, so values keep their types and names can't clash.
    """
    others = [c for c in documents.columns if c != "text"]
    renamed = documents.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    kinds = {f"c{i}": documents.schema[c].dataType for i, c in enumerate(others)}
    ddl = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, k) for c, k in kinds.items()]])

    def finish(ids, none, texts, covered, more):
        out, at = [], 0
        for t in texts:
            own = covered[at : at + len(t)]
            at += len(t)
            cut = own.any()
            left = (np.frombuffer(t, np.uint8)[~own].tobytes() if cut else t).decode("utf-8", "ignore" if cut else "replace")
            out.append(left if not cut or left.strip() else None)
        table = more.add_column(0, pa.field("text", pa.string()), pa.array(out, pa.string()))
        return table.filter(pa.array([x is not None for x in out], pa.bool_()))

    rows = repeats(renamed.filter("text is not null"), finish, ddl, keep, length, parts=parts, riders=list(kinds))
    rows = rows.unionByName(renamed.filter("text is null").select("text", *kinds))
    columns = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("text").cast(documents.schema["text"].dataType)}
    if "n_chars" in others:
        columns["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType)
    return rows.select(*[columns[c].alias(c) for c in documents.columns])
