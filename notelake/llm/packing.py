"""Best-fit packing with vector capacities.

Documents become token ids plus one end id; longer ones are cut into pieces of the sequence length. Pieces are dealt to
blocks of about BLOCK pieces by hash, and each block packs its own: longest first, into the open bin that has room under
every capacity (tokens, documents, attention cost as the sum of squared lengths) and scores best, either by the least
weighted norm of what is left (``norm``) or the greatest weighted dot product of piece and residual (``dot``).
A block is of bounded size at any scale, and costs a fraction of a sequence at its end.

By default the document and cost capacities are those that the token capacity implies, so they never bind and the number
of sequences is as small as tokens allow. Where they bind, documents are cut into pieces that an empty sequence can hold under every
capacity (the square root of the cost capacity, if that is less than the tokens); no piece is ever placed over a capacity.

Words are tokenized once per worker and run, up to a bound: the tokenizer's splitting never joins what white space parts, so a text's ids are
its words' ids in a row.

Edge cases: null text counts as empty and gives one piece with the end id alone; repeated rows and repeated ids are
packed each; a text of any length is cut, never shortened; an empty table gives an empty result; further columns are
passed over. A text's words and ids are held together: memory grows with the longest text.
"""

from __future__ import annotations

import math
import os
import struct
import sys
import types
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.exchange import trimmed
from notelake.llm.text import SPACES, batch_of, docs, slices, values
from notelake.session import written

BLOCK = 12_000
# Punctuation that ends words; the apostrophe is left out, as the tokenizer joins it with letters.
BEHIND = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
BYTE = np.random.default_rng(4).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPARE, LONG = 8, np.uint64(1 << 63)
MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)  # of the first n bytes of eight
PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weights of tokens, documents and cost in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple = (1.0, 0.01, 0.01)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that an empty sequence holds."""
        found = min(self.tokens, math.isqrt(max(0, self.cost)))
        if found < 1 or self.documents < 1:
            raise ValueError(f"no piece fits {self}")
        return found


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each stretch of a equals that of b; both arrays have SPARE bytes behind. Eight bytes are compared at a time, for all stretches that are as long."""
    same, wide = np.ones(len(sizes), bool), [np.lib.stride_tricks.as_strided(x, (len(x) - 7, 8), (1, 1)) for x in (a, b)]
    for k in range(0, min(int(sizes.max(initial=0)), 256), 8):
        left = np.flatnonzero(sizes > k)
        x, y = (w[at[left] + k].view(np.uint64).ravel() for w, at in zip(wide, (at_a, at_b)))
        same[left] &= ((x ^ y) & MASK[np.minimum(sizes[left] - k, 8)]) == 0
    for i in np.flatnonzero(sizes > 256).tolist():
        same[i] = np.array_equal(a[at_a[i] : at_a[i] + sizes[i]], b[at_b[i] : at_b[i] + sizes[i]])
    return same


class Words:
    """The words of some texts, told apart by their bytes without making an object of each.

    A word of up to seven bytes has a key that is its bytes and length. A longer one has a hash for a key, and each occurrence is compared with the first of its key, byte for
    byte; those that differ (``odd``) stand behind the others under numbers of their own.
    """

    def __init__(self, texts: list[bytes], powers: tuple[np.ndarray, np.ndarray]):
        self.data = b"\n".join(texts) + b"\n" + bytes(SPARE)
        self.bytes = np.frombuffer(self.data, np.uint8)
        b = self.bytes[:-SPARE]
        space = IS_SPACE[b]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.r_[0, edge]
        self.starts, self.ends = edge[0::2], edge[1::2]
        size = self.ends - self.starts
        head = np.lib.stride_tricks.as_strided(self.bytes, (len(b), 8), (1, 1))[self.starts].view(np.uint64).ravel()
        key = (head & MASK[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56))
        long = np.flatnonzero(size > 7)
        if len(long):
            prefix = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(BYTE[b] * powers[0][: len(b)], out=prefix[1:])
            key[long] = (prefix[self.ends[long]] - prefix[self.starts[long]]) * powers[1][self.starts[long]] | LONG
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        self.first, self.of = order[new], np.empty(len(key), np.int64)  # any one occurrence of each, and each word's number
        self.of[order] = np.cumsum(new) - 1
        self.keys, self.odd = key[self.first], {}
        first = self.first[self.of[long]]
        again = first != long
        long, first = long[again], first[again]
        same = size[long] == size[first]
        same[same] = same_bytes(self.bytes, self.starts[long[same]], self.bytes, self.starts[first[same]], size[long[same]])
        for i in long[~same].tolist():
            self.of[i] = len(self.keys) + self.odd.setdefault(self.data[self.starts[i] : self.ends[i]], len(self.odd))
        self.before = np.searchsorted(self.starts, np.r_[0, np.cumsum([len(t) + 1 for t in texts])])  # words before each text


class WordIds:
    """The ids of words, kept for the tasks that a worker has of a run (up to a bound, then anew): sorted keys, and each word's ids in one flat array.

    The bytes of longer words are kept too and compared, so that a key which two words share never gives one the ids of the other.

    A word of letters, maybe with punctuation behind, has its letters' ids and then its punctuation's. Letters are encoded
    many words at a time; as each such word is one unit of the tokenizer, its last id is the only one that ends a word.
    Any other word is encoded by itself.
    """

    PIECE = 256 << 10  # bytes of text whose words are found at a time, so that arrays stay in the processor's caches

    def __init__(self, path: str, most: int = 2_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.encode, self.most = model.encode_batch_fast, most
        suffix = getattr(model.model, "end_of_word_suffix", None)
        self.last = np.zeros(model.get_vocab_size() + 1, bool)
        if suffix:
            self.last[[i for t, i in model.get_vocab().items() if t.endswith(suffix)]] = True
        self.powers = (np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.forget()

    def forget(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.at = np.empty(1 << 16, np.uint32), np.zeros(1, np.int64)
        self.blob, self.blob_at = np.zeros(1 << 16, np.uint8), np.zeros(1, np.int64)  # each row's bytes, none for short words

    def alone(self, words: list[bytes]) -> list[bytes]:
        found = self.encode([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words of letters in lower case."""
        out: dict[bytes, bytes] = {}
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.encode([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.last[ids]) + 1
            if len(last) == len(part) and last[-1] == len(ids):
                data, edges = ids.tobytes(), [0, *(4 * last).tolist()]
                out.update((w, data[a:b]) for w, a, b in zip(part, edges, edges[1:]))
            else:
                out.update(zip(part, self.alone(part), strict=True))
        return out

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        lower = b"\n".join(words).lower().split(b"\n")
        bases = [w.rstrip(BEHIND) for w in lower]
        plain = [b.isalpha() or bool((t := b.decode("utf-8", "replace")).isalpha() and t.islower()) for b in bases]  # isalpha of bytes: letters of ASCII alone
        known = self.letters(list({b for b, p in zip(bases, plain) if p}))
        tails = [w[len(b) :] for w, b in zip(lower, bases)]
        ends = list(set(tails))
        behind = dict(zip(ends, self.alone(ends), strict=True))
        others = iter(self.alone([w for w, p in zip(words, plain) if not p]))
        return [known[b] + behind[t] if p else next(others) for b, t, p in zip(bases, tails, plain)]

    def add(self, words: list[bytes]) -> np.ndarray:
        """Rows of these words' ids, which no key leads to yet."""
        ids = self.encoded(words)
        for data, at, flat, kind in ((ids, "at", "flat", np.uint32), ([w if len(w) > 7 else b"" for w in words], "blob_at", "blob", np.uint8)):
            ends, held = getattr(self, at), getattr(self, flat)
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // np.dtype(kind).itemsize
            start, end = int(ends[-1]), int(ends[-1] + sizes.sum())
            if end + SPARE > len(held):
                held = np.concatenate([held[:start], np.zeros(end - start + end + SPARE, kind)])
                setattr(self, flat, held)
            held[start:end] = np.frombuffer(b"".join(data), kind)
            setattr(self, at, np.concatenate([ends, start + np.cumsum(sizes)]))
        return np.arange(len(self.at) - 1 - len(words), len(self.at) - 1)

    def learn(self, found: list[Words]) -> None:
        """Make every key of these known."""
        if len(self.at) > self.most:
            self.forget()
        every = np.unique(np.concatenate([f.keys for f in found]))
        new = every[~self.knows(every)]
        if not len(new):
            return
        words: list[bytes] = [b""] * len(new)
        for f in found:
            place = np.minimum(np.searchsorted(new, f.keys), len(new) - 1)
            mine = np.flatnonzero(new[place] == f.keys)
            for i, s, e in zip(place[mine].tolist(), f.starts[f.first[mine]].tolist(), f.ends[f.first[mine]].tolist()):
                words[i] = f.data[s:e]
        rows = self.add(words)
        where = np.searchsorted(self.keys, new)
        self.keys, self.rows = np.insert(self.keys, where, new), np.insert(self.rows, where, rows)

    def rows_of(self, f: Words) -> np.ndarray:
        """The row of each distinct word of f, odd ones behind."""
        if not len(f.keys):
            return np.empty(0, np.int64)
        rows = self.rows[np.searchsorted(self.keys, f.keys)]
        long = np.flatnonzero(f.keys >= LONG)
        start, size = f.starts[f.first[long]], (f.ends - f.starts)[f.first[long]]
        same = size == self.blob_at[rows[long] + 1] - self.blob_at[rows[long]]
        same[same] = same_bytes(f.bytes, start[same], self.blob, self.blob_at[rows[long[same]]], size[same])
        other = long[~same].tolist()
        more = [f.data[f.starts[f.first[i]] : f.ends[f.first[i]]] for i in other] + list(f.odd)
        if more:
            own = self.add(more)
            rows[other] = own[: len(other)]
            rows = np.r_[rows, own[len(other) :]]
        return rows

    def knows(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed as unsigned 32-bit numbers, with 0 behind."""
        pieces: list[list[bytes]] = []
        size = 0
        for t in texts:
            if not pieces or size + len(t) > self.PIECE:
                pieces.append([])
                size = 0
            pieces[-1].append(t)
            size += len(t) + 1
        longest = max((sum(map(len, p)) + len(p) + 1 for p in pieces), default=0)
        if longest > len(self.powers[0]):
            self.powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(longest, x, np.uint64)], dtype=np.uint64) for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))
        found = [Words(p, self.powers) for p in pieces]
        self.learn([f for f in found if len(f.keys)] or found)
        out: list[bytes] = []
        for f in found:
            rows = self.rows_of(f)[f.of] if len(f.keys) else np.empty(0, np.int64)
            sizes = self.at[rows + 1] - self.at[rows]
            stop = np.cumsum(sizes)
            ids = self.flat[np.repeat(self.at[rows] - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
            cut = (4 * np.r_[0, stop][f.before]).tolist()
            out += [ids[a:b] + b"\0\0\0\0" for a, b in zip(cut, cut[1:])]
        return out


HELD = "notelake_word_ids"


def word_ids(path: str, run: str) -> WordIds:
    """This worker's words of a run: ids depend on the word alone, so the run's later tasks find what earlier ones learned. Another run starts anew, so its cost is its own.

    Functions travel by value and have new globals in each task; what a worker keeps is in a module of its own. A worker ends with a task that fails, so nothing half learned stays.
    """
    held = sys.modules.setdefault(HELD, types.ModuleType(HELD)).__dict__
    if held.get("of") != (path, run):
        held["of"], held["words"] = None, None  # the old ones go first
        held["words"] = WordIds(path)
        held["of"] = (path, run)
    return held["words"]


def pieces(documents: DataFrame, path: str, tokens: int = 2048) -> DataFrame:
    """One row per piece: doc_id, row (a number of the row in its task), piece, start, length, ids_crc32."""

    run = uuid.uuid4().hex

    def cut(batches):
        known, row = word_ids(path, run), 0
        for batch in slices(batches):
            out = []
            for doc_id, ids in zip(values(batch, "doc_id"), known.of(values(batch, "text")), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    out.append((doc_id, row, k, at // 4, len(part) // 4, zlib.crc32(part)))
                row += 1
            yield batch_of(PIECES, *map(list, zip(*out, strict=True)))
        trimmed()

    return docs(documents).mapInArrow(cut, PIECES_DDL)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; the pieces come in any order and are placed longest first. None is longer than capacity.longest."""
    if len(lengths) and lengths.max() > capacity.longest:
        raise ValueError(f"a piece of {lengths.max()} tokens fits no sequence of {capacity}")
    full = (float(capacity.tokens), float(capacity.documents), float(capacity.cost))
    weight = [w / f**2 for w, f in zip(capacity.weights, full)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = [np.empty(64) for _ in full]  # of each open bin, by capacity
    number = np.empty(64, np.int64)
    n = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = float(lengths[i])
        need = (size, 1.0, size * size)
        room = [x[:n] for x in left]
        fits = np.flatnonzero((room[0] >= need[0]) & (room[1] >= 1) & (room[2] >= need[2]))
        if len(fits):
            own = [x[fits] for x in room]
            score = sum(w * (x - a) ** 2 for w, x, a in zip(weight, own, need)) if capacity.rule == "norm" else -sum(w * a * x for w, x, a in zip(weight, own, need))
            at = int(fits[np.argmin(score)])
        else:
            if n == len(number):
                left, number = [np.concatenate([x, np.empty_like(x)]) for x in left], np.concatenate([number, np.empty_like(number)])
            at, n, made = n, n + 1, made + 1
            number[at] = made - 1
            for x, f in zip(left, full):
                x[at] = f
        bins[i], offsets[i] = number[at], full[0] - left[0][at]
        for x, a in zip(left, need):
            x[at] -= a
        if min(x[at] for x in left) < 1:  # nothing more fits: close it
            n -= 1
            number[at] = number[n]
            for x in left:
                x[at] = x[n]
    return bins, offsets


def pack(documents: DataFrame, path: str | None = None, capacity: Capacity = Capacity(), block: int = BLOCK) -> DataFrame:  # noqa: B008
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(documents, path or tokenizer_path(), capacity.longest), "pack-pieces")
    blocks = max(1, -(-cut.count() // block))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["block"] * (1 << 32) + bins, offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "row", "piece", "ids_crc32"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
