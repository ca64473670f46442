"""Substring dedup of word windows by recompression.

Every round is a Spark exchange over all documents that names strings globally. Round 0 names words: a part gathers its
share of all distinct words and numbers them, comparing bytes; a block keeps its texts as a list of words and places in it. Each further round finds, in every document, the runs of one
symbol and the pairs of neighbours (first of the left half of the alphabet, second of the right; halves are drawn anew each
round by a hash of the name); parts number them, comparing the names that they are made of. So a name stands for one
string, equal in all documents, and equal substrings get equal interior symbols. A string that occurs once in the corpus gets no
number: it is a barrier, and ends the matter for its surroundings.

Each symbol carries its context, the words that its making depended on. A window of words that holds the whole context of a
string which occurs once can't occur twice, so every round leaves fewer windows; what no window that is left can hold
isn't asked any more. The windows that hold shared symbols only are verified in a last exchange: by a key of 64 bits and a
check of 64 more, both over the words' global names, parts find the first occurrence. Two different windows of 1e14 agree in all
128 bits with odds of 1e-11.

A repeat keeps its first occurrence by (doc_id, place). Windows are judged on the input.

Edge cases: null and empty texts have no words and the hash of nothing; null ids come before all others; documents under one
window keep all words; of different texts with one id, that of the lower hash comes first, however rows are partitioned; repeated
rows are copies; a long run of one word is named as a run and its windows are verified like any other; an empty table gives an
empty result; further columns are passed over, whatever their names. A text is never split: memory grows with the longest one,
by about 60 bytes a word.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notelake.llm import exchange as X
from notelake.session import dropped, parts_for, tidied, written

WINDOW, ROUNDS = 20, 2
FAR = 255  # context beyond the document, or too wide for any window
ODD = np.random.default_rng(20).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
OUTPUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
OUTPUT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def name_of(level: int, part: int, index: np.ndarray) -> np.ndarray:
    """Global names: the round, the part and the number in the part; index -1 is no name (0)."""
    base = np.uint64((level << 60) | (part << 36))
    return np.where(index >= 0, base + (index + 1).astype(np.uint64), np.uint64(0))


def numbered(distinct: int, of: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For entries of several blocks: their string's number in the part, -1 if it occurs once in all."""
    return np.where(np.bincount(of, times, distinct)[of] > 1, of, -1)


@dataclass
class Symbols:
    """One block between rounds.

    Of each symbol: name, width in words, context beyond either end in words (FAR: unusable). sizes: symbols of each document.
    Of each word: whether its window is left, and its name while a window that is left holds it. ids and ties of the documents.
    """

    names: np.ndarray
    width: np.ndarray
    back: np.ndarray
    ahead: np.ndarray
    sizes: np.ndarray
    left: np.ndarray
    words: np.ndarray
    ids: np.ndarray
    ties: np.ndarray

    def packed(self, window: int) -> bytes:
        edge = np.zeros(len(self.left) + window, np.int64)
        starts = np.flatnonzero(self.left)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        words = np.where(np.cumsum(edge)[: len(self.left)] > 0, self.words, np.uint64(0))
        (table, at), (known, word) = X.coded(self.names), X.coded(words)
        arrays = (table, at, self.width.astype(np.int32), self.back, self.ahead, self.sizes.astype(np.int32), np.packbits(self.left), known, word, self.ids, self.ties)
        return X.frame(*map(X.pack, arrays))

    @classmethod
    def of_packed(cls, data: bytes) -> Symbols:
        types = (np.uint64, np.int32, np.int32, np.uint8, np.uint8, np.int32, np.uint8, np.uint64, np.int32, np.int64, np.int64)
        table, at, width, back, ahead, sizes, left, known, word, ids, ties = (X.unpack(x, t) for x, t in zip(X.unframe(data), types, strict=True))
        taken = lambda t, i: t[i] if len(i) else t[:0]
        return cls(taken(table, at), width.astype(np.int64), back, ahead, sizes.astype(np.int64), np.unpackbits(left)[: len(word)].astype(bool), taken(known, word), ids, ties)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.repeat(np.arange(len(self.sizes)), self.sizes), self.width)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(first symbol of a document, last symbol of a document)."""
        first, last = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        ends = np.cumsum(self.sizes[self.sizes > 0])
        first[np.r_[0, ends[:-1]][: len(ends)]] = True
        last[ends - 1] = True
        return first, last


def lost(left: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """left without the windows that hold one of the contexts [lo, hi)."""
    edge = np.zeros(len(left) + 1, np.int64)
    np.add.at(edge, np.maximum(hi - window, 0), 1)
    np.add.at(edge, lo + 1, -1)
    return left & (np.cumsum(edge)[:-1] == 0)


def proposed(s: Symbols, level: int, window: int):
    """(the next round's symbols, which of them are to be named, and the (name, count, name, count) that these are made of)."""
    n = len(s.names)
    none = np.empty(0, np.int64)
    if not n:
        return replace(s), none, (s.names, none, s.names, none)
    first, last = s.edges()
    start = np.cumsum(s.width) - s.width
    lo = np.where(s.back < FAR, start - s.back, -1)
    hi = np.where(s.ahead < FAR, start + s.width + s.ahead, 1 << 60)
    none = s.names == 0

    def before(a, edge, first):
        return np.where(first, edge, np.r_[a[:1], a[:-1]])

    def after(a, edge, last):
        return np.where(last, edge, np.r_[a[1:], a[-1:]])

    # runs of equal symbols; a run's extent depends on both neighbours being different
    new = first | none | (s.names != np.r_[s.names[:1], s.names[:-1]])
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, n])
    end = at + count - 1
    lo, hi = (
        np.where(none[at], lo[at], np.minimum(np.minimum.reduceat(lo, at), before(lo, -1, first)[at])),
        np.where(none[at], hi[at], np.maximum(np.maximum.reduceat(hi, at), after(hi, 1 << 60, last)[end])),
    )  # a barrier's context stays: nothing more is decided about it
    names, none, first, last, start, stop = s.names[at], none[at], first[at], last[end], start[at], (start + s.width)[end]
    # pairs (left half, right half); a left one alone depends on what follows, a right one on what comes before
    half = (X.mixed(X.mixed(names + count.astype(np.uint64)) ^ np.uint64(0x5851F42D4C957F2D * level % (1 << 64))) & np.uint64(1)).astype(bool)
    is_left, is_right = half & ~none, ~half & ~none
    merge = is_left & ~last & np.r_[is_right[1:], False]
    second = np.r_[False, merge[:-1]]
    lo2 = np.where(is_right & ~second, np.minimum(lo, before(lo, -1, first)), lo)
    hi2 = np.where(is_left & ~merge, np.maximum(hi, after(hi, 1 << 60, last)), hi)
    to = np.flatnonzero(merge)
    lo2[to], hi2[to] = np.minimum(lo[to], lo[to + 1]), np.maximum(hi[to], hi[to + 1])
    stop = stop.copy()
    stop[to] = stop[to + 1]
    doc = np.cumsum(first) - 1
    partner, partners = np.zeros(len(names), np.uint64), np.zeros(len(names), np.int64)
    partner[to], partners[to] = names[to + 1], count[to + 1]
    stay = ~second
    names, count, partner, partners, none, lo, hi, start, stop, doc, made = (x[stay] for x in (names, count, partner, partners, none, lo2, hi2, start, stop, doc, merge | (count > 1)))
    # what no window that is left can hold needs no name
    cum = np.r_[0, np.cumsum(s.left)]
    usable = (lo >= 0) & (hi < 1 << 60) & (hi - lo <= window)
    held = np.zeros(len(names), bool)
    held[usable] = cum[lo[usable] + 1] > cum[np.maximum(hi[usable] - window, 0)]
    out = np.where(held, names, np.uint64(0))
    sizes = s.sizes.copy()
    sizes[sizes > 0] = np.bincount(doc, minlength=int((s.sizes > 0).sum()))
    reach = lambda x, known: np.where(known, np.minimum(x, FAR), FAR).astype(np.uint8)
    symbols = replace(s, names=out, width=stop - start, back=reach(start - lo, lo >= 0), ahead=reach(hi - stop, hi < 1 << 60), sizes=sizes)
    which = np.flatnonzero(made & held)
    made_of = (names[which], count[which], partner[which], partners[which])
    symbols.names[which] = 1  # to be named; not a barrier meanwhile
    return symbols, which, made_of


def without_gaps(s: Symbols) -> tuple[Symbols, np.ndarray]:
    """The inside of each stretch of barriers as one of them, as only a stretch's ends stand beside something that may still be named; and where the symbols that are left stood."""
    n = len(s.names)
    if n < 4:
        return s, np.arange(n)
    first, last = s.edges()
    none = s.names == 0
    inside = none & ~first & ~last & np.r_[False, none[:-1]] & np.r_[none[1:], False]
    at = np.flatnonzero(~(inside & np.r_[False, inside[:-1]]))
    doc = np.cumsum(first) - 1
    sizes = s.sizes.copy()
    sizes[sizes > 0] = np.bincount(doc[at], minlength=int((sizes > 0).sum()))
    return replace(s, names=s.names[at], width=np.add.reduceat(s.width, at), back=s.back[at], ahead=s.ahead[at], sizes=sizes), at


def entries(parts_of, parts: int):
    """Distinct (name, count, name, count) rows in the order asked: (part of each, index of one occurrence, each row's entry, times)."""
    a, na, b, nb = parts_of
    table, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    h = X.mixed(X.mixed(a + na.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25) + X.mixed(b ^ X.mixed(nb.astype(np.uint64))))
    part = ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    order = np.lexsort((nb, na, j, i, part))
    rows = np.stack([part[order], i[order], j[order], na[order], nb[order]])
    new = np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)] if len(order) else np.empty(0, bool)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return part[order][new], order[new], of, np.bincount(of, minlength=int(new.sum()))


def window_keys(names: np.ndarray, at: np.ndarray, window: int, parts: int, key_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(part keys, checks) of the windows that start there."""
    mixed = X.mixed(names)
    total = np.zeros((2, len(at)), np.uint64)
    for k in range(window):
        total += mixed[at + k] * ODD[:, k % 256, None]
        if k % 256 == 255:
            total = X.mixed(total)
    return X.part_keys(X.mixed(total[0]) & np.uint64((1 << key_bits) - 1), parts), X.mixed(total[1])


def distinct_windows(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first occurrence of each distinct window, in the order asked; each window's number in that order)."""
    order = np.lexsort((np.arange(len(keys)), check, keys))
    k, c = keys[order], check[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.empty(0, bool)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def firsts(part: int, got: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Whether each window's first occurrence, by (doc_id, tie), is in the asking block."""
    frames = [X.unframe(d) for _, d in got]
    keys, check, ids, ties = (np.concatenate(x) for x in zip(*((X.unpack_keys(f[0]), X.unpack(f[1], np.uint64), X.undelta(f[2], np.int64), X.unpack(f[3], np.int64)) for f in frames), strict=True))
    ends = np.cumsum([len(X.unpack(f[1], np.uint64)) for f in frames])
    order = np.lexsort((np.arange(len(ids)), ties, ids, check, keys))
    k, c = keys[order], check[order]
    holder = np.zeros(len(ids), bool)
    holder[order[np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]]] = True
    return [(block, X.pack(x)) for (block, _), x in zip(got, np.split(holder, ends[:-1]))]


def dedup(documents: DataFrame, window: int = WINDOW, parts: int | None = None, rounds: int = ROUNDS, key_bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    key_bits: bits of a window's key that are used, fewer only in tests, where keys then collide and checks must tell windows apart.
    """
    parts = parts or parts_for(documents, 32)
    def ask(ids, ties, texts):
        split = [t.split() for t in texts]
        known: dict[bytes, int] = {}
        get = known.setdefault
        at = np.array([get(w, len(known)) for ws in split for w in ws], np.int64)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        del split
        vocabulary, times = list(known), np.bincount(at, minlength=len(known))
        common = np.argsort(-times, kind="stable")  # the most frequent first: small numbers, which pack best
        rank = np.empty(len(common), np.int32)
        rank[common] = np.arange(len(common), dtype=np.int32)
        vocabulary, times = [vocabulary[i] for i in common.tolist()], np.minimum(times[common], 2).astype(np.uint8)
        order, edges = asking_order(vocabulary)
        asks = [(p, X.frame(X.squeezed(b" ".join([vocabulary[i] for i in order[s:e].tolist()])), X.pack(times[order[s:e]]))) for p, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
        words = map(X.pack, (rank[at] if len(at) else at.astype(np.int32), sizes, ids, ties))
        return [(-2, X.frame(*words, X.squeezed(b" ".join(vocabulary), 3))), *asks]

    def asking_order(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the words by part, where each part starts)."""
        from xxhash import xxh64_intdigest

        h = np.fromiter((xxh64_intdigest(w, 5) for w in vocabulary), np.uint64, len(vocabulary))
        part = ((h >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def word_names(part, got):
        frames = [X.unframe(d) for _, d in got]
        words = [X.expanded(f[0]).split(b" ") for f in frames]
        number = {w: i for i, w in enumerate(sorted(set().union(*words)))}
        of = np.array([number[w] for ws in words for w in ws], np.int64)
        index = numbered(len(number), of, np.concatenate([X.unpack(f[1], np.uint8) for f in frames]))
        return [(block, X.pack(x)) for (block, _), x in zip(got, np.split(index, np.cumsum([len(w) for w in words])[:-1]))]

    def symbol_names(part, got):
        frames = [X.unframe(d) for _, d in got]
        a, na, b, nb, times = (np.concatenate(x) for x in zip(*((X.undelta(f[0], np.uint64), X.unpack(f[1], np.int32), X.unpack(f[2], np.uint64), X.unpack(f[3], np.int32), X.unpack(f[4], np.uint8)) for f in frames), strict=True))
        order = np.lexsort((nb, na, b, a))
        columns = [x[order] for x in (a, na, b, nb)]
        new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        index = numbered(int(new.sum()), of, times)
        return [(block, X.pack(x)) for (block, _), x in zip(got, np.split(index, np.cumsum([len(X.unpack(f[4], np.uint8)) for f in frames])[:-1]))]

    def asking(s: Symbols, level: int) -> list[tuple[int, bytes]]:
        """The block's state, proposed for the next round, and what it asks."""
        s, which, made = proposed(without_gaps(s)[0], level, window)
        part, one, of, times = entries(made, parts)
        a, na, b, nb = (x[one] for x in made)
        times = np.minimum(times, 2).astype(np.uint8)
        edges = np.searchsorted(part, np.arange(parts + 1))
        asks = [(p, X.frame(X.deltas(a[x:y]), X.pack(na[x:y].astype(np.int32)), X.pack(b[x:y]), X.pack(nb[x:y].astype(np.int32)), X.pack(times[x:y]))) for p, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
        s, at = without_gaps(s)
        return [(-1, X.frame(s.packed(window), X.deltas(np.searchsorted(at, which)), X.pack(of.astype(np.int32)))), *asks]

    def opened(kept):
        *arrays, vocabulary = X.unframe(kept)
        at, sizes, ids, ties = (X.unpack(x, t) for x, t in zip(arrays, (np.int32, np.int64, np.int64, np.int64), strict=True))
        return at, sizes, ids, ties, X.expanded(vocabulary).split(b" ") if len(at) else []

    def words_named(kept, got) -> Symbols:
        at, sizes, ids, ties, vocabulary = opened(kept)
        names = np.empty(len(vocabulary), np.uint64)
        names[asking_order(vocabulary)[0]] = np.concatenate([np.empty(0, np.uint64), *(name_of(0, p, X.unpack(d, np.int64)) for p, d in got)])
        names = names[at] if len(at) else names
        left = np.arange(len(names)) + window <= np.repeat(np.cumsum(sizes), sizes)
        once, zeros = np.flatnonzero(names == 0), np.zeros(len(names), np.uint8)
        return Symbols(names, np.ones(len(names), np.int64), zeros, zeros, sizes, lost(left, once, once + 1, window), names, ids, ties)

    def renamed(kept, got, level: int) -> Symbols:
        state, which, of = X.unframe(kept)
        s, which, of = Symbols.of_packed(state), X.undelta(which, np.int64), X.unpack(of, np.int32)
        names = np.concatenate([np.empty(0, np.uint64), *(name_of(level, p, X.unpack(d, np.int64)) for p, d in got)])
        own = names[of] if len(of) else names
        s.names[which] = own
        once = which[own == 0]
        start = (np.cumsum(s.width) - s.width)[once]
        s.left = lost(s.left, start - s.back[once], start + s.width[once] + s.ahead[once], window)
        return s

    def naming(level: int):
        """Takes a round's names and asks for those of the next, or for the first occurrences of the windows that are left."""

        def run(kept, got):
            s = renamed(kept, got, level) if level else words_named(kept, got)
            if level < rounds:
                return asking(s, level + 1)
            starts = np.flatnonzero(s.left)
            keys, check = window_keys(s.words, starts, window, parts, key_bits)
            one, _ = distinct_windows(keys, check)
            ends = np.cumsum(np.bincount(s.doc_of_words(), minlength=len(s.ids)))
            doc = np.searchsorted(ends, starts[one], side="right")
            asks = X.dealt(keys[one], parts, ((X.pack, check[one]), (X.deltas, s.ids[doc]), (X.pack, s.ties[doc])))
            return [(-1, X.frame(X.deltas(starts), X.pack(one.astype(np.int32)))), *asks]

        return run

    def remove(kept, got):
        at, sizes, ids, ties, vocabulary = opened(kept)
        starts, one = X.unframe(got[0][1])
        starts, one = X.undelta(starts, np.int64), X.unpack(one, np.int32)
        stays = np.zeros(len(starts), bool)
        if len(one):
            stays[one[np.concatenate([X.unpack(d, np.bool_) for _, d in got[1:]])]] = True
        gone = starts[~stays]
        edge = np.zeros(int(sizes.sum()) + window + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        covered = np.cumsum(edge) > 0
        removed, hashes, start = [], [], 0
        for n in sizes.tolist():
            own = covered[start : start + n]
            words = at[start : start + n][~own]
            start += n
            removed.append(n - len(words))
            hashes.append(hashlib.sha256(b" ".join([vocabulary[i] for i in words.tolist()])).hexdigest())
        return pa.Table.from_arrays([pa.array(ids, mask=X.is_null(ids, ties)), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())], schema=OUTPUT)

    asks, state, texts = X.saved(X.asked(documents, ask), "recompression-words", "texts")
    dropped(state)
    state = texts
    for level in range(rounds + 1):
        names = tidied(written(X.answered(asks, parts, symbol_names if level else word_names), "recompression-names"))
        dropped(asks)
        asks, now = X.saved(X.by_block(state, names, naming(level)), "recompression-symbols")
        dropped(names, *([state] if level else []))
        state = now
    holders = tidied(written(X.answered(asks, parts, firsts), "recompression-firsts"))
    dropped(asks)
    return X.by_block(texts.union(state), holders, remove, OUTPUT_DDL)
