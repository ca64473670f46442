"""Language-model scoring by Katz backoff on bigrams.

Counts: each block of documents asks the block exchange for the global training counts of its words and word pairs; the
parts are the partitioned count tables, each holding its share of all n-grams. Good-Turing discounts (counts to 5) come
from the counts of counts of all parts. Backoff weights are normalised exactly: every distinct seen pair is owned by one block,
which adds its discounted count and its second word's unigram probability to its context; contexts are summed by a
second exchange, alpha(a) = (1 - sum P*(b|a)) / (1 - sum P(b)). A token is then scored recursively: the pair if it was seen, else
alpha of the context times the unigram, which itself backs off to the mass of unknown words.

Denominators are C + 1/2, so some mass is always left for backing off; unknown words are one event, as in the base score.
N-grams travel as hashes of 48 bits and the part's number: 54 bits at 65 parts, 64 from 65,536 parts on. At 65 parts (2 GB of input) and 5e7 distinct pairs two of them
share a key with odds of 7 %, and such pairs' counts are then those of both; a given pair is merged with odds of 3e-9.

Edge cases: null and empty texts have one token, the end; null ids count as the text ``null`` for the split; repeated rows
are counted and scored each; without training rows every word is unknown; an empty table gives an empty result; further
columns are passed over. A text is never split: memory grows with the longest one, by about 30 bytes a word.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notelake.llm import exchange as X
from notelake.session import dropped, parts_for, tidied, written

K, MOD, OUT = 5, 7, 2
START, END = 0, 1
OUTPUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
OUTPUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """d[0..k]: what a count r <= k is multiplied by; n[r] is the number of n-grams seen r times, r to k + 1."""
    d = np.ones(k + 1)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        good = n[r] and n[r + 1] and common < 1
        x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if good else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


def held_out(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    none = X.is_null(ids, ties).tolist()
    return np.array([zlib.crc32(b"null" if x else b"%d" % i) % MOD == OUT for i, x in zip(ids.tolist(), none)], bool)


def _read(texts: list[bytes]):
    """(tokens of all documents with their ends, lengths, hashes of the words)."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {b" start": START, b" end": END}
    get, tokens, lens = known.setdefault, [], []
    for t in texts:
        words = t.lower().split()
        tokens.append(np.array([get(w, len(known)) for w in words] + [END], np.int32))
        lens.append(len(words) + 1)
    return np.concatenate(tokens), np.array(lens, np.int64), np.fromiter((xxh64_intdigest(w, 11) for w in known), np.uint64, len(known))


def _pairs(tokens: np.ndarray, lens: np.ndarray, hashes: np.ndarray, parts: int):
    """Distinct pairs as (first, second) sorted by part key, their part keys, and each token's pair."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.r_[0, np.cumsum(lens)[:-1]]] = START
    code = before.astype(np.int64) * len(hashes) + tokens
    distinct, of = np.unique(code, return_inverse=True)
    a, b = distinct // len(hashes), distinct % len(hashes)
    keys = X.part_keys(X.mixed(hashes[a] * np.uint64(0x9E3779B97F4A7C15) + X.mixed(hashes[b])), parts)
    order = np.argsort(keys, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return a[order], b[order], keys[order], rank[of]


def score(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    parts = parts or parts_for(documents, 32)

    def ask(ids, ties, texts):
        tokens, lens, hashes = _read(texts)
        held = held_out(ids, ties)
        train = np.repeat(~held, lens)
        words = X.part_keys(hashes, parts)
        order = np.argsort(words, kind="stable")
        own = np.bincount(tokens[train], minlength=len(hashes))
        _, _, keys, of = _pairs(tokens, lens, hashes, parts)
        kept = X.frame(X.pack(ids), X.pack(X.is_null(ids, ties)), X.pack(held), X.pack(lens), X.pack(tokens), X.pack(hashes))
        return [(-1, kept), *X.dealt(words[order], parts, ((X.pack, own[order]),)), *X.dealt(keys, parts, ((X.pack, np.bincount(of[train], minlength=len(keys))),), parts)]

    def answer(part, got):
        """Global counts, twice, plus one where this entry owns its n-gram; and the part's own sums as block -1."""
        frames = [X.unframe(d) for _, d in got]
        distinct, of, first, ends = X.merged([X.unpack_keys(f[0]) for f in frames])
        total = np.bincount(of, np.concatenate([X.unpack(f[1], np.int64) for f in frames]), len(distinct)).astype(np.int64)
        out = total[of] * 2
        out[first] += 1
        sums = np.r_[total.sum(), (total > 0).sum(), np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2]]
        return [(-1, X.pack(sums.astype(np.int64))), *((block, X.pack(x)) for (block, _), x in zip(got, np.split(out, ends[:-1])))]

    asks, first = X.saved(X.asked(documents, ask, ordered=False), "katz-asked")
    counts = tidied(written(X.answered(asks, 2 * parts, answer), "katz-counts"))
    dropped(asks)
    sums = np.zeros((2, K + 3), np.int64)
    for r in counts.filter("block = -1").select("part", "data").toLocalIterator():  # a few numbers for each part
        sums[int(r["part"] >= parts)] += X.unpack(bytes(r["data"]), np.int64)
    n, v = int(sums[0, 0]), int(sums[0, 1])
    d1, d2 = (discounts(np.r_[0, s[2:]]) for s in sums)
    unknown = 1 - float((n - sum((1 - d1[r]) * r * sums[0, r + 1] for r in range(1, K + 1))) / (n + 0.5))

    def weigh(kept, got):
        *who, lens, tokens, hashes = (X.unpack(x, t) for x, t in zip(X.unframe(kept), (np.int64, np.bool_, np.bool_, np.int64, np.int32, np.uint64), strict=True))
        words = X.part_keys(hashes, parts)
        order = np.argsort(words, kind="stable")
        uni = np.concatenate([X.unpack(d, np.int64) for p, d in got if p < parts]) >> 1
        both = np.concatenate([X.unpack(d, np.int64) for p, d in got if p >= parts])
        c1 = np.empty(len(hashes), np.int64)
        c1[order] = uni
        context = c1.copy()
        context[START], c1[START] = c1[END], 0
        p1 = np.where(c1 > 0, _discounted(c1, d1) / (n + 0.5), unknown)
        a, b, _, of = _pairs(tokens, lens, hashes, parts)
        c2, owner = both >> 1, (both & 1).astype(bool)
        seen, mass = c2 > 0, _discounted(c2, d2)
        logs = np.where(seen, np.log10(np.where(seen, mass, 1) / (context[a] + 0.5)), np.log10(p1[b]))
        backs = ~seen & (context[a] > 0)
        doc = np.repeat(np.arange(len(lens)), lens)
        mine = owner & seen
        total, spent, low = (np.bincount(a[mine], w[mine], len(hashes)) for w in (c2, mass, p1[b]))
        needs = np.bincount(a[backs], minlength=len(hashes)) > 0
        use = order[(needs | (total > 0))[order]]
        keys, at = words[use], X.cuts(words[use], parts)
        place = np.full(len(hashes), -1)
        wanted = use[needs[use]]
        place[wanted] = np.arange(len(wanted))
        back = backs[of]
        by_doc = lambda w: np.bincount(doc, w, len(lens))
        sent = X.frame(*map(X.pack, who), X.pack(lens), X.pack(by_doc((c1[tokens] > 0).astype(float)).astype(np.int64)), X.pack(by_doc(np.log10(c1[tokens] + 1.0))), X.pack(by_doc(logs[of])), X.pack(doc[back].astype(np.int32)), X.pack(place[a[of[back]]].astype(np.int32)))
        return [(-1, sent), *((p, X.frame(X.pack_keys(keys[s:e]), *(X.pack(x[use[s:e]]) for x in (total, spent, low)), X.pack(needs[use[s:e]]))) for p, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s)]

    def alphas(part, got):
        """log10 of the backoff weights that each block needs."""
        frames = [X.unframe(d) for _, d in got]
        distinct, of, _, ends = X.merged([X.unpack_keys(f[0]) for f in frames])
        total, spent, low = (np.bincount(of, np.concatenate([X.unpack(f[k], np.float64) for f in frames]), len(distinct)) for k in (1, 2, 3))
        alpha = np.log10((1 - spent / (total + 0.5)) / np.maximum(1 - low, 1e-12))[of]
        return [(block, X.pack(x[X.unpack(f[4], np.bool_)])) for (block, _), f, x in zip(got, frames, np.split(alpha, ends[:-1]))]

    asks, second = X.saved(X.by_block(first, counts, weigh), "katz-weighed")
    dropped(first, counts)

    def finish(kept, got):
        types = (np.int64, np.bool_, np.bool_, np.int64, np.int64, np.float64, np.float64, np.int32, np.int32)
        ids, none, held, lens, known, base, done, doc, place = (X.unpack(x, t) for x, t in zip(X.unframe(kept), types, strict=True))
        alpha = np.concatenate([np.empty(0), *(X.unpack(d, np.float64) for _, d in got)])
        total = done + np.bincount(doc, alpha[place], len(lens))
        columns = (pa.array(ids, mask=none), pa.array(held), pa.array(lens), pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base - lens * np.log10(n + v + 1.0)), pa.array(total))
        return pa.Table.from_arrays(list(columns), schema=OUTPUT)

    return X.by_block(second, X.answered(asks, parts, alphas), finish, OUTPUT_DDL)
