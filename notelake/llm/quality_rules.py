"""Quality rules with risk-controlled thresholds.

Per document a few counts of words, symbols, repeated lines and repeated windows; two fixed base rules; and one cutoff per
stratum (lang) and ratio, chosen from labelled holdouts. A stratum has one family of joint cutoffs, ordered from loose to tight
and made from one label in FIT (by hash of the id). It starts without any cutoff, and each member tightens one ratio by one step: first some grid
steps above the largest ratio of the good ones among these labels, ratio by ratio, then fewer steps, at last cutoffs that drop a few thousandths of them. At each
step the ratio that catches most bad labels comes first, and one that catches no more than before isn't tightened, so that a ratio which good documents
of a language exceed now and then doesn't stand before those that tell bad ones. The good labels outside FIT certify: fixed-sequence testing goes down the family and stops
at the first member for which an exact binomial test doesn't reject "it drops more than ALPHA of the good documents of this
stratum" at level DELTA / groups; the last one before it holds. No split over ratios or grid is needed, so that with
probability 1 - DELTA no group loses more than ALPHA of its good documents to the cutoffs.

Strata of fewer good labels than ``least_joint`` asks for are pooled into one group with one sequence of its own, certified for
the pool as a whole and not for each language in it; with too few good labels in the pool as well, its cutoffs drop nothing.

Counts cover all documents and all labels; what reaches the driver is one number per group, ratio and grid point, and per group and member of the family.

Edge cases: null or empty text has no words and fails the base rule; null lang is a stratum; repeated labels of a document
count once (good only if all say so); repeated rows are judged alike; an empty table gives an empty result; without
labels only the base rules act; further columns are passed over. A text's words are held
together: memory grows with the longest text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import SPACES, batch_of, docs, slices, values
from notelake.session import written

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
NOT_CHARS = SPACES + bytes(range(0x80, 0xC0))
ALPHA, DELTA, POOL, FIT = 0.02, 0.05, "pool", 4
STEPS, SHARES = (16, 8, 4, 2, 1, 0), (0.002, 0.004, 0.008)
GRID = tuple(round(0.005 * 1.12**i, 6) for i in range(47))
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
STATS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]])
STATS_DDL = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
    if len(ids) == len(words):
        return 0
    mixed = (at + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key += mixed[k : k + n] * MULTIPLIERS[k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((at[a + k] != at[b + k]).any() for k in range(window)):  # two windows of one key: compare the words themselves
        _, key = np.unique(np.lib.stride_tricks.sliding_window_view(at, window), axis=0, return_inverse=True)
        order = np.argsort(key.ravel(), kind="stable")
        same = key.ravel()[order[1:]] == key.ravel()[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + window, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(words), len(text.translate(None, NOT_CHARS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


def measured(documents: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            yield batch_of(STATS, batch.column(0), batch.column(2), *map(list, zip(*map(measure, values(batch, "text")), strict=True)))

    return docs(documents, F.col("lang").cast("string").alias("lang")).mapInArrow(run, STATS_DDL)


def ratios() -> dict[str, Column]:
    """What the cutoffs bound from above, each 0 where its base is 0."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"),
        "long_words": over("word_chars", "n_words") / 20.0, "short_words": F.when(F.col("word_chars") > 0, F.col("n_words") / F.col("word_chars")).otherwise(F.lit(0.0)) / 1.0,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return math.fsum(math.exp(log(i)) for i in range(k + 1))


def least_joint(n_groups: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good labels without which no member of the family can be certified."""
    return math.ceil(math.log(delta / max(1, n_groups)) / math.log1p(-alpha))


def family(good: dict[str, dict[int, int]], bad: dict[str, dict[int, int]]) -> list[dict[str, float]]:
    """Joint cutoffs, loose to tight. good, bad: per ratio, labels by the number of grid points below them."""

    def least(by: dict[int, int], share: float) -> int:
        most = share * sum(by.values())
        return next(j for j in range(len(GRID) + 1) if sum(n for b, n in by.items() if b > j) <= most)

    now, members, caught = {}, [], dict.fromkeys(good, 0)
    for share, up in [*((0, i) for i in STEPS), *((e, 0) for e in SHARES)]:
        at = {k: least(by, share) + up for k, by in good.items()}
        catches = {k: sum(n for b, n in bad.get(k, {}).items() if b > j) if j < len(GRID) else 0 for k, j in at.items()}
        for k in sorted(at, key=lambda k: (-catches[k], k)):
            if catches[k] > caught[k]:
                caught[k], now = catches[k], {**now, k: GRID[at[k]]}
                members.append(now)
    return members


def tightest(drops: list[int], n: int, n_groups: int, alpha: float = ALPHA, delta: float = DELTA) -> int | None:
    """The last member certified by fixed-sequence testing, None if the first isn't. drops: good documents lost, loose to tight."""
    held = None
    for i, k in enumerate(drops):
        if binomial_tail(k, n, alpha) > delta / n_groups:
            break
        held = i
    return held


def judged(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed and kept."""
    stats = written(measured(documents), "rules-stats")
    parts = ratios()
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stratum = F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce("lang", F.lit("")))
    own = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q is not null").select("doc_id", (F.col("q") == 1).alias("good"))
    fit = (F.pmod(F.xxhash64("doc_id"), F.lit(FIT)) == 0).alias("fit")
    held = written(stats.filter(~base).join(own, "doc_id").select(stratum.alias("stratum"), fit, "good", *[c.alias(k) for k, c in parts.items()]), "rules-held")
    found = {r["stratum"]: r["n"] for r in held.filter("good and not fit").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    n_groups = len(found) + 1  # the pool may be one
    large = sorted(k for k, n in found.items() if n >= least_joint(n_groups, alpha, delta))
    sizes = {k: found[k] for k in large}
    if (pooled := sum(n for k, n in found.items() if k not in sizes)) >= least_joint(n_groups, alpha, delta):
        sizes[POOL] = pooled
    group = F.when(F.col("stratum").isin(large), F.col("stratum")).otherwise(F.lit(POOL))
    over = lambda member, of: F.coalesce(*[F.when(of[k] > t, True) for k, t in sorted(member.items())], F.lit(False))
    kept = ~base
    if sizes:
        long = held.filter("fit").select(group.alias("g"), "good", F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), F.col(k).alias("x")) for k in parts])).alias("m")).select("g", "good", "m.*")
        bins: dict[tuple[str, bool], dict[str, dict[int, int]]] = {}
        for r in long.groupBy("g", "good", "ratio", F.size(F.filter(F.array(*map(F.lit, GRID)), lambda t: t < F.col("x"))).alias("b")).agg(F.count("*").alias("n")).collect():
            bins.setdefault((r["g"], r["good"]), {}).setdefault(r["ratio"], {})[r["b"]] = r["n"]
        columns = {k: F.col(k) for k in parts}
        for s, n in sorted(sizes.items()):
            if not (members := family(bins.get((s, True), {}), bins.get((s, False), {}))):
                continue
            sums = [F.sum(over(m, columns).cast("long")) for m in members]
            drops = list(held.filter(F.col("good") & ~F.col("fit") & (group == s)).agg(*sums).first())
            if (i := tightest(drops, n, n_groups, alpha, delta)) is not None:
                inside = ~stratum.isin(large) if s == POOL else stratum == s
                kept = kept & ~(inside & over(members[i], parts))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))
