"""Words of Han text without a given dictionary: candidates from the corpus, and a segmenter that finds the likeliest path.

``candidates`` counts character n-grams of all runs of Han with their neighbours, in one aggregation. A word is frequent, holds together (it occurs far
more often than its two parts would by chance, at the split where that is least so) and stands free (its neighbours on either side vary: entropy; the
end of a run counts as a neighbour of its own). ``dictionary`` takes the most frequent words, MOST_WORDS at most, so what is broadcast with
a tokenizer has a bound whatever the corpus. ``Segmenter`` cuts a run along the path of greatest probability through the lattice of its words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import HAN_RUN

LONGEST, LEAST_COUNT, COHESION, ENTROPY, MOST_WORDS = 4, 5, 3.0, 0.8, 200_000
GRAMS = pa.schema([("gram", pa.string()), ("side", pa.int32()), ("neighbour", pa.string()), ("n", pa.int64())])
CENTRE, LEFT, RIGHT = 0, 1, 2
SLICE = 2_000_000  # characters whose windows are sorted at once


def grams(texts: DataFrame, column: str = "text", longest: int = LONGEST, run: re.Pattern = HAN_RUN) -> DataFrame:
    """(gram, side, neighbour, n): counts of n-grams of up to longest characters inside runs (side 0), and of what stands left (1) and right (2) of them, "" at an edge.

    A slice of runs is one array of characters. Its distinct windows of longest + 2 characters are counted once, and n-grams with their neighbours are counted from these.
    """

    def count(batches):
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                own = run.findall(unicodedata.normalize("NFKC", text)) if text else ()
                held += own
                size += sum(map(len, own)) + len(own)
                if size >= SLICE:
                    yield from _counted(held, longest)
                    held, size = [], 0
            if held:
                yield from _counted(held, longest)

    rows = texts.select(F.col(column).cast("string")).mapInArrow(count, "gram string, side int, neighbour string, n long")
    return rows.groupBy("gram", "side", "neighbour").agg(F.sum("n").alias("n"))


def _distinct(columns: list[np.ndarray], base: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct row first stands, how often it occurs) of numbers under base; n: how often each row counts."""
    key, bound = columns[0].astype(np.int64), base
    for c in columns[1:]:
        if bound > (1 << 62) // base:  # numbers that don't fit are replaced by their ranks
            key = np.unique(key, return_inverse=True)[1]
            bound = len(key)
        key, bound = key * base + c, bound * base
    _, first, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, times if n is None else np.bincount(which, n, len(first)).astype(np.int64)


def _counted(runs: list[str], longest: int):
    """Batches of GRAMS for runs. 0 stands between runs, so a window that holds it before its end holds the end of a run."""
    codes = np.frombuffer(("\0" + "\0".join(runs) + "\0" * (longest + 1)).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(codes, return_inverse=True)
    m, base = len(codes) - longest - 1, len(letters)
    first, n = _distinct([codes[i : i + m] for i in range(longest + 2)], base)
    windows = np.stack([codes[i + first] for i in range(longest + 2)], axis=1)
    text = lambda cells: pa.array(np.ascontiguousarray(letters[cells]).view(f"U{cells.shape[1]}").ravel().tolist(), pa.string())
    for j in range(1, longest + 1):
        own = (windows[:, 1 : j + 1] != 0).all(axis=1)
        w, times = windows[own], n[own]
        for side, cells in ((CENTRE, w[:, 1 : j + 1]), (LEFT, w[:, : j + 1]), (RIGHT, w[:, 1 : j + 2])):
            if not len(w):
                continue
            at, total = _distinct(list(cells.T), base, times)
            gram = text(w[at, 1 : j + 1])
            beside = pa.array([""] * len(at)) if side == CENTRE else text(w[at, 0 if side == LEFT else j + 1][:, None])
            yield pa.RecordBatch.from_arrays([gram, pa.array(np.full(len(at), side, np.int32)), beside, pa.array(total)], schema=GRAMS)


def candidates(counts: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, count, cohesion, entropy) of every n-gram that occurs often enough; single characters have no cohesion. counts: what ``grams`` gives, a written table."""
    own = counts.filter(F.col("side") == CENTRE).select("gram", "n")
    often = own.filter(F.col("n") >= least)
    total = own.filter(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    free = counts.filter(F.col("side") != CENTRE).groupBy("gram", "side").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("neighbour") != "", F.col("n") * F.log("n")).otherwise(F.lit(0.0))).alias("spent"))
    free = free.withColumn("h", F.log("all") - F.col("spent") / F.col("all")).groupBy("gram").agg(F.min("h").alias("entropy"))
    cut = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda i: F.struct(F.substring("gram", F.lit(1), i).alias("a"), F.substring("gram", i + 1, F.length("gram")).alias("b")))
    splits = often.filter(F.length("gram") > 1).select("gram", F.col("n").alias("whole"), F.explode(cut).alias("s")).select("gram", "whole", "s.a", "s.b")
    of = lambda name: own.select(F.col("gram").alias(name), F.col("n").alias(f"n_{name}"))
    parts = splits.join(of("a"), "a").join(of("b"), "b").join(F.broadcast(total))  # one row of one number
    held = parts.groupBy("gram").agg(F.min(F.log(F.col("whole") * F.col("total") / (F.col("n_a") * F.col("n_b")))).alias("cohesion"))
    return often.join(held, "gram", "left").join(free, "gram").select(F.col("gram").alias("word"), F.col("n").alias("count"), "cohesion", "entropy")


def words(found: DataFrame, cohesion: float = COHESION, entropy: float = ENTROPY) -> DataFrame:
    """(word, count): single characters, and candidates that hold together and stand free."""
    return found.filter((F.length("word") == 1) | (F.col("cohesion") >= cohesion) & (F.col("entropy") >= entropy)).select("word", "count")


def dictionary(found: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """The most frequent of (word, count), ties by word: what a tokenizer carries to every task. Its size is bounded by most."""
    return {r["word"]: r["count"] for r in found.orderBy(F.desc("count"), "word").limit(most).collect()}


@dataclass(frozen=True)
class Segmenter:
    """Tokens of a run: the words of the likeliest path; before a longer word the known words inside it, so that its parts are found too.

    A word's probability is its share of all counts; a character that isn't known counts less than once. Of equally likely paths the one whose first difference is the longer word counts.
    """

    counts: dict[str, int]
    longest: int = field(init=False)
    logs: dict[str, float] = field(init=False)
    unknown: float = field(init=False)

    def __post_init__(self):
        total = math.log(sum(self.counts.values()) or 1)
        object.__setattr__(self, "longest", max(map(len, self.counts), default=1))
        object.__setattr__(self, "logs", {w: math.log(n) - total for w, n in self.counts.items() if n > 0})
        object.__setattr__(self, "unknown", -total - 1.0)

    def path(self, run: str) -> list[str]:
        """The words whose log probabilities have the greatest sum."""
        n = len(run)
        best, size = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            best[i] = self.logs.get(run[i], self.unknown) + best[i + 1]
            for k in range(2, min(self.longest, n - i) + 1):
                if (p := self.logs.get(run[i : i + k])) is not None and p + best[i + k] >= best[i]:
                    best[i], size[i] = p + best[i + k], k
        out, at = [], 0
        while at < n:
            out.append(run[at : at + size[at]])
            at += size[at]
        return out

    def spans(self, run: str) -> list[tuple[str, int]]:
        """The tokens with their places, in the order in which they are given."""
        out, at = [], 0
        for word in self.path(run):
            for k in (2, 3):
                if len(word) > k:
                    out += [(word[i : i + k], at + i) for i in range(len(word) - k + 1) if word[i : i + k] in self.logs]
            out.append((word, at))
            at += len(word)
        return out

    def __call__(self, run: str) -> list[str]:
        return [w for w, _ in self.spans(run)]

    def starts(self, run: str) -> list[int]:
        return [at for _, at in self.spans(run)]
