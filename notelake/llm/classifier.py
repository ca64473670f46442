"""Quality classifier: naive Bayes support vectors.

Byte n-grams (2 and 3 bytes, A-Z lower-cased) and words are hashed to BUCKETS indicators. Each indicator is scaled by its
class log-count ratio (add-one counts of documents, L1-normalised per class) and a linear hinge-loss model is fit by dual
coordinate descent. The score is the logistic of SLOPE times the margin (a fixed slope, not fitted), so it is at least 0.5 just
where the margin is not negative.

Fitting uses at most SAMPLE labelled training rows, those with the least hash of doc_id (their ids are what is broadcast), and of
these, in the same order, as many as have INDICATORS indicators together (what the driver reads, at 4 bytes each): two documented
bounds, one on rows and one on bytes, so that long texts can't fill the driver. Scoring covers every whole text, map-side, with
a weight vector of fixed size. Scores depend on texts alone.

Edge cases: null text is empty and scores by the bias; null ids are never labelled and count as the text ``null`` for
the split; repeated labels count once, good only if all say so; of several texts with one id that of the least hash is learned; with labels of one class only, or none, every
score is that class's share (0.5 without labels); an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm.exchange import trimmed
from notelake.llm.text import batch_of, docs, slices, values
from notelake.session import dropped, written

BUCKETS, SAMPLE, INDICATORS, EPOCHS, C, SLOPE = 1 << 18, 16_384, 48 << 20, 12, 3.0, 2.0
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def remainder(mod: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, mod."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null")).cast("binary")) % mod


def features(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    text = text.lower()
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    words = np.fromiter(map(zlib.crc32, set(text.split())), np.uint32)
    if len(b) > 2:
        two = b[:-1] << 8 | b[1:]
        grams = (two, (two[:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(7), words)
    else:
        grams = (b, words)
    return np.unique(np.concatenate(grams) & np.uint32(BUCKETS - 1)).astype(np.int32)


def fit(rows: list[np.ndarray], good: np.ndarray, epochs: int = EPOCHS, c: float = C) -> tuple[np.ndarray, float]:
    """(weights, bias) of the score's logit: sum(weights[features]) / sqrt(len(features)) + bias."""
    zero = np.zeros(BUCKETS, np.float32)
    if len(rows) == 0 or good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return zero, float(np.log(share / (1 - share)))
    counts = np.ones((2, BUCKETS))
    for f, g in zip(rows, good, strict=True):
        counts[int(g), f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    y = np.where(good, 1.0, -1.0)
    scale = [1 / np.sqrt(max(1, len(f))) for f in rows]
    norm = np.array([x @ x + 1.0 for x in (ratio[f] * c for f, c in zip(rows, scale))])
    w, bias, alpha, rng = np.zeros(BUCKETS), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = ratio[rows[i]] * scale[i]  # made anew each time, so that memory holds the indicators alone
            gradient = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
    return (SLOPE * w * ratio).astype(np.float32), SLOPE * bias


def sampled(labels: DataFrame, held_out: Column, column: str = "quality", most: int = SAMPLE) -> DataFrame:
    """At most so many (doc_id, y) of the training rows, by least hash of doc_id: bounded, so it may be broadcast."""
    one = labels.filter(~held_out & F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def trained(documents: DataFrame, labels: DataFrame, mod: int = 3, out: int = 1, most: int = SAMPLE, indicators: int = INDICATORS) -> tuple[np.ndarray, float]:
    chosen = sampled(labels, remainder(mod) == out, most=most)
    ddl = "doc_id long, h long, n long, f binary, y int"
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("f", pa.binary()), ("y", pa.int32())])

    def collect(batches):
        for batch in slices(batches):
            found = [features(t) for t in values(batch, "text")]
            yield batch_of(schema, batch.column(0), values(batch, "h"), [len(f) for f in found], [f.tobytes() for f in found], values(batch, "y"))

    rows = docs(documents).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("h"), "y").mapInArrow(collect, ddl)
    one = written(rows.groupBy("doc_id").agg(F.min(F.struct("h", "f", "n", "y")).alias("r")).select("doc_id", F.xxhash64("doc_id").alias("place"), "r.n", "r.f", "r.y"), "classifier-rows")
    before = F.sum("n").over(Window.orderBy("place", "doc_id"))  # over SAMPLE short rows at most
    kept = one.select("doc_id", "place", "n").withColumn("before", before).filter(F.col("before") <= indicators)
    last = kept.agg(F.max(F.struct("place", "doc_id")).alias("m")).first()["m"]
    used = one.filter((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("doc_id") <= last["doc_id"]))) if last else one.limit(0)
    got = used.select("doc_id", "f", "y").toArrow().sort_by("doc_id")
    dropped(one)
    found, y = got["f"].combine_chunks(), np.array(got["y"].to_pylist(), int) == 1
    del got
    rows, data = [], None
    for part in found.chunks if isinstance(found, pa.ChunkedArray) else [found]:
        _, ends, data = part.buffers()
        ends = np.frombuffer(ends, np.int32)[part.offset : part.offset + len(part) + 1].tolist() if len(part) else [0]
        rows += [np.frombuffer(data, np.int32, (b - a) // 4, a) if b > a else np.empty(0, np.int32) for a, b in zip(ends, ends[1:])]  # without a copy
    weights = fit(rows, y)
    del rows, found, data
    trimmed()
    return weights


def scored(documents: DataFrame, weights: np.ndarray, bias: float, mod: int = 3, out: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shipped.value
        for batch in slices(batches):
            margin = np.array([float(w[f].sum(dtype=np.float64)) / max(1, len(f)) ** 0.5 + bias for f in map(features, values(batch, "text"))])
            score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield batch_of(SCORES, batch.column(0), batch.column(2), score.tolist(), (score >= 0.5).astype(int).tolist())

    return docs(documents, (remainder(mod) == out).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(documents, *trained(documents, labels))


def accept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the model doesn't reject, columns unchanged."""
    weights, bias = trained(documents, labels)
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        w = shipped.value
        found = (features(t.encode() if isinstance(t, str) else b"") for t in texts)
        return pd.Series([bool(float(w[f].sum(dtype=np.float64)) / max(1, len(f)) ** 0.5 + bias >= 0) for f in found], dtype=bool)

    return documents.filter(good(F.col("text")))
