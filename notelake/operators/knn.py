"""Exact nearest neighbours by cosine distance, for one query or a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators.fts import top

MAX_QUERIES, TOGETHER, SLACK = 10_000, 256, 1e-9


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector of that size without nulls, their vectors)."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == size)
    flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, flat.reshape(len(rows), size)


def nearest(keys: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int):
    """For each query: (number of the query, keys, distances) of its k nearest, ties by key; distances that aren't finite are dropped.

    One matrix product finds who can be among the k; these distances are then summed row by row, so equal vectors have equal distances.
    """
    with np.errstate(all="ignore"):
        size, own = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
        usable = np.flatnonzero(np.isfinite(size) & (size > 0))
        keys, vectors, size = keys[usable], vectors[usable], size[usable]
        for at in range(0, len(queries), TOGETHER):
            part = queries[at : at + TOGETHER]
            near = (vectors @ part.T) / size[:, None]
            for j in range(len(part)):
                if not (np.isfinite(own[at + j]) and own[at + j] > 0) or not len(keys):
                    continue
                x = near[:, j] / own[at + j]
                some = np.arange(len(x)) if len(x) <= k else np.flatnonzero(x >= np.partition(x, len(x) - k)[len(x) - k] - SLACK)
                distance = 1 - (vectors[some] * part[j]).sum(axis=1) / (size[some] * own[at + j])
                order = np.lexsort((keys[some], distance))[:k]
                yield at + j, keys[some][order], distance[order]


def knn(vectors: DataFrame, queries: DataFrame | list, k: int = 50, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, distance), the k nearest of each query (query_id, vector), a table or a list; ties by key.

    Every query meets every vector, which is what exact search is. The queries are a stated set: they go to all tasks as one matrix,
    MAX_QUERIES at a time; vectors are read once for each such block, in Arrow batches, and each batch leaves k rows for each query.
    Null vectors, other lengths and vectors of length zero have no distance and are dropped.
    """
    spark, out = vectors.sparkSession, None
    given = isinstance(queries, list)
    blocks = max(1, -(-(len(queries) if given else queries.count()) // MAX_QUERIES))
    ddl = f"query_id long, {key} long, distance double"
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("distance", pa.float64())])
    for b in range(blocks):
        if given:
            held = [x for x in queries[b * MAX_QUERIES : (b + 1) * MAX_QUERIES] if x[1]]
        else:
            own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            held = [(r["query_id"], r["vector"]) for r in own.select("query_id", "vector").collect() if r["vector"]]
        by_size: dict[int, list] = {}
        for q, v in held:
            by_size.setdefault(len(v), []).append((q, v))
        shipped = spark.sparkContext.broadcast({n: (np.array([q for q, _ in x], np.int64), np.array([v for _, v in x], np.float64)) for n, x in by_size.items()})

        def run(batches, shipped=shipped):
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                for size, (ids, matrix) in shipped.value.items():
                    rows, own = _matrix(batch.column(1), size)
                    found = list(nearest(keys[rows], own, matrix, k))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(x), ids[j]) for j, x, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([d for *_, d in found]))], schema=schema)

        found = top(vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "embedding").mapInArrow(run, ddl), ["distance", key], k)
        out = found if out is None else out.unionByName(found)
    return out
