"""Exact nearest neighbours over vectors stored by cell: whole cells are ruled out by the triangle inequality before they are read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.fts import top
from notelake.operators.knn import MAX_QUERIES, _matrix, nearest

MOST_CELLS, FILE_ROWS, FIRST, SLACK = 1024, 200_000, 2, 1e-6
OTHER = -1  # the cell of vectors of another length, and of those that have no direction


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; a row of zeros for those that have no direction."""
    with np.errstate(all="ignore"):
        size = np.sqrt((vectors * vectors).sum(axis=1))
        fine = np.isfinite(size) & (size > 0)
        return np.where(fine[:, None], vectors / np.where(fine, size, 1)[:, None], 0.0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors: the square is twice the cosine distance, and they obey the triangle inequality."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass(frozen=True)
class Clusters:
    """Vectors in a folder for each cell (key, embedding, cell), and of each cell its centre and its radius, at most MOST_CELLS rows."""

    rows: DataFrame
    key: str
    dimension: int
    ids: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    def needed(self, queries: list[tuple[int, list]], k: int) -> np.ndarray:
        """need[q, cell]: which cells may hold one of the k nearest of a query. The nearest FIRST cells of each query are read for a bound on its k-th distance."""
        units = _unit(np.array([v for _, v in queries], np.float64))
        far = _apart(units, self.centres)
        first = np.zeros(far.shape, bool)
        np.put_along_axis(first, np.argsort(far, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        bound = np.full(len(queries), np.inf)
        at = {q: i for i, (q, _) in enumerate(queries)}
        for r in self.read(queries, first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect():
            if r["n"] >= k:
                bound[at[r["query_id"]]] = np.sqrt(max(2 * r["d"], 0))
        return far - self.radii[None, :] <= bound[:, None] + SLACK

    def read(self, queries: list[tuple[int, list]], need: np.ndarray, k: int) -> DataFrame:
        """(query_id, key, distance): the k nearest of each query among the cells it needs; no other folder is read."""
        spark, key = self.rows.sparkSession, self.key
        cells = [int(c) for c in self.ids[need.any(axis=0)]]
        numbers, matrix = np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)
        shipped = spark.sparkContext.broadcast((numbers, matrix, {int(c): np.flatnonzero(need[:, j]) for j, c in enumerate(self.ids) if need[:, j].any()}))
        schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("distance", pa.float64())])

        def run(batches):
            numbers, matrix, wanted = shipped.value
            for batch in batches:
                of = batch.column(2).to_numpy(zero_copy_only=False)
                for cell in np.unique(of):
                    part = batch.take(pa.array(np.flatnonzero(of == cell)))
                    keys, own = part.column(0).to_numpy(zero_copy_only=False), wanted[int(cell)]
                    rows, vectors = _matrix(part.column(1), matrix.shape[1])
                    for j, x, d in nearest(keys[rows], vectors, matrix[own], k):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), numbers[own[j]])), pa.array(x), pa.array(d)], schema=schema)

        found = self.rows.filter(F.col("cell").isin(cells)).select(key, "embedding", "cell").mapInArrow(run, f"query_id long, {key} long, distance double")
        return top(found, ["distance", key], k)

    def knn(self, queries: DataFrame, k: int = 50) -> DataFrame:
        """The rows of ``knn`` for queries (query_id, vector), a stated set that goes to all tasks, MAX_QUERIES at a time."""
        out, blocks = None, max(1, -(-queries.count() // MAX_QUERIES))
        for b in range(blocks):
            own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            held = [(r["query_id"], r["vector"]) for r in own.select("query_id", "vector").collect() if r["vector"]]
            same = [x for x in held if len(x[1]) == self.dimension and None not in x[1]]
            parts = [self.read(same, self.needed(same, k), k)] if same and len(self.ids) else []
            if rest := [x for x in held if len(x[1]) != self.dimension]:
                from notelake.operators.knn import knn

                parts.append(knn(self.rows.filter(F.col("cell") == OTHER), rest, k, self.key))
            for p in parts:
                out = p if out is None else out.unionByName(p)
        return self.rows.sparkSession.createDataFrame([], f"query_id long, {self.key} long, distance double") if out is None else out


def stored(vectors: DataFrame, path: str, key: str = "chunk_id", cells: int | None = None) -> Clusters:
    """Write vectors (key, embedding) by cell into path.

    Centres are the vectors of the least hashed keys, about as many as the root of the number of rows, at most MOST_CELLS: a bounded sample, on which only what is read depends,
    never a result. The dimension is the commonest one among them. A cell is cut into files of some FILE_ROWS rows by its share of the sample, so a hot cell is written by many tasks.
    Rows without a key are dropped.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "embedding")
    n = rows.count()
    want = cells or max(1, min(MOST_CELLS, int(n**0.5)))
    drawn = [r["embedding"] for r in rows.filter("embedding is not null").orderBy(F.xxhash64(key), key).limit(4 * want).collect()]
    sizes = [len(v) for v in drawn if v]
    dimension = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    usable = [v for v in drawn if v and len(v) == dimension and None not in v]
    units = _unit(np.array(usable, np.float64).reshape(len(usable), dimension))
    units = np.unique(units[(units != 0).any(axis=1)], axis=0)[:want] if len(usable) else units
    share = np.bincount(_apart(_unit(np.array(usable, np.float64)), units).argmin(axis=1), minlength=len(units)) / len(usable) if len(units) else np.zeros(0)
    centres = spark.sparkContext.broadcast((units, np.append(np.ceil(share * n / FILE_ROWS), np.ceil((n - n * len(usable) / max(1, len(drawn))) / FILE_ROWS)).clip(1).astype(np.int64)))

    def place(batches):
        for batch in batches:
            held, pieces = centres.value
            cell, away = np.full(batch.num_rows, OTHER, np.int32), np.zeros(batch.num_rows)
            found, own = _matrix(batch.column(1), dimension)
            own = _unit(own)
            fine = (own != 0).any(axis=1)
            if len(held) and fine.any():
                far = _apart(own[fine], held)
                cell[found[fine]], away[found[fine]] = far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(away), pa.array(pieces[cell])], names=[key, "embedding", "cell", "away", "pieces"])

    element = rows.schema["embedding"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"{key} long, embedding {element}, cell int, away double, pieces long")
    placed.repartition("cell", F.pmod(F.xxhash64(key), "pieces")).drop("pieces").write.partitionBy("cell").parquet(path)
    done = spark.read.schema(f"{key} long, embedding {element}, away double, cell int").parquet(path)
    of = {r["cell"]: r["r"] for r in done.filter(F.col("cell") != OTHER).groupBy("cell").agg(F.max("away").alias("r")).collect()}
    ids = np.array(sorted(of), np.int64)
    return Clusters(done.drop("away"), key, dimension, ids, units[ids] if len(ids) else units[:0], np.array([of[c] for c in ids], np.float64))
