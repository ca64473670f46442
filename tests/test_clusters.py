"""Nearest neighbours by cells against a scan of all vectors."""

import numpy as np
from pyspark.sql import functions as F

from notelake.operators import clusters
from notelake.operators.knn import knn

DDL = "chunk_id long, embedding array<float>"


def same(a, b):
    one = lambda df: sorted((r.query_id, r.chunk_id, round(r.distance, 12)) for r in df.collect())
    assert one(a) == one(b)


def test_cells_are_skipped_and_rows_stay(spark, tmp_path):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in heads[i % 12] + rng.normal(scale=0.02, size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, 2.0]), (2004, [2.0, 1.0]), (2005, [None, 1.0]), (None, [1.0] * 8), (2006, [])]
    v = spark.createDataFrame(rows, DDL).repartition(5)
    asked = [(i, rows[i][1]) for i in range(0, 600, 97)] + [(9001, [float(x) for x in rng.normal(size=8)]), (9002, [1.0, 1.0]), (9003, [0.0] * 8), (9004, None), (9005, [1.0] * 3)]
    q = spark.createDataFrame(asked, "query_id long, vector array<float>")
    held = clusters.stored(v, str(tmp_path / "v"))
    for k in (1, 7, 45):
        same(held.knn(q, k), knn(v, q, k))
    one = [asked[0]]
    need = held.needed(one, 7)
    assert 0 < need.sum() < len(held.ids) / 2
    files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    read = held.rows.filter(F.col("cell").isin([int(c) for c in held.ids[need[0]]]))
    assert len(files(read)) < len(files(held.rows)) / 2
    assert "PartitionFilters: [cell" in held.read(one, need, 7)._jdf.queryExecution().executedPlan().toString().replace("isnotnull(cell), ", "").replace("[(cell", "[cell")
    same(held.knn(q.filter("query_id > 100000"), 3), knn(v, q.filter("query_id > 100000"), 3))
    same(clusters.stored(v, str(tmp_path / "one"), cells=1).knn(q, 7), knn(v, q, 7))


def test_no_vectors(spark, tmp_path):
    q = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    for name, rows in (("none", []), ("null", [(1, None)])):
        assert clusters.stored(spark.createDataFrame(rows, DDL), str(tmp_path / name)).knn(q, 3).count() == 0
