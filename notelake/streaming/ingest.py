"""Incremental indexing as a stream: batches of file versions are merged into the store by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators.store import Store, latest
from notelake.plans.index import built, changed

FILES = "path string, content string, mtime timestamp"


def merge_batch(store: Store, batch: DataFrame, embed=None) -> dict[str, int]:
    """Index the batch's new and changed files (latest version of each path) and publish what changed; files that are not in the batch stay."""
    spark = batch.sparkSession
    files = latest(batch, ["path"], F.col("mtime")).select("path", "content")
    if store.version(spark) is None:
        tables, failed = built(files, embed, stored=True)
        files = files if failed is None else files.join(failed, "path", "left_anti")
        store.publish(spark, tables | {"files": files})
        return {"new": files.count(), "errors": 0 if failed is None else failed.count()}
    store.migrate(spark)
    changes, counts = changed(store.read_all(spark), files, prune=False, embed=embed)
    if changes:
        store.change(spark, changes)
    return counts


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = True):
    """A streaming query over JSON file events (path, content, mtime) that keeps the store up to date."""
    events = spark.readStream.schema(FILES).json(folder)
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_batch(store, batch) if not batch.isEmpty() else None)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_indegree(edges: DataFrame) -> DataFrame:
    """In-degree of a stream of edges, for update mode."""
    return edges.filter("dst_id is not null").groupBy("dst_id").agg(F.count("*").alias("indegree"))
