"""Session helpers: the shared scratch folder, table reading and written intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark so that any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, local mode) a temporary folder is made; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_notelake_dir", None)
    if own is None:
        own = spark.sparkContext._notelake_dir = tempfile.mkdtemp(prefix="notelake-")
    return own


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``written`` made in this process since it had made so many, once their results are taken. Gives their number."""
    conf, paths = spark._jsparkSession.sessionState().newHadoopConf(), WRITTEN[since:]
    del WRITTEN[since:]
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def parts_for(df: DataFrame, mb: int = 64) -> int:
    """Shuffle partitions for df: the session's number, or more where df's size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # unknown, as for rows made by the driver
        size = 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (mb << 20), 65_535))


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df is made of, as far as they are known: joins don't inflate it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # beyond: unknown, as for rows made by the driver


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidied(df: DataFrame) -> DataFrame:
    """df, a written table; the shuffle files of the jobs that made it may go now, as nothing reads them again.

    Spark deletes them once nothing refers to them, which may be long after; asking both collectors frees the disk at once. Results don't
    depend on it, and one machine with its own disk doesn't need it.
    """
    if df.sparkSession.sparkContext.master.startswith("local["):
        return df
    for _ in range(2):  # the first round frees what Python held, the second what that held in the JVM
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.4)
    return df
