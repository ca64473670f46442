"""Landing rows in daily files and compacting the small ones, executed on real Parquet files.

A row's day is its arrival in whole days since 1970; days with more rows than a share of the table are dealt to lots by the
key's crc32, and each lot to pieces, so no file outgrows a fixed share of the table, whatever day or key is hot. Each (day, lot, piece) is one
file, written by one task that streams its sorted rows.

The small files of a day are packed by first fit in descending size, all days of a block in lockstep: a matrix holds what is left in each
group of each day; at each size rank one boolean argmax finds, for every day at once, the earliest group with room. An untouched column
always has room and comes after all that are in use, so opening a group needs no case of its own. Blocks of days are rows of a grouped
pandas function, which sees one row for each file.

A group of several files is rewritten as one, its sources' rows in joining order and in the order they have in their files; then the sources are
deleted. Everything else keeps its bytes. The rewritten files are committed by Spark's writer before any source goes, so a lost
executor costs a task and not a row; a run that fails as a whole leaves its folder behind, and the next call takes another.

What the driver sees is the table's row count and, one at a time, the paths to delete; the number of files is bounded by
4 x (days + lots), whatever the number of rows. Days and files are broadcast where they were counted to be at most MOST_BROADCAST, and joined otherwise.

Edge cases: rows without an arrival have a day of their own (null in the report); a null key has crc32 0 and an empty decimal; values that are
null or not finite count 0 cents; repeated rows are kept; ties of arrival and key are broken by the other columns; an empty table has no file and an
empty report; columns of any name are kept in table order (the folders' names give way to them).
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.text import batch_of, values
from notelake.session import parts_for, shared_dir, written

NO_DAY = -(1 << 40)
MOST_BROADCAST = 100_000
DAYS_IN_BLOCK = 16
PLAN_DDL = "day long, lot long, piece long, n_rows long, first_lot long, first_piece long, place long, members long, sources string"
DIGESTS = pa.schema([("day", pa.int64()), ("lot", pa.int64()), ("piece", pa.int64()), ("n_rows", pa.int64()), ("min_key", pa.int64()), ("max_key", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string())])
DIGESTS_DDL = "day long, lot long, piece long, n_rows long, min_key long, max_key long, cents long, ids_sha256 string"


@dataclass(frozen=True)
class Shares:
    """Sizes as shares of the table: 1 + floor(rows / share) rows. A file under ``small`` is packed into groups of at most ``group``."""

    lot: int = 200
    small: int = 750
    group: int = 300

    def __post_init__(self):
        if not 0 < self.group <= self.small:
            raise ValueError(f"a small file must fit into a group: {self}")


def share(total: int, of: int) -> int:
    return 1 + total // of


@dataclass(frozen=True)
class Landed:
    """A folder of files, one for each folder of (day, lot, piece); names are the folders' column names."""

    path: str
    schema: T.StructType
    names: tuple[str, str, str]
    total: int

    def rows(self, spark: SparkSession) -> DataFrame:
        found = T.StructType([*self.schema.fields, *(T.StructField(n, T.LongType()) for n in self.names)])
        return spark.read.schema(found).parquet(self.path)


def day_of(when: str) -> Column:
    return F.coalesce(F.unix_date(F.col(f"`{when}`").cast("date")).cast("long"), F.lit(NO_DAY))


def hinted(df: DataFrame) -> DataFrame:
    """df, a written table, for the small side of a join: broadcast only where it was counted to be small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def folders(columns: list[str]) -> tuple[str, str, str]:
    """Names for the folders' columns that the table's columns leave free."""
    taken, end = {c.lower() for c in columns}, ""
    while any(f"by_{n}{end}" in taken for n in ("day", "lot", "piece")):
        end += "_"
    return f"by_day{end}", f"by_lot{end}", f"by_piece{end}"


def written_by_key(rows: DataFrame, parts: int, columns: list[str], names: tuple[str, str, str], order: list[Column], path: str, mode: str) -> None:
    """One file for each distinct names, its rows by order. rows: columns, names and whatever order needs."""
    dealt = rows.repartition(parts, *names).sortWithinPartitions(*names, *order)
    dealt.select(*[F.col(f"`{c}`") for c in [*columns, *names]]).write.mode(mode).partitionBy(*names).option("maxRecordsPerFile", 0).parquet(path)


def land(rows: DataFrame, path: str, when: str, key: str, shares: Shares = Shares()) -> Landed:  # noqa: B008
    """Write rows into the new folder path, one sorted file for each day, lot and piece."""
    days = written(rows.groupBy(day_of(when).alias("day")).agg(F.count("*").alias("n")), "compact-days")
    total = days.agg(F.sum("n")).first()[0] or 0
    names = folders(rows.columns)
    lots = days.select(F.col("day").alias(names[0]), (F.floor(F.col("n") / share(total, shares.lot)) + 1).cast("long").alias("_lots"))
    h = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(0)).cast("long")
    with_h = rows.withColumn(names[0], day_of(when)).withColumn("_h", h).join(hinted(lots), names[0])
    marked = with_h.withColumns({names[1]: F.shiftright("_h", 4) % F.col("_lots"), names[2]: F.least(F.col("_h") % 4, F.shiftright("_h", 2) % 4)})
    orderable = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = [F.col(f"`{c}`") for c in dict.fromkeys([when, key, *orderable])]
    written_by_key(marked, parts_for(rows), rows.columns, names, order, path, "errorifexists")
    return Landed(path, rows.schema, names, total)


def files(landed: Landed, spark: SparkSession) -> DataFrame:
    """(day, lot, piece, n_rows, path) of the folder's files."""
    rows = landed.rows(spark)
    keys = [F.col(n).alias(k) for n, k in zip(landed.names, ("day", "lot", "piece"))]
    return rows.groupBy(*keys, F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))


def lockstep(sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each file. sizes: a row for each day, its files' sizes in the order in which they join, 0 behind the last."""
    days, ranks = sizes.shape
    left, group, every = np.full((days, max(1, ranks)), most, np.int64), np.zeros(sizes.shape, np.int64), np.arange(days)
    for k in range(ranks):
        need = sizes[:, k]
        at = (left >= need[:, None]).argmax(axis=1)
        left[every, at] -= need
        group[:, k] = at
    return group


def packed_block(found: pd.DataFrame, small: int, most: int) -> pd.DataFrame:
    """found: day, lot, piece, n_rows of the files of some days. A row for each file: its group's first file, its place there, and the group's files."""
    found = found.sort_values(["day", "n_rows", "lot", "piece"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
    own = found["n_rows"] < small
    joins = found[own]
    rank = joins.groupby("day", sort=False).cumcount().to_numpy()
    day = joins["day"].to_numpy()
    _, row = np.unique(day, return_inverse=True)
    sizes = np.zeros((row.max() + 1 if len(row) else 0, rank.max() + 1 if len(rank) else 0), np.int64)
    sizes[row, rank] = joins["n_rows"].to_numpy()
    group = np.full(len(found), -1, np.int64)
    group[own.to_numpy()] = lockstep(sizes, most)[row, rank]
    alone = np.flatnonzero(~own.to_numpy())
    group[alone] = -1 - alone  # a group of its own
    found = found.assign(group=group, name=found["lot"].astype(str) + "-" + found["piece"].astype(str))
    by = found.groupby(["day", "group"], sort=False)
    return found.assign(
        first_lot=by["lot"].transform("first"), first_piece=by["piece"].transform("first"), place=by.cumcount(), members=by["lot"].transform("size"), sources=by["name"].transform(",".join),
    )[["day", "lot", "piece", "n_rows", "first_lot", "first_piece", "place", "members", "sources"]]


def packed(found: DataFrame, total: int, shares: Shares = Shares()) -> DataFrame:  # noqa: B008
    """The plan: which files of a day become one."""
    small, most = share(total, shares.small), share(total, shares.group)
    block = F.floor(F.col("day") / DAYS_IN_BLOCK).cast("long")
    rows = found.select("day", "lot", "piece", "n_rows")
    return rows.groupBy(block).applyInPandas(lambda pdf: packed_block(pdf, small, most), PLAN_DDL)


def deleted(spark: SparkSession, paths: DataFrame) -> int:
    """Delete these files, and their folders where nothing is left in them; the driver holds one partition of the paths at a time."""
    conf, jvm, n = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm, 0
    for row in paths.toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row[0]))
        fs = at.getFileSystem(conf)
        fs.delete(at, False)
        if not len(fs.listStatus(at.getParent())):
            fs.delete(at.getParent(), False)
        n += 1
    return n


def compact(spark: SparkSession, landed: Landed, shares: Shares = Shares()) -> DataFrame:  # noqa: B008
    """Rewrite the small files in place. Gives the plan (a row for each file there was), a written table."""
    there = written(files(landed, spark), "compact-files")
    plan = written(packed(there, landed.total, shares), "compact-plan")
    keys = ["day", "lot", "piece"]
    moving = plan.filter("members > 1")
    day, lot, piece = landed.names
    rows = landed.rows(spark).withColumns({"_row": F.col("_metadata.row_index")})
    target = written(moving.select(F.col("day").alias(day), F.col("lot").alias(lot), F.col("piece").alias(piece), "first_lot", "first_piece", "place"), "compact-moves")
    met = rows.join(hinted(target), [day, lot, piece]).withColumns({lot: F.col("first_lot"), piece: F.col("first_piece")})
    written_by_key(met, parts_for(rows), landed.schema.names, landed.names, [F.col("place"), F.col("_row")], landed.path, "append")
    deleted(spark, there.join(moving.select(*keys), keys, "left_semi").select("path"))
    return plan


def digests(landed: Landed, spark: SparkSession, key: str, value: str) -> DataFrame:
    """Of each file there is: rows, least and greatest key, cents, and the sha256 of its keys in file order, by a task that streams them."""

    def run(batches):
        now, state = None, None

        def given():
            n, least, most, cents, sha = state
            return batch_of(DIGESTS, [now[0]], [now[1]], [now[2]], [n], [least], [most], [cents], [sha.hexdigest()])

        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.r_[0, np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                if (own := tuple(at[:, a].tolist())) != now:
                    if now is not None:
                        yield given()
                    now, state = own, (0, None, None, 0, hashlib.sha256())
                part = batch.slice(a, b - a)
                ids = values(part, "key")
                n, least, most, cents, sha = state
                sha.update(((b"," if n else b"") + ",".join("" if i is None else str(i) for i in ids).encode()))
                some = [i for i in (least, most, *ids) if i is not None]
                state = (n + len(ids), min(some, default=None), max(some, default=None), cents + sum(values(part, "cents")), sha)
        if now is not None:
            yield given()

    v = F.col(f"`{value}`").cast("double")
    cents = F.when(v.isNotNull() & (F.abs(v) < 1e300), F.floor(v * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
    rows = landed.rows(spark).select(*[F.col(n).alias(k) for n, k in zip(landed.names, ("day", "lot", "piece"))], F.col("_metadata.row_index").alias("row"), F.col(f"`{key}`").cast("long").alias("key"), cents.alias("cents"))
    return rows.repartition(parts_for(rows), "day", "lot", "piece").sortWithinPartitions("day", "lot", "piece", "row").mapInArrow(run, DIGESTS_DDL)


def compacted(rows: DataFrame, when: str = "arrived_at", key: str = "click_id", value: str = "value", shares: Shares = Shares(), path: str | None = None) -> DataFrame:  # noqa: B008
    """Land rows in a new folder, compact it, and report on each file that is left."""
    spark = rows.sparkSession
    landed = land(rows, path or f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}", when, key, shares)
    none = F.when(F.col("day") != NO_DAY, F.col("day")).alias("day")
    if not landed.total:
        return spark.createDataFrame([], "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean")
    plan = compact(spark, landed, shares)
    left = written(files(landed, spark), "compact-left")
    of_file = digests(landed, spark, key, value).join(left.select("day", "lot", "piece", "path"), ["day", "lot", "piece"])
    first = plan.filter("place = 0").select("day", "lot", "piece", "sources", (F.col("members") > 1).alias("rewritten"))
    held = spark.read.option("mergeSchema", True).parquet(landed.path).columns  # what the files' own footers name
    columns = ",".join(c for c in held if c not in landed.names)
    return of_file.join(first, ["day", "lot", "piece"]).select(
        none, "lot", "piece", "n_rows", F.col("min_key").alias("min_click_id"), F.col("max_key").alias("max_click_id"), "cents", "sources", "ids_sha256", F.lit(columns).alias("columns"), F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), "rewritten",
    )
