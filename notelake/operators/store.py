"""The index as versioned snapshots of Parquet tables: lookups, change detection, upserts, deletes, pruning, freshness, suggestions.

A version is a numbered manifest that names the segments and the schema of each table. A segment is a folder of rows, with the keys whose rows in
older segments it takes the place of; a table is what is left of all its segments, so a change writes its own rows and keys and nothing else. Counts (SUMMED) are tables whose
segments are added up. Segments of like size are merged when their number passes MOST_SEGMENTS, so a row is rewritten a logarithmic number of times. Publishing writes the tables that changed into new folders, then the
manifest under a temporary name, and renames it to the next number; nothing is ever deleted or overwritten on the way. So readers
find the last complete manifest and see its version whole, a writer that dies leaves the last one in force, and of two
writers of one number one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 2
TABLES = (
    "sources", "chunks", "vectors", "edges", "tags", "suggestions", "files",
    "text_postings", "text_terms", "text_stats", "name_postings", "name_terms", "name_stats",
)
# The columns of a source that may be updated.
SOURCE_COLUMNS = ("path", "title", "content_hash", "status", "indegree", "fs_modified_at", "indexed_at", "aliases")
# The key by which a change takes rows of a table away, and tables whose rows are added up by their keys.
KEYS = {
    "sources": "source_id", "chunks": "source_id", "vectors": "chunk_id", "edges": "src_id", "tags": "source_id", "suggestions": "suggestion_id", "files": "path",
    "text_postings": "chunk_id", "name_postings": "source_id",
}
SUMMED = {"text_terms": ("df", "bucket", "term"), "name_terms": ("df", "bucket", "term"), "text_stats": ("n_rows",), "name_stats": ("n_rows",)}
MOST_SEGMENTS, LIKE, FEW_ROWS, MOST_KEYS, PAGE_ROWS = 6, 4, 100_000, 1_000_000, 2_000
SUGGESTIONS = "suggestion_id long, source_note_id long, target_note_id long, score double, reason string, status string, created_at timestamp, resolved_at timestamp"


class CapabilityError(RuntimeError):
    """The store is newer than this package, or Spark is too old."""


def check_capabilities(spark: SparkSession) -> None:
    if tuple(int(x) for x in spark.version.split(".")[:2]) < (4, 1):
        raise CapabilityError(f"Spark 4.1 or later is needed, not {spark.version}")


class PublishConflict(RuntimeError):
    """Another writer published the next version first."""


@dataclass(frozen=True)
class Change:
    """What a change does to a table: rows come, and rows of these keys (a table of the key's column) go first."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


def added_up(name: str, rows: DataFrame) -> DataFrame:
    """A table of counts from the rows of its segments."""
    value, *by = SUMMED[name]
    if not by:
        return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])
    how = {c: F.max if c in ("best", "top", "high") else F.min if c == "low" else F.sum for c in rows.columns if c not in by}
    out = rows.groupBy(*by).agg(*[f(c).alias(c) for c, f in how.items()])
    # terms that are gone count no more, but that some of their postings went must be known to those who add this up further
    return out.filter((F.col(value) != 0) | (F.col("removed") != 0) if "removed" in how else F.col(value) != 0).select(*rows.columns)


def counted(name: str, table: DataFrame) -> DataFrame:
    """A table as readers see it: counts that came to nothing are left out."""
    value, *by = SUMMED.get(name, ("",))
    return table.filter(F.col(value) > 0) if by else table


def applied(name: str, table: DataFrame, change: Change, few: bool = True) -> DataFrame:
    """The table after the change. few: the keys were counted to be few enough for a broadcast."""
    if name in SUMMED:
        return counted(name, added_up(name, table.unionByName(change.rows.select(*table.columns))))
    if change.gone is not None:
        table = table.join(F.broadcast(change.gone) if few else change.gone, KEYS[name], "left_anti").select(*table.columns)
    return table if change.rows is None else table.unionByName(change.rows.select(*table.columns))


@dataclass(frozen=True)
class Store:
    """Snapshots under root."""

    root: str

    def number(self, spark: SparkSession) -> int:
        """Of the last complete manifest, 0 if there is none."""
        fs, path = _fs(spark, f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max([int(n) for n in names if n.isdigit()], default=0)

    def manifest(self, spark: SparkSession, number: int | None = None) -> dict | None:
        n = self.number(spark) if number is None else number
        if not n:
            return None
        fs, path = _fs(spark, f"{self.root}/manifests/{n}")
        stream = fs.open(path)
        try:
            found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        # a table of an older manifest is one folder
        found["tables"] = {t: [{"rows": f, "gone": None, "keys": 0, "bytes": _bytes(spark, f"{self.root}/{f}")}] if isinstance(f, str) else f for t, f in found["tables"].items()}
        if found["schema_version"] > SCHEMA_VERSION:
            raise CapabilityError(f"the store has schema {found['schema_version']}, this package knows {SCHEMA_VERSION}")
        return found

    def version(self, spark: SparkSession) -> str | None:
        found = self.manifest(spark)
        return None if found is None else found["version"]

    def has(self, spark: SparkSession, name: str) -> bool:
        return name in ((self.manifest(spark) or {}).get("tables") or {})

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.read_all(spark, name)[name]

    def read_all(self, spark: SparkSession, *names: str) -> dict[str, DataFrame]:
        """Tables of one version (all that it has, if none are named)."""
        found = self.manifest(spark)
        if found is None:
            raise FileNotFoundError(f"no index in {self.root}")
        return {n: counted(n, self.of_segments(spark, n, found["tables"][n], found["schemas"][n])) for n in names or found["tables"]}

    def rows_of(self, spark: SparkSession, folder: str, schema: dict | StructType) -> DataFrame:
        return spark.read.schema(schema if isinstance(schema, StructType) else StructType.fromJson(schema)).parquet(f"{self.root}/{folder}")

    def of_segments(self, spark: SparkSession, name: str, segments: list[dict], schema: dict) -> DataFrame:
        """The rows that are left of segments, old to new."""
        rows = [self.rows_of(spark, s["rows"], schema) for s in segments]
        if name in SUMMED:
            return rows[0] if len(rows) == 1 else added_up(name, _union(rows))
        out = rows[-1]
        gone, keys = None, 0
        for seg, newer in zip(rows[-2::-1], segments[:0:-1]):
            if newer["gone"]:
                own = self.rows_of(spark, newer["gone"], StructType([StructType.fromJson(schema)[KEYS[name]]]))
                gone, keys = own if gone is None else gone.unionByName(own), keys + newer["keys"]
            if gone is not None:  # the number of keys was counted when they were written
                seg = seg.join(F.broadcast(gone) if keys <= MOST_KEYS else gone, KEYS[name], "left_anti").select(*seg.columns)
            out = seg.unionByName(out)
        return out

    def segment(self, spark: SparkSession, folder: str, rows: DataFrame, gone: DataFrame | None = None, few: bool = False) -> dict:
        """Write a segment. few: of so few rows that one file holds them; else a table of postings has a folder for each bucket."""
        out = {"rows": folder, "gone": None, "keys": 0}
        if few:
            _sorted(rows.coalesce(1)).write.parquet(f"{self.root}/{folder}")
        elif "positions" in rows.columns:  # postings come sorted, and are written in small pages, so that scans can skip
            rows.write.partitionBy("bucket").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.root}/{folder}")
        else:
            (_sorted(rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, "term")) if "term" in rows.columns else rows).write.parquet(f"{self.root}/{folder}")
        if gone is not None:
            at = f"{folder}-gone"
            keys = gone.distinct()
            out["keys"] = keys.count()
            (keys.coalesce(1) if out["keys"] <= FEW_ROWS else keys).write.parquet(f"{self.root}/{at}")
            out["gone"] = at
        return out | {"bytes": sum(_bytes(spark, f"{self.root}/{f}") for f in (out["rows"], out["gone"]) if f)}

    def publish(self, spark: SparkSession, tables: dict[str, DataFrame | Callable], schema_version: int = SCHEMA_VERSION) -> str:
        """Write the given tables whole as a new version; the others stay as they are in the current one, without being written again.

        A function among them gets the tables as written before it.
        """
        n, version = self.number(spark), uuid.uuid4().hex
        old = self.manifest(spark, n) if n else None
        named, schemas = (dict(old["tables"]), dict(old["schemas"])) if old else ({}, {})
        done: dict[str, DataFrame] = {}
        for name, df in sorted(tables.items(), key=lambda x: callable(x[1])):
            df = df(done) if callable(df) else df
            named[name], schemas[name] = [self.segment(spark, f"data/{version}/{name}", df)], df.schema.jsonValue()
            done[name] = self.rows_of(spark, named[name][0]["rows"], df.schema)
        self._commit(spark, n + 1, {"schema_version": schema_version, "version": version, "tables": named, "schemas": schemas})
        return version

    def change(self, spark: SparkSession, changes: dict[str, Change], tries: int = 5) -> str:
        """Publish a version with a segment more for each changed table.

        A writer that comes second puts its segments on top of the other's version, if the other has touched other keys only; else it fails.
        """
        n, version = self.number(spark), uuid.uuid4().hex
        base = now = self.manifest(spark, n)
        if base is None:
            raise FileNotFoundError(f"no index in {self.root}")
        made: dict[str, dict] = {}
        for name, c in changes.items():
            like = StructType.fromJson(base["schemas"][name])
            rows = spark.createDataFrame([], like) if c.rows is None else c.rows.select(*like.fieldNames())
            few = c.rows is None or rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS
            made[name] = self.segment(spark, f"data/{version}/{name}", rows, None if c.gone is None or name in SUMMED else c.gone.select(KEYS[name]), few)
        for _ in range(tries):
            named = {t: list(s) for t, s in now["tables"].items()}
            for name, seg in made.items():
                named[name] = self.merged(spark, name, [*named[name], seg], now["schemas"][name], version)
            try:
                self._commit(spark, n + 1, {**now, "version": version, "tables": named})
                return version
            except PublishConflict:
                n = self.number(spark)
                now = self.manifest(spark, n)
                self._apart(spark, base, now, made)
        raise PublishConflict(f"{self.root} is written by others all the time")

    def _apart(self, spark: SparkSession, base: dict, now: dict, made: dict[str, dict]) -> None:
        """Raise unless what others have added to the base touches other keys than these segments."""
        for name, seg in made.items():
            own, theirs = base["tables"][name], now["tables"].get(name, [])
            if theirs[: len(own)] != own:
                raise PublishConflict(f"{name} of {self.root} was written whole by another writer")
            if name in SUMMED:
                continue
            key = KEYS[name]
            schema = StructType.fromJson(base["schemas"][name])
            keys = lambda s: _union([self.rows_of(spark, s["rows"], schema).select(key), *([self.rows_of(spark, s["gone"], StructType([schema[key]]))] if s["gone"] else [])])
            for other in theirs[len(own) :]:
                if not keys(other).join(keys(seg), key, "left_semi").isEmpty():
                    raise PublishConflict(f"{name} of {self.root}: another writer changed the same {key}")

    def merged(self, spark: SparkSession, name: str, segments: list[dict], schema: dict, version: str) -> list[dict]:
        """The segments; where there are too many, the newest of like size as one."""
        if len(segments) <= MOST_SEGMENTS:
            return segments
        take = 2
        while take < len(segments) and segments[-take - 1]["bytes"] <= LIKE * sum(s["bytes"] for s in segments[-take:]):
            take += 1
        last, older = segments[-take:], segments[:-take]
        rows = self.of_segments(spark, name, last, schema)
        gone = [self.rows_of(spark, s["gone"], StructType([StructType.fromJson(schema)[KEYS[name]]])) for s in last if s["gone"]] if older and name not in SUMMED else []
        few = rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS
        if "positions" in rows.columns and not few:
            rows = _sorted(rows.repartition("bucket"))
        return [*older, self.segment(spark, f"data/{version}/{name}-merged-{uuid.uuid4().hex[:8]}", rows, _union(gone) if gone else None, few)]

    def _commit(self, spark: SparkSession, number: int, found: dict) -> None:
        fs, draft = _fs(spark, f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(found).encode()))
        finally:
            out.close()
        _, final = _fs(spark, f"{self.root}/manifests/{number}")
        if fs.exists(final) or not fs.rename(draft, final):
            raise PublishConflict(f"version {number} of {self.root} was published by another writer")

    def migrate(self, spark: SparkSession) -> bool:
        """Bring an older schema to this one; whether there was anything to do."""
        found = self.manifest(spark)
        if found is None or found["schema_version"] >= SCHEMA_VERSION:
            return False
        self.publish(spark, {"sources": migrated(self.read(spark, "sources"))})
        return True


def _sorted(rows: DataFrame) -> DataFrame:
    """Postings by bucket, term and falling impact, terms by name; other tables as they are."""
    if "positions" in rows.columns:
        return rows.sortWithinPartitions("bucket", "term", *([F.desc("impact")] if "impact" in rows.columns else []))
    return rows.sortWithinPartitions("term") if "term" in rows.columns else rows


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _bytes(spark: SparkSession, folder: str) -> int:
    fs, path = _fs(spark, folder)
    return fs.getContentSummary(path).getLength()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


# ---- lookups


def sources_by(sources: DataFrame, column: str, values: list) -> DataFrame:
    """Sources of these ids, uids or paths."""
    if column not in ("source_id", "uid", "path"):
        raise ValueError(f"sources are looked up by source_id, uid or path, not {column}")
    return sources.filter(F.col(column).isin(list(values)))


def listed_sources(sources: DataFrame, status: str | None = None) -> DataFrame:
    return sources if status is None else sources.filter(F.col("status") == status)


def chunks_of(chunks: DataFrame, source_ids: list[int]) -> DataFrame:
    """The chunks of these sources with their places in order."""
    own = chunks.filter(F.col("source_id").isin(list(source_ids)))
    return own.withColumn("position", F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_index")))


def chunks_by_id(chunks: DataFrame, chunk_ids: list[int]) -> DataFrame:
    return chunks.filter(F.col("chunk_id").isin(list(chunk_ids)))


def tags_of(tags: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, tags): each source's distinct tags, sorted."""
    return tags.join(sources.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def with_tags(tags: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags with more (source_id, tag), one row: how many were new)."""
    fresh = more.select("source_id", "tag").distinct().join(tags, ["source_id", "tag"], "left_anti")
    return tags.select("source_id", "tag").unionByName(fresh), fresh.agg(F.count("*").alias("added"))


def linked(edges: DataFrame, more: DataFrame) -> DataFrame:
    """edges with more (src_id, target_path, dst_id); a link that is there already stays as it is."""
    return inserted_or_ignored(edges, more, ["src_id", "target_path"])


def unlinked(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges without those out of these sources."""
    return edges.join(sources.select(F.col("source_id").alias("src_id")).distinct(), "src_id", "left_anti").select(*edges.columns)


def inserted(sources: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """sources with rows (path, ...) added: next numbers in path order, unprocessed unless they say otherwise; paths that are there already are an error."""
    if not rows.join(sources.select("path"), "path", "left_semi").isEmpty() or rows.groupBy("path").count().filter("count > 1").count():
        raise ValueError("a source of that path exists")
    from notelake.sources.vault import numbered

    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("m")).first()["m"]
    when = now if now is not None else F.current_timestamp()
    given = numbered(rows, top + 1)
    defaults = {"status": F.lit("unprocessed"), "created_at": when, "updated_at": when, "uid": uid_of(F.col("path"), F.col("source_id"))}
    given = given.withColumns({c: v for c, v in defaults.items() if c not in given.columns})
    return sources.unionByName(given.select(*[F.col(c) if c in given.columns else F.lit(None).cast(sources.schema[c].dataType).alias(c) for c in sources.columns]))


def uid_of(path: Column, source_id: Column) -> Column:
    """A source's lasting name, made once when it is added: it stays when the path changes."""
    return F.sha2(F.concat_ws("\u0000", path, source_id.cast("string")), 256)


def renamed(sources: DataFrame, moves: DataFrame) -> DataFrame:
    """sources after moves (old_path, new_path): the path changes, number and uid stay."""
    m = moves.select(F.col("old_path").alias("path"), F.col("new_path").alias("_new"))
    out = sources.join(m, "path", "left")
    return out.withColumn("path", F.coalesce("_new", "path")).select(*sources.columns)


# ---- changes


def migrated(sources: DataFrame) -> DataFrame:
    """Sources of schema 1 with the columns that schema 2 added."""
    out = sources
    if "aliases" not in out.columns:
        out = out.withColumn("aliases", F.array().cast("array<string>"))
    return out if "tags" in out.columns else out.withColumn("tags", F.array().cast("array<string>"))


def changes(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or gone, from (path, content_hash) of both sides."""
    a, b = files.select("path", F.col("content_hash").alias("now")), sources.select("path", F.col("content_hash").alias("was"))
    kind = F.when(F.col("was_here").isNull(), "new").when(F.col("is_here").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("changed")
    return a.withColumn("is_here", F.lit(1)).join(b.withColumn("was_here", F.lit(1)), "path", "full_outer").select("path", kind.alias("change"))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows replacing those of equal keys (copy on write)."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def inserted_or_ignored(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def updated(table: DataFrame, where: Column, now: Column | None = None, **values) -> DataFrame:
    """Set allowed source columns where the condition holds, and updated_at."""
    if unknown := set(values) - set(SOURCE_COLUMNS):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    if not values:
        return table
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    if "updated_at" in table.columns:
        given["updated_at"] = now if now is not None else F.current_timestamp()
    return table.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in given.items()})


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after deleting the sources in gone (source_id): cascades, vectors too, and links into them become unresolved."""
    out = dict(tables)
    ids = gone.select("source_id").distinct()
    anti = lambda df, c: df.join(ids.withColumnRenamed("source_id", c), c, "left_anti").select(*df.columns)
    if {"vectors", "chunks"} <= set(out):
        lost = out["chunks"].join(ids, "source_id", "left_semi").select("chunk_id")
        out["vectors"] = out["vectors"].join(lost, "chunk_id", "left_anti").select(*out["vectors"].columns)
    for name, c in (("sources", "source_id"), ("chunks", "source_id"), ("tags", "source_id"), ("edges", "src_id"), ("suggestions", "source_note_id")):
        if name in out:
            out[name] = anti(out[name], c)
    if "suggestions" in out:
        out["suggestions"] = anti(out["suggestions"], "target_note_id")
    if "edges" in out:
        e, hit = out["edges"], ids.withColumnRenamed("source_id", "dst_id").withColumn("_gone", F.lit(True))
        out["edges"] = e.join(hit, "dst_id", "left").withColumn("dst_id", F.when(F.col("_gone").isNull(), F.col("dst_id"))).select(*e.columns)
    return out


def pruned(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources whose path was not seen: (source_id, path)."""
    return sources.join(seen.select("path").distinct(), "path", "left_anti").select("source_id", "path")


def freshness(files: DataFrame, sources: DataFrame, slack_s: int = 2) -> DataFrame:
    """(path, state): new (on disk only), missing (indexed only), stale (changed over slack_s after indexing, or never stamped)."""
    f, s = files.select("path", "mtime").withColumn("_f", F.lit(1)), sources.select("path", "indexed_at").withColumn("_s", F.lit(1))
    late = F.col("indexed_at").isNull() | (F.unix_micros(F.col("mtime").cast("timestamp")) - F.unix_micros(F.col("indexed_at").cast("timestamp")) > slack_s * 1_000_000)
    state = F.when(F.col("_s").isNull(), "new").when(F.col("_f").isNull(), "missing").when(late, "stale")
    return f.join(s, "path", "full_outer").select("path", state.alias("state")).filter("state is not null")


def stats(sources: DataFrame, chunks: DataFrame, edges: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row: notes_total, notes_unprocessed, chunks_total, links_total, suggestions_pending."""
    one = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    parts = [
        one(sources, notes_total=F.count("*"), notes_unprocessed=F.count_if(F.col("status") != "indexed")), one(chunks, chunks_total=F.count("*")),
        one(edges, links_total=F.count("*")), one(suggestions, suggestions_pending=F.count_if(F.col("status") == "pending")),
    ]
    long = None
    for p in parts:
        row = p.select(F.explode(F.create_map(*[x for c in p.columns for x in (F.lit(c), F.col(c))])).alias("k", "v"))
        long = row if long is None else long.unionByName(row)
    names = [c for p in parts for c in p.columns]
    return long.agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in names])


# ---- suggestions


def suggested(suggestions: DataFrame, rows: DataFrame, at: Column | None = None) -> DataFrame:
    """suggestions with rows (source_note_id, target_note_id, score, reason) added as pending, numbered onwards by pair.

    A pair that is pending already, or repeated, is left out.
    """
    new = rows.groupBy("source_note_id", "target_note_id").agg(F.max(F.struct("score", "reason")).alias("s"))
    new = new.join(suggestions.filter("status = 'pending'").select("source_note_id", "target_note_id"), ["source_note_id", "target_note_id"], "left_anti")
    top = suggestions.agg(F.coalesce(F.max("suggestion_id"), F.lit(0)).alias("m"))
    # pairs of one source are numbered together, sources by the running sum of their pairs (one short row for each source)
    per = new.groupBy("source_note_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_note_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("source_note_id").orderBy("target_note_id"))
    new = new.withColumn("place", place).join(per.withColumn("before", before).drop("n"), "source_note_id").join(F.broadcast(top))
    when = at if at is not None else F.current_timestamp()
    new = new.select((F.col("m") + F.col("before") + F.col("place")).alias("suggestion_id"), "source_note_id", "target_note_id", F.col("s.score").alias("score"), F.col("s.reason").alias("reason"), F.lit("pending").alias("status"), when.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    return suggestions.unionByName(new.select(*suggestions.columns))


def pending(suggestions: DataFrame) -> DataFrame:
    """Pending suggestions, best score first, ties by number."""
    return suggestions.filter("status = 'pending'").orderBy(F.desc("score"), "suggestion_id")


def is_pending(suggestions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (source_note_id, target_note_id) with a flag."""
    known = suggestions.filter("status = 'pending'").select("source_note_id", "target_note_id").distinct().withColumn("is_pending", F.lit(True))
    return pairs.join(known, ["source_note_id", "target_note_id"], "left").withColumn("is_pending", F.coalesce("is_pending", F.lit(False)))


def resolved_suggestions(suggestions: DataFrame, decisions: DataFrame, at: Column | None = None) -> DataFrame:
    """Pending suggestions take the decision (suggestion_id, decision) approved or rejected; others stay as they are."""
    d = decisions.groupBy("suggestion_id").agg(F.min("decision").alias("decision"))
    goes = (F.col("status") == "pending") & F.col("decision").isin("approved", "rejected")
    out = suggestions.join(d, "suggestion_id", "left")
    columns = {"status": F.when(goes, F.col("decision")).otherwise(F.col("status"))}
    if "resolved_at" in suggestions.columns:
        columns["resolved_at"] = F.when(goes, at if at is not None else F.current_timestamp()).otherwise(F.col("resolved_at"))
    return out.withColumns(columns).select(*suggestions.columns)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_rn = 1").drop("_rn")
