"""Folders of markdown files, and tables shaped like them, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as T


def files(spark: SparkSession, root: str, everything: bool = False, valid: bool = True) -> DataFrame:
    """(path, content, mtime) of all *.md files under root that are valid UTF-8; hidden and skipped folders are left out.

    path is relative to root. Line ends become LF. everything: keep hidden and skipped paths, and suffixes in any case, as single-file
    indexing does. valid=False: files of other bytes stay, with null content.
    """
    suffix = "*.[mM][dD]" if everything else "*.md"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root)
    at = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), r"/+", "/")
    base = root.rstrip("/").split("://")[-1]
    base = "/" + base.split(":", 1)[-1].lstrip("/") if ":" in base else base
    rel = F.regexp_replace(F.url_decode(F.replace(at, F.lit("+"), F.lit("%2B"))), "^" + _quoted(base) + "/", "")
    out = read.select(rel.alias("path"), "content", F.col("modificationTime").alias("mtime"))
    text = F.col("content").cast("string")
    out = out.select("path", F.when(F.is_valid_utf8(text), T.normalized_newlines(text)).alias("content"), "mtime")
    if valid:
        out = out.filter("content is not null")
    return out if everything else out.filter(~T.is_hidden("path"))


def _quoted(text: str) -> str:
    import re

    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", text)


def parsed(files: DataFrame) -> DataFrame:
    """files with content_hash, yaml, body, title, tags, aliases and links."""
    yaml = T.frontmatter("content")
    out = files.withColumns({"content_hash": T.content_hash("content"), "yaml": yaml, "body": T.body("content")})
    return out.withColumns({"title": T.title("body", "path"), "tags": T.list_field("yaml", "tags"), "aliases": T.list_field("yaml", "aliases"), "links": T.wiki_links("body")})


def heading(text: Column | str) -> Column:
    """What stands before the first full stop, on one line, 80 characters at most: empty for an empty text and for one that begins with a full stop."""
    return F.trim(F.substring(F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), r"[ \t\n\r]+", " "), 1, 80))


def from_documents(documents: DataFrame, *more: Column) -> DataFrame:
    """A vault made of the documents table, one note each, by one projection: (source_id, path, content), and more columns of documents."""
    n = documents.count()
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit("---\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\naliases: [d"), i, F.lit("]\n---\n# "))
    tail = F.concat(F.lit("\n\nSee [[doc-"), ((F.col("doc_id") * 7 + 3) % n).cast("string"), F.lit("]] and [[d"), ((F.col("doc_id") * 5 + 1) % n).cast("string"), F.lit("]]."))
    return documents.select(F.col("doc_id").alias("source_id"), F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), i, F.lit(".md")).alias("path"), F.concat(head, heading("text"), F.lit("\n\n"), "text", tail).alias("content"), *more)


def numbered(files: DataFrame, start: int = 1) -> DataFrame:
    """files with source_id in path order, component by component: a rank within each top-level folder plus the folder's offset."""
    from pyspark.sql import Window

    parts = F.split("path", "/")
    first = files.withColumn("_top", F.element_at(parts, 1)).withColumn("_parts", parts)
    sizes = first.groupBy("_top").agg(F.count("*").alias("_n"))
    offset = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_top").orderBy("_parts"))
    return first.join(offset, "_top").withColumn("source_id", (F.col("_before") + rank + (start - 1)).cast("long")).drop("_top", "_parts", "_before")


def query_file(spark: SparkSession, path: str) -> list[dict]:
    """The items of a query set in a JSON file (a list, or one item on each line), or in YAML where a YAML reader is installed."""
    import json

    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; JSON needs nothing") from e
        return yaml.safe_load(text) or []
    return json.loads(text) if text.lstrip().startswith("[") else [json.loads(x) for x in text.splitlines() if x.strip()]


def query_specs(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Query sets (parsed YAML or JSON) as rows; expected paths get grade 3, graded labels override, bad grades are errors."""
    rows = []
    for i, q in enumerate(items):
        if not q.get("query"):
            raise ValueError(f"query {i} has no text")
        graded = dict.fromkeys(q.get("expected_paths") or [], 3.0)
        for path, grade in (q.get("relevance") or {}).items():
            if isinstance(grade, bool) or not isinstance(grade, (int, float)) or grade < 0:
                raise ValueError(f"grade of {path!r} must be a number of at least 0")
            graded[path] = float(grade)
        rows.append((i, q["query"], q.get("intent") or "", list(q.get("expected_paths") or []), graded, list(q.get("tags") or []), list(q.get("expansion") or [])))
    return spark.createDataFrame(rows, "query_id long, query string, intent string, expected_paths array<string>, relevance map<string,double>, tags array<string>, expansion array<string>")


def windows(files: DataFrame, path: str, line: int | None = None, count: int | None = None, context: int | None = None) -> DataFrame:
    """The lines asked of one file: all of it, or count (100) from line, or line with context on both sides. Lines under 1 count as 1."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"{path!r} leads out of the vault")
    one = files.filter(F.col("path") == path)
    if line is None:
        lines: Column = F.col("content") if count is None else T.line_window("content", 1, count)
    else:
        start = max(1, line)
        first, n = (max(1, start - context), start - max(1, start - context) + context + 1) if context is not None else (start, 100 if count is None else count)
        lines = T.line_window("content", first, n)
    return one.select("path", lines.alias("lines"))
