"""Results as text lines and JSON, and the related-links section of a note."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import preview

EMPTY = '{"schema_version":1,"count":0,"results":[]}'


def as_lines(results: DataFrame) -> DataFrame:
    """(query_id, position, line): score, path[:line], title and a preview of 120 characters."""
    place = F.col("path")
    if "line_start" in results.columns:
        place = F.concat(place, F.when(F.col("line_start") > 0, F.concat(F.lit(":"), F.col("line_start").cast("string"))).otherwise(F.lit("")))
    line = F.concat(F.format_string("%.4f", F.col("score")), F.lit("  "), place, F.lit("  "), F.coalesce("title", F.lit("")), F.lit("\n    "), preview("content", 120))
    return results.select("query_id", "position", line.alias("line"))


def as_json(results: DataFrame, length: int = 200) -> DataFrame:
    """(query_id, json): one payload for each query, its results in order (a query's results are at most top_k)."""
    fields = [c for c in ("source_id", "chunk_id", "path", "title", "score", "indegree", "line_start", "line_end") if c in results.columns]
    item = F.struct(F.col("position"), *fields, preview("content", length).alias("content"))
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    return rows.select("query_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.size("results").alias("count"), "results")).alias("json"))


def with_related(content: Column, target: str) -> Column:
    """The note with ``- [[target]]`` in its Related section, made at the end if missing; unchanged if it is there already."""
    link = f"[[{target}]]"
    line = F.lit(f"- {link}\n")
    heading = r"(?dm)^## Related[ \t]*$\n?"
    parts = F.split(content, heading, 2)
    head = F.substring(content, F.lit(1), F.length(content) - F.length(F.get(parts, F.lit(1))))
    rest = F.get(parts, F.lit(1))
    section = F.get(F.split(rest, r"(?dm)^## ", 2), F.lit(0))
    after = rest.substr(F.length(section) + 1, F.length(rest))
    body = F.regexp_replace(section, r"\s+$", "")
    filled = F.concat(head, body, F.lit("\n"), line, after)
    empty = F.concat(head, F.lit("\n"), line, after)
    made = F.concat(content, F.when((content != "") & ~content.endswith("\n"), F.lit("\n")).otherwise(F.lit("")), F.lit("\n## Related\n\n"), line)
    return F.when(F.size(parts) < 2, made).when(F.contains(section, F.lit(link)), content).when(body == "", empty).otherwise(filled)


def status_json(counts: dict[str, int]) -> str:
    """The status payload: counts of the index, and of files that are new, stale or missing."""
    fresh = {k: counts.get(k, 0) for k in ("new", "stale", "missing")}
    return json.dumps({"schema_version": 1, "index": {k: v for k, v in counts.items() if k not in fresh}, "freshness": fresh, "fresh": not any(fresh.values())})


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as one JSON file, in any store that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    try:
        out.write(bytearray(json.dumps(report, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()
