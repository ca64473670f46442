"""The link graph: resolution of targets, in-degrees, forward references, neighbours and breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.text import ascii_fold, stem
from notelake.session import written


def keys_of(sources: DataFrame) -> DataFrame:
    """(key, kind, source_id): kind 1 path, 2 root-level stem, 3 folded stem of a nested path, 4 alias."""
    at = F.struct
    base = F.regexp_replace("path", r"\.md$", "")
    own = F.array(
        at(F.col("path").alias("key"), F.lit(1).alias("kind")),
        at(F.when(F.col("path").endswith(".md") & ~F.col("path").contains("/"), base).alias("key"), F.lit(2).alias("kind")),
        at(F.when(F.col("path").endswith(".md") & F.col("path").contains("/"), ascii_fold(F.substring_index(base, "/", -1))).alias("key"), F.lit(3).alias("kind")),
    )
    alias = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: at(a.alias("key"), F.lit(4).alias("kind")))
    return sources.select("source_id", F.explode(F.concat(own, alias)).alias("k")).select("source_id", "k.key", "k.kind").filter("key is not null").distinct()


def candidates(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(src_id, target_path, priority, source_id) by the four kinds of match, as equi-joins on exploded keys."""
    simple = ~F.col("target_path").contains("/") & ~F.col("target_path").contains("\\")
    ask = lambda key, kind, priority: F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))
    t = F.col("target_path")
    # names under a folder end in "/" + stem + ".md", so a stem is compared with the last component
    wants = F.array(ask(F.concat(t, F.lit(".md")), 1, 1), ask(t, 1, 2), ask(F.when(simple, t), 2, 3), ask(F.when(simple, ascii_fold(t)), 3, 3), ask(F.when(simple, t), 4, 4))
    asked = links.select("src_id", "target_path", F.explode(wants).alias("w")).select("src_id", "target_path", "w.*").filter("key is not null")
    return asked.join(keys_of(sources), ["key", "kind"]).select("src_id", "target_path", "priority", "source_id").distinct()


def path_order(sources: DataFrame) -> DataFrame:
    """(source_id, parts): what files are ordered by, component by component."""
    return sources.select("source_id", F.split("path", "/").alias("parts"))


def own_names(sources: DataFrame) -> DataFrame:
    """(source_id, target_path): stem, path without .md and aliases, by which a file claims links that found nothing."""
    path = F.regexp_replace("path", r"\.md$", "")
    return sources.select("source_id", F.explode(F.array_distinct(F.concat(F.array(stem("path"), path), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("target_path"))


def resolve(links: DataFrame, sources: DataFrame, mode: str = "compat") -> DataFrame:
    """(src_id, target_path, dst_id), dst_id null for forward references.

    global: the best match of all notes. compat: as if notes arrived in path order: a link takes the best match among notes up
    to its own, else the first later note that claims the target by name. Where sources have flags known and fresh, notes that are
    known were there before all others, and only fresh ones (read in this run) claim links.
    """
    links = links.select("src_id", "target_path").distinct()
    found = candidates(links, sources)
    if mode == "global":
        best = found.groupBy("src_id", "target_path").agg(F.min(F.struct("priority", "source_id")).alias("b"))
        return links.join(best, ["src_id", "target_path"], "left").select("src_id", "target_path", F.col("b.source_id").alias("dst_id"))
    own = path_order(sources).select(F.col("source_id").alias("src_id"), F.col("parts").alias("own"))
    order, fresh = path_order(sources), sources
    if "known" in sources.columns:
        order = sources.select("source_id", F.when(F.col("known"), F.array().cast("array<string>")).otherwise(F.split("path", "/")).alias("parts"))
        fresh = sources.filter("fresh")
    then = found.join(order, "source_id").join(own, "src_id")
    before = F.when(F.col("priority") == 4, F.col("parts") < F.col("own")).otherwise(F.col("parts") <= F.col("own"))
    first = then.filter(before).groupBy("src_id", "target_path").agg(F.min(F.struct("priority", "source_id")).alias("b"))
    later = links.join(own_names(fresh), "target_path").join(path_order(fresh), "source_id").join(own, "src_id").filter(F.col("parts") >= F.col("own"))
    later = later.groupBy("src_id", "target_path").agg(F.min(F.struct("parts", "source_id")).alias("l"))
    out = links.join(first, ["src_id", "target_path"], "left").join(later, ["src_id", "target_path"], "left")
    return out.select("src_id", "target_path", F.coalesce(F.col("b.source_id"), F.col("l.source_id")).alias("dst_id"))


def forward_refs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Unresolved edges that a source's stem, path without .md or alias now claims, the first source in path order: (src_id, target_path, dst_id)."""
    claims = own_names(sources).join(path_order(sources), "source_id")
    found = edges.filter("dst_id is null").drop("dst_id").join(claims, "target_path")
    return found.groupBy("src_id", "target_path").agg(F.min(F.struct("parts", "source_id")).alias("f")).select("src_id", "target_path", F.col("f.source_id").alias("dst_id"))


def indegree(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, indegree), 0 where nothing links."""
    count = edges.filter("dst_id is not null").groupBy(F.col("dst_id").alias("source_id")).agg(F.count("*").alias("indegree"))
    return sources.select("source_id").join(count, "source_id", "left").select("source_id", F.coalesce("indegree", F.lit(0)).cast("long").alias("indegree"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, source_id): one step out of or into the seeds (query_id, source_id), distinct."""
    e = edges.filter("dst_id is not null").select("src_id", "dst_id")
    out = e.join(seeds, seeds.source_id == e.src_id).select("query_id", F.col("dst_id").alias("source_id"))
    into = e.join(seeds, seeds.source_id == e.dst_id).select("query_id", F.col("src_id").alias("source_id"))
    return out.union(into).distinct()


def bfs(edges: DataFrame, center: int, depth: int, direction: str = "out") -> DataFrame:
    """(source_id, depth): nodes within depth steps at their least depth, without the centre.

    Each front is written, so a step reads the edges and small tables, and the plan doesn't grow with depth.
    """
    a, b = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
    e = edges.filter("dst_id is not null").select(F.col(a).alias("a"), F.col(b).alias("b"))
    spark = edges.sparkSession
    seen = front = spark.createDataFrame([(center, 0)], "source_id long, depth int")
    for d in range(1, depth + 1):
        step = e.join(front, front.source_id == e.a, "left_semi").select(F.col("b").alias("source_id")).distinct()
        front = written(step.join(seen, "source_id", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def bfs_many(edges: DataFrame, centres: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(centre, source_id, depth): for each of centres (source_id), the nodes within depth steps at their least depth, without the centre.

    One iteration over (centre, node) for all centres, so the number of steps is that of one walk. Only the last front is joined with the edges, on the node: a hub that many centres reach
    at once is a skewed key of an ordinary join, which Spark splits; what is found is reduced to distinct pairs before it is compared with what was seen.
    """
    a, b = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
    e = edges.filter("dst_id is not null").select(F.col(a).alias("source_id"), F.col(b).alias("next")).distinct()
    seen = front = written(centres.select(F.col("source_id").alias("centre"), "source_id").distinct().withColumn("depth", F.lit(0)), "walk")
    for d in range(1, depth + 1):
        step = front.join(e, "source_id").select("centre", F.col("next").alias("source_id")).distinct()
        front = written(step.join(seen, ["centre", "source_id"], "left_anti").withColumn("depth", F.lit(d)), "walk")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")
