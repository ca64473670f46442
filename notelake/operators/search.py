"""Hybrid search: four ranked channels, post-filters, fusion, reranking with title-gated blending, and expansion.

The channels read the stored indexes; what they find (at most a few hundred rows for each query) is kept once, and everything
after works on these rows. Of up to FEW queries it comes to the driver as a local relation (bounded by FEW times the limits), so that what belongs to the found numbers is
read by filters that reach the scans, and no later step shuffles; of more it is a written table that is joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelake.functions.text import col, has_cjk, tokens
from notelake.operators import fts, fuse, links
from notelake.operators.knn import knn
from notelake.session import written

FAST_K, DEEP_K = 5, 20
SHOWN = ("source_id", "path", "title", "tags", "indegree")
CHANNELS = ("bm25", "vector", "title", "indegree", "metadata")
# Fixed values.
TECHNICAL_TERMS = ("向量", "嵌入", "文档", "切块", "算法", "搜索", "检索", "融合", "模型", "数据库", "fsrs", "bm25", "rrf", "rag", "anki", "hybrid", "chunk", "embedding", "vector")
COMPANION_STOPWORDS = ("and", "are", "but", "does", "for", "from", "how", "into", "not", "the", "what", "when", "where", "why", "with")


@dataclass(frozen=True)
class Spec:
    """Settings shared by the queries of one batch."""

    top_k: int = 10
    bm25_weight: float = 1.0
    vec_weight: float = 1.0
    indegree_weight: float = 0.3
    title_weight: float = 1.5
    metadata_weight: float = 1.0
    folder: str | None = None
    path_prefix: str | None = None
    tags: tuple[str, ...] = ()
    expand: bool = False
    rerank_k: int | str = 20
    metadata: bool = False
    metadata_limit: int = 8
    neighbor_min_rank: int = 4
    chunk_limit: int = 50
    title_limit: int = 50
    knn_limit: int = 50
    knn_wide: int = 200
    lenient: bool = False

    @property
    def prefix(self) -> str | None:
        return self.folder or self.path_prefix

    @property
    def filtered(self) -> bool:
        return bool(self.prefix or self.tags)


@dataclass(frozen=True)
class Index:
    """sources(source_id, path, title, aliases, tags, indegree), chunks(chunk_id, source_id, content), vectors(chunk_id, embedding), edges(src_id, dst_id).

    text and names are the full-text indexes of contents and of titles with aliases, made on the fly where none is stored.
    """

    sources: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    edges: DataFrame
    text: fts.TextIndex | None = None
    names: fts.TextIndex | None = None

    def text_index(self) -> fts.TextIndex:
        return self.text or fts.built(self.chunks, "chunk_id", text_columns())

    def name_index(self) -> fts.TextIndex:
        return self.names or fts.built(self.sources, "source_id", name_columns())


def text_columns() -> dict[str, Column]:
    return {"content": F.col("content")}


def name_columns() -> dict[str, Column]:
    return {"title": F.coalesce("title", F.lit("")), "aliases": F.to_json(F.coalesce("aliases", F.array().cast("array<string>")))}


@dataclass(frozen=True)
class Reranker:
    """A scoring model: score(query, passages) -> a number in 0..1 for each passage.

    A query's passages are one row, so it is called once for each query with all of them, however batches fall. Where it is disabled, fails, or gives other than one number for each
    passage, the query keeps its first-stage order.
    """

    score: Callable[[str, list[str]], list[float] | None]
    disabled: bool = False

    def scores(self, rows: DataFrame) -> DataFrame:
        """(query_id, position, p) of rows (query_id, query, position, content), of which a query has a bounded number; p is null where the model failed."""
        score = self.score

        @F.pandas_udf("array<double>")
        def run(queries: pd.Series, passages: pd.Series) -> pd.Series:
            import logging

            out = []
            for q, own in zip(queries, passages, strict=True):
                try:
                    found = [float(x) for x in score(q, list(own))]
                except Exception:  # any model may fail in its own way; the first stage stands
                    logging.getLogger(__name__).warning("reranking failed for %r", q, exc_info=True)
                    found = []
                out.append(found if len(found) == len(own) else [None] * len(own))
            return pd.Series(out, dtype=object)

        head = rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("content", F.lit("")).alias("content")))).alias("h"))
        found = head.withColumn("p", run(F.col("query"), F.col("h.content")))
        return found.select("query_id", F.explode(F.arrays_zip(F.col("h.position").alias("position"), F.col("p").alias("p"))).alias("x")).select("query_id", "x.position", "x.p")


def safe_embed(embed: Callable[[str], list | None], query: str) -> list | None:
    """The query's vector, or None where the embedder fails: its channel stays empty."""
    import logging

    try:
        found = embed(query)
        return None if found is None else [float(x) for x in found]
    except Exception:  # any model may fail in its own way
        logging.getLogger(__name__).warning("embedding failed for %r", query, exc_info=True)
        return None


FEW = 20


def small(df: DataFrame, n_queries: int) -> DataFrame:
    """df, the rows that limits leave of so many queries: a local relation in one partition if the queries are few, else a written table."""
    return df.sparkSession.createDataFrame(df.toArrow()).coalesce(1) if n_queries <= FEW else written(df, "search")


def of_ids(table: DataFrame, column: str, ids: list[int]) -> DataFrame:
    """The rows of these numbers, by a filter that files are skipped by."""
    return table.filter(F.col(column).isin(sorted(set(ids))))


def rerank_budget(query: Column | str, rerank_k: int | str, has_filter: Column | bool, has_title: Column | bool) -> tuple[Column, Column]:
    """(k, reason) for each query."""
    if isinstance(rerank_k, int):
        return F.lit(rerank_k), F.lit("fixed")
    if rerank_k != "auto":
        raise ValueError(f"rerank_k is a number or 'auto', not {rerank_k!r}")
    q = col(query)
    technical = has_cjk(q) & F.exists(F.array(*map(F.lit, TECHNICAL_TERMS)), lambda t: F.contains(F.lower(q), t))
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    pick = lambda a, b, c, d: F.when(as_col(has_filter), a).when(as_col(has_title), b).when(technical, c).otherwise(d)
    return pick(DEEP_K, FAST_K, DEEP_K, FAST_K), pick("filter", "title", "cjk_technical", "default")


def metadata_terms(query: str) -> list[str]:
    """Adjacent pairs of words, then words, of three characters or more; the query itself if it has none."""
    words = [w for w in re.findall("[A-Za-z0-9]+", query.casefold()) if len(w) >= 3]
    found = list(dict.fromkeys([f"{a} {b}" for a, b in zip(words, words[1:])] + words))
    return found or ([query.strip()] if len(query.strip()) >= 3 else [])


def singular(toks: Column) -> Column:
    """The tokens, and those over three letters that end in s also without it."""
    return F.array_union(toks, F.transform(F.filter(toks, lambda t: t.endswith("s") & (F.length(t) > 3)), lambda t: t.substr(F.lit(1), F.length(t) - 1)))


def title_hits(index: Index, queries: list[tuple[int, str]], limit: int, lenient: bool = False) -> DataFrame:
    return fts.hits(index.name_index(), queries, limit, lenient)


def metadata_seeds(index: Index, queries: list[tuple[int, str]], limit: int, titles: DataFrame) -> DataFrame:
    """(query_id, source_id, seed_order): rows of the first term that has any, for queries without a title hit (titles: query_id, ...).

    A single word of a query of three words or more that hits several notes counts only for notes whose names hold another of its words.
    """
    spark = index.sources.sparkSession
    terms = []
    for q, text in queries:
        words = [w for w in re.findall("[A-Za-z0-9]+", text.casefold()) if len(w) >= 3]
        for i, t in enumerate(metadata_terms(text)):
            others = [c for w in words if w != t and w not in COMPANION_STOPWORDS for c in ([w, w[:-1]] if w.endswith("s") and len(w) > 3 else [w])]
            terms.append((len(terms), q, i, t, " " in t, len(words), list(dict.fromkeys(others))))
    if not terms:
        return spark.createDataFrame([], "query_id long, source_id long, seed_order int")
    table = spark.createDataFrame([(n, *x[:2], *x[3:]) for n, *x in terms], "term_id long, query_id long, idx int, pair boolean, n_words int, companions array<string>")
    hits = title_hits(index, [(n, t) for n, _, _, t, *_ in terms], limit).withColumnRenamed("query_id", "term_id")
    names = index.sources.select("source_id", singular(tokens(F.concat_ws(" ", "title", F.array_join("aliases", " "), "path"))).alias("names"))
    rows = names.join(F.broadcast(hits), "source_id").join(F.broadcast(table), "term_id").withColumn("n", F.count("*").over(Window.partitionBy("term_id")))
    plain = F.col("pair") | (F.col("n") <= 1) | (F.col("n_words") < 3) | (F.size("companions") == 0)
    kept = rows.filter(plain | F.arrays_overlap("names", "companions")).join(titles.select("query_id").distinct(), "query_id", "left_anti")
    kept = kept.withColumn("least", F.min("idx").over(Window.partitionBy("query_id"))).filter("idx = least")
    return kept.select("query_id", "source_id", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "source_id")).alias("seed_order"))


def metadata_candidates(index: Index, seeds: DataFrame, base: DataFrame, limit: int, min_rank: int) -> DataFrame:
    """(query_id, source_id, rank): each seed, then its neighbours out and in unless the seed ranks before min_rank; first seen counts."""
    known = seeds.join(base.select("query_id", "source_id", F.col("rank").alias("base")), ["query_id", "source_id"], "left").withColumn("base", F.coalesce("base", F.lit(9999)))
    wide = F.broadcast(known.filter(F.col("base") >= min_rank))  # limit rows for each query
    e = index.edges.filter("dst_id is not null")
    own = known.select("query_id", "seed_order", F.lit(0).alias("kind"), F.lit("").alias("sub"), "source_id")
    out = e.join(wide, wide.source_id == e.src_id).select("query_id", "seed_order", F.lit(1).alias("kind"), F.col("target_path").alias("sub"), F.col("dst_id").alias("source_id"))
    into = e.join(wide, wide.source_id == e.dst_id).select("query_id", "seed_order", F.lit(2).alias("kind"), F.lpad(F.col("src_id").cast("string"), 20, "0").alias("sub"), F.col("src_id").alias("source_id"))
    every = own.union(out).union(into).groupBy("query_id", "source_id").agg(F.min(F.struct("seed_order", "kind", "sub")).alias("seen"))
    return every.select("query_id", "source_id", F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "source_id")).alias("rank")).filter(F.col("rank") <= limit)


def channels(index: Index, queries: list[tuple[int, str, list | None]], spec: Spec) -> dict[str, DataFrame]:
    """ranks (query_id, source_id, channel, rank), fused (query_id, source_id, score), and what the later steps reuse."""
    spark = index.sources.sparkSession
    texts = [(q, t) for q, t, _ in queries if t.strip()]
    vectors = [(q, [float(x) for x in v]) for q, t, v in queries if v is not None and t.strip()]
    k = spec.knn_wide if spec.expand or spec.filtered else spec.knn_limit
    by_text = fts.hits(index.text_index(), texts, spec.chunk_limit, spec.lenient)
    by_vector = knn(index.vectors, vectors, k).withColumnRenamed("distance", "score") if vectors else by_text.limit(0)
    both = by_text.select("query_id", F.lit("bm25").alias("channel"), "chunk_id", "score").unionByName(by_vector.select("query_id", F.lit("vector").alias("channel"), "chunk_id", "score"))
    by_name = title_hits(index, texts, spec.title_limit, spec.lenient).select("query_id", F.lit("title").alias("channel"), F.lit(None).cast("long").alias("chunk_id"), "score", "source_id")
    few = len(queries) <= FEW
    chunks, sources = index.chunks, index.sources
    hits = both.withColumn("source_id", F.lit(None).cast("long")).unionByName(by_name)
    if few:  # limits bound what the channels find
        table = hits.toArrow()
        ids = lambda t, c: [i for i in t[c].to_pylist() if i is not None]
        chunks = of_ids(chunks, "chunk_id", ids(table, "chunk_id"))
        of_chunk = {r["chunk_id"]: r["source_id"] for r in chunks.select("chunk_id", "source_id").collect()}
        where = [s if s is not None else of_chunk.get(c) for c, s in zip(table["chunk_id"].to_pylist(), table["source_id"].to_pylist())]
        shown = of_ids(sources, "source_id", [s for s in where if s is not None]).select(*SHOWN).toArrow()
        sources = spark.createDataFrame(shown).coalesce(1)
        at = {s: i for i, s in enumerate(shown["source_id"].to_pylist())}
        rows = [i for i, s in enumerate(where) if s in at]
        met, own = table.drop_columns("source_id").take(pa.array(rows, pa.int64())), shown.take(pa.array([at[where[i]] for i in rows], pa.int64()))
        for c in ("source_id", "path", "tags", "indegree"):
            met = met.append_column(own.schema.field(c), own[c])
        found = spark.createDataFrame(met).coalesce(1)
    else:
        hits = hits.join(index.chunks.select("chunk_id", F.col("source_id").alias("_own")), "chunk_id", "left").withColumn("source_id", F.coalesce("source_id", "_own")).drop("_own")
        found = small(index.sources.select(*SHOWN).drop("title").join(hits, "source_id"), len(queries))
    best = found.groupBy("query_id", "channel", "source_id", "path", "tags", "indegree").agg(F.min(F.struct("score", F.coalesce("chunk_id", "source_id").alias("chunk_id"))).alias("b")).select("query_id", "channel", "source_id", "path", "tags", "indegree", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("score", "chunk_id")))
    passes = fuse.folder_filter(F.col("path"), spec.prefix) & fuse.tags_filter(F.col("tags"), spec.tags)
    ranks = ranked.filter(passes).select("query_id", "source_id", "channel", "rank", "indegree", "chunk_id")
    bm25, vec = (ranks.filter(F.col("channel") == c).select("query_id", "source_id", "chunk_id") for c in ("bm25", "vector"))
    near = found.filter("channel = 'vector'").select("query_id", "source_id", "chunk_id", F.col("score").alias("distance"))
    ranks = ranks.drop("chunk_id")

    def with_indegree(rows: DataFrame) -> DataFrame:
        pool = rows.select("query_id", "source_id", "indegree").distinct()
        return rows.drop("indegree").unionByName(fuse.ranked(pool, [F.desc("indegree"), "source_id"], "indegree"))

    full = with_indegree(ranks)
    weights = {"bm25": spec.bm25_weight, "vector": spec.vec_weight, "title": spec.title_weight, "indegree": spec.indegree_weight, "metadata": spec.metadata_weight}
    fused = fuse.rrf(full, weights)
    if spec.metadata:
        base = fuse.ranked(fused, [F.desc("score"), "source_id"])
        seeds = small(metadata_seeds(index, texts, spec.metadata_limit, found.filter("channel = 'title'")), len(queries))
        more = small(metadata_candidates(index, seeds, base, spec.metadata_limit, spec.neighbor_min_rank), len(queries))
        if few:
            with_more = {r["source_id"] for t in (found, more) for r in t.select("source_id").collect()}
            sources = small(of_ids(index.sources, "source_id", list(with_more)).select(*SHOWN), 1)
        extra = sources.select("source_id", "path", "tags", "indegree").join(more, "source_id").filter(passes).select("query_id", "source_id", F.lit("metadata").alias("channel"), "rank", "indegree")
        full = with_indegree(ranks.unionByName(small(extra, len(queries))))
        fused = fuse.rrf(full, weights)
    return {"ranks": full, "fused": fused, "bm25": bm25, "vector": vec, "near": near, "chunks": chunks, "sources": sources}


def search(index: Index, queries: list[tuple[int, str, list | None]], spec: Spec = Spec(), reranker: Column | Reranker | None = None) -> DataFrame:  # noqa: B008
    """(query_id, position, source_id, chunk_id, path, title, content, score, indegree), in the order of position.

    queries: (query_id, text, vector or None). reranker: a model, or a column over (query, content) in 0..1, evaluated on the head only.
    """
    if isinstance(reranker, Reranker):
        reranker = None if reranker.disabled else reranker
    spark = index.sources.sparkSession
    queries = [q for q in queries if q[1].strip()] if spec.top_k > 0 else []
    if not queries:
        return spark.createDataFrame([], "query_id long, position int, source_id long, chunk_id long, path string, title string, content string, score double, indegree long")
    got = channels(index, queries, spec)
    sent = F.broadcast if len(queries) <= FEW else lambda df: df  # a few rows for each query go to where contents and names lie
    asked = spark.createDataFrame([(q, t) for q, t, _ in queries], "query_id long, query string")
    title_any = got["ranks"].filter("channel = 'title'").select("query_id").distinct().withColumn("has_title", F.lit(True))
    budget, reason = rerank_budget("query", spec.rerank_k, spec.filtered, F.coalesce("has_title", F.lit(False)))
    asked = asked.join(title_any, "query_id", "left").select("query_id", "query", budget.alias("budget"), reason.alias("reason"))
    rows = got["fused"].join(sent(asked), "query_id")
    cut = F.greatest("budget", F.lit(spec.top_k)) if reranker is not None else F.lit(spec.top_k)
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id"))).filter(F.col("_r") <= cut)
    b, v = got["bm25"].withColumnRenamed("chunk_id", "b"), got["vector"].withColumnRenamed("chunk_id", "v")
    rows = rows.join(b, ["query_id", "source_id"], "left").join(v, ["query_id", "source_id"], "left").withColumn("chunk_id", F.coalesce("b", "v"))
    with_chunk = got["chunks"].select("chunk_id", "content").join(sent(rows.filter("chunk_id is not null")), "chunk_id")
    rows = with_chunk.unionByName(rows.filter("chunk_id is null").withColumn("content", F.lit(None).cast("string")))
    rows = got["sources"].select("source_id", "path", "title", "indegree").join(sent(rows), "source_id")
    rows = rows.withColumn("only_title", F.col("chunk_id").isNull()).withColumn("content", F.when(F.col("only_title"), F.coalesce(F.nullif("title", F.lit("")), "path")).otherwise(F.col("content")))
    rows = rows.withColumn("chunk_id", F.coalesce("chunk_id", F.lit(0)).cast("long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "only_title", "source_id")
    rows = rows.withColumn("position", F.row_number().over(w))
    if reranker is not None:
        rows = blend(rows, got["ranks"], reranker)
    rows = rows.filter(F.col("position") <= spec.top_k)
    columns = ["query_id", "position", "source_id", "chunk_id", "path", "title", "content", "score", "indegree"]
    rows = rows.select(*columns)
    if spec.expand:
        rows = expand(index, small(rows, len(queries)), got["near"], spec, n_queries=len(queries)).select(*columns)
    return rows


def blend(rows: DataFrame, ranks: DataFrame, reranker: Column | Reranker) -> DataFrame:
    """New scores and positions for the head of each query: reranked alone, or blended with the fused score if the gate is open.

    The gate: the best title match or a metadata candidate is in the head. The tail keeps fused scores and stands behind the head.
    """
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("n", F.count("*").over(q)).withColumn("head", (F.col("position") <= F.col("budget")) & (F.least("budget", "n") > 1))
    gate = ranks.filter("(channel = 'title' and rank = 1) or channel = 'metadata'").select("query_id", "source_id").distinct().withColumn("opens", F.lit(True))
    rows = rows.join(gate, ["query_id", "source_id"], "left").withColumn("gate", F.max(F.coalesce("opens", F.lit(False)) & F.col("head")).over(q))
    if isinstance(reranker, Reranker):
        rows = rows.join(reranker.scores(rows.filter("head")), ["query_id", "position"], "left")
    else:
        rows = rows.withColumn("p", F.when(F.col("head"), reranker))
    # a model that failed for any passage of a query leaves its first-stage order
    failed = F.max((F.col("head") & (F.col("p").isNull() | F.isnan("p"))).cast("int")).over(q) == 1
    rows = rows.withColumn("head", F.col("head") & ~failed)
    top_rrf = F.max(F.when(F.col("position") == 1, F.col("score"))).over(q)
    alpha = F.when(F.col("position") <= 3, 0.60).when(F.col("position") <= 10, 0.50).otherwise(0.40)
    rows = rows.withColumn("top_rrf", F.when(top_rrf > 0, top_rrf).otherwise(1.0))
    new = F.when(~F.col("head"), F.col("score")).when(F.col("gate"), alpha * F.col("score") / F.col("top_rrf") + (1 - alpha) * F.col("p")).otherwise(F.col("p"))
    rows = rows.withColumn("score", new)
    order = Window.partitionBy("query_id").orderBy(F.desc("head"), F.when(F.col("head"), -F.col("score")).otherwise(F.col("position").cast("double")), "position")
    return rows.withColumn("position", F.row_number().over(order))


def overlap_scorer(query: str = "query", content: str = "content") -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's tokens that the content has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(content))) / F.size(q))


def expand(index: Index, rows: DataFrame, near: DataFrame, spec: Spec, discount: float = 0.7, n_queries: int = FEW) -> DataFrame:
    """rows with the one-step neighbours of each query's first three results that the wide vector list holds, sorted anew and cut."""
    seeds = rows.filter("position <= 3").select("query_id", "source_id")
    seeds = F.broadcast(seeds) if n_queries <= FEW else seeds
    fresh = links.neighbours(index.edges, seeds).join(rows.select("query_id", "source_id"), ["query_id", "source_id"], "left_anti")
    best = fuse.best_chunk(near.join(fresh, ["query_id", "source_id"], "left_semi"), "distance")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "source_id"))
    more = best.withColumn("score", F.lit(discount * spec.vec_weight) / (F.lit(fuse.K_RRF) + rank)).drop("distance")
    more = small(more, n_queries)
    chunks, sources = index.chunks, index.sources
    if n_queries <= FEW:
        found = more.select("chunk_id", "source_id").toArrow()
        chunks, sources = (of_ids(t, c, found[c].to_pylist()) for t, c in ((chunks, "chunk_id"), (sources, "source_id")))
    more = chunks.select("chunk_id", "content").join(more, "chunk_id")
    more = sources.select("source_id", "path", "title", "indegree").join(more, "source_id").withColumn("position", F.lit(1 << 30))
    every = rows.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "source_id")
    return every.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= spec.top_k)
