"""The index build as DataFrame plans: files -> sources, tags, chunks, vectors, edges and full-text indexes, whole or for what has changed."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from notelake.functions.models import Embedder
from notelake.functions.text import Tokenizer
from notelake.operators import chunk, fts, links, search, store
from notelake.session import written
from notelake.sources import vault


def hashing_embedder(dimension: int = 64) -> Callable[[Column], Column]:
    """A deterministic stand-in for an embedding model: token hashes summed into a vector, JVM-side."""
    from notelake.functions.text import tokens

    marks = "".join(chr((48 if dimension <= 79 else 0x4E00) + i) for i in range(dimension))  # one character for each place

    def embed(text: Column) -> Column:
        hashed = F.transform(tokens(text), lambda t: F.substring(F.lit(marks), F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int") + 1, F.lit(1)))
        counts = lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(m), F.lit("")))).cast("float") for m in marks])
        found = F.transform(F.array(F.array_join(hashed, "")), counts)  # inside, so that a text is hashed once and not for each place
        return F.element_at(found, 1)

    return embed


log = logging.getLogger("notelake")
REPORTED = 20  # failed notes named in the log; all are counted


def build(files: DataFrame, embed: Callable[[Column], Column] | Embedder | None = None, target: int = 400, overlap: int = 0, mode: str = "compat", now: Column | None = None, tokenizer: Tokenizer | None = None, stored: bool = False) -> dict:
    """Tables of a fresh index. files: (path, content[, source_id, mtime]).

    Sources are numbered in path order where they come without ids; an empty file is a source without chunks. stored: for ``Store.publish``.
    Notes that the embedding model fails for are left out, see ``built``.
    """
    return built(files, embed, target, overlap, mode, now, tokenizer, stored)[0]


def built(files: DataFrame, embed: Callable[[Column], Column] | Embedder | None = None, target: int = 400, overlap: int = 0, mode: str = "compat", now: Column | None = None, tokenizer: Tokenizer | None = None, stored: bool = False) -> tuple[dict, DataFrame | None]:
    """(tables of a fresh index, the notes that failed (source_id, path, failure) or None).

    Only an ``Embedder`` can fail for a note: one chunk without a vector fails it whole, and links to it are unresolved as if it weren't there.
    """
    when = now if now is not None else F.current_timestamp()
    notes = vault.parsed(files if "source_id" in files.columns else vault.numbered(files))
    own, failed = None, None
    if isinstance(embed, Embedder):
        notes = written(notes, "index-notes")
        own, failed = embedded(notes, embed, target, overlap)
        if failed is not None:
            notes = notes.join(failed, "source_id", "left_anti")
    else:  # parsed once; the text itself is in the body
        notes = written(notes.drop("content", "yaml"), "index-notes")
    edges = links.resolve(notes.select(F.col("source_id").alias("src_id"), F.explode("links").alias("target_path")), notes, mode)
    edges = written(edges, "index-edges")
    notes = notes.withColumns({"uid": store.uid_of(F.col("path"), F.col("source_id")), "status": F.lit("indexed"), "indexed_at": when, "created_at": when, "updated_at": when})
    own = own or contents(notes, embed, target, overlap)
    sources = notes.select(*SOURCES).join(links.indegree(edges, notes), "source_id")
    return {"sources": sources, **own, "edges": edges, **text_tables(own["chunks"], sources, tokenizer, stored)}, failed


SOURCES = ("source_id", "uid", "path", "title", "content_hash", "status", "aliases", "tags", "indexed_at", "created_at", "updated_at")


def contents(notes: DataFrame, embed: Callable[[Column], Column] | Embedder | None = None, target: int = 400, overlap: int = 0) -> dict[str, DataFrame]:
    """chunks, vectors and tags of parsed notes."""
    chunks = written(cut(notes, target, overlap), "index-cut")
    vectors = chunks.select("chunk_id", (embed or hashing_embedder())(F.col("content")).alias("embedding"))
    return {"chunks": chunks, "vectors": vectors, "tags": tags_of(notes)}


def cut(notes: DataFrame, target: int, overlap: int) -> DataFrame:
    """chunks of parsed notes; their numbers are the source's number, then the place in the source."""
    return chunk.chunked(notes, F.col("body"), target, overlap).withColumn("chunk_id", F.col("source_id") * 1_000_000 + F.col("chunk_index") + 1)


def tags_of(notes: DataFrame) -> DataFrame:
    return notes.select("source_id", F.explode(F.array_distinct("tags")).alias("tag"))


def embedded(notes: DataFrame, embed: Embedder, target: int = 400, overlap: int = 0) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """(chunks, vectors and tags of the notes for which the model didn't fail, the others (source_id, path, failure) or None).

    Chunks and vectors are written once, so that the model runs once; failures are counted in that write.
    """
    seen = Observation()
    chunks = cut(notes, target, overlap).withColumn("v", embed.passages(F.col("content")))
    chunks = written(chunks.observe(seen, F.count("v.failure").alias("n")), "index-embedded")
    tags, failed = tags_of(notes), None
    if seen.get["n"]:
        failed = chunks.filter("v.failure is not null").groupBy("source_id").agg(F.min_by("v.failure", "chunk_index").alias("failure"))
        failed = written(failed.join(notes.select("source_id", "path"), "source_id").select("source_id", "path", "failure"), "index-failed")
        chunks, tags = (t.join(failed, "source_id", "left_anti") for t in (chunks, tags))
    return {"chunks": chunks.drop("v"), "vectors": chunks.select("chunk_id", "v.embedding"), "tags": tags}, failed


# Of each full-text index: the key of its rows, their columns, and the table they are.
TEXTS = {"text": ("chunk_id", search.text_columns, "chunks"), "name": ("source_id", search.name_columns, "sources")}


def text_tables(chunks: DataFrame, sources: DataFrame, tokenizer: Tokenizer | None = None, stored: bool = False) -> dict:
    """Both full-text indexes as tables of the store. stored: terms and statistics are functions of the tables as written, for ``Store.publish``."""
    out: dict = {}
    for kind, rows in (("text", chunks), ("name", sources)):
        if stored:
            out |= text_part(kind, rows, tokenizer, TEXTS[kind][2])
        else:
            key, columns = TEXTS[kind][0], TEXTS[kind][1]()
            post = written(fts.postings(rows, key, columns, tokenizer, usual=fts.usual_tokens(rows, columns)), "fts-postings")
            out |= {f"{kind}_postings": post, f"{kind}_terms": fts.terms_of(post, key, tuple(columns)), f"{kind}_stats": fts.stats_of(post, rows)}
    return out


def text_part(kind: str, rows: DataFrame, tokenizer: Tokenizer | None = None, of: str | None = None) -> dict:
    """One of the full-text indexes for ``Store.publish``; of: the table that holds the rows once it is written, where it is published too."""
    key, columns, _ = TEXTS[kind]
    columns = columns()
    fields, post = tuple(columns), fts.postings(rows, key, columns, tokenizer, usual=fts.usual_tokens(rows, columns))
    return {
        f"{kind}_postings": post,
        f"{kind}_terms": lambda t: fts.terms_of(t[f"{kind}_postings"], key, fields),
        f"{kind}_stats": lambda t: fts.stats_of(t[f"{kind}_postings"], t[of] if of else rows),
    }


def text_opened(tables: dict[str, DataFrame], kind: str, tokenizer: Tokenizer | None = None) -> fts.TextIndex | None:
    """A full-text index of the store's tables, None where it has none."""
    if f"{kind}_postings" not in tables:
        return None
    key, columns, _ = TEXTS[kind]
    return fts.TextIndex(*(tables[f"{kind}_{t}"] for t in ("postings", "terms", "stats")), key, tuple(columns()), tokenizer or Tokenizer())


def opened(tables: dict[str, DataFrame], tokenizer: Tokenizer | None = None) -> search.Index:
    """An index of the store's tables; searches read the postings that are there."""
    return search.Index(tables["sources"], tables["chunks"], tables["vectors"], tables["edges"], text_opened(tables, "text", tokenizer), text_opened(tables, "name", tokenizer))


def updated(old: dict[str, DataFrame], files: DataFrame, prune: bool = True, embed: Callable[[Column], Column] | Embedder | None = None, target: int = 400, overlap: int = 0, now: Column | None = None, tokenizer: Tokenizer | None = None) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(the tables that change, whole, counts) for the files as they are now: what ``changed`` says, applied."""
    found, counts = changed(old, files, prune, embed, target, overlap, now, tokenizer)
    return {n: store.applied(n, old[n], c, few=False) for n, c in found.items()}, counts


def changed(old: dict[str, DataFrame], files: DataFrame, prune: bool = True, embed: Callable[[Column], Column] | Embedder | None = None, target: int = 400, overlap: int = 0, now: Column | None = None, tokenizer: Tokenizer | None = None) -> tuple[dict[str, store.Change], dict[str, int]]:
    """(what changes in which table, counts) for the files (path, content[, mtime]) as they are now.

    Only new and changed files are parsed, cut, embedded and tokenized, and only rows that differ are given: those of these files, those of sources whose in-degree
    changes, the links of sources that lose or gain a target, and differences of term counts and statistics. Numbers, uids and creation times of known paths stay, new
    paths get the next numbers in path order. Unchanged sources whose file is younger than their indexed_at (all of them, if files have no mtime) get a new one, so that a
    touched file isn't stale for ever. prune: sources whose files are gone go, and links into them become unresolved. Links elsewhere keep their targets; unresolved
    ones are claimed by the files read now. A file that an ``Embedder`` fails for stays as it was indexed, or out of the index, and is tried again in the next run;
    counts has their number as errors where there are any, and they don't count as new or changed.
    """
    when = now if now is not None else F.current_timestamp()
    sources = old["sources"]
    mtime = F.col("mtime").cast("timestamp") if "mtime" in files.columns else F.lit(None).cast("timestamp")
    files = written(files.select("path", "content", mtime.alias("mtime")).withColumn("content_hash", F.sha2("content", 256)), "index-files")
    kinds = written(store.changes(files, sources), "index-changes")
    counts = {r["change"]: r["n"] for r in kinds.groupBy("change").agg(F.count("*").alias("n")).collect()}
    counts = {k: counts.get(k, 0) for k in ("new", "changed", "unchanged", "gone")}
    same = files.join(kinds.filter("change = 'unchanged'"), "path", "left_semi").select("path", F.col("mtime").alias("_mtime"))
    seen = sources.filter("status = 'indexed'").join(same, "path").filter(F.col("_mtime").isNull() | F.col("indexed_at").isNull() | (F.col("_mtime") > F.col("indexed_at").cast("timestamp")))
    seen = written(seen.select("source_id"), "index-seen")
    nothing = lambda: not (counts["new"] or counts["changed"] or (prune and counts["gone"]))
    touched_only = lambda: {} if seen.isEmpty() else {"sources": store.Change(sources.join(seen, "source_id", "left_semi").withColumn("indexed_at", when).select(*sources.columns), seen)}
    if nothing():
        return touched_only(), counts
    moved = files.drop("mtime").join(kinds.filter("change = 'changed'"), "path", "left_semi").join(sources.select("path", "source_id"), "path")
    top = sources.agg(F.coalesce(F.max("source_id"), F.lit(0)).alias("m")).first()["m"]
    added = vault.numbered(files.drop("mtime").join(kinds.filter("change = 'new'"), "path", "left_semi"), top + 1)
    gone = sources.join(kinds.filter("change = 'gone'"), "path", "left_semi").select("source_id") if prune else sources.select("source_id").limit(0)
    gone = written(gone, "index-gone")
    fresh = written(vault.parsed(moved.unionByName(added.select(*moved.columns))), "index-fresh")
    if isinstance(embed, Embedder):
        own, failed = embedded(fresh, embed, target, overlap)
        if failed is not None:
            lost = failed.select("path")
            for r in kinds.join(lost, "path", "left_semi").groupBy("change").agg(F.count("*").alias("n")).collect():
                counts[r["change"]] -= r["n"]
                counts["errors"] = counts.get("errors", 0) + r["n"]
            for r in failed.select("path", "failure").limit(REPORTED).collect():
                log.warning("not indexed: %s: %s", r["path"], r["failure"])
            if nothing():
                return touched_only(), counts
            kinds, fresh = (t.join(lost, "path", "left_anti") for t in (kinds, fresh))
    else:
        own = contents(fresh, embed, target, overlap)
    ids = fresh.select("source_id")
    away = written(ids.unionByName(gone), "index-away")  # sources whose rows go
    of = lambda df, c="source_id", rows=None: df.join((away if rows is None else rows).withColumnRenamed("source_id", c), c, "left_semi").select(*df.columns)
    own = {n: written(t, f"index-{n}") for n, t in own.items()}
    out = {n: store.Change(own[n], away) for n in ("chunks", "tags")}
    before = written(of(old["chunks"]), "index-lost")
    lost = before.select("chunk_id")
    out["vectors"] = store.Change(own["vectors"], lost)
    # links: those of the files read now, and of others those that lose their target or find one
    was = written(of(sources), "index-were")
    known = sources.select("source_id", "path", "aliases").join(gone, "source_id", "left_anti").withColumns({"known": F.lit(True), "fresh": F.lit(False)})
    named = known.join(ids, "source_id", "left_anti").unionByName(fresh.select("source_id", "path", "aliases").join(was.select("source_id", F.lit(True).alias("known")), "source_id", "left").select("source_id", "path", "aliases", F.coalesce("known", F.lit(False)).alias("known"), F.lit(True).alias("fresh")))
    edges = old["edges"].select("src_id", "target_path", "dst_id")
    others = edges.join(away.withColumnRenamed("source_id", "src_id"), "src_id", "left_anti")
    cut = others.join(gone.withColumnRenamed("source_id", "dst_id"), "dst_id", "left_semi").select("src_id", "target_path", F.lit(None).cast("long").alias("dst_id"))
    open_ = written(others.filter("dst_id is null").unionByName(cut), "index-open")
    claimed = written(links.forward_refs(open_, fresh), "index-claimed")
    differ = written(cut.join(claimed, ["src_id", "target_path"], "left_anti").unionByName(claimed), "index-differ")
    touched = differ.select("src_id").distinct()
    theirs = others.join(touched, "src_id", "left_semi").join(differ.withColumnRenamed("dst_id", "_now").withColumn("_is", F.lit(True)), ["src_id", "target_path"], "left")
    theirs = theirs.select("src_id", "target_path", F.when(F.col("_is"), F.col("_now")).otherwise(F.col("dst_id")).alias("dst_id"))
    made = written(links.resolve(fresh.select(F.col("source_id").alias("src_id"), F.explode("links").alias("target_path")), named), "index-made")
    out["edges"] = store.Change(made.unionByName(theirs), away.withColumnRenamed("source_id", "src_id").unionByName(touched))
    # in-degrees: one more for each link that finds its target, one fewer for each of a source that goes or is read anew
    left = of(edges, "src_id")
    steps = [made.select("dst_id", F.lit(1).alias("n")), claimed.select("dst_id", F.lit(1).alias("n")), left.select("dst_id", F.lit(-1).alias("n"))]
    delta = steps[0].unionByName(steps[1]).unionByName(steps[2]).filter("dst_id is not null").groupBy(F.col("dst_id").alias("source_id")).agg(F.sum("n").alias("_delta")).filter("_delta <> 0")
    delta = written(delta.join(gone, "source_id", "left_anti"), "index-delta")
    held = was.select("source_id", F.col("uid").alias("_uid"), F.col("created_at").alias("_created"), F.col("indegree").alias("_indegree"))
    rows = fresh.join(held, "source_id", "left").join(delta, "source_id", "left").withColumns({
        "uid": F.coalesce("_uid", store.uid_of(F.col("path"), F.col("source_id"))), "created_at": F.coalesce("_created", when), "status": F.lit("indexed"), "indexed_at": when, "updated_at": when,
        "indegree": (F.coalesce("_indegree", F.lit(0)) + F.coalesce("_delta", F.lit(0))).cast("long"),
    }).select(*sources.columns)
    rows = written(rows, "index-rows")
    others_too = written(delta.select("source_id").unionByName(seen).distinct().join(away, "source_id", "left_anti"), "index-others")
    stays = sources.join(others_too, "source_id", "left_semi").join(delta, "source_id", "left").join(seen.withColumn("_seen", F.lit(True)), "source_id", "left")
    stays = stays.withColumns({"indegree": (F.col("indegree") + F.coalesce("_delta", F.lit(0))).cast("long"), "indexed_at": F.when(F.col("_seen"), when).otherwise(F.col("indexed_at"))}).select(*sources.columns)
    out["sources"] = store.Change(rows.unionByName(stays), away.unionByName(others_too))
    if "suggestions" in old:
        named_gone = [old["suggestions"].join(gone.withColumnRenamed("source_id", c), c, "left_semi").select("suggestion_id") for c in ("source_note_id", "target_note_id")]
        out["suggestions"] = store.Change(None, named_gone[0].unionByName(named_gone[1]).distinct())
    if "files" in old:
        left_paths = kinds.filter("change in ('gone', 'changed')" if prune else "change = 'changed'").select("path")
        out["files"] = store.Change(fresh.select("path", "content"), left_paths)
    # postings: those of the rows read now; counts: theirs, less those of the rows that go
    for kind, new, gone_rows, key, columns, keys in (("text", own["chunks"], before, "chunk_id", search.text_columns(), lost), ("name", rows, was, "source_id", search.name_columns(), away)):
        if f"{kind}_postings" not in old:
            continue
        out |= text_changes(kind, old, new, gone_rows, keys, key, columns, tokenizer)
    return out, counts


def text_changes(kind: str, old: dict[str, DataFrame], new: DataFrame, gone_rows: DataFrame, keys: DataFrame, key: str, columns: dict[str, Column], tokenizer: Tokenizer | None = None) -> dict[str, store.Change]:
    """What changes in a full-text index: postings of new rows come, those of keys (the numbers of gone_rows) go, and counts of terms and rows by their differences."""
    fields, sizes = tuple(columns), old[f"{kind}_stats"].first()
    usual = sizes["n_tokens"] / sizes["n_rows"] if sizes["n_tokens"] else fts.USUAL_TOKENS
    post, minus = (written(fts.postings(x, key, columns, tokenizer, usual=usual), f"index-{kind}") for x in (new, gone_rows))
    both = fts.terms_of(post, key, fields).unionByName(fts.terms_of(minus, key, fields).withColumns({"df": -F.col("df"), "removed": F.col("df"), "best": F.lit(0.0), "top": F.lit(0.0)}))
    sums = fts.stats_of(post, new).unionByName(fts.stats_of(minus, gone_rows).select(*[(-F.col(c)).alias(c) for c in ("n_rows", "n_tokens")]))
    terms, stats = f"{kind}_terms", f"{kind}_stats"
    return {f"{kind}_postings": store.Change(post, keys), terms: store.Change(store.added_up(terms, both.select(*old[terms].columns))), stats: store.Change(store.added_up(stats, sums))}


def missing_tables(old: dict[str, DataFrame], tokenizer: Tokenizer | None = None) -> dict:
    """Tables that an index of an older schema lacks, made from those that it has, for ``Store.publish``."""
    if all(f"{kind}_{t}" in old for kind in ("text", "name") for t in ("postings", "terms", "stats")):
        return {}
    found = text_tables(old["chunks"], old["sources"], tokenizer, stored=True)
    return {n: t if not callable(t) else (lambda done, t=t: t({**old, **done})) for n, t in found.items()}


def with_lines(results: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """results with line_start and line_end: of the chunk in its file; 1 for title-only rows; 0 where file or chunk is missing."""
    from notelake.functions.text import line_of

    spans = chunks.select("chunk_id", "char_start", "char_end")
    out = results.join(files.select("path", F.col("content").alias("_file")), "path", "left").join(spans, "chunk_id", "left")
    known = F.col("_file").isNotNull() & F.col("char_start").isNotNull()
    alone = F.col("_file").isNotNull() & (F.col("chunk_id") == 0)
    at = lambda c: F.when(alone, F.lit(1)).when(known, line_of("_file", c)).otherwise(F.lit(0)).cast("long")
    return out.withColumns({"line_start": at(F.col("char_start")), "line_end": at(F.greatest("char_start", F.col("char_end") - 1))}).select(*results.columns, "line_start", "line_end")
