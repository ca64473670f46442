"""Full-text search: a stored index of postings, a parser for the query language, and BM25.

The index is three tables: postings (bucket, term, field, key, n_tokens, positions, below 0 for characters of Han that stand outside the sequence, impact), terms (bucket, term, df,
and bounds of impacts) and stats (one row). A bucket is a hash of the term and a folder of files that are sorted by term, then from the greatest impact down, so a query reads the
buckets of its terms only and of these the pages that hold them, whatever the size of the corpus; a term's postings are dealt to several files of
its bucket, so no task holds a hot term. Terms are dealt by ranges and sorted: a prefix is a range of them, and names the buckets it needs. The tokenizer is the index's own: texts
and queries are cut by one rule.

Impact is a posting's part of the score without its term's weight, at the average length known when it was written. A term keeps the greatest impact and one that at least
KEPT postings reach. For a query of one term, or of any of several, the k-th score is at least that of the best such term alone; what a posting would need beside the greatest
impacts of all other terms to reach it is a bound on its own impact, which goes to the scan as a filter, so pages and row groups below it are skipped. The rows found are the same.

Queries of plain terms, all or any of which must occur, of any number, are one join on the term. Others (phrases, prefixes, first tokens, NEAR,
columns, nesting) gather their terms' positions for each row and evaluate an expression over them, many queries in one pass.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelake.functions.text import Tokenizer
from notelake.session import leaf_bytes, parts_for, written

K1, B, TINY_IDF = 1.2, 0.75, 1e-6
BUCKETS, MOST_LISTED = 16, 500
TASK_BYTES, MOST_SPREAD = 4 << 20, 4_000  # of Parquet, whose postings one task sorts
BLOCK = 256  # queries of a batch that are scored at once
KEPT, LEVELS, USUAL_TOKENS = 64, 64, 100.0  # LEVELS: steps in which impacts are counted


class QuerySyntaxError(ValueError):
    """The query isn't in the language; ``safe_parse`` turns it into an empty channel."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # "and", "or", "not"
    left: object
    right: object


TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x80-\U0010ffff\x1a]+)|([(){}:+*^,]|-))')


split_tokens = Tokenizer().split


class _Parser:
    """Recursive descent; tightest first: implicit AND, NOT, AND, OR."""

    def __init__(self, query: str, columns: tuple[str, ...], split):
        self.columns, self.split, self.items, at = columns, split, [], 0
        query = query.rstrip()
        while at < len(query):
            m = TOKEN.match(query, at)
            if not m:
                raise QuerySyntaxError(f"at {query[at:at + 10]!r}")
            text, word, sign = m.groups()
            self.items.append(("string", text[1:-1].replace('""', '"')) if text is not None else ("word", word) if word else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else (None, None)

    def take(self, sign: str | None = None):
        item = self.peek()
        if item[0] is None or (sign and item != ("sign", sign)):
            raise QuerySyntaxError(f"{sign or 'something'} expected, {item[1]!r} found")
        self.at += 1
        return item

    def operator(self, word: str) -> bool:
        if self.peek() == ("word", word):
            self.at += 1
            return True
        return False

    def binary(self, word: str, below):
        left = below()
        while self.operator(word):
            left = Op(word.lower(), left, below())
        return left

    def query(self):
        out = self.binary("OR", lambda: self.binary("AND", lambda: self.binary("NOT", self.implicit)))
        return out

    def starts(self) -> bool:
        kind, value = self.peek()
        return kind == "string" or (kind == "word" and value not in ("AND", "OR", "NOT")) or (kind == "sign" and value in "({^-")

    def implicit(self):
        if not self.starts():
            raise QuerySyntaxError(f"a term expected, {self.peek()[1]!r} found")
        left, any_yet = None, False
        while self.starts():
            one = self.unit()
            if one is None:  # a term without tokens is passed over inside an AND
                any_yet = True
                continue
            left = one if left is None else Op("and", left, one)
        return left if left is not None else (Phrase(()) if any_yet else None)

    def filtered(self):
        """Column names of a filter that starts here, or None."""
        negative = self.peek() == ("sign", "-")
        shift = int(negative)
        names = []
        if self.peek(shift) == ("sign", "{"):
            k = shift + 1
            while self.peek(k)[0] in ("word", "string"):
                names.append(self.peek(k)[1])
                k += 1
            if self.peek(k) != ("sign", "}") or self.peek(k + 1) != ("sign", ":"):
                raise QuerySyntaxError("a column list must end in }:")
            self.at += k + 2
        elif self.peek(shift)[0] in ("word", "string") and self.peek(shift + 1) == ("sign", ":"):
            names = [self.peek(shift)[1]]
            self.at += shift + 2
        elif negative:
            raise QuerySyntaxError("- must precede a column filter")
        else:
            return None
        if unknown := [x for x in names if x.lower() not in self.columns]:
            raise QuerySyntaxError(f"no such column: {unknown[0]}")
        names = [x.lower() for x in names]
        return tuple(c for c in self.columns if (c in names) != negative)

    def unit(self):
        columns = self.filtered()
        if self.peek() == ("sign", "("):
            self.take()
            out = self.query()
            self.take(")")
        elif self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.at += 2
            phrases, distance = [], 10
            while self.peek()[0] in ("string", "word") or self.peek() == ("sign", "^"):
                if (p := self.phrase()) is not None:
                    phrases.append(p)
            if self.peek() == ("sign", ","):
                self.take()
                kind, number = self.take()
                if not number.isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
                distance = int(number)
            self.take(")")
            out = Near(tuple(phrases), distance)
        else:
            out = self.phrase()
        return out if columns is None or out is None else _within(out, columns)

    def phrase(self):
        initial = self.peek() == ("sign", "^")
        if initial:
            self.take()
        terms: tuple[str, ...] = ()
        while True:
            kind, value = self.take()
            if kind == "sign":
                raise QuerySyntaxError(f"a term expected, {value!r} found")
            terms += self.split(value)
            if self.peek() != ("sign", "+"):
                break
            self.take()
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Phrase(terms, prefix, initial) if terms else None


def _within(node, columns):
    if isinstance(node, Op):
        return Op(node.kind, _within(node.left, columns), _within(node.right, columns))
    if isinstance(node, Near):
        return Near(tuple(_within(p, columns) for p in node.phrases), node.distance)
    own = columns if node.columns is None else tuple(c for c in node.columns if c in columns)
    return Phrase(node.terms, node.prefix, node.initial, own)


def parse(query: str, columns: tuple[str, ...] = ("content",), split=split_tokens, lenient: bool = False):
    """The query's tree, None for an empty query. lenient: punctuation is dropped first and operators are terms."""
    if lenient:
        query = " ".join(f'"{w}"' for w in re.findall(r"\w+", query))
    parser = _Parser(query, columns, split)
    if not parser.items:
        return None
    out = parser.query()
    if parser.at < len(parser.items):
        raise QuerySyntaxError(f"unexpected {parser.peek()[1]!r}")
    return out


def safe_parse(query: str, columns: tuple[str, ...] = ("content",), lenient: bool = False, split=split_tokens):
    """parse, or None where the query has an error: its channel stays empty."""
    try:
        return parse(query, columns, split, lenient)
    except QuerySyntaxError:
        return None


def scored(node, near: Near | None = None) -> list[tuple[Phrase, Near | None]]:
    """The phrases that count for the score, with the NEAR group that limits where they count."""
    if isinstance(node, Op):
        return scored(node.left) + scored(node.right)
    if isinstance(node, Near):
        return [(p, node) for p in node.phrases]
    return [] if node is None else [(node, near)]


@dataclass(frozen=True)
class TextIndex:
    """key: the rows' id column; fields: the indexed columns' names."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    key: str
    fields: tuple[str, ...]
    tokenizer: Tokenizer = field(default_factory=Tokenizer)
    buckets: int = BUCKETS


def usual_tokens(rows: DataFrame, columns: dict[str, Column]) -> float:
    """About how many tokens a row has: runs of ASCII letters and digits are counted."""
    return rows.agg(F.avg(sum((F.regexp_count(c, F.lit("[a-zA-Z0-9]+")) for c in columns.values()), F.lit(0)))).first()[0] or USUAL_TOKENS


def postings(rows: DataFrame, key: str, columns: dict[str, Column], tokenizer: Tokenizer | None = None, buckets: int = BUCKETS, usual: float = USUAL_TOKENS) -> DataFrame:
    """(bucket, term, field, key, n_tokens, positions, impact, usual) of rows, sorted by bucket, term and falling impact. usual: an average length, which impacts are made with.

    A row's tokens are gathered by term where the row lies, in Arrow batches, so one shuffle moves postings, not tokens. A bucket is
    spread over as many tasks as its share of the corpus asks for, so that a task sorts what its memory holds. What is the same for all postings is added behind the sort,
    and impacts, which hardly compress, behind the shuffle.
    """
    spread = min(max(1, -(-leaf_bytes(rows) // (TASK_BYTES * buckets))), MOST_SPREAD)
    long = gathered(rows, key, columns, tokenizer, buckets)
    names, tf = long.columns, F.size("positions")
    same = {"usual": F.lit(float(usual))}
    if len(columns) == 1:
        same["field"] = F.lit(next(iter(columns)))
        long = long.drop("field")
    if spread == 1:
        dealt = long.repartition("bucket")
    else:  # by number, as hashes of so few places leave some tasks several of them
        dealt = long.repartitionById(buckets * spread, F.col("bucket") * F.lit(spread) + F.pmod(F.xxhash64(key), F.lit(spread)).cast("int"))
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / same["usual"]))
    return in_order(dealt.withColumn("impact", impact), key).withColumns(same).select(*names, "impact", "usual")


def gathered(rows: DataFrame, key: str, columns: dict[str, Column], tokenizer: Tokenizer | None = None, buckets: int = BUCKETS, only: Callable[[str], bool] | None = None) -> DataFrame:
    """(bucket, term, field, key, n_tokens, positions) as rows lie. only: postings of these terms alone, and for each row one of the empty term, so that all are counted."""
    own_tokenizer, names = tokenizer or Tokenizer(), list(columns)
    split, characters = own_tokenizer.split, own_tokenizer.characters
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n = part.num_rows
                texts = [[t or "" for t in part.column(i + 1).to_pylist()] for i in range(len(names))]
                words, of, places, sizes = [], [], [], np.zeros(n, np.int64)  # of: field and row of each token as one number
                for f, own in enumerate(texts):
                    tokens = [split(t) for t in own]
                    lengths = np.fromiter(map(len, tokens), np.int64, n)
                    sizes += lengths
                    words += chain.from_iterable(tokens)
                    of.append(np.repeat(np.arange(f * n, (f + 1) * n), lengths))
                    places.append(np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
                for f, own in enumerate(texts):  # behind all tokens, as they stand outside the sequence
                    for r, t in enumerate(own):
                        if found := characters(t):
                            words += [c for c, _ in found]
                            of.append(np.full(len(found), f * n + r))
                            places.append(np.array([-1 - i for _, i in found]))
                if only is not None:
                    words += [""] * n
                    of.append(np.arange(n))
                    places.append(np.zeros(n, np.int64))
                coded = pa.array(words, pa.string()).dictionary_encode()
                terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                of, places = np.concatenate(of), np.concatenate(places)
                listed = terms.to_pylist()
                if only is not None:
                    kept = np.fromiter((not t or only(t) for t in listed), bool, len(listed))[codes]
                    codes, of, places = codes[kept], of[kept], places[kept]
                groups = of * max(1, len(listed)) + codes
                order = np.argsort(groups, kind="stable")
                groups, places = groups[order], places[order]
                starts = np.flatnonzero(np.diff(groups, prepend=-1))
                of, codes = of[order][starts], codes[order][starts]
                ends = np.append(starts, len(groups))
                if only is not None:  # the empty term's postings have no places
                    empty = np.array([not t for t in listed], bool)[codes]
                    places = places[np.repeat(~empty, np.diff(ends))]
                    ends = np.concatenate([[0], np.cumsum(np.where(empty, 0, np.diff(ends)))])
                bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in listed), np.int32, len(listed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[codes]), terms.take(pa.array(codes)), pa.array(names, pa.string()).take(pa.array(of // n)), part.column(0).take(pa.array(of % n)), pa.array(sizes[of % n].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int32)))],
                    ["bucket", "term", "field", key, "n_tokens", "positions"],
                )

    return rows.select(key, *columns.values()).mapInArrow(run, f"bucket int, term string, field string, {key} {kind}, n_tokens int, positions array<int>")


def in_order(post: DataFrame, key: str | None = None) -> DataFrame:
    """Postings sorted as the files of a bucket are."""
    return post.sortWithinPartitions("bucket", "term", *([F.desc("impact")] if "impact" in post.columns else []), *([key] if key else []))


RUNS = "bucket int, term string, n long, best double, low double, high double, by array<long>"
LEVEL = 1 << 40  # a level and a count are one number, level first


def run_counts(batches):
    """Counts of postings for each run of one term. The files of a bucket are sorted, so a file has one run for a term and no table of terms is held.

    by: how many (modulo LEVEL) have which level of impact, of the KEPT greatest and those of their level; the runs of a term in other files or batches are added up by those who read this.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        bucket, term = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        impact, usual = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        new = np.ones(rows, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | pc.not_equal(term.slice(1), term.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        level = np.floor(impact * (LEVELS / (K1 + 1))).astype(np.int64)
        span = int(level.max()) + 1
        # of each run the levels from the greatest down, with their counts
        cells, count = np.unique((np.cumsum(new) - 1) * span + (span - 1 - level), return_counts=True)
        run = cells // span
        first = np.searchsorted(run, np.arange(len(start)))
        before = np.cumsum(count) - count
        kept = before - before[first][run] < KEPT
        ends = np.r_[0, np.cumsum(np.bincount(run[kept], minlength=len(start)))].astype(np.int32)
        by = (span - 1 - cells[kept] % span) * LEVEL + count[kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[start].astype(np.int32)), term.take(pa.array(start)), pa.array(np.diff(np.r_[start, rows])), pa.array(np.maximum.reduceat(impact, start)),
             pa.array(np.minimum.reduceat(usual, start)), pa.array(np.maximum.reduceat(usual, start)), pa.ListArray.from_arrays(pa.array(ends), pa.array(by))],
            ["bucket", "term", "n", "best", "low", "high", "by"],
        )


def terms_of(post: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(bucket, term, df, best, top, low, high, removed), counted from postings.

    best: the greatest impact; top: one that KEPT postings reach, 0 if there are fewer; low, high: the least and greatest average the impacts were made with;
    removed: how many postings have gone since. An index of several fields has no bounds, as impacts are those of single fields.
    """
    bounds = {"low": F.min("usual"), "high": F.max("usual")}
    if len(fields) > 1 or "impact" not in post.columns:
        none = {"best": F.lit(0.0), "top": F.lit(0.0)} | (bounds if "usual" in post.columns else {"low": F.lit(USUAL_TOKENS), "high": F.lit(USUAL_TOKENS)})
        found = post.groupBy("bucket", "term").agg((F.count("*") if len(fields) == 1 else F.count_distinct(key)).alias("df"), *[v.alias(k) for k, v in none.items()])
        return found.withColumn("removed", F.lit(0).cast("long"))
    runs = post.select("bucket", "term", "impact", "usual").mapInArrow(run_counts, RUNS)
    falling = F.reverse(F.array_sort(F.flatten(F.collect_list("by"))))
    one = runs.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("best").alias("best"), falling.alias("by"), F.min("low").alias("low"), F.max("high").alias("high"))
    step = F.lit(LEVELS / (K1 + 1))
    reached = F.aggregate("by", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("level")), lambda s, x: F.when(s["n"] >= KEPT, s).otherwise(F.struct((s["n"] + x % LEVEL).alias("n"), F.shiftright(x, 40).alias("level"))))
    top = F.when(reached["n"] >= KEPT, reached["level"] / step).otherwise(F.lit(0.0))
    return one.select("bucket", "term", "df", "best", top.alias("top"), "low", "high", F.lit(0).cast("long").alias("removed"))


def stats_of(post: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: n_rows, those without any token as well, and n_tokens."""
    size = post.agg(F.coalesce(F.sum(F.size(F.filter("positions", lambda i: i >= 0))), F.lit(0)).alias("n_tokens"))
    return rows.agg(F.count("*").alias("n_rows")).join(F.broadcast(size))


def built(rows: DataFrame, key: str, columns: dict[str, Column], tokenizer: Tokenizer | None = None) -> TextIndex:
    """An index of rows that no store holds: its postings are a scratch table."""
    post, fields = written(postings(rows, key, columns, tokenizer), "fts-postings"), tuple(columns)
    return TextIndex(post, terms_of(post, key, fields), stats_of(post, rows), key, fields, tokenizer or Tokenizer())


def _of_terms(table: DataFrame, terms: list[str], buckets: int) -> DataFrame:
    """The rows of these terms: from their buckets alone, and by name (or by a join, if there are very many)."""
    own = table.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % buckets for t in terms})))
    if len(terms) <= MOST_LISTED:
        return own.filter(F.col("term").isin(terms))
    wanted = table.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return own.join(F.broadcast(wanted), "term", "left_semi")


def flat(node, kind: str | None = None) -> tuple[str, list[str]] | None:
    """("and" or "or", terms) of a query that is only that, else None."""
    if isinstance(node, Phrase):
        return (kind or "and", [node.terms[0]]) if len(node.terms) == 1 and not (node.prefix or node.initial or node.columns) else None
    if isinstance(node, Op) and node.kind in ("and", "or") and kind in (None, node.kind):
        a, b = flat(node.left, node.kind), flat(node.right, node.kind)
        return (node.kind, a[1] + b[1]) if a and b else None
    return None


def _bm25(f: Column, df: Column, n: Column, rows: Column, total: Column) -> Column:
    idf = F.log((rows - df + 0.5) / (df + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(TINY_IDF))
    return idf * (f * F.lit(K1 + 1)) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * n / (total / rows)))


def _known(index: TextIndex, names: list[str]) -> tuple[dict[str, dict], int, int]:
    """(what the index knows of these terms, its rows, its tokens), by one job; at most MOST_LISTED terms."""
    bounds = [c for c in ("best", "top", "low", "high", "removed") if c in index.terms.columns]
    of_terms = _of_terms(index.terms, names, index.buckets).select("term", "df", F.lit(0).cast("long").alias("n"), *[F.col(c).cast("double").alias(c) for c in bounds])
    of_all = index.stats.select(F.lit(None).cast("string").alias("term"), F.col("n_rows").alias("df"), F.col("n_tokens").alias("n"), *[F.lit(0.0).alias(c) for c in bounds])
    rows = of_terms.unionByName(of_all).collect()
    stats = next(r for r in rows if r["term"] is None)
    return {r["term"]: r.asDict() for r in rows if r["term"] is not None}, stats["df"], stats["n"]


def _needed(terms: list[tuple[str, int]], kind: str, known: dict[str, dict], weights: dict[str, float], usual: float, limit: int | None) -> dict[str, float]:
    """The impact that a posting of each term needs if its row is to be among the first limit; 0 where no bound is known."""
    none = dict.fromkeys((t for t, _ in terms), 0.0)
    if limit is None or any(t not in known or "top" not in known[t] for t, _ in terms) or (kind == "and" and len(terms) > 1):
        return none
    sure = [n * weights[t] * k["top"] * min(1.0, usual / k["high"]) for t, n in terms if (k := known[t])["top"] > 0 and KEPT - k["removed"] >= limit]
    most = {t: n * weights[t] * known[t]["best"] * max(1.0, usual / known[t]["low"]) for t, n in terms}
    if not sure or any(known[t]["best"] <= 0 for t, _ in terms):
        return none
    return {t: max(0.0, (max(sure) * (1 - 1e-9) - (sum(most.values()) - most[t])) / (n * weights[t] * max(1.0, usual / known[t]["low"]))) for t, n in terms}


def _by_join(index: TextIndex, queries: list[tuple[int, str, list[str]]], limit: int | None = None) -> DataFrame:
    """(query_id, key, score) for plain queries (id, and/or, terms): postings met with the asked terms, then gathered for each query and row.

    limit: how many rows of each query are wanted; rows that can't be among them may be left out.
    """
    spark, key = index.postings.sparkSession, index.key
    asked = [(q, kind, [(t, terms.count(t)) for t in dict.fromkeys(terms)]) for q, kind, terms in queries]
    names = sorted({t for _, _, terms in asked for t, _ in terms})
    post = _of_terms(index.postings, names, index.buckets)
    if len(names) <= MOST_LISTED:
        known, n_rows, total = _known(index, names)
        weights = {t: max(math.log((n_rows - k["df"] + 0.5) / (k["df"] + 0.5)), 0.0) or TINY_IDF for t, k in known.items()}
        usual = total / n_rows if n_rows else 1.0
        rows, need = [], {}
        for q, kind, terms in asked:
            least = _needed(terms, kind, known, weights, usual, limit)
            for i, (t, n) in enumerate(terms):
                if t in known:
                    rows.append((q, t, i, n * weights[t], len(terms) if kind == "and" else 1, least[t]))
                    need[t] = min(need.get(t, least[t]), least[t])
        wanted = spark.createDataFrame(rows, "query_id long, term string, place int, weight double, need int, least double")
        if "impact" in post.columns and any(need.values()):
            post = post.filter(reduce(lambda a, b: a | b, [(F.col("term") == t) & (F.col("impact") >= x) for t, x in sorted(need.items())]))
        length = F.lit(float(usual))
    else:
        long = [(q, t, i, n, len(terms) if kind == "and" else 1) for q, kind, terms in asked for i, (t, n) in enumerate(terms)]
        known = _of_terms(index.terms, names, index.buckets).select("term", "df")
        wanted = spark.createDataFrame(long, "query_id long, term string, place int, times int, need int").join(F.broadcast(known), "term").join(F.broadcast(index.stats.select("n_rows", F.col("n_tokens").alias("total"))))
        idf = F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        wanted = wanted.withColumn("weight", F.col("times") * F.when(idf > 0, idf).otherwise(F.lit(TINY_IDF))).withColumn("length", F.col("total") / F.col("n_rows"))
        length = F.col("length")
    if len(index.fields) == 1:
        post = post.select("term", key, "n_tokens", F.size("positions").alias("tf"))
    else:
        post = post.groupBy("term", key, "n_tokens").agg(F.sum(F.size("positions")).alias("tf"))
    f = F.col("tf")
    part = F.col("weight") * (f * F.lit(K1 + 1)) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_tokens") / length))
    met = post.join(F.broadcast(wanted), "term").select("query_id", key, "need", F.struct("place", part.alias("part")).alias("p"))
    rows = met.groupBy("query_id", key, "need").agg(F.sort_array(F.collect_list("p")).alias("p")).filter(F.size("p") >= F.col("need"))
    return rows.select("query_id", key, (-F.aggregate("p", F.lit(0.0), lambda s, x: s + x["part"])).alias("score"))  # always summed in one order


def _batch(index: TextIndex, queries: list[tuple[int, list[str]]], limit: int, digits: int | None) -> DataFrame:
    """(query_id, key, score, _s) of the first limit rows of each partition for very many terms, any of which may occur; _s: the score as it is compared.

    A row's postings of asked terms meet once, whatever the number of queries: numbers of terms and frequencies are shuffled, and a row is scored for a block of queries by one
    product of its terms' weights. Pairs of queries and rows, nearly all of which have some term in common, are never rows themselves.
    """
    spark, key = index.postings.sparkSession, index.key
    names = sorted({t for _, terms in queries for t in terms})
    # what was asked bounds these: one row for each term
    df = {r["term"]: r["df"] for r in _of_terms(index.terms, names, index.buckets).select("term", "df").collect()}
    stats = index.stats.first()
    n_rows, usual = stats["n_rows"], stats["n_tokens"] / stats["n_rows"] if stats["n_rows"] else 1.0
    known = {t: i for i, t in enumerate(t for t in names if t in df)}
    weight = [max(math.log((n_rows - df[t] + 0.5) / (df[t] + 0.5)), 0.0) or TINY_IDF for t in known]
    asked: dict[int, dict[int, int]] = {}
    for q, terms in queries:
        own = asked.setdefault(q, {})
        for t in terms:
            if t in known:
                own[known[t]] = own.get(known[t], 0) + 1
    cells = [(q, i, n * weight[i]) for q, own in asked.items() for i, n in own.items()]
    ids, n_terms = list(asked), len(known)
    kind = index.postings.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        column = {q: i for i, q in enumerate(ids)}
        at, term, value = (np.array(x) for x in ([column[q] for q, _, _ in cells], [i for _, i, _ in cells], [w for _, _, w in cells]))
        blocks = []
        for first in range(0, len(ids), BLOCK):
            own = (at >= first) & (at < first + BLOCK)
            used, row = np.unique(term[own], return_inverse=True)
            table = np.zeros((len(used) + 1, min(BLOCK, len(ids) - first)))  # the last row: terms that no query of the block has
            table[row, at[own] - first] = value[own]
            place = np.full(n_terms, len(used))
            place[used] = np.arange(len(used))
            blocks.append((first, place, table))
        best = [np.full(len(ids), np.inf), np.zeros((0, 2)), np.zeros(0, np.int64), None]  # what the last kept row has, and (score, compared), query, key of kept rows

        def cut(scores, query, keys):
            order = np.lexsort((keys, scores[:, 1], query))
            rank = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
            order = order[rank < limit]
            worst = np.full(len(ids), np.inf)
            full = np.bincount(query[order], minlength=len(ids)) >= limit
            np.maximum.at(top := np.full(len(ids), -np.inf), query[order], scores[order, 1])
            worst[full] = top[full]
            return [worst, scores[order], query[order], keys[order]]

        def scored(keys, terms, tf, n):
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / usual))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for first, place, table in blocks:
                sums = np.add.reduceat(part[:, None] * table[place[terms]], starts, axis=0)
                compared = -sums if digits is None else np.round(-sums, digits)
                width = table.shape[1]
                # keys come in rising order, so of equals those that are there already stay
                r, q = np.nonzero((sums > 0) & (compared < best[0][None, first : first + width]))
                if len(r):
                    new = np.stack([-sums[r, q], compared[r, q]], axis=1), q + first, keys[starts][r]
                    best[:] = cut(np.concatenate([best[1], new[0]]), np.concatenate([best[2], new[1]]), new[2] if best[3] is None else np.concatenate([best[3], new[2]]))

        held = None
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            own = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            if not len(own[0]):
                continue
            last = int(np.searchsorted(own[0], own[0][-1], "left"))  # the last row may go on in the next batch
            held = [x[last:] for x in own]
            if last:
                scored(*(x[:last] for x in own))
        if held is not None and len(held[0]):
            scored(*held)
        if best[3] is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[best[2]]), pa.array(best[3]), pa.array(best[1][:, 0].copy()), pa.array(best[1][:, 1].copy())], ["query_id", key, "score", "_s"])

    numbered = spark.createDataFrame(list(known.items()), "term string, number int")
    post = _of_terms(index.postings, names, index.buckets).select("term", key, "n_tokens", F.size("positions").alias("tf")).join(F.broadcast(numbered), "term")
    rows = post.select(key, "number", "tf", "n_tokens").repartition(parts_for(index.postings), key).sortWithinPartitions(key, "number")
    return rows.mapInArrow(run, f"query_id long, {key} {kind}, score double, _s double")


def prefix_buckets(index: TextIndex, prefixes: list[str]) -> list[int]:
    """The buckets that hold the terms of these prefixes: each is a range of the sorted term table."""
    own = reduce(lambda a, b: a | b, [in_range(t) for t in prefixes])
    return sorted(r["bucket"] for r in index.terms.filter(own).select("bucket").distinct().collect())  # as many numbers as there are buckets, at most


def in_range(prefix: str) -> Column:
    """Terms that start so. The term's own order (that of its bytes) makes it a range, which sorted files skip by."""
    last = prefix[-1:]
    above = prefix[:-1] + chr(ord(last) + 1) if last and ord(last) + 1 not in (0xD800, 0x110000) else None
    least = F.col("term") >= prefix
    return least & F.col("term").startswith(prefix) if above is None else least & (F.col("term") < above)


class _Positions:
    """The columns that hold the positions of each term or prefix in each field, for one row."""

    def __init__(self, fields: tuple[str, ...], phrases: list[Phrase]):
        self.fields = fields
        kinds = [(t, p.prefix and k == len(p.terms) - 1) for p in phrases for k, t in enumerate(p.terms)]
        self.slots = {k: i for i, k in enumerate(dict.fromkeys(kinds))}

    def of(self, p: Phrase, k: int, name: str) -> Column:
        return F.col(f"p{self.slots[p.terms[k], p.prefix and k == len(p.terms) - 1]}_{name}")

    def fields_of(self, p: Phrase) -> tuple[str, ...]:
        return self.fields if p.columns is None else p.columns

    def starts(self, p: Phrase, name: str) -> Column:
        """Where the phrase starts in a field."""
        fits = lambda i: reduce(lambda a, b: a & b, [F.array_contains(self.of(p, k, name), i + k) for k in range(1, len(p.terms))], F.lit(True))
        first = self.of(p, 0, name)
        out = first if len(p.terms) == 1 else F.filter(first, fits)
        return F.filter(out, lambda i: i == 0) if p.initial else out

    def count(self, p: Phrase, near: Near | None) -> Column:
        parts = [F.size(self.starts(p, f) if near is None else self.clump(near, p, f)) for f in self.fields_of(p) if p.terms]
        return sum(parts, F.lit(0))

    def clump(self, near: Near, p: Phrase, name: str) -> Column:
        """Starts of p inside a stretch that holds all of the group's phrases: each ends at most distance tokens before the start of the last."""
        if any(name not in self.fields_of(x) or not x.terms for x in near.phrases):
            return F.array().cast("array<int>")
        lasts = F.concat(*[self.starts(x, name) for x in near.phrases])

        def whole(last: Column) -> Column:
            inside = lambda x: F.exists(self.starts(x, name), lambda i: (i <= last) & (i >= last - len(x.terms) - near.distance))
            return reduce(lambda a, b: a & b, [inside(x) for x in near.phrases if x is not p], F.lit(True))

        return F.filter(self.starts(p, name), lambda i: F.exists(lasts, lambda m: (i <= m) & (i >= m - len(p.terms) - near.distance) & whole(m)))

    def matches(self, node) -> Column:
        if isinstance(node, Op):
            a, b = self.matches(node.left), self.matches(node.right)
            return a & b if node.kind == "and" else a | b if node.kind == "or" else a & ~b
        if isinstance(node, Near):
            return self.count(node.phrases[0], node) > 0 if node.phrases else F.lit(False)
        return self.count(node, None) > 0


def _by_positions(index: TextIndex, trees: list[tuple[int, object]]) -> DataFrame:
    """(query_id, key, score) for any queries."""
    key, items = index.key, list(dict.fromkeys(x for _, t in trees for x in scored(t)))
    at = _Positions(index.fields, [p for p, _ in items])
    read = ("slot", "field", key, "n_tokens", "positions")
    exact = {t: i for (t, prefix), i in at.slots.items() if not prefix}
    found = []
    if exact:
        slot = F.element_at(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]), F.col("term"))
        found.append(_of_terms(index.postings, list(exact), index.buckets).withColumn("slot", slot).select(*read))
    if starts := {t: i for (t, prefix), i in at.slots.items() if prefix}:
        own = index.postings.filter(F.col("bucket").isin(prefix_buckets(index, list(starts))))
        found += [own.filter(in_range(t)).withColumn("slot", F.lit(i)).select(*read) for t, i in starts.items()]
    if not found:
        return index.postings.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0.0).alias("score")).limit(0)
    gather = lambda i, f: F.flatten(F.collect_list(F.when((F.col("slot") == i) & (F.col("field") == f), F.col("positions")))).alias(f"p{i}_{f}")
    rows = reduce(DataFrame.union, found).groupBy(key, "n_tokens").agg(*[gather(i, f) for i in at.slots.values() for f in index.fields])
    number = {x: i for i, x in enumerate(items)}
    alone = [at.count(p, None) for p, _ in items]
    counted = rows.select(key, "n_tokens", *[c.alias(f"a{i}") for i, c in enumerate(alone)], *[(at.count(p, near) if near else a).alias(f"f{i}") for i, ((p, near), a) in enumerate(zip(items, alone))], *[at.matches(t).alias(f"m{i}") for i, (_, t) in enumerate(trees)])
    df = counted.agg(*[F.count_if(F.col(f"a{i}") > 0).alias(f"d{i}") for i in range(len(items))])
    one = df.join(F.broadcast(index.stats.select("n_rows", F.col("n_tokens").alias("total"))))  # one row of numbers, whatever the corpus
    part = lambda x: _bm25(F.col(f"f{(i := number[x])}"), F.col(f"d{i}"), F.col("n_tokens"), F.col("n_rows"), F.col("total"))
    hits = [F.when(F.col(f"m{i}"), F.struct(F.lit(q).cast("long").alias("query_id"), (-sum((part(x) for x in scored(t)), F.lit(0.0))).alias("score"))) for i, (q, t) in enumerate(trees)]
    every = counted.join(F.broadcast(one))
    return every.select(key, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h")).select("h.query_id", key, "h.score")


def hits(index: TextIndex, queries: list[tuple[int, str]], limit: int | None = 50, lenient: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, key, score) of the best rows for each query; scores are negative, least is best, ties by key. digits: scores that are equal when rounded so are ties."""
    trees = [(q, t) for q, text in queries if (t := safe_parse(text, index.fields, lenient, index.tokenizer.split)) is not None]
    plain = [(q, *f) for q, t in trees if (f := flat(t))]
    rich = [(q, t) for q, t in trees if not flat(t)]
    compared = F.col("score") if digits is None else F.round("score", digits)
    many = [(q, terms) for q, kind, terms in plain if kind == "or" or len(terms) == 1]
    numbers = index.postings.schema[index.key].dataType.simpleString() in ("int", "bigint")
    if limit is None or not numbers or len(index.fields) > 1 or len({t for _, terms in many for t in terms}) <= MOST_LISTED:
        many = []
    else:
        plain = [(q, kind, terms) for q, kind, terms in plain if kind == "and" and len(terms) > 1]
    found = ([_by_join(index, plain, limit if digits is None else None)] if plain else []) + ([_by_positions(index, rich)] if rich else [])
    found = [x.withColumn("_s", compared) for x in found] + ([_batch(index, many, limit, digits)] if many else [])
    if not found:
        return nothing(index.postings.sparkSession, index.postings, index.key)
    return top(reduce(DataFrame.unionByName, found), ["_s", index.key], limit).drop("_s")


def nothing(spark: SparkSession, like: DataFrame, key: str) -> DataFrame:
    return spark.createDataFrame([], f"query_id long, {key} {like.schema[key].dataType.simpleString()}, score double")


def bm25(rows: DataFrame, key: str, columns: dict[str, Column], queries: list[tuple[int, str]], limit: int | None = 50, lenient: bool = False, tokenizer: Tokenizer | None = None) -> DataFrame:
    """The same over rows that have no stored index: all are tokenized, and postings of the asked terms and prefixes are kept, in no order."""
    own, fields = tokenizer or Tokenizer(), tuple(columns)
    phrases = [p for _, text in queries if (t := safe_parse(text, fields, lenient, own.split)) is not None for p, _ in scored(t)]
    exact = {t for p in phrases for k, t in enumerate(p.terms) if not (p.prefix and k == len(p.terms) - 1)}
    starts = tuple({p.terms[-1] for p in phrases if p.prefix and p.terms})
    every = written(gathered(rows, key, columns, own, only=lambda t: t in exact or t.startswith(starts)), "fts-postings")
    post = every.filter("term <> ''")
    stats = every.filter("term = ''").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return hits(TextIndex(post, terms_of(post, key, fields), stats, key, fields, own), queries, limit, lenient)


def top(hits: DataFrame, order: list, limit: int | None, by: str = "query_id") -> DataFrame:
    """The first rows of each query (WindowGroupLimit cuts before the shuffle)."""
    if limit is None:
        return hits
    return hits.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rn") <= limit).drop("_rn")
