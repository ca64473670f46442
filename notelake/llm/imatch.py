"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band (as shares of all documents: idf between -ln HIGH
and -ln LOW), counted over all documents. LEXICONS random subsets of it are drawn by a term's hash, at four rates. A
document's distinct terms are sorted, and for each subset those in it are hashed to six hex digits ("......" if none).
Likeness is the share of slots with equal hashes among those where either document has terms.

At most mean-distinct-terms / LOW terms can reach a document frequency of LOW, whatever the corpus's size: that bounds
the lexicon that is broadcast (as 64-bit hashes). A text without any lexicon term hashes all its terms in every slot.

The next document is found without a global sort: ids are dealt to ranges at quantiles, each range is sorted by itself, and
the first row of a range also goes to the range before it (that of the first range to the last).

Edge cases: null text counts as empty; null ids come first, ties of ids are ordered by text hash, so repeated rows stand side by
side; a single document is its own next; an empty table gives an empty result; further columns are passed over. A text's words
are held together: memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import batch_of, docs, slices, values
from notelake.session import parts_for

LOW, HIGH, LEXICONS, RATES, DIGITS = 0.001, 0.1, 48, (64, 128, 256, 512), 6
NONE = "." * DIGITS
ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def term_hash(term: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(term, 0)


def frequencies(documents: DataFrame) -> DataFrame:
    """(term, df) with the term as a signed 64-bit hash; counted per task first."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def given(counts):
        keys = np.fromiter(map(term_hash, counts), np.uint64, len(counts)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches):
        from collections import Counter

        counts: Counter = Counter()
        for batch in slices(batches):
            for text in values(batch, "text"):
                counts.update(set(text.split()))
            if len(counts) > 400_000:
                yield given(counts)
                counts = Counter()
        yield given(counts)

    return docs(documents).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(documents: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band; their number is bounded as said above."""
    n = documents.count()
    band = frequencies(documents).filter((F.col("df") >= max(2, math.ceil(low * n))) & (F.col("df") <= max(2, math.floor(high * n)))).select("term").toArrow()
    return np.sort(band["term"].to_numpy().view(np.uint64)) if band.num_rows else np.empty(0, np.uint64)


class Prints:
    """Fingerprints of texts, with the slots of each term kept while the task runs."""

    def __init__(self, band: np.ndarray, lexicons: int = LEXICONS, rates: tuple = RATES):
        self.band, self.slots, self.lexicons, self.rates = band, {}, lexicons, rates

    def learn(self, term: bytes) -> tuple:
        if len(self.slots) > 500_000:
            self.slots.clear()
        h = term_hash(term)
        at = np.searchsorted(self.band, np.uint64(h))
        found = ()
        if at < len(self.band) and int(self.band[at]) == h:
            found = tuple(j for j in range(self.lexicons) if term_hash(b"%d:%s" % (j, term)) % self.rates[j % len(self.rates)] == 0)
        self.slots[term] = found
        return found

    def of(self, text: bytes) -> str:
        terms, slots, some = set(text.split()), self.slots, {}
        for t in terms:
            got = slots.get(t)
            for j in self.learn(t) if got is None else got:
                some.setdefault(j, []).append(t)
        if not some:
            return self.cut(sorted(terms)) * self.lexicons
        return "".join(self.cut(sorted(some[j])) if j in some else NONE for j in range(self.lexicons))

    @staticmethod
    def cut(terms: list[bytes]) -> str:
        return hashlib.blake2b(b" ".join(terms), digest_size=4).hexdigest()[:DIGITS]


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    pairs = [(x, y) for i in range(0, len(a), DIGITS) if not (x := a[i : i + DIGITS]) == (y := b[i : i + DIGITS]) == NONE]
    return sum(x == y for x, y in pairs) / len(pairs)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points, the text with its last half replaced by the start of the following text)."""
    s = text.decode("utf-8", "replace")
    half = len(s) // 2
    return len(s), (s[: len(s) - half] + following[: 4 * half].decode("utf-8", "ignore" if len(following) > 4 * half else "replace")[:half]).encode()


def place_of(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are less than x, by binary search: log2 steps however many there are."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda found, step: found + F.when((found + step <= len(cuts)) & (F.get(F.lit(cuts), found + step - 1) < x), step).otherwise(F.lit(0)))


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (look, doc_id, text) such that, within each partition, the next row holds the next document; look = 1: only that."""
    n = parts_for(documents)
    # nulls stand first: (0, -) before (1, id)
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), 100_000).alias("q")).first()["q"] if n > 1 else None
    cuts = sorted(set(map(int, cuts or [])))
    part = F.lit(0) if not cuts else F.coalesce(place_of(F.col("doc_id"), cuts), F.lit(0))
    firsts = ids.groupBy(part.alias("part")).agg(F.max(F.col("doc_id").isNull()).alias("none"), F.min("doc_id").alias("least")).orderBy("part").collect()  # one row for each range
    none, least, behind = [True] * (len(cuts) + 1), [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, r in enumerate(firsts):
        none[r["part"]], least[r["part"]], behind[r["part"]] = r["none"], r["least"], firsts[k - 1]["part"]
    rows = docs(documents).withColumn("part", part)
    at = lambda kind, xs: F.get(F.lit(xs) if any(x is not None for x in xs) else F.array(F.lit(None).cast(kind)), F.col("part")).cast(kind)
    is_first = F.when(at("boolean", none), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == at("long", [0 if x is None else x for x in least]))
    rows = rows.withColumn("before", F.when(is_first, at("int", behind)))
    own, look = F.struct(F.col("part").alias("part"), F.lit(0).alias("look")), F.struct(F.col("before").alias("part"), F.lit(1).alias("look"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, look))).alias("p")).select("p.part", "p.look", "doc_id", "text")
    order = ["look", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"]
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions(*order).select("look", "doc_id", "text")


def fingerprinted(documents: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    shipped = documents.sparkSession.sparkContext.broadcast(lexicon(documents, low, high))

    def run(batches):
        prints, last = Prints(shipped.value), None
        for batch in slices(batches):
            out = []
            for look, doc_id, text in zip(values(batch, "look"), values(batch, "doc_id"), values(batch, "text"), strict=True):
                own = prints.of(text)
                if last is not None:
                    n, changed = edited(last[1], text)
                    after = prints.of(changed)
                    out.append((last[0], n, hashlib.sha256(changed).hexdigest(), last[2], after, likeness(last[2], after), likeness(last[2], own)))
                last = None if look else (doc_id, text, own)
                if look:
                    break
            if out:
                yield batch_of(ROWS, *map(list, zip(*out, strict=True)))

    return with_next(documents).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
