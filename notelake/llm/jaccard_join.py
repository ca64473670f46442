"""Exact Jaccard join of documents' word n-gram sets as a metric-space join: pivots, regions, windows, recursion.

The space: distinct sets of n-grams with the symmetric difference, of which the Jaccard distance is the normalised form; two sets link when
their Jaccard distance is at most EPS, and then |x - y| <= EPS |x|, as |x n y| >= (1 - EPS) |x u y|.

Pivots and regions. Every n-gram that several sets hold belongs to the region of one pivot, the least by hash of the sets that hold it; a set is spread over the
regions of the pivots it shares n-grams with, and most of a near copy lies in one. A set's private n-grams can be in no other set.

Windows. Regions stand in one order, rare ones first. For the union P of all regions before some region the triangle inequality says
|x n P| <= |y n P| + |x - y|, so a set with more than EPS |x| of its n-grams in P (private ones counted in) shares one there with whatever it links to. A set is therefore
replicated from the first region on while what lies before is at most EPS |x|, and not beyond: two linked sets meet in the first region that holds a
common n-gram. Sets whose private share is over EPS have an empty window and leave at once, which takes most documents out before anything of them is shuffled but the keys of
their n-grams, a few bytes each, through the block exchange (``exchange``).

Recursion. A region of at most LIMIT sets (and n-grams) is joined in one task. A larger one is cut around a pivot of its own, the least by hash among the sets that no
earlier pivot holds: sets within EPS of it are linked to it by one edge each and need no comparison among themselves; of these, only boundary sets stay, those whose
distance to the pivot reaches within EPS of the nearest set outside, and they are not compared with sets of the same pivot. What stays is a smaller region for the next
round. After ROUNDS rounds the rest is dealt to pairs of blocks, each of which one task joins: exact at any size, at quadratic cost in that rest alone.

A task compares by an inverted list of its n-grams, windows of set sizes, and distances to a few pivots, and gives a spanning forest of the links, never all pairs. Links
are joined to components by distributed stars. N-grams are told apart by 64 bits of XXH64: two sets of a thousand n-grams are misjudged with odds below 1e-13; equal sets are found by 128 bits.

Edge cases: null and empty texts and texts of white space only have no n-gram and link with nothing; fewer than n words are one n-gram; equal sets are linked; null ids
take part, and a component of null ids alone has a null id; repeated rows are copies, though empty ones of one id have that id; an empty table gives an empty result; further columns are passed over. A text's
n-grams are held together: memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelake.llm import exchange as X
from notelake.llm.graph import components
from notelake.llm.simhash import shingles
from notelake.llm.text import batch_of, docs, slices, values
from notelake.session import dropped, parts_for, tidied, written

WORDS, PERCENT = 5, 80
LIMIT, LOAD, ROUNDS = 512, 1 << 21, 8
SPREAD = pa.schema([("doc_id", pa.int64()), ("hash", pa.binary()), ("n", pa.int64()), ("private", pa.int64()), ("over", pa.list_(pa.struct([("region", pa.int64()), ("mass", pa.int64())])))])
SPREAD_DDL = "doc_id long, hash binary, n long, private long, over array<struct<region: long, mass: long>>"
SETS = pa.schema([("hash", pa.binary()), ("n", pa.int64()), ("grams", pa.list_(pa.int64()))])
SETS_DDL = "hash binary, n long, grams array<long>"
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def linked(common, a, b, percent: int):
    """Whether sets of sizes a and b with so many common members link."""
    return 100 * common >= percent * (a + b - common)


def keys_of(grams: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Part keys of n-grams with so many bits inside a part; two n-grams of one key only look shared, which costs work and no link."""
    low = np.uint64(X.key_bits(parts) - bits)
    return X.part_keys(grams, parts) >> low << low


def bits_for(size: int, parts: int) -> int:
    """Bits inside a part, in whole bytes, by which one n-gram in a thousand looks shared or fewer, where there is one for each two bytes of input."""
    need = max(1, size).bit_length() + 9 - (parts - 1).bit_length()
    return min(X.key_bits(parts), max(16, -(-need // 8) * 8))


def spread(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, parts: int | None = None, bits: int | None = None) -> DataFrame:
    """Per row: doc_id, hash (128 bits of its set, null for an empty one), n (the set's size), private, and over (region, mass), null where it can have no partner.

    Blocks of documents ask the block exchange about their distinct n-grams. An entry names the first of the block's sets that hold the n-gram; of those that several
    hold, the block keeps the others. A part sees one entry a block for the hottest n-gram, and answers for those n-grams alone that several sets hold.
    """
    parts = parts or parts_for(documents, 32)
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = bits or bits_for(min(size, 1 << 50), parts)

    def ask(ids, ties, texts):
        from xxhash import xxh3_128_digest

        found = [np.unique(shingles(t, words)) for t in texts]
        n = np.array([len(x) for x in found], np.int64)
        hashes = b"".join([xxh3_128_digest(x.tobytes()) for x in found])
        key, doc = keys_of(np.concatenate(found), parts, bits), np.repeat(np.arange(len(n), dtype=np.int32), n)
        del found
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        times = np.diff(np.r_[new, len(key)])
        several = np.flatnonzero(times > 1)
        rest = np.repeat(times > 1, times)
        at = X.cuts(key[new], parts)
        kept = X.frame(X.pack(ids), X.pack(X.is_null(ids, ties)), X.pack(n), X.squeezed(hashes), X.pack(at), X.deltas(several), X.pack(times[several].astype(np.int32)), X.pack(doc[rest]))
        return [(-1, kept), *X.dealt(key[new], parts, ((X.pack, doc[new]), (X.pack, times > 1)))]

    def answer(part, got):
        """For each block: which of its n-grams several sets hold, the first that holds it there, and the region."""
        frames = [X.unframe(d) for _, d in got]
        keys = [X.unpack_keys(f[0]) for f in frames]
        first = np.concatenate([X.unpack(f[1], np.int32) for f in frames])
        several = np.concatenate([X.unpack(f[2], np.bool_) for f in frames])
        _, of, _, ends = X.merged(keys)
        block = np.repeat(np.array([b for b, _ in got], np.int64), [len(k) for k in keys])
        own = X.mixed(X.mixed(block.astype(np.uint64)) + first.astype(np.uint64))
        region = np.full(of.max() + 1 if len(of) else 0, np.iinfo(np.uint64).max)
        np.minimum.at(region, of, own)
        shared = (np.bincount(of, minlength=len(region))[of] > 1) | several
        out = []
        for (b, _), s, e in zip(got, np.r_[0, ends[:-1]], ends):
            at = np.flatnonzero(shared[s:e])
            if len(at):
                out.append((b, X.frame(X.deltas(at), X.pack(first[s:e][at]), X.pack(region[of[s:e][at]]))))
        return out

    asks, kept = X.saved(X.asked(documents, ask, ordered=False), "jaccard-asked")
    answers = tidied(written(X.answered(asks, parts, answer), "jaccard-shared"))
    dropped(asks)

    def finish(state, got):
        ids, none, n, hashes, at, several, times, docs_of = X.unframe(state)
        ids, none, n, at, times, docs_of = (X.unpack(x, t) for x, t in ((ids, np.int64), (none, np.bool_), (n, np.int64), (at, np.int64), (times, np.int32), (docs_of, np.int32)))
        several, hashes = X.undelta(several, np.int64), X.expanded(hashes)
        doc, region = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        start = np.r_[0, np.cumsum(times)].astype(np.int64)
        for part, data in got:
            entry, first, own = (f(x, t) for f, x, t in zip((X.undelta, X.unpack, X.unpack), X.unframe(data), (np.int64, np.int32, np.uint64)))
            entry = entry + at[part]
            place = np.minimum(np.searchsorted(several, entry), max(0, len(several) - 1))
            many = several[place] == entry if len(several) else np.zeros(len(entry), bool)
            doc.append(first[~many].astype(np.int64))
            region.append(own[~many])
            if many.any():
                size = times[place[many]].astype(np.int64)
                stop = np.cumsum(size)
                doc.append(docs_of[np.repeat(start[place[many]] - (stop - size), size) + np.arange(stop[-1])].astype(np.int64))
                region.append(np.repeat(own[many], size))
        doc, region = np.concatenate(doc), np.concatenate(region)
        private = n - np.bincount(doc, minlength=len(n))
        stays = (n > 0) & (100 * private <= (100 - percent) * n)
        doc, region = doc[stays[doc]], region[stays[doc]]
        order = np.lexsort((region, doc))
        doc, region = doc[order], region[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (region[1:] != region[:-1])]) if len(doc) else np.empty(0, np.int64)
        mass = np.diff(np.r_[new, len(doc)])
        offsets = np.searchsorted(doc[new], np.arange(len(n) + 1))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(region[new].view(np.int64)), pa.array(mass, pa.int64())], ["region", "mass"]), mask=pa.array(~stays))
        return pa.Table.from_arrays([pa.array(ids, mask=none), pa.array([hashes[i : i + 16] if m else None for i, m in zip(range(0, len(hashes), 16), n.tolist())], pa.binary()), pa.array(n), pa.array(private), lists], schema=SPREAD)

    out = tidied(written(X.by_block(kept, answers, finish, SPREAD_DDL), "jaccard-spread"))
    dropped(answers)
    return out


def windows(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(region, hash, n): the regions of each distinct set's window. found: what ``spread`` gives."""
    over = lambda mass: 100 * mass <= (100 - percent) * F.col("n")
    sets = found.filter("over is not null").groupBy("hash").agg(F.first("n").alias("n"), F.first("private").alias("private"), F.first("over").alias("over"))
    each = written(sets.select("hash", "n", "private", F.inline("over")), "jaccard-masses")
    rare = each.groupBy("region").agg(F.count("*").alias("held")).filter("held > 1")
    before = Window.partitionBy("hash").orderBy("held", "region").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(rare, "region", "left").fillna({"held": 1}).withColumn("before", F.col("private") + F.coalesce(F.sum("mass").over(before), F.lit(0)))
    return placed.filter(over(F.col("before")) & (F.col("held") > 1)).select("region", "hash", "n")


def gram_sets(documents: DataFrame, members: DataFrame, words: int = WORDS) -> DataFrame:
    """node, hash, n, grams of the sets that are members (hash, doc_id of a row that has it), a written table: the texts of these rows are read again."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in slices(batches):
            found = [np.unique(shingles(t, words)).view(np.int64) for t in values(batch, "text")]
            ends = np.cumsum([0, *map(len, found)])
            yield batch_of(SETS, [xxh3_128_digest(x.tobytes()) for x in found], np.diff(ends), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found))))

    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    rows = docs(documents).select(*key, "doc_id", "text").join(members.select(*key).distinct(), ["none", "id"], "left_semi").select("text")
    sets = rows.mapInArrow(run, SETS_DDL).join(members.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    return tidied(written(sets.withColumn("node", F.monotonically_increasing_id()), "jaccard-sets"))


class Region:
    """Some sets in one task. label: the pivot that a set is known to be linked to, or its own number."""

    def __init__(self, nodes: np.ndarray, grams: list[np.ndarray], labels: np.ndarray, percent: int):
        order = np.argsort([len(g) for g in grams], kind="stable")
        self.nodes, self.labels, self.percent = nodes[order], labels[order], percent
        grams = [grams[i] for i in order.tolist()]
        self.n = np.array([len(g) for g in grams], np.int64)
        _, of = np.unique(np.concatenate(grams), return_inverse=True)
        self.at = np.r_[0, np.cumsum(self.n)]
        self.of, holder = of, np.repeat(np.arange(len(grams)), self.n)
        by = np.argsort(of, kind="stable")
        self.holders, self.lists = holder[by], np.r_[0, np.cumsum(np.bincount(of))]
        self.pivots: list[np.ndarray] = []  # distances of all to some sets compared so far

    def common(self, i: int) -> np.ndarray:
        """How many members each set shares with set i, by the lists of i's members."""
        own = self.of[self.at[i] : self.at[i + 1]]
        start, size = self.lists[own], self.lists[own + 1] - self.lists[own]
        stop = np.cumsum(size)
        return np.bincount(self.holders[np.repeat(start - (stop - size), size) + np.arange(stop[-1])], minlength=len(self.n))

    def forest(self) -> tuple[list[int], list[int]]:
        """Edges (places) that join what links join."""
        us: list[int] = []
        vs: list[int] = []
        rest, labels = np.ones(len(self.n), bool), self.labels
        eps = (100 - self.percent) / 100 + 1e-9
        for first in range(len(self.n)):
            if not rest[first]:
                continue
            rest[first] = False
            front = [first]
            if (known := rest & (labels == labels[first])).any():  # linked through their pivot already
                front += np.flatnonzero(known).tolist()
                rest &= ~known
            while front:
                i = front.pop()
                near = rest & (self.n * 100 >= self.percent * self.n[i]) & (self.percent * self.n <= 100 * self.n[i])
                for d in self.pivots:
                    near &= np.abs(d - d[i]) <= eps
                if not near.any():
                    continue
                common = self.common(i)
                if len(self.pivots) < 4:
                    self.pivots.append(1 - common / (self.n + self.n[i] - common))
                if not (near := near & linked(common, self.n, self.n[i], self.percent)).any():
                    continue
                got = np.flatnonzero(near).tolist()
                us += [i] * len(got)
                vs += got
                near = rest & (near | np.isin(labels, labels[got]))
                front += np.flatnonzero(near).tolist()
                rest &= ~near
        return us, vs


def joined(rows: DataFrame, sets: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Links within each group of bounded size. rows: by, node, label. Groups come one after another in sorted order."""
    k = len(by)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        now = None

        def given():
            nodes, labels, grams = zip(*{x[0]: x for x in held}.values(), strict=True)
            if len(nodes) < 2:
                return
            region = Region(np.array(nodes, np.int64), list(grams), np.array(labels, np.int64), percent)
            us, vs = region.forest()
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(region.nodes[us]), pa.array(region.nodes[vs])], schema=EDGES)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(k)), strict=True))
            nodes, labels = (batch.column(k + i).to_pylist() for i in range(2))
            lists = batch.column(k + 2)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, key in enumerate(keys):
                if key != now:
                    if held:
                        yield from given()
                    held, now = [], key
                held.append((nodes[i], labels[i], flat[ends[i] : ends[i + 1]].copy()))
        if held:
            yield from given()

    dealt = rows.join(sets.select("node", "grams"), "node").select(*by, "node", "label", "grams")
    return dealt.repartition(2 * parts_for(sets, 32), *by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def around_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """rows (region, node, n, label, grams), with pivot and the distance to it, null for those held by an earlier pivot's label alone where no pivot is left."""

    def run(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            common, held = [], {}
            for region, own, pivot in zip(column("region").to_pylist(), column("grams"), column("pivot_grams"), strict=True):
                if region not in held:
                    held = {region: pivot.values.to_numpy()}
                common.append(len(np.intersect1d(own.values.to_numpy(), held[region], assume_unique=True)))
            yield pa.RecordBatch.from_arrays([column("region"), column("node"), column("n"), column("label"), column("pivot"), column("pivot_n"), pa.array(common, pa.int64())], ["region", "node", "n", "label", "pivot", "pivot_n", "common"])

    free = rows.filter("label = node")
    pivot = free.groupBy("region").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node")).alias("p")).select("region", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    grams = rows.select(F.col("node").alias("pivot"), F.col("region"), F.col("grams").alias("pivot_grams"))
    pivot = written(pivot.join(grams, ["region", "pivot"]), "jaccard-pivots")
    found = rows.join(pivot, "region").mapInArrow(run, "region long, node long, n long, label long, pivot long, pivot_n long, common long")
    return written(found, "jaccard-around")


def large_links(rows: DataFrame, sets: DataFrame, percent: int, limit: int, load: int, rounds: int) -> list[DataFrame]:
    """The links of regions that are too large for one task. rows: region, node, n."""
    edges: list[DataFrame] = []
    rows = rows.withColumn("label", F.col("node"))
    eps = (100 - percent) / 100
    for _ in range(rounds):
        around = around_pivots(rows.join(sets.select("node", "grams"), "node"), percent)
        d = 1 - F.col("common") / (F.col("n") + F.col("pivot_n") - F.col("common"))
        near = linked(F.col("common"), F.col("n"), F.col("pivot_n"), percent)
        around = around.withColumns({"d": d, "near": near})
        edges.append(around.filter("near and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")))
        # held by the pivot: near it, and free until now; those that an earlier pivot holds stay guests of that one
        around = around.withColumn("mine", F.col("near") & (F.col("label") == F.col("node")))
        edge = around.groupBy("region").agg(F.min(F.when(~F.col("near"), F.col("d"))).alias("outside"), F.count_if((F.col("label") == F.col("node")) & ~F.col("near")).alias("free"))
        # what is within the window of what is outside stays; where no free set is left, so do guests of several pivots, which later blocks compare
        stays = ~F.col("mine") | (F.col("d") >= F.col("outside") - eps - 1e-9)
        kept = around.join(edge, "region").filter(stays).select("region", "node", "n", F.when(F.col("mine"), F.col("pivot")).otherwise(F.col("label")).alias("label"), "free")
        kept = written(kept, "jaccard-kept")
        several = kept.groupBy("region").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("held"), F.sum("n").alias("load"), F.max("free").alias("left")).filter("a < b").drop("a", "b")
        several = written(several, "jaccard-regions")
        small = (F.col("held") <= limit) & (F.col("load") <= load) | (F.col("held") == 2)
        members = kept.drop("free").join(several, "region")
        edges.append(joined(members.filter(small), sets, ["region"], percent))
        ended = members.filter(~small & (F.col("left") == 0))
        edges.append(blocks(ended, sets, percent, limit, load))
        rows = written(members.filter(~small & (F.col("left") > 0)).select("region", "node", "n", "label"), "jaccard-large")
        if rows.isEmpty():
            return edges
    every = rows.groupBy("region").agg(F.count("*").alias("held"), F.sum("n").alias("load"))
    return [*edges, blocks(rows.join(every, "region"), sets, percent, limit, load)]


def blocks(rows: DataFrame, sets: DataFrame, percent: int, limit: int, load: int) -> DataFrame:
    """Links of regions by pairs of blocks of bounded size. rows: region, node, n, label, held, load."""
    count = F.ceil(F.greatest(F.col("held") / (limit / 2), F.col("load") / (load / 2))).cast("long")
    own = rows.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    both = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    spread = own.withColumn("pair", F.explode(both)).select("region", "node", "label", "pair.i", "pair.j")
    return joined(spread, sets, ["region", "i", "j"], percent)


def links(placed: DataFrame, sets: DataFrame, percent: int = PERCENT, limit: int = LIMIT, load: int = LOAD, rounds: int = ROUNDS) -> DataFrame:
    """Edges (u, v) of distinct sets, each a link, that join whatever links join. placed: region, node, n; sets: node, n, grams; both written tables."""
    size = written(placed.groupBy("region").agg(F.count("*").alias("held"), F.sum("n").alias("load")), "jaccard-sizes")
    members = placed.join(size, "region")
    small = (F.col("held") <= limit) & (F.col("load") <= load) | (F.col("held") == 2)
    own = members.filter(small).select("region", "node", F.col("node").alias("label"))
    edges = [joined(own, sets, ["region"], percent)]
    large = written(members.filter(~small).select("region", "node", "n"), "jaccard-large")
    if not large.isEmpty():
        edges += large_links(large, sets, percent, limit, load, rounds)
    every = edges[0]
    for e in edges[1:]:
        every = every.union(e)
    return every


def grouped(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, limit: int = LIMIT, load: int = LOAD, rounds: int = ROUNDS, parts: int | None = None, bits: int | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    rows = spread(documents, words, percent, parts, bits)
    placed = written(windows(rows, percent), "jaccard-windows")
    several = placed.join(placed.groupBy("region").agg(F.count("*").alias("held")).filter("held > 1").select("region"), "region", "left_semi")
    first = rows.filter("n > 0").groupBy("hash").agg(F.min("doc_id").alias("first"))
    members = written(rows.filter("over is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).join(several.select("hash").distinct(), "hash", "left_semi"), "jaccard-members")
    sets = gram_sets(documents, members, words)
    named = written(several.join(sets.select("hash", "node"), "hash").select("region", "node", "n"), "jaccard-placed")
    roots = components(links(named, sets, percent, limit, load, rounds))
    rooted = first.join(sets.select("hash", "node").join(roots, "node"), "hash", "left").select("hash", "first", "node", "root")
    rooted = written(rooted.join(sets.select("hash", F.col("node").alias("own")), "hash", "left").select("hash", "first", F.coalesce("root", "own").alias("root")), "jaccard-roots")
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    ends = rooted.join(least, "root", "left").select("hash", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.select("doc_id", "n", "hash").join(ends, "hash", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
