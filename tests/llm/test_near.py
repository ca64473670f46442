"""The pipeline's near-dedup stage against all pairs by exact Jaccard of five-word shingles."""

import random

import corpus_pipeline
import pytest

from notelake.llm import near
from tests.llm import brute

DDL = "doc_id long, text string, source string"


def shingles(t):
    w = [x.lower() for x in brute.words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def planted(n, seed=5):
    """n unrelated texts, and by each a copy with 0.2 to 3 % of its words replaced: odd ids are the copies."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 600))]
        copy = [("new%d" % r.randrange(99) if r.random() < p else w) for p in [r.uniform(0.002, 0.03)] for w in words]
        rows += [(2 * i, " ".join(words), "a"), (2 * i + 1, " ".join(copy), "b")]
    return rows


def test_planted_copies_of_four_fifths_are_met(spark):
    rows = planted(300)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DDL).repartition(4), "").collect()}
    at = [similarity(shingles(a[1]), shingles(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    close = [i for i, x in enumerate(at) if x >= near.LEAST]
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        some = [i for i in close if low <= at[i] < high]
        assert len(some) > 20
        print(low, len(some), sum(2 * i + 1 not in kept for i in some))
    assert sum(2 * i + 1 in kept for i in close) <= 0.01 * len(close)
    assert all(2 * i + 1 in kept for i, x in enumerate(at) if x < near.LEAST) and all(2 * i in kept for i in range(300))


@pytest.mark.parametrize("small,region", [(32, 2048), (3, 2048), (3, 20)])
def test_group_of_copies_of_one_text(spark, small, region):
    """Copies that are further from each other than from their source, in buckets below and above the size compared in all pairs."""
    r = random.Random(2)
    words = [f"w{r.randrange(3000)}" for _ in range(200)]
    rows = [(0, " ".join(words), "a")]
    for i in range(1, 200):
        copy = list(words)
        for at in r.sample(range(200), 2):
            copy[at] = f"new{r.randrange(999)}"
        rows.append((i, " ".join(copy), "a"))
    assert [x.doc_id for x in near.one_of_each(spark.createDataFrame(rows, DDL).repartition(4), small=small, region=region).collect()] == [0]


def test_columns_and_exact_links(spark):
    rows = brute.hard_cases(3)
    df = spark.createDataFrame(rows, brute.DDL).repartition(4)
    assert near.one_of_each(spark.createDataFrame([(i, " " * i, "a") for i in range(40)], DDL)).count() == 1  # a large bucket of white space
    got = near.one_of_each(df)
    assert got.columns == df.columns
    sets, todo, want = [shingles(r[1]) for r in rows], set(range(len(rows))), []
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            group.add(x := front.pop())
            found = {y for y in todo if similarity(sets[x], sets[y]) >= near.LEAST}
            todo -= found
            front += found
        want.append(min((r[0] is None, r[0] or 0) for r in map(rows.__getitem__, group)))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(want)
    assert near.one_of_each(df.limit(0)).count() == 0


def test_one_row_of_each_component_and_null_ids(spark):
    """Unrelated texts of one id both stay; copies under null ids go."""
    r = random.Random(3)
    a, b, c = (" ".join(f"w{r.randrange(3000)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "a"), (1, b, "a"), (2, a, "a"), (None, b, "a"), (None, c, "a"), (None, c, "a")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DDL), "").collect()
    assert sorted((repr(x.doc_id), x.text) for x in got) == sorted([("1", a), ("1", b), ("None", c)])


def test_copies_inside_large_buckets(spark):
    """Texts of one long shared passage (a Jaccard of about 0.6 to one another) fill the same buckets; each one's copy is still met."""
    r = random.Random(12)
    shared = [f"s{i}" for i in range(230)]
    rows = []
    for i in range(60):
        own = [f"o{r.randrange(10**6)}" for _ in range(70)]
        copy = list(own)
        copy[r.randrange(70)] = "edit"
        rows += [(2 * i, " ".join(shared + own), "a"), (2 * i + 1, " ".join(shared + copy), "a")]
    assert 0.5 < similarity(shingles(rows[0][1]), shingles(rows[2][1])) < 0.8 < similarity(shingles(rows[0][1]), shingles(rows[1][1]))
    got = sorted(x.doc_id for x in near.one_of_each(spark.createDataFrame(rows, DDL).repartition(4), small=6).collect())
    assert got == list(range(0, 120, 2))


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_in_buckets_above_the_default_bound(spark, seed):
    """Three hundred texts, each a few words further on in one sequence than the last, leave one row: no link of the chain is lost where buckets hold hundreds."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(1500)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 600]), "a") for i in range(300)]
    r.shuffle(rows)
    assert [x.doc_id for x in near.one_of_each(spark.createDataFrame(rows, DDL).repartition(4)).collect()] == [0]
