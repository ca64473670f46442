"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from notelake.llm import exchange, jaccard_join
from tests.llm import brute

DDL = "doc_id long, text string, n long, region string"


def plain(rows, words=5, percent=80):
    """(doc_id, set size, component) of each row, by all pairs of rows."""
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((repr((r[0], len(s), (least.get(find(i)) if s else r[0]))) for i, (r, s) in enumerate(zip(rows, sets))))


def corpus(seed, n=260):
    """Groups of copies with few edits, chains, a passage that many hold, short and empty texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(300))
    base = [[word() for _ in range(rnd.randrange(20, 90))] for _ in range(12)]
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three four five", "x " * 50, "x " * 60]
    for _ in range(n):
        kind = rnd.random()
        words = list(rnd.choice(base)) if kind < 0.55 else [word() for _ in range(rnd.randrange(3, 60))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            words[rnd.randrange(len(words))] = word()
        if kind > 0.7:
            words = passage[: rnd.randrange(20, 41)] + words[: rnd.choice([2, 8, 60])]
        texts.append(rnd.choice([" ", "\n"]).join(words))
    chain = [word() for _ in range(160)]
    texts += [" ".join(chain[i : i + 60]) for i in range(0, 100, 3)]
    return [(None if rnd.random() < 0.02 else i, t, 1, "z") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,limit,rounds,bits", [(1, 512, 8, None), (2, 8, 8, None), (3, 6, 1, 16), (4, 4, 0, None)])
def test_components_equal_all_pairs(spark, seed, limit, rounds, bits, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 3000)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got = jaccard_join.grouped(df, limit=limit, rounds=rounds, parts=3, bits=bits).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain(rows)


def test_hard_cases(spark):
    rows = [(r[0], r[1], 1, "z") for r in brute.hard_cases(1)]
    got = jaccard_join.grouped(spark.createDataFrame(rows, DDL), parts=2).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain(rows)
    assert jaccard_join.grouped(spark.createDataFrame([], DDL)).count() == 0


def test_forest_joins_what_links_join():
    rnd = random.Random(9)
    for _ in range(40):
        base = rnd.sample(range(5000), 40)
        sets = [np.unique([x if rnd.random() > 0.06 else rnd.randrange(5000) for x in base]) for _ in range(60)]
        region = jaccard_join.Region(np.arange(60), sets, np.arange(60), 80)
        us, vs = region.forest()
        assert len(us) == len({(u, v) for u, v in zip(us, vs)}) < 60
        got, want = list(range(60)), list(range(60))

        def find(root, i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in zip(region.nodes[us], region.nodes[vs]):
            both = len(np.intersect1d(sets[u], sets[v]))
            assert 100 * both >= 80 * (len(sets[u]) + len(sets[v]) - both)
            got[find(got, u)] = find(got, v)
        for i in range(60):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    want[find(want, i)] = find(want, j)
        part = lambda root: {frozenset(x for x in range(60) if find(root, x) == find(root, i)) for i in range(60)}
        assert part(got) == part(want)
