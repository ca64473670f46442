import hashlib
import random

import numpy as np
import pytest

from notelake.llm import suffix
from tests.llm import brute


def rows_of(seed):
    rows = brute.hard_cases(seed)
    r = random.Random(seed)
    long = "".join(r.choice("abcdefgh ") for _ in range(900))
    more = [long, "q" * 30 + long[100:420] + "r" * 250, long[:250] + "zz" + long[250:], long[650:] + long[:199], "ababab" * 80 + "c", "x" + "ababab" * 60]
    more += [f"{i} " * 3 + long[300:420] + f" {i}" * 60 for i in range(40)]  # one anchor under many contents
    return rows + [(7000 + i, t, *rows[0][2:]) for i, t in enumerate(more)]


def expected(rows, keep):
    return sorted(repr((i, n, r, s, hashlib.sha256(k).hexdigest())) for i, n, r, s, k in brute.byte_windows(rows, first=keep == "first"))


def found(spark, rows, keep, partitions=5, **options):
    return sorted(repr(tuple(r)) for r in suffix.dedup(spark.createDataFrame(rows, brute.DDL).repartition(partitions), keep, parts=3, **options).collect())


@pytest.mark.parametrize("keep,hot,seed", [("none", 256, 1), ("first", 256, 2), ("none", 3, 3), ("first", 2, 4)])
def test_removed_bytes_equal_brute_force(spark, keep, hot, seed):
    rows = rows_of(seed)
    assert found(spark, rows, keep, hot=hot) == expected(rows, keep)


def test_ties_of_ids_don_t_depend_on_partitions(spark):
    r = random.Random(9)
    start = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(5, start + f"{c}" * 150 + start[:250], *brute.hard_cases(1)[0][2:]) for c in "wxyz"]
    rows += [(None, x[1], *x[2:]) for x in rows] + [(-(1 << 63), rows[0][1], *rows[0][2:])]
    assert {tuple(found(spark, rows, "first", n)) for n in (1, 2, 7)} == {tuple(expected(rows, "first"))}


def test_previous_factors():
    r = random.Random(1)
    for _ in range(40):
        t = bytes(r.choice(b"ab") for _ in range(r.randrange(1, 25)))
        n = len(t)
        match = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or t[i + k] != t[j + k]), n)
        order = sorted(range(n), key=lambda i: t[i:])
        common = np.array([0, *(match(a, b) for a, b in zip(order, order[1:]))])
        got = np.empty(n, np.int64)
        got[order] = suffix.previous_factors(np.array(order), common)
        assert got.tolist() == [max([match(i, j) for j in range(i)], default=0) for i in range(n)]


def test_factors_are_clipped():
    r = random.Random(3)
    t = bytes(r.choice(b"ab") for _ in range(300))
    cut = [t[i : i + 8] for i in range(293)]
    place = np.array(r.sample(range(1000), 293))
    before, both = suffix.factors(cut, place, 8)
    same = lambda a, b: next((k for k in range(8) if a[k] != b[k]), 8)
    assert before.tolist() == [max([same(cut[i], cut[j]) for j in range(293) if place[j] < place[i]], default=0) for i in range(293)]
    assert both.tolist() == [max(same(cut[i], cut[j]) for j in range(293) if j != i) for i in range(293)]


def test_columns_come_through_unchanged(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "x" * 300), (2, "short"), (3, None)], "doc_id long, text string").withColumns({
        "at": F.expr("timestamp'2024-01-02 03:04:03.456789'"), "bad": F.lit(float("nan")), "raw": F.lit(b"\x00\xff").cast("binary"), "c0": F.lit(5),
        "tie": F.array(F.lit(1.5)), "dec": F.expr("cast(1.25 as decimal(20,5))"), "m": F.create_map(F.lit("a"), F.lit(None).cast("date")), "n_chars": F.length("text"),
    })
    got = suffix.deduplicated(df).orderBy("doc_id")
    assert got.schema.simpleString() == df.schema.simpleString()
    same = lambda rows: [repr(r.asDict()).replace("nan", "N") for r in rows]
    assert same(got.drop("text", "n_chars").collect()) == same(df.drop("text", "n_chars").orderBy("doc_id").collect())
    assert [r.n_chars for r in got.collect()] == [1, 5, None]  # the text repeats itself from its second byte on


def test_text_longer_than_a_block(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghij klmnop") for _ in range(4_400_000))
    filler = brute.hard_cases(1)[0][2:]
    rows = [(1, long, *filler), (2, "0" * 50 + long[4_300_000:4_300_500] + "1" * 50, *filler)]
    got = sorted(tuple(x) for x in suffix.dedup(spark.createDataFrame(rows, brute.DDL), "none", parts=3).collect())
    assert [x[1:4] for x in got] == [(4_400_000, 500, 1), (600, 500, 1)]


def test_nothing(spark):
    empty = spark.createDataFrame([], brute.DDL)
    assert suffix.dedup(empty).count() == 0 and suffix.deduplicated(empty).count() == 0
