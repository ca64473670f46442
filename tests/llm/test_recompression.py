import hashlib

import pytest

from notelake.llm import recompression
from tests.llm import brute


def expected(rows):
    return sorted(repr((i, n, r, hashlib.sha256(k).hexdigest())) for i, n, r, k in brute.word_windows(rows))


def found(spark, rows, partitions=5, **options):
    return sorted(repr(tuple(r)) for r in recompression.dedup(spark.createDataFrame(rows, brute.DDL).repartition(partitions), parts=3, **options).collect())


def more(rows, *texts):
    return rows + [(5000 + i, t, *rows[0][2:]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,rounds", [(1, 3), (5, 3), (7, 0), (8, 5)])
def test_removed_words_equal_brute_force(spark, seed, rounds):
    rows = more(brute.hard_cases(seed), " ".join(["la"] * 130), "x " + " ".join(["la"] * 60), "la la lu lu lu " * 30)
    assert found(spark, rows, rounds=rounds) == expected(rows)


def test_ties_of_ids_don_t_depend_on_partitions(spark):
    start = " ".join(f"s{i}" for i in range(30))
    rows = [(5, f"{start} {' '.join(f'{c}{i}' for i in range(40))}", "en", "a", 0, 1, 2, 3, 4, "k", "r", 0, 1) for c in "abcd"]
    rows += [(None, r[1], *r[2:]) for r in rows] + [(-(1 << 63), rows[0][1], *rows[0][2:]), (6, rows[1][1], *rows[1][2:])]
    assert {tuple(found(spark, rows, n)) for n in (1, 2, 7)} == {tuple(expected(rows))}


def test_windows_of_one_key_are_told_apart(spark):
    """All windows are forced to one key of 2 bits; what differs survives."""
    rows = brute.hard_cases(6)
    assert found(spark, rows, key_bits=2) == expected(rows)


def test_text_longer_than_a_block(spark):
    r = __import__("random").Random(2)
    long = " ".join(r.choice(("ab", "cd", "ef")) + str(r.randrange(200_000)) for _ in range(700_000))
    rows = [(1, long, *brute.hard_cases(1)[0][2:]), (2, "new words here " + long[4_000_000:4_000_400], *brute.hard_cases(1)[0][2:])]
    assert len(long) > 1 << 22 and found(spark, rows) == expected(rows)


def test_nothing(spark):
    assert recompression.dedup(spark.createDataFrame([], brute.DDL)).count() == 0
