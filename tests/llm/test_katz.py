import pytest

from notelake.llm import katz
from tests.llm import brute


@pytest.mark.parametrize("seed", [1, 2])
def test_katz_equals_plain_scoring(spark, seed, monkeypatch):
    monkeypatch.setattr(katz.X, "BLOCK_BYTES", 4000)
    rows = brute.hard_cases(seed)
    got = katz.score(spark.createDataFrame(rows, brute.DDL).repartition(3), parts=3).collect()
    want = brute.katz([(r[0], r[1]) for r in rows])
    plain = sorted((-1 if r[0] is None else r[0], *x[:3], round(x[3], 6), round(x[4], 6)) for r, x in zip(rows, want))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == plain


def test_katz_of_nothing(spark):
    assert katz.score(spark.createDataFrame([], brute.DDL)).count() == 0


def test_held_out_and_least_long(spark):
    import zlib

    rows = [(-(1 << 63), "a b c", *brute.hard_cases(1)[0][2:]), *brute.hard_cases(1)]
    got = katz.score(spark.createDataFrame(rows, brute.DDL).repartition(3), parts=3).collect()
    held = lambda i: zlib.crc32(b"null" if i is None else b"%d" % i) % 7 == 2
    assert sorted(map(repr, ((r.doc_id, r.held_out) for r in got))) == sorted(map(repr, ((r[0], held(r[0])) for r in rows)))
