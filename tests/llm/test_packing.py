import zlib

import numpy as np
import pytest

from notelake.llm import packing
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")


def check(rows, got, most=2048, room=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), most)):
            part = np.array(ids[at : at + most], "<u4").tobytes()
            want.append((str(r[0]), k, at, len(part) // 4, zlib.crc32(part)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= room
    return len(by), sum(w[3] for w in want)


def test_pieces_and_sequences(spark):
    rows = brute.hard_cases() + [(999, "a<|endoftext|>b İSTANBUL don't x'. l'été... ΣΑΣ 3.14 ét naïve y \U0001f600! ﬁn", *brute.hard_cases()[0][2:])]
    n, total = check(rows, packing.pack(spark.createDataFrame(rows, brute.DDL)).collect())
    assert n <= -(-total // 2048) + 1


def test_real_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    n, total = check(rows, packing.pack(df).collect())
    assert n <= -(-total // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(3).integers(1, 200, 500)
    bins, _ = packing.best_fit(lengths, packing.Capacity(400, 5, 50_000, (1, 1, 1), rule))
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 400 and len(own) <= 5 and (own**2).sum() <= 50_000


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], brute.DDL)).count() == 0


@pytest.mark.parametrize("capacity", [packing.Capacity(400, 3, 400 * 400), packing.Capacity(400, 400, 10_000), packing.Capacity(300, 4, 20_000, (1.0, 1.0, 1.0), "dot")])
def test_pack_under_capacities_that_bind(spark, capacity):
    rows = brute.hard_cases()
    got = packing.pack(spark.createDataFrame(rows, brute.DDL), capacity=capacity).collect()
    check(rows, got, capacity.longest, capacity.tokens)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= capacity.tokens and len(x) <= capacity.documents and sum(n * n for n in x) <= capacity.cost for x in by.values())
    assert max(map(len, by.values())) > 1


def test_capacities_that_hold_nothing():
    with pytest.raises(ValueError):
        packing.Capacity(cost=0).longest  # noqa: B018
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), packing.Capacity(400, 9, 10_000))


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("order", [0, 1])
def test_words_of_one_key_are_told_apart(order):
    """A word and its complement, which sums of powers modulo 2 ** 64 can't tell apart, in one text, in two, and in later calls."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    two = [thue_morse(2048), thue_morse(2048, "b", "a")]
    two = two[::-1] if order else two
    texts = [f"x {two[0]} {two[1]} {two[0]}", two[1], two[0] + ", " + two[1], "abcdefg abcdefg\0 abcdefgh", "\0 \0\0 a\0", ""]
    want = [np.array(model.encode(t, add_special_tokens=False).ids + [0], np.uint32).tobytes() for t in texts]
    known = packing.WordIds(packing.tokenizer_path())
    assert known.of(texts_of(texts)) == want
    for t, w in zip(texts[::-1], want[::-1]):
        assert known.of(texts_of([t])) == [w]
    one = packing.WordIds(packing.tokenizer_path())
    assert [one.of(texts_of([t]))[0] for t in (two[1], two[0])] == [want[1], np.array(model.encode(two[0], add_special_tokens=False).ids + [0], np.uint32).tobytes()]


def texts_of(texts):
    return [t.encode() for t in texts]


def test_every_key_shared(monkeypatch):
    """All longer words under one key: ids are still those of the tokenizer."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BYTE", np.zeros(256, np.uint64))
    model = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["elephants and crocodiles, crocodiles", "crocodiles elephants hippopotamus and elephants", "q" * 300 + " " + "r" * 300]
    known = packing.WordIds(packing.tokenizer_path())
    for t in [*texts, *texts[::-1]]:
        assert known.of([t.encode()]) == [np.array(model.encode(t, add_special_tokens=False).ids + [0], np.uint32).tobytes()]


def test_words_outlive_a_task_and_not_their_run():
    """Functions travel by value to each task; the words that a worker has learned are found by its next task of the run, with the same ids, and not by another run."""
    from pyspark import cloudpickle

    tasks = [cloudpickle.loads(cloudpickle.dumps(packing.word_ids)) for _ in range(2)]
    path = packing.tokenizer_path()
    first = tasks[0](path, "a")
    ids = first.of([b"some words, Some more", b""])
    n = len(first.at)
    again = tasks[1](path, "a")
    assert again is first and again.of([b"some words, Some more", b""]) == ids and len(again.at) == n
    assert packing.WordIds(path).of([b"some words, Some more", b""]) == ids
    other = tasks[0](path, "b")
    assert other is not first and len(other.at) == 1
