"""Alignment against a plain version on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from notelake.llm import alignment, exchange
from tests.llm import brute


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = alignment.tokenizer_paths()
    one = Tokenizer.from_file(a)
    one.encode_special_tokens = True
    return one, SentencePieceProcessor(model_file=b)


def tokens(models, text):
    """(A ids with end offsets, B ids with end offsets), or None."""
    one, two = models
    if not text:
        return None
    raw, letters = b" " + text.encode(), alignment.byte_letters()
    out = []
    for pieces in (
        [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids],
        [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)],
    ):
        if b"".join(p for _, p in pieces) != raw:
            return None
        at, own = 0, []
        for i, p in pieces:
            at += len(p)
            own.append((i, at))
        out.append(own)
    return out


def plain(models, rows):
    found = [tokens(models, t) for t in rows]
    counts = Counter((a, b) for f in found if f for a, e in f[0] for b, g in [x for x in f[1] if x[1] == e])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, e in f[0]} & {e for _, e in f[1]})
        groups, at = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, x in side if at < x <= e) for side in f))
            at = e
        by_end = dict((e, b) for b, e in f[1])
        links = [(a, by_end[e]) for a, e in f[0] if e in by_end]
        out.append((len(f[0]), len(f[1]), len(ends), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


HARD = [
    "", " ", "  a  b ", "a\nb\t c", " lead", "trail ", "a　b ▁c", "x▁y z", "naïve é 日本語のテキスト", "<|endoftext|> <s> </s> <unk> <0x41>",
    "it's we'll don't 'tis", "a   b    c\n\n d \n e", " q ​z \x1fw\x85v", "\U0001f600\U0001f600 ok", "a\x00b", "12345 67 8.9e10", "q" * 3000, "\r\n \r\n x", "##  ##  # #", "abc" * 700 + " end",
]


def test_alignment_equals_plain_version(spark, models, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 4000)
    rnd = random.Random(5)
    bits = [*"ab \n\t'.,", "  ", "é", "中", "the", " of ", "1", " ", "ing", "Th"]
    texts = [None, *HARD, *("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60))) for _ in range(300))]
    texts += [r[1] for r in brute.hard_cases(1)]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    got = alignment.align(df, parts=3).collect()
    want = [(r[0], *w) for r, w in zip(rows, plain(models, texts))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_borders_are_the_common_ends():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randrange(1, 30)
        a, b = (sorted({n, *rnd.sample(range(1, n + 1), rnd.randrange(0, n))}) for _ in range(2))
        got = np.array(b)[alignment.borders(np.array(a), np.array(b))].tolist()
        assert got == sorted(set(a) & set(b))


def test_chunks_are_forgotten_beyond_the_bound(models, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_CHUNKS", 3)
    own = alignment.Aligner(*alignment.tokenizer_paths())
    for text in ("one two three four five", "five six seven", "one one"):
        f = tokens(models, text)
        assert own.read([text.encode()])[0].tolist() == [[len(f[0]), len(f[1]), len({e for _, e in f[0]} & {e for _, e in f[1]})]]


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], brute.DDL)).count() == 0
    got = alignment.align(spark.createDataFrame([(1, bytearray(b"\xff\xfe a")), (2, None)], "doc_id long, text binary")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
