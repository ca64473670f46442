"""Plain versions of the operators, for small inputs, and tables of hard cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

DDL = "doc_id long, text string, lang string, source string, n_chars long, part int, block long, size long, fp long, key string, row string, look int, piece int"


def hard_cases(seed=1, n=60):
    """Null ids and texts, empty and long texts, ties, repeated rows; and columns named like those that operators make."""
    r = random.Random(seed)
    vocab = ["the", "of", "And", "über", "x", "$$$", "été", *(f"w{i}" for i in range(400))]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [sentence(70), sentence(40), "same line here " * 30]
    texts = [None, "", " \n\t ", "one", "a b c", "a b c d", "y" * 700, "ab" * 300, "z z " * 90, sentence(6000)]
    for _ in range(n):
        t = sentence(r.choice([5, 30, 60, 120]))
        if r.random() < 0.4:
            t += r.choice([" ", "\n"]) + r.choice(shared) + " " + sentence(20)
        if r.random() < 0.2:
            words = t.split(" ")
            words[r.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
        texts.append(t)
    rows = [[i * 3, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "Z", None]), 0, 1, 2, 3, 4, "k", "r", 0, 1] for i, t in enumerate(texts)]
    rows.append(list(rows[12]))
    rows.append([rows[13][0], "tie of an id " + sentence(30), *rows[13][2:]])
    rows += [[None, sentence(50), *rows[0][2:]], [None, None, *rows[0][2:]]]
    r.shuffle(rows)
    return [tuple(x) for x in rows]


def words(t):
    return (t or "").encode().split()


def katz(rows, k=5):
    """{row number: (n_tokens, n_known, N, base, score)}."""
    out = [zlib.crc32(b"null" if i is None else b"%d" % i) % 7 == 2 for i, _ in rows]
    seqs = [[w.lower() for w in words(t)] + [None] for _, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for held, s in zip(out, seqs):
        if not held:
            uni.update(s)
            for a, b in zip([0, *s], s):
                bi[a, b] += 1
                ctx[a] += 1
    N, V = sum(uni.values()), len(uni)

    def disc(c):
        n = Counter(c.values())
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        d = {}
        for r in range(1, k + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and n[r + 1] and common < 1 else 0
            d[r] = x if 0 < x < 1 else (r - 0.5) / r
        return lambda v: v * d.get(v, 1)

    d1, d2 = disc(uni), disc(bi)
    unk = 1 - sum(d1(c) for c in uni.values()) / (N + 0.5)
    p1 = lambda w: d1(uni[w]) / (N + 0.5) if uni[w] else unk
    seen = defaultdict(list)
    for (a, b), c in bi.items():
        seen[a].append((b, c))
    alpha = {a: (1 - sum(d2(c) for _, c in s) / (ctx[a] + 0.5)) / (1 - sum(p1(b) for b, _ in s)) for a, s in seen.items()}
    p2 = lambda a, b: d2(bi[a, b]) / (ctx[a] + 0.5) if bi[a, b] else alpha.get(a, 1) * p1(b)
    for a in list(seen)[:20]:  # exactly normalised over the words and the unknown event
        assert abs(sum(p2(a, b) for b in uni) + alpha[a] * unk - 1) < 1e-9
    return [(len(s), sum(uni[w] > 0 for w in s), N, sum(math.log10((uni[w] + 1) / (N + V + 1)) for w in s), sum(math.log10(p2(a, b)) for a, b in zip([0, *s], s))) for s in seqs]


def in_order(rows):
    """Row numbers by (doc_id, hash of the text, text), nulls first, their hashes downwards."""
    from xxhash import xxh64_intdigest

    def place(i):
        text = (rows[i][1] or "").encode()
        h = xxh64_intdigest(text, 42) & ((1 << 63) - 1)
        return (rows[i][0] is not None, rows[i][0] or 0, h if rows[i][0] is not None else -h, text)

    return sorted(range(len(rows)), key=place)


def word_windows(rows, n=20):
    """[(doc_id, n_words, n_removed, kept)] in the order of ids."""
    seen, out = set(), []
    for i in in_order(rows):
        w = words(rows[i][1])
        gone = set()
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            if key in seen:
                gone.update(range(p, p + n))
            seen.add(key)
        out.append((rows[i][0], len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def byte_windows(rows, n=200, first=False):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] in the order of ids; first: the first copy stays."""
    data = [(rows[i][0], (rows[i][1] or "").encode()) for i in in_order(rows)]
    count = Counter(t[p : p + n] for _, t in data for p in range(len(t) - n + 1))
    seen, out = set(), []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            key = t[p : p + n]
            if (key in seen) if first else count[key] > 1:
                gone[p : p + n] = b"\1" * n
            seen.add(key)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out
