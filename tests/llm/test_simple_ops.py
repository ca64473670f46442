"""SimHash, I-Match, URL filter, mixing, classifier and rules on hard cases, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import classifier, imatch, mixing, quality_rules, simhash, url_filter
from tests.llm import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, brute.DDL).repartition(4)


@pytest.mark.parametrize("hot", [2048, 2])
def test_simhash_components(spark, hot):
    rows = brute.hard_cases(7)
    xxh = pytest.importorskip("xxhash").xxh64_intdigest
    prints = []
    for r in rows:
        w = brute.words((r[1] or "").lower() if (r[1] or "").isascii() else r[1])
        w = [x.lower() for x in brute.words(r[1])]
        h = [xxh(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h)))
    todo, want = set(range(len(rows))), []
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            x = front.pop()
            group.add(x)
            near = {y for y in todo if (prints[x] ^ prints[y]).bit_count() <= 4}
            todo -= near
            front += near
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        want += [(rows[i][0], f"{prints[i]:016x}", least) for i in group]
    got = [tuple(r) for r in simhash.grouped(frame(spark, rows), hot=hot).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_segmented_ball_equals_full_ball(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for bit in r.sample(range(64), r.randrange(1, 7)):
                x ^= 1 << bit
            fps.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = lambda e: {x.node: x.root for x in simhash.components(e).collect()}
    assert roots(simhash.links(df)) == roots(simhash.full_ball(df))


def plain_imatch(rows, low=imatch.LOW, high=imatch.HIGH):
    """The rows of the operator, by plain Python."""
    import math

    xxh = pytest.importorskip("xxhash").xxh64_intdigest
    data = sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, s if (s := xxh(x[1], 42)) < 1 << 63 else s - (1 << 64), x[1]))
    df = {}
    for _, t in data:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    n = len(data)
    band = {w for w, k in df.items() if max(2, math.ceil(low * n)) <= k <= max(2, math.floor(high * n))}

    def prints(text):
        terms = sorted(set(text.split()))
        slots = []
        for j in range(imatch.LEXICONS):
            own = [w for w in terms if w in band and xxh(b"%d:%s" % (j, w), 0) % imatch.RATES[j % len(imatch.RATES)] == 0]
            slots.append(hashlib.blake2b(b" ".join(own), digest_size=4).hexdigest()[:6] if own else None)
        return slots if any(slots) else [hashlib.blake2b(b" ".join(terms), digest_size=4).hexdigest()[:6]] * imatch.LEXICONS

    def like(a, b):
        used = [(x, y) for x, y in zip(a, b) if x or y]
        return 1.0 if a == b else sum(x == y for x, y in used) / len(used)

    out = []
    for k, (i, t) in enumerate(data):
        after = data[(k + 1) % n][1]
        s, f = t.decode(), after.decode()
        e = (s[: len(s) - len(s) // 2] + f[: len(s) // 2]).encode()
        a, b, c = prints(t), prints(e), prints(after)
        show = lambda x: "".join(y or "......" for y in x)
        out.append((i, len(s), hashlib.sha256(e).hexdigest(), show(a), show(b), like(a, b), like(a, c)))
    return out


@pytest.mark.parametrize("seed,partitions", [(9, 4), (10, 1), (11, 90)])
def test_imatch_equals_plain_version(spark, seed, partitions):
    rows = brute.hard_cases(seed, 150)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # ranges of ids, more than 64 as well
    try:
        got = imatch.fingerprinted(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_imatch(rows)))


def test_imatch_of_few(spark):
    row = brute.hard_cases(9)[0]
    assert imatch.fingerprinted(frame(spark, [])).count() == 0
    assert [r.near_next for r in imatch.fingerprinted(frame(spark, [(None, None, *row[2:])])).collect()] == [1.0]


def test_place_among_cuts(spark):
    cuts = [3, 7, 8, 20, 21]
    got = spark.range(25).select("id", imatch.place_of(F.col("id"), cuts).alias("p")).collect()
    assert all(r.p == sum(c < r.id for c in cuts) for r in got)


URLS = ["http://A.example.NET/en/x?q", "https://x.org/fr/1#t", "http://net/", "http://net", "http://mynet/", "no scheme", None, "", "ftp://b.example.com/de/", "http://spam1.example.org/p", "a://b://c/d", "http://h.org/p/%20", "http://h.org/p/%20"]


def test_url_rules_and_cascade(spark):
    urls = URLS + [f"http://h{i % 50}.example.org/p/{i}" for i in range(3000)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    listed = lambda k: bool(k) and (k.startswith("spam") or hashlib.md5(k.encode()).hexdigest()[0] == "0")
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        stop = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:stop].lower(), rest[stop:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rule = max(fits, key=len, default=None)
        verdict = rules[rule] if rule else "block" if host and (listed(host) or listed(host + path)) else "allow"
        assert tuple(got[i]) == (i, host, path, rule, verdict), u
    few = spark.createDataFrame([("h1.example.org",)], "key string")
    assert {r.host for r in url_filter.judge(df, few).filter("verdict = 'block' and rule is null").collect()} == {"h1.example.org"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_filter_in_shards(spark):
    """Lists of any length go the same way: more shards, the same verdicts, no join."""
    df = spark.createDataFrame([(i, f"http://h{i % 50}.example.org/p/{i}") for i in range(500)], "page_id long, url string")
    one = sorted(map(tuple, url_filter.judge(df).collect()), key=repr)
    many = url_filter.judge(df, shard_bytes=16)
    assert url_filter.shards_for(40, 500, 16) > 3
    assert sorted(map(tuple, many.collect()), key=repr) == one
    assert "Join" not in many._jdf.queryExecution().executedPlan().toString()


def test_url_plan_has_no_join_or_python(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 50}.example.org/p/{i}") for i in range(500)], "page_id long, url string")
    plan = url_filter.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


def test_mixing_targets(spark):
    rows = brute.hard_cases(4)
    got = mixing.mix_report(frame(spark, rows)).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in names}
    of = {r[0]: r[3] for r in rows}
    for r in got:
        s = of[r.doc_id]
        if list(of).count(r.doc_id) == 1 and r.doc_id is not None and [x[0] for x in rows].count(r.doc_id) == 1:
            assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    assert abs(sum(target.values()) - total) < 1e-6
    assert sorted(map(repr, mixing.mix_report(frame(spark, rows)).collect())) == sorted(map(repr, got))
    assert mixing.mix_report(frame(spark, [])).count() == 0


def test_classifier(spark):
    rows = brute.hard_cases(5)
    r = random.Random(1)
    rows += [(10_000 + i, ("$$$ | %% " if i % 3 == 0 else "") + " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) + (" ### |" if i % 3 == 0 else "."), *rows[0][2:]) for i in range(600)]
    labels = spark.createDataFrame([(10_000 + i, int(i % 3 != 0), 0) for i in range(600)] + [(None, 1, 0), (10_000, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = classifier.classify(docs, labels).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id and x.doc_id >= 10_000]
    assert np.mean([x.predicted == int((x.doc_id - 10_000) % 3 != 0) for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    kept = classifier.accept(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.select("doc_id").collect()) == sorted(str(x.doc_id) for x in got if x.predicted)
    assert {x.score for x in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(frame(spark, []), labels).count() == 0


def plain_svm(texts, good, docs):
    """Scores of docs by naive Bayes support vectors, with dictionaries instead of arrays."""
    import math
    import zlib

    def features(t):
        t = t.lower()
        found = {zlib.crc32(w) for w in t.split()}
        if len(t) > 2:
            found |= {t[i] << 8 | t[i + 1] for i in range(len(t) - 1)}
            found |= {((t[i] << 16 | t[i + 1] << 8 | t[i + 2]) * 2654435761 % (1 << 32)) >> 7 for i in range(len(t) - 2)}
        else:
            found |= set(t)
        return sorted({x % classifier.BUCKETS for x in found})

    rows = [features(t) for t in texts]
    count = [{}, {}]
    for f, g in zip(rows, good):
        for x in f:
            count[g][x] = count[g].get(x, 0) + 1
    size = [sum(c.values()) + classifier.BUCKETS for c in count]
    ratio = lambda x: math.log((count[1].get(x, 0) + 1) / size[1]) - math.log((count[0].get(x, 0) + 1) / size[0])
    w, bias, alpha, r = {}, 0.0, [0.0] * len(rows), np.random.default_rng(7)
    for _ in range(classifier.EPOCHS):
        for i in r.permutation(len(rows)):
            x = {k: ratio(k) / math.sqrt(max(1, len(rows[i]))) for k in rows[i]}
            y = 1 if good[i] else -1
            now = min(max(alpha[i] - (y * (sum(w.get(k, 0) * v for k, v in x.items()) + bias) - 1) / (sum(v * v for v in x.values()) + 1), 0), classifier.C)
            for k, v in x.items():
                w[k] = w.get(k, 0) + (now - alpha[i]) * y * v
            bias += (now - alpha[i]) * y
            alpha[i] = now
    margin = [sum(w.get(k, 0) * ratio(k) for k in f) / math.sqrt(max(1, len(f))) + bias for f in map(features, docs)]
    return [1 / (1 + math.exp(-classifier.SLOPE * m)) for m in margin]


def test_classifier_equals_plain_version(spark):
    import zlib

    rows = [x for x in brute.hard_cases(5) if x[0] is not None and (x[1] is None or len(x[1]) < 3000)]
    once = [x for x in rows if [y[0] for y in rows].count(x[0]) == 1]
    labels = [(x[0], int(len(x[1] or "") % 2), 0) for x in once[::2]] + [(once[0][0], 1, 0)]
    got = {r.doc_id: r for r in classifier.classify(frame(spark, once), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = lambda i: zlib.crc32(b"%d" % i) % 3 == 1
    train = sorted((x for x in once[::2] if not held(x[0])), key=lambda x: x[0])
    bytes_of = lambda x: (x[1] or "").encode()
    want = plain_svm([bytes_of(x) for x in train], [len(x[1] or "") % 2 for x in train], [bytes_of(x) for x in once])
    assert {r.doc_id: r.held_out for r in got.values()} == {x[0]: held(x[0]) for x in once}
    assert max(abs(got[x[0]].score - w) for x, w in zip(once, want)) < 1e-4


def test_classifier_bounds_and_ties(spark):
    rows = [(i % 40, f"word{i} " * (1 + i % 7) + "tail" * (i % 3), *brute.hard_cases(1)[0][2:]) for i in range(80)]  # two texts for each id
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    weights = [classifier.trained(spark.createDataFrame(rows, brute.DDL).repartition(n), labels) for n in (1, 3, 8)]
    assert all((w[0] == weights[0][0]).all() and w[1] == weights[0][1] for w in weights)
    few = classifier.trained(frame(spark, rows), labels, indicators=200)
    assert (few[0] != weights[0][0]).any()
    assert (classifier.trained(frame(spark, rows), labels, indicators=0)[0] == 0).all()


def test_dual_coordinate_descent_separates():
    r = np.random.default_rng(2)
    rows = [np.unique(np.r_[r.integers(0, 500, 30), 600 + (i % 2)]).astype(np.int32) for i in range(400)]
    good = np.arange(400) % 2 == 0
    w, b = classifier.fit(rows, good)
    margin = np.array([w[f].sum() / len(f) ** 0.5 + b for f in rows])
    assert ((margin > 0) == good).mean() > 0.99


def test_rules(spark):
    rows = brute.hard_cases(6)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {repr(tuple(x)[:7]) for x in quality_rules.judged(frame(spark, rows), labels).collect()}
    want = set()
    for i, t, *_ in rows:
        t = (t or "").encode()
        w = t.split()
        windows = [tuple(w[p : p + 8]) for p in range(len(w) - 7)]
        twice = {k for p, x in enumerate(windows) if windows.count(x) > 1 for k in range(p, p + 8)} if len(windows) < 3000 else None
        if twice is None:
            from collections import Counter

            c = Counter(windows)
            twice = {k for p, x in enumerate(windows) if c[x] > 1 for k in range(p, p + 8)}
        lines = [x for x in t.split(b"\n") if x.split()]
        text = t.decode()
        want.add(repr((i, len(w), sum(c not in " \t\n\r\x0b\x0c" for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice), len(w) < 20 or 100 * len(twice) > 30 * len(w))))
    assert got == want
    assert quality_rules.judged(frame(spark, []), labels).count() == 0


def test_exact_bound():
    from math import comb

    assert abs(quality_rules.binomial_tail(3, 20, 0.1) - sum(comb(20, i) * 0.1**i * 0.9 ** (20 - i) for i in range(4))) < 1e-12


def test_rules_lose_few_good_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefghij") * r.randrange(2, 6) for _ in range(30)) + (" ### $$$ %%% &&& *** ||| <<< >>> ###" if i % 4 == 0 else ""), "en", *brute.hard_cases()[0][3:]) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id: x.kept for x in quality_rules.judged(frame(spark, rows), labels).filter(~F.col("base_failed")).collect()}
    good, bad = [v for k, v in kept.items() if k % 4], [v for k, v in kept.items() if k % 4 == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) < 0.05
