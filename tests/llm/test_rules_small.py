"""Cutoffs of the quality rules on strata of a few hundred labels, and the certificate itself."""

import random

import numpy as np

from notelake.llm import quality_rules
from tests.llm import brute


def test_small_strata_are_certified(spark):
    r = random.Random(8)
    text = lambda bad: " ".join(r.choice("abcdefghij") * r.randrange(2, 6) for _ in range(30)) + (" ### $$$ %%% &&& *** ||| <<< >>> ###" if bad else "")
    langs = [lang for lang, n in (("en", 800), ("fr", 700), ("de", 150), ("es", 120), (None, 130)) for _ in range(n)]
    rows = [(i, text(i % 5 == 0), lang, *brute.hard_cases()[0][3:]) for i, lang in enumerate(langs)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    kept = {x.doc_id: x.kept for x in quality_rules.judged(spark.createDataFrame(rows, brute.DDL).repartition(4), labels).collect()}
    for lang in set(langs):
        of = [i for i, x in enumerate(langs) if x == lang]
        assert np.mean([kept[i] for i in of if i % 5 == 0]) < 0.05, lang  # de, es and null through the pool
        assert np.mean([kept[i] for i in of if i % 5]) >= 0.95, lang


def test_sequence_stops_at_the_first_member_not_certified():
    n = quality_rules.least_joint(5)
    assert quality_rules.tightest([0], n, 5) == 0 and quality_rules.tightest([0], n - 1, 5) is None
    assert quality_rules.tightest([0, 0, 40, 0], 1000, 5) == 1
    members = quality_rules.family({"symbols": {3: 990, 9: 10}, "repeats": {0: 1000}}, {"symbols": {40: 50, 12: 1, 8: 2}, "repeats": {20: 3}})
    assert [m["symbols"] for m in members] == sorted((m["symbols"] for m in members), reverse=True)
    assert members[0].keys() == {"symbols"} and members[1].keys() == {"symbols", "repeats"}
    assert quality_rules.family({"symbols": {3: 990}}, {}) == [] and quality_rules.family({}, {"symbols": {3: 9}}) == []


def test_repeats_when_all_keys_agree(monkeypatch):
    words = brute.words("a b c d e f g h i a b c d e f g h j k l m n o p q r s t")
    want = quality_rules.repeat_words(words)
    monkeypatch.setattr(quality_rules, "MULTIPLIERS", np.zeros(64, np.uint64))
    assert quality_rules.repeat_words(words) == want == 16


def plain_kept(rows, labels, alpha=quality_rules.ALPHA, delta=quality_rules.DELTA):
    """The verdicts by plain Python over the operator's own base columns. rows: (id, lang, stats by name, base_failed)."""
    import math

    xxh = __import__("xxhash").xxh64_intdigest
    grid = [round(0.005 * 1.12**i, 6) for i in range(47)]

    def ratios(s):
        over = lambda a, b: a / b if b else 0.0
        return {"symbols": over(s["n_symbols"], s["word_chars"]), "dup_lines": over(s["n_dup_lines"], s["n_lines"]), "repeats": over(s["n_repeat_words"], s["n_words"]), "long_words": over(s["word_chars"], s["n_words"]) / 20, "short_words": over(s["n_words"], s["word_chars"])}

    def tail(k, n):
        return sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(min(k, n) + 1))

    fit = lambda i: (h if (h := xxh(i.to_bytes(8, "little", signed=True), 42)) < 1 << 63 else h - (1 << 64)) % 4 == 0
    good = [(i, lang, ratios(s)) for i, lang, s, failed in rows if not failed and labels.get(i) == 1]
    bad = [(i, lang, ratios(s)) for i, lang, s, failed in rows if not failed and labels.get(i) == 0]
    count = {}
    for i, lang, _ in good:
        if not fit(i):
            count[lang] = count.get(lang, 0) + 1
    groups = len(count) + 1
    need = math.ceil(math.log(delta / groups) / math.log(1 - alpha))
    large = {k for k, n in count.items() if n >= need}
    of = lambda lang: lang if lang in large else "the pool"
    cutoff = {}
    for g in {of(lang) for lang in count}:
        own = [r for i, lang, r in good if of(lang) == g and fit(i)]
        test = [r for i, lang, r in good if of(lang) == g and not fit(i)]
        if len(test) < need:
            continue
        lost = [r for i, lang, r in bad if of(lang) == g and fit(i)]
        held, member, caught, going = None, {}, {}, True
        for share, up in [(0, u) for u in (16, 8, 4, 2, 1, 0)] + [(e, 0) for e in (0.002, 0.004, 0.008)]:
            moves = []
            for k in ("symbols", "dup_lines", "repeats", "long_words", "short_words"):
                bins = [sum(t < r[k] for t in grid) for r in own]
                j = next(j for j in range(48) if sum(b > j for b in bins) <= share * len(bins)) + up if bins else 47
                if j < 47:
                    moves.append((-sum(r[k] > grid[j] for r in lost), k, grid[j]))
            for n, k, t in sorted(moves):
                if -n <= caught.get(k, 0) or not going:
                    continue
                caught[k], member = -n, {**member, k: t}
                drops = sum(any(r[k] > t for k, t in member.items()) for r in test)
                if going := tail(drops, len(test)) <= delta / groups:
                    held = member
        if held is not None:
            cutoff[g] = held
    return {i: not failed and not any(ratios(s)[k] > t for k, t in cutoff.get(of(lang), {}).items()) for i, lang, s, failed in rows}


def test_kept_equals_plain_version(spark):
    r = random.Random(18)
    rows, labels = [], {}
    for i in range(2600):
        bad = r.random() < 0.2
        words = [r.choice("abcdefghij") * r.randrange(2, 7) for _ in range(r.choice([10, 30, 60]))]
        if bad or r.random() < 0.001:
            words += [r.choice(["###", "$$", "|", "<>"]) for _ in range(r.randrange(6, 20))]
        rows.append((i, " ".join(words), r.choice(["en"] * 6 + ["fr"] * 3 + ["de", None]), *brute.hard_cases()[0][3:]))
        if r.random() < 0.7:
            labels[i] = int(not bad)
    df = spark.createDataFrame(rows, brute.DDL).repartition(4)
    stats = {x.doc_id: x.asDict() for x in quality_rules.measured(df).collect()}
    failed = lambda s: s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]
    want = plain_kept([(x[0], x[2], stats[x[0]], failed(stats[x[0]])) for x in rows], labels)
    got = {x.doc_id: x.kept for x in quality_rules.judged(df, spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    assert got == want
    assert sum(got.values()) < sum(not failed(s) for s in stats.values())


@__import__("pytest").mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_promise_holds_on_labels_left_out(spark):
    """Cutoffs from half of the labels: of the other half's good documents no language loses over ALPHA (with slack for chance), and bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.filter("pmod(xxhash64(doc_id, 1), 2) = 0")
    kept = {x.doc_id: (x.kept, x.base_failed) for x in quality_rules.judged(docs, half).collect()}
    lang = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    rest = [x for x in labels.filter("pmod(xxhash64(doc_id, 1), 2) = 1").collect() if not kept[x.doc_id][1]]
    for name in set(lang.values()):
        own = [kept[x.doc_id][0] for x in rest if x.quality == 1 and lang[x.doc_id] == name]
        assert own.count(False) <= 0.02 * len(own) + 3 * (0.02 * len(own)) ** 0.5, name
        bad = [kept[x.doc_id][0] for x in rest if x.quality == 0 and lang[x.doc_id] == name]
        print(name, len(own), own.count(False), len(bad), bad.count(False))
        whole = len(own) >= 228
        assert bad.count(False) > (0.5 if whole else 0.3) * len(bad), name
