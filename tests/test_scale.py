"""Work that must not grow with what a query doesn't ask for."""

import os

from notelake.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_a_walk_makes_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "shared_dir", lambda s: str(tmp_path))
    got = {r["source_id"]: r["depth"] for r in catalogue.QUERIES["bfs_out"](spark, SF).collect()}
    assert got and set(got.values()) <= {1, 2, 3}
    made = [f for f in os.listdir(tmp_path) if f.startswith("index-")]
    assert [f.split("-")[1] for f in made] == ["graph"]
    n = len(catalogue.QUERIES["bfs_many"](spark, SF).collect())
    assert n and len([f for f in os.listdir(tmp_path) if f.startswith("index-")]) == 1


def test_a_search_of_texts_makes_no_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "shared_dir", lambda s: str(tmp_path))
    assert catalogue.QUERIES["bm25_top50"](spark, SF).count() == 50
    assert [f.split("-")[1] for f in os.listdir(tmp_path) if f.startswith("index-")] == ["text"]


def test_a_batch_of_many_terms_makes_no_row_for_each_pair(spark):
    """Rows and ties of the batch are those of the join, for more terms than are listed by name and for rows that go over Arrow batches."""
    import random

    from pyspark.sql import functions as F

    from notelake.operators import fts

    rnd = random.Random(5)
    word = lambda: f"w{int(rnd.random() ** 2 * 900)}"
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(i, texts[i % 300]) for i in range(1200)], "doc_id long, text string")  # copies: ties
    index = fts.built(rows, "doc_id", {"content": F.col("text")})
    queries = [(q, " OR ".join(f'"{t}"' for t in dict.fromkeys(word() for _ in range(40)))) for q in range(300)] + [(900, "nowhere"), (901, "w1 w2")]
    assert len({t for _, q in queries for t in fts.split_tokens(q)}) > fts.MOST_LISTED
    found = fts.hits(index, queries, 10, digits=9)
    whole = fts.hits(index, queries, None).withColumn("_s", F.round("score", 9))
    same = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 8)) for r in df.collect())
    assert same(found) == same(fts.top(whole, ["_s", "doc_id"], 10))
    many = fts._batch(index, [(q, fts.flat(fts.parse(t))[1]) for q, t in queries[:300]], 10, 9)
    assert "collect_list" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_leave_a_task_by_slices():
    """A batch of any size is cut in slices of bounded texts, in order and without a row lost; a long text is alone."""
    import pyarrow as pa

    from notelake.operators import chunk

    texts = ["a" * 1000] * 5000 + [None, "é" * (3 << 20), ""] + ["b"] * 900
    parts = list(chunk.slices(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["source_id", "_body"]), 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    assert max(p.num_rows for p in parts) <= chunk.SLICE_ROWS
    assert all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()[:-1]) < chunk.SLICE_BYTES for p in parts)


def test_wide_characters_are_counted_in_each_chunk():
    from notelake.operators import chunk

    plain = lambda t: max(1, int((len(t) - (w := sum("㐀" <= c <= "鿿" or "豈" <= c <= "﫿" for c in t))) / 4 + w / 1.5))
    for text in ("向量 数据。\n\nplain é words. " * 40, "été. " * 200, "plain. " * 100):
        got = chunk.spans(text, 30)
        assert len(got) > 1 and all(n == plain(text[a:b]) for a, b, n in got)


def test_a_search_without_an_index_keeps_asked_terms_only(spark, monkeypatch):
    """Scores are those of a whole index, counts of rows and tokens included; postings of other terms are not written."""
    from pyspark.sql import functions as F

    from notelake.operators import fts

    rows = spark.createDataFrame([(1, "red fox 向量", "t fox"), (2, "red redder dog", ""), (3, "", None), (4, "dog fox dog", "red"), (5, None, "x")], "doc_id long, a string, b string")
    columns = {"a": F.col("a"), "b": F.col("b")}
    queries = [(1, "fox"), (2, "red*"), (3, '"red fox"'), (4, "dog NOT fox"), (5, "向"), (6, "none"), (7, "red OR dog")]
    kept, own = [], fts.written
    monkeypatch.setattr(fts, "written", lambda df, tag: kept.append(own(df, tag)) or kept[-1])
    same = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    got = same(fts.bm25(rows, "doc_id", columns, queries[:4]))
    assert {r["term"] for r in kept[0].select("term").collect()} == {"", "fox", "red", "redder", "dog"}
    whole = fts.built(rows, "doc_id", columns)
    assert got == same(fts.hits(whole, queries[:4])) and len(got) > 6
    assert same(fts.bm25(rows, "doc_id", columns, queries)) == same(fts.hits(whole, queries))


def test_grams_are_counted_from_distinct_windows(spark, monkeypatch):
    """Counts are those of every place in every run, over several slices and for more characters than fit one number."""
    from collections import Counter

    from notelake.functions import han

    monkeypatch.setattr(han, "SLICE", 50)
    texts = ["向量数据库，数据向量 abc 库", "向", None, "", "".join(chr(0x4E00 + i * 7 % 20000) for i in range(3000)), "数据" * 40]
    found: Counter = Counter()
    for r in (r for t in texts if t for r in han.HAN_RUN.findall(t)):
        for i in range(len(r)):
            for j in range(i + 1, min(len(r), i + 4) + 1):
                found[r[i:j], 0, ""] += 1
                found[r[i:j], 1, r[i - 1] if i else ""] += 1
                found[r[i:j], 2, r[j : j + 1]] += 1
    rows = [pair for t in texts for pair in [(t,)]]
    got = {(r["gram"], r["side"], r["neighbour"]): r["n"] for r in han.grams(spark.createDataFrame(rows, "text string"), longest=4).collect()}
    assert got == found
    assert list(han._counted(["向量" * 3], 4))  # one slice of distinct windows, not one row for each place


def test_hashed_embeddings_count_tokens_by_place(spark):
    """Vectors are those of one pass over all places for each token, for small and large dimensions."""
    from pyspark.sql import functions as F

    from notelake.functions.text import tokens
    from notelake.plans.index import hashing_embedder

    rows = spark.createDataFrame([(1, "the Red fox the a b c d e"), (2, ""), (3, None), (4, "fox " * 500 + "élan x9")], "id long, text string")
    for dimension in (7, 64, 200):
        found = rows.select("id", hashing_embedder(dimension)(F.col("text")).alias("v"))
        assert found.schema["v"].dataType.simpleString() == "array<float>"
        places = {r["id"]: r["p"] for r in rows.select("id", F.transform(tokens("text"), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension))).alias("p")).collect()}
        assert {r["id"]: r["v"] for r in found.collect()} == {i: [float(p.count(k)) for k in range(dimension)] for i, p in places.items()}
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_by_runs_with_one_shuffle(spark):
    """Counts, bounds and the impact that KEPT postings reach are those of a plain count, for terms over several files, batches and averages."""
    import random

    from pyspark.sql import functions as F

    from notelake.operators import fts
    from notelake.session import written

    rnd = random.Random(9)
    word = lambda: f"w{int(rnd.random() ** 3 * 300)}"
    rows = spark.createDataFrame([(i, " ".join(word() for _ in range(rnd.randrange(0, 60)))) for i in range(900)], "doc_id long, text string")
    halves = [fts.postings(rows.filter(f"doc_id % 2 = {k}"), "doc_id", {"content": F.col("text")}, usual=20.0 + k) for k in (0, 1)]
    post = written(halves[0].unionByName(halves[1]), "terms")
    assert post.columns == ["bucket", "term", "field", "doc_id", "n_tokens", "positions", "impact", "usual"]
    plain: dict = {}
    for r in post.select("bucket", "term", "impact", "usual").collect():
        plain.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    step = fts.LEVELS / (fts.K1 + 1)
    top = lambda x: int(sorted(x, reverse=True)[fts.KEPT - 1] * step) / step if len(x) >= fts.KEPT else 0.0
    want = {k: (len(v), max(i for i, _ in v), top([i for i, _ in v]), min(u for _, u in v), max(u for _, u in v), 0) for k, v in plain.items()}
    terms = fts.terms_of(post, "doc_id", ("content",))
    assert {(r[0], r[1]): tuple(r[2:]) for r in terms.collect()} == want and any(x[2] > 0 for x in want.values()) and any(x[2] == 0 for x in want.values())
    assert fts.terms_of(post, "doc_id", ("content",))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_postings_are_shuffled_without_what_all_share(spark):
    """Impacts come behind the shuffle; field and average length behind the sort."""
    from pyspark.sql import functions as F

    from notelake.operators import fts

    rows = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    one, two = (fts.postings(rows, "doc_id", c) for c in ({"content": F.col("text")}, {"a": F.col("text"), "b": F.col("text")}))
    assert one.columns == two.columns and {(r["field"], r["term"]) for r in one.collect()} == {("content", "a"), ("content", "b")}
    assert {(r["field"], r["term"]) for r in two.collect()} == {(f, t) for f in "ab" for t in "ab"}
    dealt = next(x for x in one._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in x)
    below = one._jdf.queryExecution().optimizedPlan().toString().split(dealt)[1]
    assert "impact" not in below and "usual" not in below
    sorted_ = one._jdf.queryExecution().optimizedPlan().toString().split("Sort ")[1]
    assert "usual" not in sorted_ and "AS field" not in sorted_
