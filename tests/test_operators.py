import datetime as dt

import pytest
from pyspark.sql import functions as F

from notelake import api
from notelake.operators import evaluate, fts, fuse, links, search, store
from notelake.operators.knn import knn
from notelake.plans import index as I
from notelake.sources import vault
from notelake.streaming import ingest

NOTES = [("a.md", "alpha beta"), ("b.md", "beta gamma [[a]]"), ("c.md", "isolated words"), ("hub.md", "---\ntags: [t]\naliases: [center]\n---\n# Hub\nsee [[a]] and [[b]] and [[nowhere]]")]


@pytest.fixture(scope="module")
def built(spark):
    tables = I.build(spark.createDataFrame(NOTES, "path string, content string"))
    return {k: v.persist() for k, v in tables.items()}


@pytest.mark.parametrize("bad", ["what?", "don't", "C++", "cat/dog", "note-name", "zz:cat", "[[a]]", "AND", "(a", '"a', "a OR"])
def test_syntax_errors_are_empty(bad):
    assert fts.safe_parse(bad) is None


def test_precedence():
    t = fts.parse("a b OR c NOT d")
    assert t.kind == "or" and t.left.kind == "and" and t.right.kind == "not"
    assert fts.parse("and").terms == ("and",)
    assert fts.parse("hello_world").terms == ("hello", "world")
    assert fts.parse('cat ""').terms == ("cat",)


def test_bm25_operators(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat on the cat"), (3, "a bird")], "id long, t string")
    hits = lambda q: [r.id for r in fts.bm25(df, "id", {"content": F.col("t")}, [(1, q)]).orderBy("score", "id").collect()]
    assert set(hits("cat sat")) == {1, 2} and hits('"dog sat"') == [2] and hits("^the NOT dog") == [1]
    assert hits("NEAR(dog cat, 1)") == [] and hits("NEAR(dog cat, 3)") == [2] and hits("bi*") == [3] and hits("dog + sat") == [2]


def test_fusion(spark):
    r = spark.createDataFrame([(1, 1, "bm25", 1), (1, 2, "bm25", 2), (1, 2, "vector", 1)], "query_id long, source_id long, channel string, rank int")
    got = {x.source_id: x.score for x in fuse.rrf(r, {"bm25": 1.0, "vector": 1.0}).collect()}
    assert got[2] > got[1] and abs(got[1] - 1 / 61) < 1e-12
    c = spark.createDataFrame([(1, 5, 10, -2.0), (1, 5, 11, -3.0), (1, 5, 12, -3.0)], "query_id long, source_id long, chunk_id long, score double")
    assert fuse.best_chunk(c, "score").first().chunk_id == 11


def test_graph(spark, built):
    ids = {r.path: r.source_id for r in built["sources"].collect()}
    assert {r.path: r.indegree for r in built["sources"].collect()} == {"a.md": 2, "b.md": 1, "c.md": 0, "hub.md": 0}
    assert [r.target_path for r in built["edges"].filter("dst_id is null").collect()] == ["nowhere"]
    out = {r.source_id: r.depth for r in links.bfs(built["edges"], ids["hub.md"], 2).collect()}
    assert out == {ids["a.md"]: 1, ids["b.md"]: 1}
    late = spark.createDataFrame([(99, "x/nowhere.md", None)], "source_id long, path string, aliases array<string>")
    assert links.forward_refs(built["edges"], late).first().dst_id == 99


def test_resolution_depends_on_order(spark):
    s = spark.createDataFrame([(1, "a.md", []), (2, "b/n.md", []), (3, "c/N.md", ["t"]), (4, "n.md", [])], "source_id long, path string, aliases array<string>")
    e = spark.createDataFrame([(1, "n"), (4, "n"), (3, "t"), (2, "t")], "src_id long, target_path string")
    assert {(r.src_id, r.target_path): r.dst_id for r in links.resolve(e, s).collect()} == {(1, "n"): 2, (4, "n"): 4, (3, "t"): 3, (2, "t"): 3}
    assert {(r.src_id, r.target_path): r.dst_id for r in links.resolve(e, s, "global").collect()}[(1, "n")] == 4


def test_blending_scores(spark, built):
    idx = I.opened(built)
    always = F.when(F.col("position") == 1, 0.5).otherwise(0.1)
    rows = search.search(idx, [(1, "hub", None)], search.Spec(), always).collect()
    assert rows[0].title == "Hub"
    two = search.search(idx, [(1, "beta", None)], search.Spec(rerank_k=5), always).orderBy("position").collect()
    assert [round(r.score, 2) for r in two] == [0.5, 0.1]  # no title hit: the reranker's scores alone
    gate = search.search(idx, [(1, "hub OR beta", None)], search.Spec(), always).orderBy("position").collect()
    assert round(gate[0].score, 2) == 0.8  # 0.60 * 1 + 0.40 * 0.5
    assert search.search(idx, [(1, "  ", None)]).count() == 0


def test_title_only_and_filters(spark, built):
    rows = search.search(I.opened(built), [(1, "center", None)]).collect()
    assert rows[0].path == "hub.md" and rows[0].chunk_id == 0
    assert search.search(I.opened(built), [(1, "beta", None)], search.Spec(tags=("t",))).count() == 0


def test_knn_drops_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.chunk_id for r in knn(v, q, 5).orderBy("distance").collect()] == [1, 3]


def test_metrics(spark):
    row = spark.createDataFrame([(["x", "a", "b", "a", "c"], ["a", "b", "zz", ""])], "h array<string>, e array<string>").select(*evaluate.row_metrics(F.col("h"), F.col("e"))).first()
    assert abs(row.recall_at_10 - 2 / 3) < 1e-12 and row.mrr == 0.5 and row.precision_at_5 == 0.4 and row.last_rank == 3
    assert abs(row.ap_at_10 - (1 / 2 + 2 / 3) / 3) < 1e-12
    assert spark.range(1).select(evaluate.dcg_at_k(F.array(F.lit(3.0)), 1).alias("d")).first().d == 7.0
    p = spark.createDataFrame([(1, float(x)) for x in (100, 200, 300)], "k int, v double")
    assert [evaluate.percentile(p, "v", q, ["k"]).first().percentile for q in (0.0, 0.5, 0.95, 1.0)] == [100, 200, 300, 300]


def test_store(spark, tmp_path, built):
    st = store.Store(str(tmp_path / "s"))
    assert st.version(spark) is None
    st.publish(spark, built)
    first = st.version(spark)
    gone = built["sources"].filter("path = 'a.md'").select("source_id")
    st.publish(spark, store.without({n: st.read(spark, n) for n in ("sources", "chunks", "vectors", "edges", "tags")}, gone))
    assert st.version(spark) != first and st.read(spark, "sources").count() == 3
    assert st.read(spark, "edges").filter("dst_id is null").count() == 3
    with pytest.raises(ValueError):
        store.updated(built["sources"], F.lit(True), nothing=1)


def test_freshness(spark):
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([("a", t), ("b", t + dt.timedelta(seconds=3)), ("n", t), ("z", t)], "path string, mtime timestamp")
    s = spark.createDataFrame([("a", t), ("b", t), ("m", t), ("z", None)], "path string, indexed_at timestamp")
    assert {r.path: r.state for r in store.freshness(f, s).collect()} == {"b": "stale", "n": "new", "m": "missing", "z": "stale"}


def test_folder_to_search(spark, tmp_path):
    root = tmp_path / "vault"
    for path, text in [*NOTES, ("sub dir/é+1.md", "# Deep\r\nbeta"), (".git/x.md", "no"), ("todo/y.md", "no")]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    (root / "bad.md").write_bytes(b"\xff\xfe")
    assert {r.path for r in vault.files(spark, str(root)).collect()} == {p for p, _ in NOTES} | {"sub dir/é+1.md"}
    at = str(tmp_path / "store")
    assert api.index(spark, str(root), at) == {"ingested": 5, "unchanged": 0, "skipped": 1, "errors": 0, "pruned": 0}
    assert api.index(spark, str(root), at)["unchanged"] == 5
    assert "hub.md" in api.search(spark, at, "hub")
    assert '"schema_version":1' in api.search(spark, at, "beta", as_json=True)
    assert api.status(spark, str(root), at)["notes_total"] == 5
    assert api.get(spark, str(root), "hub.md", 6) == "see [[a]] and [[b]] and [[nowhere]]"
    with pytest.raises(ValueError):
        api.get(spark, str(root), "../x.md")


def test_stream(spark, tmp_path):
    src, st = tmp_path / "in", store.Store(str(tmp_path / "st"))
    rows = lambda text: spark.createDataFrame([("a.md", text, dt.datetime(2024, 1, 1)), ("b.md", "see [[a]]", dt.datetime(2024, 1, 1))], ingest.FILES)
    for text in ("one", "two"):
        rows(text).coalesce(1).write.mode("append").json(str(src))
        ingest.follow(spark, str(src), st, str(tmp_path / "cp")).awaitTermination()
    assert {r.content for r in st.read(spark, "chunks").collect()} == {"two", "see [[a]]"}


def test_plans(spark):
    rows = spark.createDataFrame([(1, "beta"), (2, "gamma")], "chunk_id long, content string")
    plan = fts.bm25(rows, "chunk_id", {"content": F.col("content")}, [(1, "beta")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_walks_from_many_centres_take_the_steps_of_one(spark):
    """A ring with a hub: every centre's walk equals its own, and the number of written fronts doesn't grow with centres."""
    from notelake.operators import links
    from notelake.session import WRITTEN

    e = spark.createDataFrame([(i, "x", (i + 1) % 30) for i in range(30)] + [(i, "h", 99) for i in range(0, 30, 3)] + [(99, "y", 5), (3, "n", None)], "src_id long, target_path string, dst_id long")
    for way in ("out", "in"):
        counts = []
        for k in (1, 10):
            before = len(WRITTEN)
            centres = spark.createDataFrame([(i,) for i in range(k)], "source_id long")
            got = {(r.centre, r.source_id, r.depth) for r in links.bfs_many(e, centres, 3, way).collect()}
            counts.append(len(WRITTEN) - before)
            if k == 1:
                assert got == {(0, r.source_id, r.depth) for r in links.bfs(e, 0, 3, way).collect()}
            else:
                assert {x for x in got if x[0] == 7} == {(7, r.source_id, r.depth) for r in links.bfs(e, 7, 3, way).collect()}
        assert counts[0] == counts[1] == 4
    assert links.bfs_many(e, spark.createDataFrame([], "source_id long"), 3).count() == 0
