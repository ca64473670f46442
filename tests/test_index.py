"""The stored index: tokenizer, postings, incremental runs, snapshots, models that fail, evaluation, settings."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from notelake import __main__ as cli
from notelake import api
from notelake.config import Config
from notelake.functions import han
from notelake.functions import text as T
from notelake.operators import evaluate, fts, links, search, store
from notelake.plans import index as I
from notelake.session import WRITTEN, cleared, written
from notelake.sources import vault
from notelake.streaming import ingest

NOTES = {"a.md": "alpha beta", "b.md": "beta gamma [[a]]", "dir/c.md": "---\naliases: [sea]\n---\nsee [[later]] and [[b]]", "hub.md": "---\ntags: [t]\naliases: [center]\n---\n# Hub\nsee [[a]] and [[b]] and [[nowhere]]"}


def frame(spark, notes):
    return spark.createDataFrame(sorted(notes.items()), "path string, content string")


def put(root, notes):
    for path, text in notes.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


@pytest.mark.parametrize("text,want", [("向量数据库", ["向量", "量数", "数据", "据库"]), ("ＡＢＣ向量x", ["abc", "向量", "x"]), ("café dé", ["caf", "d"]), ("ﬁsh ² Ⅳ", ["fish", "2", "iv"]), ("plain Text_1", ["plain", "text", "1"]), ("", [])])
def test_tokenizer_is_one_rule(spark, text, want):
    t = T.Tokenizer()
    assert list(t.split(text)) == want
    assert spark.createDataFrame([(text,)], "t string").select(t.column("t").alias("x")).first().x == want


def test_search_in_chinese(spark):
    df = spark.createDataFrame([(1, "关于向量数据库的笔记"), (2, "向量"), (3, "数据 库")], "id long, t string")
    hits = lambda q, tk=None: {r.id for r in fts.bm25(df, "id", {"content": F.col("t")}, [(1, q)], tokenizer=tk).collect()}
    assert hits("向量") == {1, 2} and hits("数据库") == {1} and hits("向量 AND 笔记") == {1} and hits("数据") == {1, 3}
    assert hits("库") == {1, 3} and hits("库*") == {1, 3} and hits("量 OR 笔") == {1, 2} and hits('"据 库"') == set()
    words = T.Tokenizer(han.Segmenter({"向量": 5, "数据": 4, "数据库": 3, "笔记": 2, "关于": 2, "的": 9}))
    assert hits("数据库", words) == {1} and hits("数据", words) == {1, 3} and hits("记", words) == {1} and hits("量数", words) == set()
    chars = T.Tokenizer(list)  # another segmenter: single characters
    assert hits("库", chars) == {1, 3} and hits("据库", chars) == {1, 3}


def test_near_needs_one_stretch(spark):
    df = spark.createDataFrame([(1, "a b " + "x " * 30 + "a c"), (2, "c a x b"), (3, "b a c b"), (4, "a x x x b c")], "id long, t string")
    hits = lambda q: {r.id for r in fts.bm25(df, "id", {"content": F.col("t")}, [(1, q)]).collect()}
    assert hits("NEAR(a b c, 2)") == {2, 3} and hits('NEAR("x b" c, 0)') == {4} and hits("NEAR(a b c, 40)") == {1, 2, 3, 4}


def test_joined_and_positional_scores_are_equal(spark):
    df = spark.createDataFrame([(i, " ".join("abcde"[(i * k) % 5] for k in range(1, 9))) for i in range(40)], "id long, t string")
    idx = fts.built(df, "id", {"content": F.col("t")})
    for q in ("a b", "a a c", "b OR d OR zz"):
        tree = fts.parse(q)
        one = {r.id: round(r.score, 12) for r in fts._by_join(idx, [(1, *fts.flat(tree))]).collect()}
        assert one == {r.id: round(r.score, 12) for r in fts._by_positions(idx, [(1, tree)]).collect()} and one


def test_search_reads_the_asked_buckets_alone(spark, tmp_path):
    st = store.Store(str(tmp_path / "s"))
    st.publish(spark, I.build(frame(spark, NOTES)))
    idx = I.opened(st.read_all(spark))
    read = fts.hits(idx.text, [(1, "beta gamma")])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "Python" not in plan
    assert {r.chunk_id for r in read.collect()} == {2_000_001}
    files = fts._of_terms(idx.text.postings, ["gamma"], idx.text.buckets)
    assert {r.term for r in files.collect()} == {"gamma"}
    bucket = __import__("zlib").crc32(b"gamma") % idx.text.buckets
    assert all(f"bucket={bucket}" in f for f in files.filter("term = 'gamma'").select(F.input_file_name().alias("f")).distinct().toPandas()["f"])


def run(spark, root, at):
    got = api.index(spark, str(root), at)
    return {k: v for k, v in got.items() if v}


def test_incremental_runs(spark, tmp_path):
    root, at = tmp_path / "v", str(tmp_path / "s")
    put(root, NOTES)
    assert run(spark, root, at) == {"ingested": 4}
    st = store.Store(at)
    first = {r.path: r for r in st.read(spark, "sources").collect()}
    api.suggest(spark, at, spark.createDataFrame([(first["a.md"].source_id, first["hub.md"].source_id, 0.7, "near")], "source_note_id long, target_note_id long, score double, reason string"))
    put(root, {"aa.md": "new words [[center]]", "later.md": "late", "b.md": "beta changed [[sea]]"})
    (root / "hub.md").unlink()
    (root / "bad.md").write_bytes(b"\xff\xfe")
    for p in ("a.md", "dir/c.md"):  # touched, though not changed
        __import__("os").utime(root / p, (time.time() + 60, time.time() + 60))
    assert run(spark, root, at) == {"ingested": 3, "unchanged": 2, "skipped": 1, "pruned": 1}
    now = {r.path: r for r in st.read(spark, "sources").collect()}
    for p in ("a.md", "b.md", "dir/c.md"):
        assert (now[p].source_id, now[p].uid, now[p].created_at) == (first[p].source_id, first[p].uid, first[p].created_at)
        assert now[p].indexed_at > first[p].indexed_at
    assert now["aa.md"].source_id == 5 and now["later.md"].source_id == 6
    edges = {(r.src_id, r.target_path): r.dst_id for r in st.read(spark, "edges").collect()}
    assert edges == {(3, "later"): 6, (3, "b"): 2, (2, "sea"): 3, (5, "center"): None}
    assert st.read(spark, "suggestions").count() == 0  # it named the note that is gone
    whole = I.opened({k: written(v, "whole") for k, v in I.build(frame(spark, {p: (root / p).read_text() for p in now})).items()})
    mine, paths = I.opened(st.read_all(spark)), {r.source_id: r.path for r in now.values()}
    for q in ("beta", "words OR late OR see", "sea"):
        a = [(r.path, round(r.score, 9)) for r in search.search(mine, [(1, q, None)]).collect()]
        assert sorted(a) == sorted((r.path, round(r.score, 9)) for r in search.search(whole, [(1, q, None)]).collect()), q
    stats = lambda i: [tuple(x.stats.select("n_rows", "n_tokens").first()) for x in (i.text, i.names)]
    assert stats(mine) == stats(whole) and paths


def test_touched_notes_are_not_stale_for_ever(spark, tmp_path):
    root, at = tmp_path / "v", str(tmp_path / "s")
    put(root, NOTES)
    run(spark, root, at)
    later = time.time() + 10
    __import__("os").utime(root / "a.md", (later, later))
    assert api.status(spark, str(root), at)["stale"] == 1
    t, counts = I.updated(store.Store(at).read_all(spark), vault.files(spark, str(root)), now=F.lit(dt.datetime.fromtimestamp(later + 1)).cast("timestamp"))
    assert set(t) == {"sources"} and counts["unchanged"] == 4
    store.Store(at).publish(spark, t)
    assert api.status(spark, str(root), at)["stale"] == 0


def test_single_file_and_rename(spark, tmp_path):
    root, at = tmp_path / "v", str(tmp_path / "s")
    put(root, NOTES)
    run(spark, root, at)
    put(root, {"todo/x.MD": "hidden words", "a.md": "alpha again"})
    assert api.index(spark, str(root), at, "a.md")["ingested"] == 1 and api.index(spark, str(root), at, "todo/x.MD")["ingested"] == 1
    assert api.index(spark, str(root), at, "none.md")["ingested"] == 0
    st = store.Store(at)
    assert st.read(spark, "sources").count() == 5
    before = {r.path: (r.source_id, r.uid) for r in st.read(spark, "sources").collect()}
    (root / "a.md").rename(root / "z.md")
    api.rename(spark, at, "a.md", "z.md")
    run(spark, root, at)
    after = {r.path: (r.source_id, r.uid) for r in st.read(spark, "sources").collect()}
    assert after["z.md"] == before["a.md"] and "a.md" not in after


def test_snapshots(spark, tmp_path):
    st = store.Store(str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "source_id long")
    st.publish(spark, {"sources": one, "chunks": one})
    reader, old = st.read_all(spark), st.manifest(spark)
    (tmp_path / "s/manifests/draft-dead").write_text("{")  # a writer that died
    st.publish(spark, {"sources": one.union(one)})
    assert reader["sources"].count() == 1 and st.read(spark, "sources").count() == 2
    assert st.manifest(spark)["tables"]["chunks"] == old["tables"]["chunks"]  # not written again
    (tmp_path / "s/manifests/3").write_text(json.dumps(old))  # another writer was faster
    real, store.Store.number = store.Store.number, lambda self, spark: 2
    try:
        with pytest.raises(store.PublishConflict):
            st.publish(spark, {"sources": one})
    finally:
        store.Store.number = real
    st2 = store.Store(str(tmp_path / "v1"))
    st2.publish(spark, {"sources": one}, schema_version=1)
    assert st2.migrate(spark) and not st2.migrate(spark) and st2.read(spark, "sources").columns == ["source_id", "aliases", "tags"]
    st2.publish(spark, {"sources": one}, schema_version=99)
    with pytest.raises(store.CapabilityError):
        st2.read(spark, "sources")


def test_status_of_streams_and_suggestions(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "st")
    spark.createDataFrame([("a.md", "one", dt.datetime(2024, 1, 1)), ("b.md", "see [[a]]", dt.datetime(2024, 1, 1))], ingest.FILES).coalesce(1).write.json(str(src))
    ingest.follow(spark, str(src), store.Store(at), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "v").mkdir()
    put(tmp_path / "v", {"a.md": "one", "c.md": "new"})
    api.suggest(spark, at, spark.createDataFrame([(1, 2, 0.7, "x"), (1, 2, 0.6, "y"), (2, 1, 0.5, "z")], "source_note_id long, target_note_id long, score double, reason string"))
    got = api.status(spark, str(tmp_path / "v"), at)
    assert (got["notes_total"], got["suggestions_pending"], got["missing"], got["new"]) == (2, 2, 1, 1)
    api.decide(spark, at, 1, "approved")
    s = store.Store(at).read(spark, "suggestions")
    assert [r.suggestion_id for r in store.pending(s).collect()] == [2] and s.filter("resolved_at is not null").count() == 1
    assert json.loads(api.status_json(spark, str(tmp_path / "v"), at))["freshness"] == {"new": 1, "stale": got["stale"], "missing": 1}
    with pytest.raises(ValueError):
        api.decide(spark, at, 2, "maybe")


def test_live_indegree(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2), (3, "a", 2), (3, "x", None)], "src_id long, target_path string, dst_id long").coalesce(1).write.json(str(tmp_path / "e"))
    edges = spark.readStream.schema("src_id long, target_path string, dst_id long").json(str(tmp_path / "e"))
    ingest.live_indegree(edges).writeStream.outputMode("update").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("degrees").collect()] == [(2, 2)]


@pytest.fixture(scope="module")
def small(spark):
    return I.opened({k: v.persist() for k, v in I.build(frame(spark, NOTES)).items()})


def order(small, reranker):
    return [(r.path, round(r.score, 6)) for r in search.search(small, [(1, "beta", None)], search.Spec(), reranker).orderBy("position").collect()]


def test_models_that_fail(small):
    plain = order(small, None)

    def bad(query, passages):
        raise RuntimeError("no model")

    for r in (search.Reranker(bad), search.Reranker(bad, disabled=True), search.Reranker(lambda q, p: [1.0]), search.Reranker(lambda q, p: None), search.Reranker(lambda q, p: [float("nan")] * len(p))):
        assert order(small, r) == plain
    assert [s for _, s in order(small, search.Reranker(lambda q, p: [0.2 if "gamma" in x else 0.1 for x in p]))] == [0.2, 0.1]
    assert search.safe_embed(lambda q: 1 / 0, "x") is None and search.safe_embed(lambda q: [1], "x") == [1.0]


def test_evaluation_report(spark, small, tmp_path):
    items = [{"query": "beta", "expected_paths": ["b.md", "zz.md"], "tags": ["x"], "expansion": ["gamma"]}, {"query": "hub", "expected_paths": ["hub.md"], "tags": ["x", "y"], "expansion": ["center", "nowhere"]}]
    specs = vault.query_specs(spark, items)
    got = evaluate.report(small, specs, search.Spec(), lambda q: None, timed=True)
    assert got["n_queries"] == 2 and got["aggregate"]["mean_recall_at_10"] == 0.75 and got["by_tag"]["y"]["mean_mrr"] == 1.0
    assert [r["path"] for r in got["results"][0]["first_stage"]] != [] and got["aggregate"]["p95_latency_ms"] >= got["aggregate"]["p50_latency_ms"] > 0
    ranks = {r["path"]: r for r in got["results"][0]["first_stage"]}
    assert ranks["zz.md"]["known"] is False and ranks["b.md"]["bm25"] in (1, 2) and ranks["b.md"]["title"] is None
    fused = {r.query_id: r.hits for r in evaluate.run(small, specs, search.Spec(), lambda q: None, config="C").collect()}
    assert fused[0][0] == "b.md" and fused[1][0] == "hub.md"
    with pytest.raises(ValueError):
        evaluate.run(small, vault.query_specs(spark, [{"query": "q", "expected_paths": []}]), search.Spec(), lambda q: None, config="C")
    from notelake.sources import sinks

    sinks.write_report(spark, got, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["config"] == "A"
    (tmp_path / "q.json").write_text(json.dumps(items))
    assert vault.query_file(spark, str(tmp_path / "q.json")) == items


def test_metadata_expansion(spark):
    notes = {"n/rocket.md": "# Rocket notes\nfuel [[tank]]", "n/tank.md": "# Tank\nsteel", "n/other.md": "# Other notes\nwords", "n/back.md": "# Back\nsee [[rocket]]"}
    idx = I.opened(I.build(frame(spark, notes)))
    rows = search.search(idx, [(1, "rocket manual unknown", None)], search.Spec(metadata=True)).collect()
    assert {r.path for r in rows} == {"n/rocket.md", "n/tank.md", "n/back.md"}
    assert search.search(idx, [(1, "rocket manual unknown", None)]).count() == 0
    # a single word that several notes hold needs company
    assert {r.path for r in search.search(idx, [(1, "notes other unknown", None)], search.Spec(metadata=True)).collect()} == {"n/other.md"}


def test_walk_plans_stay_small(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src_id long, dst_id long")
    size = lambda d: links.bfs(edges, 0, d)._jdf.queryExecution().analyzed().toString().count("\n")
    assert {r.source_id: r.depth for r in links.bfs(edges, 0, 12).collect()} == {i: i for i in range(1, 13)}
    assert size(12) - size(8) == size(8) - size(4)


def test_config_and_command_line():
    c = Config.from_env({"NOTELAKE_VAULT": "/v", "NOTELAKE_RERANKER": "off"}, vault=None)
    assert (c.vault, c.store, c.reranking) == ("/v", "/v/.notelake", False)
    p = cli.parser()
    parse = lambda *a: cli.checked(p, p.parse_args(list(a)))
    assert vars(parse("get", "a/b.md:12", "--context", "3"))["line"] == 12 and parse("get", "a:b.md", "--lines", "4").path == "a:b.md"
    assert parse("index", "one.md").path == "one.md" and parse("--vault", "v", "status", "--json").json
    for bad in (("get", "a.md", "-C", "2"), ("get", "a.md:1", "-C", "2", "-l", "1"), ("search", "q", "--rerank-k", "0"), ("get", "a.md:1", "-l", "-1")):
        with pytest.raises(SystemExit):
            parse(*bad)


def test_scratch_tables_can_be_cleared(spark):
    since = len(WRITTEN)
    path = written(spark.range(3).toDF("x"), "scratch").inputFiles()[0]
    assert cleared(spark, since) == 1 and not __import__("os").path.exists(path.removeprefix("file://").removeprefix("file:"))


def table_bytes(manifest):
    return {n: sum(x["bytes"] for x in t) for n, t in manifest["tables"].items()}


def test_one_changed_note_of_many_writes_little(spark, tmp_path):
    """Under a hundredth of the index's bytes, by the manifest; scores, links and in-degrees are those of a rebuild."""
    import random

    rnd = random.Random(3)
    word = lambda: f"w{int(rnd.random() ** 3 * 30000)}"
    notes = {f"{i % 40}/n{i}.md": " ".join(word() for _ in range(120)) + f" [[n{(i * 7) % 10000}]]" for i in range(10_000)}
    st = store.Store(str(tmp_path / "s"))
    files = lambda: frame(spark, notes).repartition(4)
    st.publish(spark, I.build(files(), stored=True) | {"files": files()})
    first = st.manifest(spark)
    whole = sum(table_bytes(first).values())
    target = {r.target_path: r.dst_id for r in st.read(spark, "edges").filter("target_path = 'n14'").collect()}["n14"]
    degree = lambda: st.read(spark, "sources").filter(F.col("source_id") == target).first().indegree
    assert degree() == 1
    notes["2/n2.md"] = "something else altogether zebra " + " ".join(word() for _ in range(100))  # linked to n14
    changes, counts = I.changed(st.read_all(spark), files().withColumn("mtime", F.lit("2020-01-01").cast("timestamp")))
    assert counts == {"new": 0, "changed": 1, "unchanged": 9999, "gone": 0}
    st.change(spark, changes)
    now = st.manifest(spark)
    assert sum(table_bytes(now).values()) - whole < 0.01 * whole
    assert all(now["tables"][n][0] == first["tables"][n][0] for n in first["tables"])  # nothing is written again
    assert degree() == 0
    mine, rebuilt = I.opened(st.read_all(spark)), I.opened(I.build(files()))
    for q in ("zebra", "w1 w2", "w3 OR w77 OR zebra", "w5*"):
        read = lambda i: {(r.chunk_id // 1_000_000, round(r.score, 9)) for r in fts.hits(i.text, [(1, q)]).collect()}
        assert read(mine) == read(rebuilt) and read(mine), q


def test_segments_are_merged_and_stay_right(spark, tmp_path, monkeypatch):
    """Many small changes, adds, deletions and links that come and go: every table is that of a rebuild, and segments stay few."""
    monkeypatch.setattr(store, "MOST_SEGMENTS", 2)
    notes = dict(NOTES)
    st = store.Store(str(tmp_path / "s"))
    st.publish(spark, I.build(frame(spark, notes), stored=True, mode="global") | {"files": frame(spark, notes), "suggestions": spark.createDataFrame([(1, 1, 2, 0.5, "x", "pending", None, None)], store.SUGGESTIONS)})
    steps = [{"later.md": "late [[hub]] zebra", "b.md": "beta [[nowhere]]", "a.md": None}, {"hub.md": "# Hub again\n[[later]]", "new/d.md": "zebra [[later]] [[b]]", "dir/c.md": None}]
    for step in steps:
        notes = {p: t for p, t in {**notes, **step}.items() if t is not None}
        changes, _ = I.changed(st.read_all(spark), frame(spark, notes))
        st.change(spark, changes)
    assert max(map(len, st.manifest(spark)["tables"].values())) <= 2
    now = st.read_all(spark)
    path = {r.source_id: r.path for r in now["sources"].collect()}
    assert set(path.values()) == set(notes) and {r.path: r.content for r in now["files"].collect()} == notes
    whole = {k: written(v, "whole") for k, v in I.build(frame(spark, notes), mode="global").items()}
    its = {r.source_id: r.path for r in whole["sources"].collect()}
    terms = lambda t, n: {(r.term, r.df) for r in t[n].collect()}
    for kind in ("text", "name"):
        assert terms(now, f"{kind}_terms") == terms(whole, f"{kind}_terms")
        assert tuple(now[f"{kind}_stats"].first()) == tuple(whole[f"{kind}_stats"].first())
    degrees = lambda t, p: {p[r.source_id]: r.indegree for r in t["sources"].collect()}
    count = {}
    for r in now["edges"].collect():
        count[path.get(r.dst_id)] = count.get(path.get(r.dst_id), 0) + 1
    assert degrees(now, path) == {p: count.get(p, 0) for p in notes} == degrees(whole, its)
    assert now["chunks"].count() == whole["chunks"].count() == now["vectors"].count() and now["suggestions"].count() == 0
    zebra = lambda t, p: {(p[r.chunk_id // 1_000_000], round(r.score, 9)) for r in fts.hits(I.opened(t).text, [(1, "zebra")]).collect()}
    assert zebra(now, path) == zebra(whole, its) and zebra(now, path)


def test_second_writer_goes_on_top_or_fails(spark, tmp_path):
    st = store.Store(str(tmp_path / "s"))
    frame_of = lambda rows: spark.createDataFrame(rows, "source_id long, tag string")
    st.publish(spark, {"tags": frame_of([(1, "a"), (2, "b"), (3, "c")])})
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id long")
    real, stale = store.Store.number, [1]
    store.Store.number = lambda self, spark: stale.pop() if stale else real(self, spark)
    try:
        st.change(spark, {"tags": store.Change(frame_of([(1, "aa")]), ids(1))})
        stale.append(1)
        st.change(spark, {"tags": store.Change(frame_of([(2, "bb")]), ids(2))})  # read version 1 as well, touches another source
        assert {(r.source_id, r.tag) for r in st.read(spark, "tags").collect()} == {(1, "aa"), (2, "bb"), (3, "c")}
        stale.append(2)
        with pytest.raises(store.PublishConflict):
            st.change(spark, {"tags": store.Change(frame_of([(2, "late")]), ids(2))})
    finally:
        store.Store.number = real
    assert {r.tag for r in st.read(spark, "tags").collect()} == {"aa", "bb", "c"}


def test_old_schema_is_upgraded_and_searched(spark, tmp_path):
    """A store of schema 1, without aliases, tags and postings, is indexed on and searched from postings."""
    root, at = tmp_path / "v", str(tmp_path / "s")
    put(root, NOTES)
    made = I.build(frame(spark, NOTES))
    old = {n: made[n] for n in ("chunks", "vectors", "edges", "tags")} | {"sources": made["sources"].drop("aliases", "tags"), "files": frame(spark, NOTES)}
    store.Store(at).publish(spark, old, schema_version=1)
    assert api.upgrade(spark, at) and not api.upgrade(spark, at)
    put(root, {"new.md": "zebra alpha"})
    assert run(spark, root, at) == {"ingested": 1, "unchanged": 4}
    idx, _ = api.opened(spark, at)
    assert idx.text is not None and idx.names is not None
    assert {r.path for r in api.results(spark, at, "alpha", rerank=False).collect()} >= {"a.md", "new.md"}


def scanned(df):
    """Rows that the scans of an executed query gave, of tables with positions."""
    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "FileSourceScanExec" and "positions" in p.simpleString(100):
            return p.metrics().apply("numOutputRows").value()
        kids = p.children()
        return sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A stored index of 12,000 texts, nearly all of which hold one word, a few of them often."""
    import random

    rnd = random.Random(7)
    rows = [(i, " ".join(["common"] * (rnd.randrange(5, 30) if rnd.random() < 0.02 else rnd.randrange(0, 3)) + [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 60))])) for i in range(12_000)]
    df = spark.createDataFrame(rows, "chunk_id long, content string")
    st = store.Store(str(tmp_path_factory.mktemp("many") / "s"))
    columns = search.text_columns()
    post = fts.postings(df, "chunk_id", columns, usual=fts.usual_tokens(df, columns))
    st.publish(spark, {"text_postings": post, "text_terms": lambda t: fts.terms_of(t["text_postings"], "chunk_id", ("content",)), "text_stats": lambda t: fts.stats_of(t["text_postings"], df)})
    t = st.read_all(spark)
    return fts.TextIndex(t["text_postings"], t["text_terms"], t["text_stats"], "chunk_id", ("content",))


@pytest.mark.parametrize("query,falls", [("common", True), ("common OR w5", False), ("w5 OR w6 OR w7", False), ("common w5", False), ("common OR common OR w9", False), ("nowhere OR common", False), ("nowhere", False)])
def test_bounds_leave_the_best_rows_as_they_are(spark, many, query, falls):
    tree = fts.flat(fts.parse(query))
    every = sorted((round(r.score, 14), r.chunk_id) for r in fts._by_join(many, [(1, *tree)]).collect())[:50]
    got = fts.hits(many, [(1, query)])
    assert every == sorted((round(r.score, 14), r.chunk_id) for r in got.collect())
    whole = many.postings.filter(F.col("term").isin(tree[1])).count()
    if falls:
        assert scanned(got) < 0.5 * whole


def test_prefix_reads_the_buckets_of_its_terms(spark, many):
    """w39* is a range of the term table: w39 and w390 to w399, which lie in some of the buckets."""
    of = lambda p: sorted({r.bucket for r in many.postings.filter(F.col("term").startswith(p)).select("bucket").distinct().collect()})
    assert fts.prefix_buckets(many, ["w39"]) == of("w39") and len(of("w39")) < 16
    assert fts.prefix_buckets(many, ["common"]) == of("common") and fts.prefix_buckets(many, ["zz"]) == []
    got = fts.hits(many, [(1, "comm*")], None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "").replace("PartitionFilters: [(", "PartitionFilters: [")
    assert got.count() == many.postings.filter("term = 'common'").count()
    assert fts.hits(many, [(1, "zz*")]).count() == 0
    for odd in ("퟿", "\U0010ffff", "é"):
        df = spark.createDataFrame([(odd,), (odd + "a",), ("b",)], "term string")
        assert df.filter(fts.in_range(odd)).count() == 2


def test_reranker_sees_all_passages_of_a_query(spark):
    """One call for each query with all its passages, in the order of position, though Arrow batches hold seven rows; a wrong length leaves that query alone without scores."""
    rows = spark.createDataFrame([(q, f"query {q}", p, f"{p}") for q in range(3) for p in range(1, 21)], "query_id long, query string, position int, content string").repartition(3)
    model = search.Reranker(lambda q, own: [float(x) for x in own] if len(own) == 20 and own == sorted(own, key=int) and q != "query 1" else [1.0])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.query_id, r.position): r.p for r in model.scores(rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(q, p): None if q == 1 else float(p) for q in range(3) for p in range(1, 21)}
