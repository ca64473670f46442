"""Embedding models in batches, and notes that they fail for."""

import pytest
from pyspark.sql import functions as F

from notelake import api
from notelake.functions.models import Embedder, vectors
from notelake.operators import search, store
from notelake.streaming import ingest


class Lengths:
    """A model by the length of a text; it fails for texts that hold the word broken. loads: a folder with a file for each time it was loaded."""

    def __init__(self, loads=None):
        import os
        import uuid

        if loads:
            open(os.path.join(loads, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

    def passages(self, texts):
        if any("broken" in t for t in texts):
            raise ValueError("a broken passage")
        return [[float(len(t)), 1.0] for t in texts]

    def queries(self, texts):
        if any("broken" in t for t in texts):
            raise ValueError("a broken query")
        return [[-float(len(t)), 2.0] for t in texts]


def lengths(loads=None):
    import importlib

    return lambda: importlib.import_module("tests.test_models").Lengths(loads)


def test_groups_are_halved_until_the_failing_text_is_alone():
    calls = []

    def call(texts):
        calls.append(list(texts))
        return Lengths().passages(texts)

    got = vectors(call, ["aaa", "broken", "a", "", "aaaaaaaaa"], 8)
    assert [v for v, _ in got] == [[3.0, 1.0], None, [1.0, 1.0], [0.0, 1.0], [9.0, 1.0]]
    assert [f for _, f in got if f] == ["ValueError: a broken passage"]
    assert calls[0] == ["", "a", "aaa", "broken", "aaaaaaaaa"]  # by length
    short = vectors(lambda t: [[1.0]] * (len(t) if len(t) < 2 else 1), ["x", "y", "z"], 3)  # another number of vectors
    assert [v for v, _ in short] == [[1.0]] * 3
    odd = vectors(lambda t: [None, [], [float("nan")], "x", [1]][: len(t)], list("abcde"), 5)
    assert [f is None for _, f in odd] == [False, False, False, False, True] and vectors(None, [], 3) == []


def test_a_model_is_loaded_once_in_each_worker(spark, tmp_path):
    model = Embedder(lengths(str(tmp_path)), batch=4)
    texts = spark.range(200).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t")).repartition(16)
    for side, sign in (("passages", 1), ("queries", -1), ("passages", 1)):
        got = texts.select("t", getattr(model, side)(F.col("t")).alias("v")).collect()
        assert all(r.v.embedding[0] == sign * len(r.t) and r.v.failure is None for r in got) and len(got) == 200
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert pids and len(pids) == len(set(pids))


def test_a_model_that_cannot_be_loaded_fails_every_text(spark):
    def load():
        raise OSError("no weights")

    got = spark.createDataFrame([("a",), (None,)], "t string").select(Embedder(load).passages(F.col("t")).alias("v")).collect()
    assert [(r.v.embedding, r.v.failure) for r in got] == [(None, "RuntimeError: OSError: no weights")] * 2


def test_null_texts_are_empty(spark):
    got = spark.createDataFrame([(None,), ("ab",)], "t string").select(Embedder(lengths()).passages(F.col("t")).alias("v")).collect()
    assert sorted(r.v.embedding[0] for r in got) == [0.0, 2.0]


def test_one_note_that_fails_fails_no_other(spark, tmp_path):
    root, kept, model = tmp_path / "notes", str(tmp_path / "index"), Embedder(lengths())
    root.mkdir()
    put = lambda name, text: (root / name).write_text(text)
    put("a.md", "alpha [[b]]"), put("b.md", "broken beta"), put("c.md", "gamma [[a]]")
    read = lambda t: store.Store(kept).read(spark, t)
    links = lambda: {(r.target_path, r.dst_id is not None) for r in read("edges").collect()}
    assert api.index(spark, str(root), kept, embed=model) == {"ingested": 2, "unchanged": 0, "skipped": 0, "errors": 1, "pruned": 0}
    assert {r.path for r in read("sources").collect()} == {r.path for r in read("files").collect()} == {"a.md", "c.md"}
    assert links() == {("b", False), ("a", True)} and read("vectors").count() == 2
    # it is tried again, and a note that fails once it is known stays as it was
    put("b.md", "beta whole"), put("a.md", "alpha broken, without a link")
    before = {r.path: r.content_hash for r in read("sources").collect()}
    assert api.index(spark, str(root), kept, embed=model) == {"ingested": 1, "unchanged": 1, "skipped": 0, "errors": 1, "pruned": 0}
    after = {r.path: r.content_hash for r in read("sources").collect()}
    assert set(after) == {"a.md", "b.md", "c.md"} and after["a.md"] == before["a.md"]
    assert links() == {("b", True), ("a", True)}
    assert {r.path: r.content for r in read("files").collect()}["a.md"] == "alpha [[b]]"
    # nothing but failures: no new version
    version = store.Store(kept).number(spark)
    out = api.index(spark, str(root), kept, path="a.md", embed=model)
    assert out["errors"] == 1 and out["ingested"] == 0 and store.Store(kept).number(spark) == version
    # the side of queries is another one, and one that fails leaves its channel empty
    assert model.query("abc") == [-3.0, 2.0] and search.safe_embed(model.query, "broken") is None
    with pytest.raises(RuntimeError):
        model.query("broken")
    assert {r.path for r in api.results(spark, kept, "beta", embed_query=model, rerank=False).collect()} >= {"b.md"}


def test_a_stream_counts_failures(spark, tmp_path):
    st = store.Store(str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame([(p, c, None) for p, c in x], ingest.FILES)
    assert ingest.merge_batch(st, rows(("a.md", "one"), ("b.md", "broken")), Embedder(lengths())) == {"new": 1, "errors": 1}
    got = ingest.merge_batch(st, rows(("b.md", "two"), ("c.md", "broken")), Embedder(lengths()))
    assert (got["new"], got["errors"]) == (1, 1)
    assert {r.path for r in st.read(spark, "sources").collect()} == {"a.md", "b.md"}
