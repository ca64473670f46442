import re

import pytest
from pyspark.sql import functions as F

from notelake.functions import han
from notelake.functions import text as T
from notelake.functions import vectors as V
from notelake.operators import chunk
from notelake.sources import sinks


def one(spark, value, *columns):
    return list(spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_tokens(spark):
    assert one(spark, "für hello_World 42é", T.tokens("t"))[0] == ["f", "r", "hello", "world", "42"]
    assert one(spark, "ﬁne 向量检索 ok", T.Tokenizer().column("t"))[0] == ["fine", "向量", "量检", "检索", "ok"]
    assert one(spark, None, T.tokens("t"))[0] == []


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a" * 40, 10), ("你好世界你好", 4), ("ab你好", 1)])
def test_token_estimate(spark, text, n):
    assert one(spark, text, T.token_estimate("t"))[0] == n


@pytest.mark.parametrize(
    "yaml,tags",
    [("tags: [ai, 'ml', \"x y\"]", ["ai", "ml", "x y"]), ("tags:\n  - ai\n  - a/b\n", ["ai", "a/b"]), ("tags: ai, ml", ["ai, ml"]), ("tags: []", []), ("other: 1", []), ("tags:\n- ai", ["- ai"]), ("tags: [机器, 学习]", ["机器", "学习"])],
)
def test_list_field(spark, yaml, tags):
    assert one(spark, yaml, T.list_field("t", "tags"))[0] == tags


def test_frontmatter_body_title(spark):
    note = "---\ntags: [a]\n---\n\n\n# Head\ntext"
    assert one(spark, note, T.frontmatter("t"), T.body("t"), T.title(T.body("t"), F.lit("x/stem.md"))) == ["tags: [a]\n", "# Head\ntext", "Head"]
    assert one(spark, "no fence", T.body("t"), T.title("t", F.lit("x/stem.md"))) == ["no fence", "stem"]
    assert one(spark, "---\na: 1\n---", T.frontmatter("t"))[0] == ""


def test_links(spark):
    text = "[[a]] [[b|B]] `[[c]]` [[a]]\n```\n[[d]]\n```\n[[笔记]] [[x#y]] [[]]"
    assert one(spark, text, T.wiki_links("t"))[0] == ["a", "b", "笔记", "x#y"]


def test_lines(spark):
    note = "---\na: 1\n---\none\ntwo\nthree"
    assert one(spark, note, T.line_of("t", 0), T.line_of("t", 4), T.line_of("t", 9)) == [4, 5, 6]
    assert one(spark, "1\n2\n3\n", T.line_window("t", 2, 1), T.line_window("t", 0, 2), T.line_window("t", 9, 2)) == ["2", "1\n2", ""]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.d for r in df.select(V.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == 1.0 and abs(got[1]) < 1e-12 and got[2] is None


BODIES = ["", "one paragraph", "# A\n\ntext a\n\n# B\n\ntext b", "p one.\n\np two.\n\n" * 30, "Long sentence here. " * 200, "x\n\n```py\na\n\n# no head\n```\n\ny", "中文。" * 400, "a" * 3000 + "\n\nshort\n\n" + "b. " * 900]


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("overlap", [0, 30])
def test_chunk_spans_hold_the_text(body, overlap):
    found = chunk.spans(body, 50, overlap)
    assert all(body[a:b].strip() for a, b, _ in found)
    starts = [a for a, _, _ in found]
    assert starts == sorted(starts)
    covered = "".join(body[max(a, p) : b] for (a, b, _), p in zip(found, [0, *(b for _, b, _ in found)]))
    assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", body)


def test_chunk_rules():
    assert [b for _, b, _ in chunk.spans("a.\n\n" * 3, 400)] == [10]
    code = "x\n\n```\n" + "long " * 500 + "\n```\n\ny"
    assert len(chunk.spans(code, 50)) == 3
    heads = chunk.spans("# A\ntext\n# B\ntext", 400)
    assert len(heads) == 2
    held = "tiny\n\n" + "Word here. " * 100  # a large paragraph after held text is kept whole
    assert len(chunk.spans(held, 50)) == 2


def test_related(spark):
    link = lambda t: one(spark, t, sinks.with_related(F.col("t"), "x"))[0]
    assert link("a") == "a\n\n## Related\n\n- [[x]]\n"
    first = "# T\n\n## Related\n- [[y]]\n\n## More\nz"
    assert link(first) == "# T\n\n## Related\n- [[y]]\n- [[x]]\n## More\nz"
    assert link("## Related\n- [[x]]\n") == "## Related\n- [[x]]\n"


def test_vectors_from_blobs(spark):
    import numpy as np

    from notelake.functions.vectors import from_blob

    blob = np.array([1.5, -2.0, 0.25], "<f4").tobytes()
    rows = spark.createDataFrame([(bytearray(blob),), (None,)], "b binary").select(from_blob(F.col("b")).alias("v")).collect()
    assert [r.v for r in rows] == [[1.5, -2.0, 0.25], None]


def test_likeliest_path_equals_all_paths():
    """Every way to cut a short run, by brute force."""
    import math
    import random

    rnd = random.Random(4)
    for _ in range(60):
        counts = {"".join(rnd.choice("甲乙丙丁") for _ in range(rnd.randrange(1, 5))): rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 14))}
        own = han.Segmenter(counts)
        run = "".join(rnd.choice("甲乙丙丁戊") for _ in range(rnd.randrange(1, 9)))
        cost = lambda words, own=own: math.fsum(own.logs.get(w, own.unknown if len(w) == 1 else -math.inf) for w in words)
        ways = [[run[a:b] for a, b in zip((0, *cut), (*cut, len(run)))] for m in range(1 << (len(run) - 1)) for cut in [[i + 1 for i in range(len(run) - 1) if m >> i & 1]]]
        got = own.path(run)
        assert "".join(got) == run and abs(cost(got) - max(map(cost, ways))) < 1e-9


def test_segmenter_gives_parts_before_the_whole():
    own = han.Segmenter({"数据": 9, "据库": 1, "数据库": 20, "知识": 5, "管理": 5, "知识管理": 30})
    assert own("数据库知识管理") == ["数据", "据库", "数据库", "知识", "管理", "知识管理"] and own("库") == ["库"]
    t = T.Tokenizer(own)
    assert t.split("用数据库") == ("用", "数据", "据库", "数据库")
    assert t.characters("x 用数据库") == [("数", 2), ("据", 2), ("库", 3)]
    assert T.Tokenizer().characters("天天天a库") == [("天", 0), ("天", 0), ("天", 1)]


def test_words_are_learned_from_text(spark):
    """Words that recur in varied company are found, fragments of them aren't."""
    import random

    rnd = random.Random(2)
    true = ["知识", "管理", "数据库", "向量", "检索", "方法"]
    filler = [chr(0x4E00 + 7 * i) for i in range(300)]
    rows = [("".join(rnd.choice(true) if rnd.random() < 0.5 else rnd.choice(filler) for _ in range(12)),) for _ in range(600)] + [(None,), ("",), ("abc",)]
    counts = han.grams(spark.createDataFrame(rows, "text string"))
    found = han.words(han.candidates(counts, 60), 2.0).filter("length(word) > 1")
    assert {r["word"] for r in found.collect()} == set(true)
    few = han.dictionary(han.words(han.candidates(counts, 60), 2.0), 3)
    assert len(few) == 3
    assert han.Segmenter(han.dictionary(han.words(han.candidates(counts, 60), 2.0))).path("知识管理数据库") == ["知识", "管理", "数据库"]
    assert han.dictionary(han.words(han.candidates(han.grams(spark.createDataFrame([], "text string"))))) == {}


def test_chunk_as_a_table_function(spark):
    """A row for each chunk, a schema that follows the arguments, and arguments that are refused."""
    from pyspark.errors import PySparkException

    chunk.register(spark)
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, None), (3, "")], "id long, body string")
    got = spark.sql("SELECT id, c.* FROM {d}, LATERAL chunk(body, target => 1) AS c ORDER BY id, chunk_index", d=df)
    assert got.columns == ["id", "chunk_index", "text", "char_start", "char_end", "token_count"]
    assert [(r.id, r.text) for r in got.collect()] == [(1, "One."), (1, "Two."), (1, "Three.")]
    assert "text" not in spark.sql("SELECT * FROM chunk('a b', with_text => false)").columns
    for bad in ("chunk(1)", "chunk('a', target => 0)"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {bad}").collect()
