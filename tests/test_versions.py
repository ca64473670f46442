"""Keyed state over file versions: late ones, deletions, links that go."""

import datetime as dt

from notelake.streaming import ingest, versions


def test_links_that_go_lower_the_indegree(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    batches = [
        [("a.md", "see [[x]] and [[y]] and [[x]]", at(5)), ("b.md", "see [[x]]", at(5)), ("c.md", None, at(9)), (None, "[[x]]", at(1)), ("d.md", "[[x]]", None)],
        [("a.md", "see [[y]] and [[z]]", at(7)), ("a.md", "see [[w]]", at(6)), ("b.md", "see [[late]]", at(4)), ("c.md", "[[x]]", at(8)), ("e.md", "", at(1))],
        [("b.md", None, at(8)), ("a.md", "see [[y]] and [[z]]", at(9)), ("a.md", "see [[gone]]", at(8))],
        [("b.md", "see [[z]]", at(9)), ("a.md", "see [[late]]", at(9))],
    ]
    seen, degrees = [], []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ingest.FILES).coalesce(1).write.mode("append").json(str(tmp_path / "in"), timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        source = spark.readStream.schema(ingest.FILES).json(str(tmp_path / "in"))
        versions.differences(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        every = sorted(((r.path, r.change, r.target_path or "", r.delta) for r in spark.read.schema(versions.CHANGES).parquet(str(tmp_path / "out")).collect()))
        seen.append([x for x in every if x not in sum(seen, [])])
        live = versions.indegrees(spark.readStream.schema(versions.CHANGES).parquet(str(tmp_path / "out")))
        got = []
        live.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "d")).foreachBatch(lambda df, _: got.extend((r.target_path, r.indegree) for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
        degrees.append(dict(got))
    assert seen[0] == [("a.md", "new", "", 0), ("a.md", "new", "x", 1), ("a.md", "new", "y", 1), ("b.md", "new", "", 0), ("b.md", "new", "x", 1)]
    assert seen[1] == [("a.md", "changed", "", 0), ("a.md", "changed", "x", -1), ("a.md", "changed", "z", 1), ("e.md", "new", "", 0)]
    assert seen[2] == [("b.md", "deleted", "", 0), ("b.md", "deleted", "x", -1)]
    assert seen[3] == [("b.md", "new", "z", 1)]  # known again; its row without a link is like the first one's
    assert degrees == [{"x": 2, "y": 1}, {"x": 1, "z": 1}, {"x": 0}, {"z": 2}]
