"""Compaction against a plain version, file by file."""

import datetime
import hashlib
import random
import zlib
from collections import defaultdict
from math import floor
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from notelake.llm import compaction

DDL = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value double, props string, by_day string"


def plain(rows):
    """What the final folder holds: (day, lot, piece) of the first source -> (sources, rows in order)."""
    r_all = len(rows)
    s = lambda x: 1 + r_all // x
    day = lambda r: (r["arrived_at"] - datetime.datetime(1970, 1, 1)).days if r["arrived_at"] is not None else None
    per = defaultdict(int)
    for r in rows:
        per[day(r)] += 1
    found = defaultdict(list)
    for r in rows:
        h = zlib.crc32(str(r["click_id"]).encode()) if r["click_id"] is not None else 0
        found[day(r), (h // 16) % (1 + per[day(r)] // s(200)), min(h % 4, (h // 4) % 4)].append(r)
    least = lambda x: (x is not None, x)
    for v in found.values():
        v.sort(key=lambda r: (least(r["arrived_at"]), least(r["click_id"]), least(r["ts"]), least(r["value"]), least(r["props"])))
    out = {}
    for d in per:
        own = sorted((k for k in found if k[0] == d), key=lambda k: (-len(found[k]), k[1], k[2]))
        groups = []
        for k in own:
            if len(found[k]) >= s(750):
                out[k] = ([k], found[k])
                continue
            for g in groups:
                if sum(len(found[x]) for x in g) + len(found[k]) <= s(300):
                    g.append(k)
                    break
            else:
                groups.append([k])
        for g in groups:
            out[g[0]] = (g, [r for k in g for r in found[k]])
    return out


def made(n, seed, days=12):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        day = 0 if rnd.random() < 0.3 else rnd.randrange(days)
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, seconds=rnd.randrange(5000), microseconds=rnd.choice([0, 999_999]))
        out.append({"click_id": i if rnd.random() > 0.01 else None, "ts": at, "arrived_at": at if rnd.random() > 0.02 else None, "value": rnd.choice([None, 1.005, -0.5, 2.0, float("nan"), float("inf")]), "props": rnd.choice(["", "x", None]), "by_day": "kept"})
    out += [dict(r) for r in out[: n // 20]]
    out.append({"click_id": 7, "ts": None, "arrived_at": datetime.datetime(1969, 12, 31, 23), "value": 1.0, "props": None, "by_day": None})
    return out


def test_final_files_equal_the_plain_version(spark, tmp_path):
    rows = made(4000, 1)
    got = {(r["day"], r["lot"], r["piece"]): r for r in compaction.compacted(spark.createDataFrame(rows, DDL), path=f"{tmp_path}/c").collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert any(r["rewritten"] for r in got.values()) and not all(r["rewritten"] for r in got.values())
    for k, (sources, held) in want.items():
        r = got[k]
        ids = [x["click_id"] for x in held]
        assert r["sources"] == ",".join(f"{a}-{b}" for _, a, b in sources)
        assert r["rewritten"] == (len(sources) > 1)
        assert r["n_rows"] == len(held)
        assert r["ids_sha256"] == hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
        some = [i for i in ids if i is not None]
        assert (r["min_click_id"], r["max_click_id"]) == (min(some, default=None), max(some, default=None))
        assert r["cents"] == sum(floor(100 * x["value"] + 0.5) for x in held if x["value"] is not None and abs(x["value"]) < 1e9)
        assert r["columns"] == "click_id,ts,arrived_at,value,props,by_day"
        table = pq.ParquetFile(r["path"].removeprefix("file://")).read()
        assert table.column_names == ["click_id", "ts", "arrived_at", "value", "props", "by_day"]
        assert table["click_id"].to_pylist() == ids
        assert table["props"].to_pylist() == [x["props"] for x in held]
    left = {str(p) for p in Path(f"{tmp_path}/c").rglob("*.parquet")}
    assert left == {r["path"].removeprefix("file://") for r in got.values()}


def test_untouched_files_keep_their_bytes(spark, tmp_path):
    df = spark.createDataFrame(made(3000, 2), DDL)
    landed = compaction.land(df, f"{tmp_path}/c", "arrived_at", "click_id")
    before = {str(p): p.read_bytes() for p in Path(landed.path).rglob("*.parquet")}
    plan = compaction.compact(spark, landed)
    after = {str(p): p.read_bytes() for p in Path(landed.path).rglob("*.parquet")}
    alone = plan.filter("members = 1").count()
    assert len(after.keys() & before.keys()) == alone > 0
    assert all(after[p] == before[p] for p in after.keys() & before.keys())
    assert sum(pa.parquet.ParquetFile(p).metadata.num_rows for p in after) == df.count()


def test_lockstep_is_first_fit():
    rnd = random.Random(3)
    import numpy as np

    days = [sorted((rnd.randrange(1, 60) for _ in range(rnd.randrange(0, 40))), reverse=True) for _ in range(30)]
    sizes = np.zeros((30, 40), np.int64)
    for i, d in enumerate(days):
        sizes[i, : len(d)] = d
    got = compaction.lockstep(sizes, 100)
    for i, d in enumerate(days):
        open_, want = [], []
        for n in d:
            at = next((j for j, x in enumerate(open_) if x + n <= 100), len(open_))
            open_[at:] = [*open_[at:]] if at < len(open_) else [0]
            open_[at] += n
            want.append(at)
        assert got[i, : len(d)].tolist() == want


def test_empty_table_and_joined_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    empty = compaction.compacted(spark.createDataFrame([], DDL), path=f"{tmp_path}/e")
    assert empty.count() == 0 and "ids_sha256" in empty.columns
    monkeypatch.setattr(compaction, "MOST_BROADCAST", 0)
    rows = made(800, 4)
    got = compaction.compacted(spark.createDataFrame(rows, DDL), path=f"{tmp_path}/j").collect()
    assert {(r["day"], r["lot"], r["piece"]): r["n_rows"] for r in got} == {k: len(v[1]) for k, v in plain(rows).items()}
