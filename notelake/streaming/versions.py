"""File versions as keyed state: by path the last version's time, hash and links, giving events and differences of links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notelake.functions import text as T

CHANGES = "path string, change string, target_path string, delta int"
STATE = "mtime long, hash string, links array<string>"


def differences(files: DataFrame) -> DataFrame:
    """(path, change, target_path, delta) of a stream of file versions (path, content, mtime), append mode.

    For each path a batch's latest version counts if it is later than the last one seen (ties: the greater content; a deletion, null content, is least). It gives one row
    (new, changed or deleted, null, 0), and one for each link that came (+1) or went (-1). A version that is late, or like the last one, gives nothing; neither does the
    deletion of an unknown path, whose time is kept all the same, so that what is older stays out. Rows without path or mtime are dropped. The state of a path is one
    version's links, and a batch's rows of a path pass one after another, so a path of any number of versions needs the memory of one.
    """
    rows = files.filter("path is not null and mtime is not null").select("path", F.unix_micros("mtime").alias("mtime"), "content")
    rows = rows.select("path", "mtime", "content", F.when(F.col("content").isNull(), F.array().cast("array<string>")).otherwise(T.wiki_links(T.body("content"))).alias("links"))
    return rows.groupBy("path").applyInPandasWithState(_step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, had, old = state.get if state.exists else (None, None, [])
    best = None
    for batch in batches:
        for at, content, own in zip(batch["mtime"], batch["content"], batch["links"]):
            rank = (int(at), content is not None, content or "")
            if (last is None or rank[0] > last) and (best is None or rank > best[0]):
                best = (rank, own)
    if best is None:
        return
    (at, there, content), own = best
    now = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest() if there else None
    links = list(dict.fromkeys(own)) if there else []
    state.update((at, now, links))
    if now == had:
        return
    change = "deleted" if now is None else "new" if had is None else "changed"
    old = list(old) if old is not None else []
    out = [(change, None, 0), *((change, t, -1) for t in old if t not in set(links)), *((change, t, 1) for t in links if t not in set(old))]
    yield pd.DataFrame([(key[0], *x) for x in out], columns=["path", "change", "target_path", "delta"])


def indegrees(changes: DataFrame) -> DataFrame:
    """(target_path, indegree) from differences of links, as a table, or as a stream in update mode: what loses its last link comes with 0."""
    return changes.filter("target_path is not null").groupBy("target_path").agg(F.sum("delta").cast("long").alias("indegree"))
