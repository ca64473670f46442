"""Shared helpers on texts: Arrow batches in slices of bounded bytes, words, and null-safe columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = bytes([32, *range(9, 14)])


def bytes_col(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def docs(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's bytes and the named columns; whatever else the table holds is dropped."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_col(), *more)


def n_words(name: str = "text") -> Column:
    """Number of words of a string column, 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(F.col(name), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of the column, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def kept_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with exactly the columns of like, in order."""
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
