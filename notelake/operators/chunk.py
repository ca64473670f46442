"""Markdown chunks: fenced code whole, then headers, paragraphs and sentences packed up to a token target.

The packing is a small state machine over spans of one text, so it runs in Arrow batches; offsets are code points and each
chunk's text is the body between them.
"""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, StringType, StructType

SLICE_BYTES, SLICE_ROWS = 1 << 20, 200  # texts that are cut and given on before the next are read from a batch; one long text is a slice of its own
WIDE = re.compile("[㐀-鿿豈-﫿]")
CHUNK_DDL = "array<struct<text:string,char_start:int,char_end:int,token_count:int>>"
# Fixed values.
FENCE, HEADING, BLANK, SENTENCE = r"(?ms)^(`{3,})[^\n]*\n(.*?)^\1\s*$", r"(?m)^#{1,6}\s", r"\n\s*\n", r"(?<=[.!?。！？])\s+"


def spans(text: str, target: int = 400, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each chunk."""
    some_wide = not text.isascii() and WIDE.search(text) is not None

    def estimate(a: int, b: int) -> int:
        wide = len(WIDE.findall(text, a, b)) if some_wide else 0
        return max(1, int((b - a - wide) / 4 + wide / 1.5)) if b > a else 0

    def cut(a: int, b: int, pattern: str) -> list[tuple[int, int]]:
        edges = [a]
        out = []
        region = text[a:b]
        for m in re.finditer(pattern, region):
            out.append((edges[-1], a + m.start()))
            edges.append(a + m.end())
        return [*out, (edges[-1], b)]

    def trimmed(a: int, b: int) -> tuple[int, int]:
        part = text[a:b]
        return a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))

    found: list[tuple[int, int]] = []

    def pack(units: list[tuple[int, int]], split_large: bool) -> None:
        """Join neighbours while their estimates stay within target; a large unit is split only where nothing is held."""
        held = None
        for a, b in units:
            n = estimate(a, b)
            if split_large and held is None and n > target:
                sentences = cut(a, b, SENTENCE)
                pack(sentences if sentences[-1][0] < b else sentences[:-1], False)
                continue
            if held and held[2] + n > target:
                found.append(held[:2])
                held = None
            held = (held[0], b, held[2] + n) if held else (a, b, n)
        if held:
            found.append(held[:2])

    def prose(a: int, b: int) -> None:
        heads = [m.start() + a for m in re.finditer(HEADING, text[a:b]) if m.start()]
        for s, e in zip([a, *heads], [*heads, b]):
            pack([t for t in (trimmed(*p) for p in cut(s, e, BLANK)) if t[0] < t[1]], True)

    at = 0
    for m in re.finditer(FENCE, text):
        prose(at, m.start())
        found.append(m.span())
        at = m.end()
    prose(at, len(text))
    found = [(a, b) for a, b in found if text[a:b].strip()]
    first = [found[0][0]] if found else []
    starts = first + [max(p[0], c[0] - max(0, overlap)) for p, c in zip(found, found[1:])]
    return [(s, b, estimate(s, b)) for s, (_, b) in zip(starts, found)]


def chunks_of(body: Column, target: int = 400, overlap: int = 0) -> Column:
    """array<struct<text, char_start, char_end, token_count>> of a body column."""
    @F.pandas_udf(CHUNK_DDL)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": t[a:b], "char_start": a, "char_end": b, "token_count": n} for a, b, n in spans(t or "", target, overlap)])

    return run(body)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts are of bounded size, whatever rows the batch has."""
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast(pa.int64())).to_pylist()
    start, before = 0, 0
    for i, end in enumerate(ends):
        if end - before >= SLICE_BYTES or i + 1 - start >= SLICE_ROWS or i + 1 == len(ends):
            yield batch.slice(start, i + 1 - start)
            start, before = i + 1, end


def chunked(sources: DataFrame, body: Column, target: int = 400, overlap: int = 0, with_text: bool = True) -> DataFrame:
    """(source_id, chunk_index[, content], char_start, char_end, token_count).

    A task holds the chunks of one slice of a batch at a time. with_text: without it, chunks are only placed and no text leaves the task.
    """
    kind = sources.schema["source_id"].dataType.simpleString()
    names = ["source_id", "chunk_index", *(["content"] if with_text else []), "char_start", "char_end", "token_count"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                of, numbers, texts, found = [], [], [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    own = spans(text or "", target, overlap)
                    of += [r] * len(own)
                    numbers += range(len(own))
                    found += own
                    if with_text:
                        texts += [text[a:b] for a, b, _ in own]
                places = [pa.array([x[k] for x in found], pa.int32()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), pa.array(numbers, pa.int32()), *([pa.array(texts, pa.string())] if with_text else []), *places], names)

    content = "content string, " if with_text else ""
    return sources.select("source_id", body.alias("_body")).mapInArrow(run, f"source_id {kind}, chunk_index int, {content}char_start int, char_end int, token_count int")


class ChunkTable:
    """The table function ``chunk(text[, target[, overlap[, with_text]]])`` for SQL: a row for each chunk, so a long note is never one value.

    with_text => false leaves the text column out: the schema follows the arguments. A null text has no rows.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, target: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"chunk() takes a text, not {text.dataType.simpleString()}")
        for name, a in (("target", target), ("overlap", overlap), ("with_text", with_text)):
            if a is not None and not a.isConstantExpression:
                raise ValueError(f"{name} of chunk() must be a constant")
        if target is not None and target.value < 1:
            raise ValueError("target of chunk() must be positive")
        schema = StructType().add("chunk_index", IntegerType())
        if with_text is None or with_text.value:
            schema = schema.add("text", StringType())
        for c in ("char_start", "char_end", "token_count"):
            schema = schema.add(c, IntegerType())
        return AnalyzeResult(schema=schema)

    def eval(self, text: str, target: int = 400, overlap: int = 0, with_text: bool = True):
        for i, (a, b, n) in enumerate(spans(text, target, overlap) if text is not None else ()):
            yield (i, *([text[a:b]] if with_text else []), a, b, n)


def register(spark: SparkSession) -> None:
    """Make ``chunk`` known to SQL: SELECT ... FROM notes, LATERAL chunk(text, target => 400)."""
    spark.udtf.register("chunk", F.udtf(ChunkTable))
