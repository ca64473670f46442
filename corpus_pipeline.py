"""The training-corpus pipeline: classifier, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame that is written
as Parquet in the shared folder and read again as the next stage's docs. All but the last return the columns of documents, with further
columns unchanged in name, type and value, and all give an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import classifier, mixing, near, packing, suffix
from notelake.session import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the naive Bayes support vector model rejects.

    Null and empty texts are scored like any other, by the bias; without labels, or with labels of one class only, rows stay if that class is good
    (or if there are none); repeated rows fare alike; null ids are never learned from.
    """
    return classifier.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies (five-word shingles, Jaccard 0.8 or more), that of the least doc_id.

    Null and empty texts and texts of white space only are copies of one another; of equal ids the text of the least hash stays, of equal rows one;
    null ids take part and come last.
    """
    return near.one_of_each(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every string of 200 bytes that starts earlier in the corpus; the first copy stays, rows that end up empty go.

    Null and empty texts stay as they are; of different texts with one id that of the lower hash comes first; null ids come before all others; what a cut leaves of
    a UTF-8 character goes.
    """
    return suffix.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights.

    A null source is a source of its own; null and empty texts have size 0; repeated rows draw alike, null ids by their other columns.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 2048. Null and empty texts are one piece of the end id; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", long_repeats), ("mixing", mix), ("best-fit packing", pack)]

# Hinge-loss models, suffix arrays and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs.select([F.col(c) for c in docs.columns])
