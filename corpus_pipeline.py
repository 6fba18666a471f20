"""A training-corpus pipeline over ``documents``: filter, deduplicate, cut repeats, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next stage's docs. All stages but the last return the columns of documents.
Tables that a stage kept in the shared folder are deleted when the next one begins on its written result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.llm import kernel, mixing, near, packing, quality, substring
from tacet.sources import shared

_last: list[str] = []


def _stage(work):
    """A stage that first deletes what the stage before has kept, unless docs are still read from there."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        shared.release(spark, _last, docs)
        before = set(shared.kept_tables())
        out = work(spark, docs, sf_dir)
        _last = [p for p in shared.kept_tables() if p not in before]
        return out

    return run


#: SQL cannot express packing or tokenisation; tests hold the stages against brute force.
ORACLE_SQL = None


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return quality.filter_documents(docs)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (a similarity of 0.8 or more) one row stays: that of the least doc_id.

    Rows without an id go where a copy with an id stays; of rows equal in id and text one stays.
    """
    return near.one_of_each(docs)


@_stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document of which nothing is left goes too."""
    out = substring.remove_repeats(docs)
    out = out.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))))
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("doc.text"))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("doc").getField("n_chars") if "n_chars" in docs.columns else F.lit(None))
    return out.select(*[text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns])


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule of their sources.

    The order of rows does not outlive the reread; the packing stage works the slots out again.
    """
    return mixing.mix(docs)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences, which follow the schedule of the sources."""
    slots = mixing.placed(docs).select("doc.doc_id", "doc.text", "_slot", "_h")
    return packing.pack_in_order(slots, packing.tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = kernel.read(spark, sf_dir, "documents")
    read: list[str] = []
    for _, stage in STAGES[:-1]:
        docs = kernel.keep(stage(spark, docs, sf_dir))
        shared.release(spark, read)  # the stage's input, now that its result is written
        read = shared.kept_tables()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
