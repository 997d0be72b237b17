"""From raw documents to packed training sequences, in stages that are each written and read again.

Each stage is a function of (spark, docs, sf_dir), works on all that the one before it kept, and calls one operator. All but the
last return the columns of documents, with all that the rows have in them.

Edge cases: empty tables pass through every stage. Rows with a null or empty text are kept until packing, where they are an end id.
Rows without an id are judged like others by toxicity, keep their lines, are no duplicate of any row, and are sanitised and packed.
Of rows that repeat an id, near_duplicates keeps one; until then each keeps its own text. Very long texts are whole in every stage.
Columns beyond id and text may have any names; they come through unchanged, but are not in the last stage's result. Without labels, or
labels of one class, no document is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ionweave.llm.common import cut, discard, table
from ionweave.llm.jaccard import one_of_each
from ionweave.llm.linededup import drop_repeated_lines
from ionweave.llm.packing import pack
from ionweave.llm.pii import sanitise
from ionweave.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic, under a lexicon learned from the labels."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated passages of three lines; drop documents of which nothing is left."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that disclose it, in the texts."""
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts, in pieces with their places in training sequences."""
    return pack(docs, with_ids=True, memo=100_000)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("packing", packing),
]

#: The stages learn weights, find components and pack, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage returned is deleted when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
            discard(before)
    return docs
