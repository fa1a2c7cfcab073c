"""The corpus pipeline: toxic documents go, near-duplicates go, repeated passages and benchmark passages go, the rest is packed.

A stage takes and returns the columns of ``docs``, whatever they are called; it needs doc_id and text, and makes n_chars fit where there is one.
Common to all stages: a row with a null or empty text, or without doc_id, stays; a text of any length is read whole;
an empty table gives an empty result. What each does with ties and repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import contamination, packing, simhash, substrings, toxicity
from loomtext.session import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. Examples come from the documents of the stage's own input that have labels.

    Equally similar examples count by doc_id; repeated rows stay or go together; without labels all stay.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Of rows with one doc_id and one text any one stays; rows that share a doc_id but not the text are judged apart.
    """
    return simhash.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences, by (doc_id, position), of passages that repeat.

    Of rows at one (doc_id, position) none is later than the other, so repeated rows are treated alike.
    """
    return substrings.drop_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that mostly consist of them go.

    A document just half of which is found stays, without it; repeated rows are treated alike; an empty benchmark changes nothing.
    """
    return contamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their text, and the bins they are in, see ``packing.pack``.

    Of pieces of one length the one with the smaller doc_id goes first; repeated rows are packed one by one; a document
    without a token is a piece in no bin.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the isotonic calibration, the fingerprint groups or the subset sums.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole table of documents; what a stage returns is written as Parquet before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
