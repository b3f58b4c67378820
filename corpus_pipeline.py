"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, token ids.

Each stage works on what the one before it kept, and the kept rows are written in between. No stage can be put into
SQL (trees, fingerprints, suffix order, index and Viterbi have no SQL form), so the tests hold each against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import cut, small_batches, table
from tessera.llm.copies import keep_one
from tessera.llm.decontam import without_contaminated
from tessera.llm.pieces import Pieces, encode_pieces
from tessera.llm.quality import contract_model, keep_good
from tessera.llm.suffixes import PASSAGES, without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    return keep_good(docs, contract_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; texts are linked if their sets of five-word shingles have
    a Jaccard similarity of at least 0.8."""
    small_batches(spark)
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that start anywhere else too go, whatever their case and punctuation; every document
    stays, with what is left of it."""
    small_batches(spark)
    return without_repeats(docs, rule=PASSAGES)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, the others stay as they are."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    small_batches(spark)
    return encode_pieces(docs, Pieces.load())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("pieces", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
