"""Corpus preparation in stages, each of which reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.llm import common, copies, decontamination, packing, personal, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 stay. The model learns from the labelled documents among the given ones."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    score = common.fresh(docs.columns, "score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.7).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest identifier.

    Candidates come from the vantage-point tree over SimHash fingerprints and from banded min-hashes; a pair counts from a Jaccard
    similarity of 0.8 over five-word shingles.
    """
    return copies.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return personal.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, packing.vocabulary_path())


def _bounded(stage: Stage) -> Stage:
    """The stage with small Arrow batches: its result holds whole texts and is computed when it is written, after the function has returned."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.set_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _bounded(without_toxic)),
    ("simhash near-duplicates", _bounded(without_near_copies)),
    ("benchmark decontamination", _bounded(without_benchmark)),
    ("personal data", _bounded(without_personal_data)),
    ("best-fit packing", _bounded(packed)),
]

#: The stages apply learned models, hash trees and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents in order; each stage's rows are written before the next one reads them."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
