"""A corpus from documents: toxic texts go, then exact copies, then near copies; the rest
is mixed to target weights and packed. Each stage's result is written to the shared
folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeweir.llm.common import table, written
from codeweir.llm.exact_dedup import without_copies
from codeweir.llm.mixing import Mix, mixed
from codeweir.llm.ngram_join import without_near_copies
from codeweir.llm.packing import pack
from codeweir.llm.toxicity import scored, train_chain


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; it is trained on those with labels."""
    chain = train_chain(docs, table(spark, sf_dir, "labels"))
    return scored(docs, chain, [], only_clean=True)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id."""
    return without_copies(docs)


def separate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, similarity 0.8), the one with the smallest id."""
    return without_near_copies(docs, words=5, percent=80)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of domains, languages and sources take."""
    return mixed(docs, Mix())


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, along the curve."""
    return pack(docs)


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("ngram_join", separate), ("mixing", blend), ("packing", sequences)]

#: Classifier, hashed projections and BPE ids are beyond SQL; tests hold run() against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
