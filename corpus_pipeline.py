"""A corpus pipeline over documents: quality, near-duplicates, personal data, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from townmeter.llm import bpe, mixing, near_duplicates, pii, quality
from townmeter.llm.common import Scratch, table
from townmeter.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds; null and empty texts don't, repeated rows are judged alike."""
    return quality.quality_filter(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents that share 80 % of their 5-word shingles: the one with the smallest key; rows without a key stay."""
    return near_duplicates.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null sources are one source, null texts have no words."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null text is empty."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the components of near-duplicates nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written and reread by the next. Empty tables go through all stages; other columns are carried, whatever their names."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, scratch.put(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
