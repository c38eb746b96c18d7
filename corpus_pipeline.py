"""Preparing a training corpus: five stages, each the work of one operator on what the stage before has kept.

Every stage is written as Parquet in the shared folder and read again as the next one's documents.  All stages
but the last keep the columns of their input, whatever their names; an empty table gives an empty one; texts of
any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowanmill.llm import mixing, near_duplicates, pii, quality, resemblance, tokenizing
from rowanmill.llm.common import documents, materialize, packed, with_text
from rowanmill.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet all rules; a null or empty text has no words and goes, repeated rows are judged one by one."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates: close fingerprints, then a resemblance of 0.8 or more.

    Of rows with the same id the one with the least text stays, rows without an id stay; null and empty texts are one group.
    """
    return resemblance.drop_similar(materialize(near_duplicates.drop_near_duplicates(docs, shingle=5)))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and keys replaced by their kinds; n_chars follows the text; a null text stays null, repeated rows are treated alike."""
    return with_text(pii.redact(pii.find(packed(docs))), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The word ranges that the mix takes, in shards; a range taken twice is two rows, n_chars follows the text; null texts give no row, a null source is one of its own."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digests of ids and decoded text; a null text is the empty text, which has no ids."""
    return tokenizing.tokenize(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The pieces of the last stage and the links of the second can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
