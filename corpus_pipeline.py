"""A corpus pipeline over ``documents``: quality, line dedup, near duplicates, mixing, encoding.

Every stage works on all that the stage before kept, is written as Parquet and read again.  All but
the last return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bytebpe, linededup, mixing, neardup, quality
from folioflow.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees, carry=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without cross-site boilerplate lines, of any number of words."""
    clean = linededup.dedup_lines(docs)
    return clean.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs, carry=True)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's ids and of its decoded text."""
    return bytebpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mix sources", mix_sources), ("byte bpe", byte_bpe)]
#: Trees, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Scratch(spark)
        docs = written.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.discard()
        before = written
    return docs
