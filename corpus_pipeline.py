"""The corpus pipeline: documents through five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns documents; its rows are
written as Parquet to the shared folder and read again by the next one, whose
own rows replace them there.

Defined edge cases: a null text is empty, so the first stage drops it; documents
without an id pass the near-duplicate stage and come last in the substring stage;
rows that repeat an id are versions of one document, of which one stays; an empty
table gives an empty result; further columns are carried through, whatever their
names; a very long text is handled whole by every stage.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontam, langid, mixing, near_dup, substring
from weft.llm.common import remove, shared_dir, small_batches, sweep, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    small_batches(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    small_batches(spark)
    return near_dup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans leave the texts."""
    small_batches(spark)
    return substring.cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]

#: SQL can express neither the trained classifier nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written and read again."""
    return apply(spark, table(spark, sf_dir, "documents"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/weft-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
        sweep(spark)
    atexit.register(remove, spark, before)
    return docs
