"""Corpus cleaning pipeline over ``documents``: each stage calls one operator of ``diamondlake.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diamondlake.llm.common import remove, scratch, write
from diamondlake.llm.decontamination import without_leaks
from diamondlake.llm.language_id import identified
from diamondlake.llm.ngram_join import one_of_each
from diamondlake.llm.packing import pack
from diamondlake.llm.secret_scan import redacted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are clearly in another language than English go, and nulls and texts without a letter.

    Where no text is labelled as English, nothing can be learnt to reject by, and all texts with a letter stay.
    """
    return identified(docs, ("en",))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8)."""
    return one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: the pieces of each document and their places."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can express neither the model of the first stage nor the tokens of the last; a test holds ``run`` against a
#: brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files go once the next stage has written its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        write(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
