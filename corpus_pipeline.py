"""A corpus pipeline: language, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of their input. Stages don't share state, so each can be
written and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridelta.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from veridelta.llm._shared import Tables
from veridelta.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter go, and those that two languages encode in sizes that differ by less than 4 %."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.fit_languages(docs), min_margin=0.04)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document in training sequences, with their token ids."""
    ship(spark)
    # Workers that stay alive through other stages keep few words.
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=150_000)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Tokenizers, compression and sketches are beyond SQL; tests/llm hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder before the next reads it."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
