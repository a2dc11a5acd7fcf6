"""Corpus pipeline: from raw documents to shards, in five stages.

Each stage takes what the one before it kept, as a Parquet table that it rereads;
all but the last return documents with the columns they came with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, mixing, quality, sharding, simhash
from tidemill.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy "corpus" keeps.

    Null and wordless texts go, and texts full of symbols, capitals or repeats, whole
    texts being measured.  Rows that repeat share their fate; other columns are left
    alone; an empty table gives an empty result.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; ties go by the other columns.

    Null and wordless texts are one group, of which one row stays; texts without id
    stay if their group has no id.  Rows that repeat, or share an id, are judged by
    their texts; an empty table gives an empty result.
    """
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Null, empty and very short texts share none and stay; whole texts are compared.
    Rows that repeat share their fate; without benchmark, or documents, nothing goes.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy.

    Null sources are a source.  Texts without words weigh nothing, and go if their
    source has none.  Rows that repeat draw apart; an empty table gives an empty
    result.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and its depth, of 64 MiB of text at most.

    Null texts have no bytes; a longer text has a shard of its own; rows that repeat
    id and text fill numbered shards.  Input columns of these names are replaced; an
    empty table gives an empty result.
    """
    return sharding.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The stages use XXH64 majorities, connected components and seeded windows, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every stage's result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
