"""The corpus pipeline: documents to token shards in five stages, each by one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
to the shared folder and reads again as the next stage's input. All stages but the last return
the columns of ``documents``.

1. quality rules (5): documents that fail a rule go.
2. near-duplicates (4): one document of each group stays (5-word shingles, similarity 0.8).
3. benchmark decontamination (9): documents with a benchmark item go.
4. mixing (8): sources are brought to their target weights; a document comes once per draw.
5. token shards (7): a row per sequence, written to fixed-stride shards in training order.

SQL cannot express the sketches, the tokenizer or the permutation, so ``ORACLE_SQL`` is None; the
tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import seqwright
from seqwright.llm import decontaminate, mixing, quality_rules, setsketch, token_shards
from seqwright.llm.common import scratch, shared_path, table
from seqwright.session import remove_path

# Python workers do not have this folder on their path: ship the package by value.
cloudpickle.register_pickle_by_value(seqwright)

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.keep_one(docs, k=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.materialised(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmark_leaks),
          ("source mix", mix_sources), ("token shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. What a stage wrote on its way goes when its result is written, and
    a result when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name.replace(' ', '-')}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            remove_path(spark, before)
        before = path
    return docs
