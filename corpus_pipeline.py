"""A corpus pipeline of five stages, each working on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm import stages
from loomlake.llm.util import written

STAGES = [
    ("quality rules", stages.quality),
    ("n-gram jaccard join", stages.near_duplicates),
    ("benchmark decontamination", stages.decontaminate),
    ("mixing sources to target weights", stages.mix),
    ("sharding", stages.shard),
]

#: Sharding draws its counts from a random law, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
