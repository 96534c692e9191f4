"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns what it keeps with the columns of documents; the last one returns the
shard table. Stages are written as Parquet and read again between.

Null and empty texts have no words and go in the first stage; null labels and
null ids are no matter: rows are told apart by id and words. An empty table
stays empty through all stages. Texts of any length are worked on whole.
Further columns come along to the last stage but one; names that begin with
``_lq_`` are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenq.llm import decontam, jaccard, mixing, quality, sharding
from lumenq.llm.shared import release, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the calibrated classifier go. Without
    labels of both kinds only the base rule counts; repeated rows get one verdict."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id;
    of rows with equal id and words one. Null ids come last."""
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; repeated rows go together."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by calibrated probabilities, rows with one id and labels alike."""
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 contiguous shards of near equal size, in id order, null ids first."""
    return sharding.shard(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("source_mix", source_mix), ("shards", shards)]
#: The quality classifier and the alignment are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        release(before)  # what the next stage has read is of no use any more
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)  # shards rest on a checkpoint of their own
    return out
