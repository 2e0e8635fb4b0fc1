"""A training-data pipeline over `documents`: each stage's result is written as Parquet and read as the next one's docs.

quality rules -> near-dedup -> benchmark decontamination -> secret scans -> packing. Documents that the
quality rules reject, all but the smallest doc_id of a group of near copies (five-word similarity of 0.8 or more), and documents that hold a benchmark
passage go; secrets are replaced in the text; what is left is packed. Near copies come from op9's links and from its
index over a wider sketch (docspark.llm.near_copies), as 64 bits cannot tell a similarity of 0.8; the sets of shingles decide.

Defined results: a null text fails the quality rules' base test and goes; rows with a null doc_id are documents like
any other, and stay behind those with an id where they are near copies; repeated rows are exact copies, of which one
stays; two texts of one doc_id stay both if they differ; ties go to the smallest doc_id, then to the least text hash;
an empty table gives an empty one. Columns beyond COLUMNS are not carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docspark.llm import common, decontaminate, near_copies, packing, quality_rules, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs.select(*COLUMNS), rules).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminated), ("secret_scans", secrets), ("packing", packed)]
#: Learned rules, 64-bit hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
