"""The operators as queries over the driver's tables, each with its SQL oracle for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprint, jaccard, line_dedup, packing, quality, sharding, toxicity, warc


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("headers", warc.as_text(F.col("headers")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), to="again")
    return out.select("doc_id", "tokens", F.size("tokens").alias("n_tokens"), F.col("again").eqNullSafe(F.col("text")).alias("exact"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), copies="copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_fingerprints, op3_line_dedup, op4_sharding, op5_warc_revisits, op6_quality, op7_toxicity, op8_bpe, op9_packing, op10_exact_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_jaccard_join": jaccard.ORACLE_SQL, "op3_line_dedup": line_dedup.ORACLE_SQL, "op4_sharding": sharding.ORACLE_SQL, "op5_warc_revisits": warc.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
