"""A corpus made ready for training, stage by stage.

Each stage takes all rows that the one before kept. It reads labels by
``doc_id`` from ``sf_dir``; where they are missing for one of the classes it keeps all
rows. Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns are treated as the operators' docstrings say; rows with a null
text stay until packing, where they take no room.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.common import materialize
from quillspan.llm.exact_dedup import exact_dedup
from quillspan.llm.jaccard import near_dedup
from quillspan.llm.packing import pack
from quillspan.llm.quality import drop_poor
from quillspan.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranking score reaches the threshold."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each text."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each group of near copies."""
    return near_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The window and place of every document that is left."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", toxicity), ("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]

#: Models, groups and greedy packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
