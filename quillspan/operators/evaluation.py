"""Retrieval quality, budgets and telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket, path_matches


def first_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, first): the rank of the first result whose path is expected, null without one. Every expected query counts."""
    r, e = results.select("query_id", "rank", "file_path"), expected.select("query_id", F.col("file_path").alias("wanted"))
    hit = r.join(e, "query_id").where(path_matches(F.col("file_path"), F.col("wanted"))).groupBy("query_id").agg(F.min("rank").alias("first"))
    return expected.select("query_id").distinct().join(hit, "query_id", "left")


def summary(hits: DataFrame) -> DataFrame:
    """One row: hit@1, 3, 5, 10 and mean reciprocal rank at 10."""
    at = [F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    return hits.agg(F.count("*").alias("queries"), *at, F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)).alias("mrr"))


def ndcg(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): graded, each piece of evidence counted at its first result only, 1 at most.

    ``expected``: query_id, file_path, relevance.
    """
    e = expected.select("query_id", F.col("file_path").alias("wanted"), "relevance")
    hit = results.where(F.col("rank") <= k).join(e, "query_id").where(path_matches(F.col("file_path"), F.col("wanted")))
    used = hit.groupBy("query_id", "wanted", "relevance").agg(F.min("rank").alias("rank"))
    gain = used.groupBy("query_id").agg(F.sum((F.pow(2.0, F.col("relevance")) - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "wanted"))
    ideal = e.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query_id").agg(F.sum((F.pow(2.0, F.col("relevance")) - 1) / F.log2(F.col("nth") + 1.0)).alias("ideal"))
    return ideal.join(gain, "query_id", "left").select("query_id", F.least(F.lit(1.0), F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0))).alias("ndcg"))


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50, p95 and p99, interpolated."""
    return rows.groupBy(*by).agg(*[F.percentile(value, p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


def nearest_rank(rows: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """The smallest value with at least that share of rows at or below it."""
    w = Window.partitionBy(*by)
    placed = rows.withColumns({"_nth": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    return placed.where(F.col("_nth") == F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).select(*by, F.col(value).alias("value"))


LATENCY = [(10, "<=10"), (50, "<=50"), (100, "<=100"), (500, "<=500")]


def histograms(events: DataFrame, dimensions: dict[str, Column], most: int = 1_000_000_000) -> DataFrame:
    """(dimension, bucket, n) of several dimensions in one pass, counts capped."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("bucket")) for k, c in dimensions.items()])
    return events.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.bucket").agg(F.least(F.count("*"), F.lit(most)).alias("n"))


def latency_bucket(value: Column) -> Column:
    return bucket(value, LATENCY, ">500")


def delta(current: Column, baseline: Column) -> tuple[Column, Column]:
    """Absolute and relative change in percent; against 0 it is 0 or 100."""
    change = current - baseline
    return change, F.when(baseline == 0, F.when(current == 0, 0.0).otherwise(100.0)).otherwise(change / baseline * 100)


def budget_violations(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, bound) of each metric of the one-row frame that is below its ``min`` or above its ``max``."""
    rows = [metrics.select(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("bound"), (F.col(m) < x if kind == "min" else F.col(m) > x).alias("bad")) for m, (kind, x) in limits.items()]
    return reduce(DataFrame.union, rows).where("bad").drop("bad")


def weighted_average(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("average"), F.percentile(value, 0.5).alias("median"))


def best_setting(sweep: DataFrame) -> DataFrame:
    """The setting with the best hit rate, then reciprocal rank, then latency."""
    return sweep.orderBy(F.desc("hit_5"), F.desc("mrr"), "p95", "setting").limit(1)


def failure_bucket(first: Column, found_file: Column, k: int = 10) -> Column:
    return F.when(first <= k, "none").when(first.isNotNull(), "ranked-low").when(found_file, "wrong-symbol").otherwise("not-retrieved")
