"""Modules: groups of symbols by path, their activity and their strongest members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def module(path: Column, depth: int) -> Column:
    return F.substring_index(path, "/", depth)


def derive(symbols: DataFrame, depth: int = 2) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("function", "functions"), ("class", "classes"), ("method", "methods"))]
    return symbols.groupBy(module(F.col("file_path"), depth).alias("module")).agg(F.count("*").alias("members"), *kinds)


def file_activity(log: DataFrame) -> DataFrame:
    """(file_path, churn, commits, latest) of a change log (file_path, changed, at)."""
    return log.groupBy("file_path").agg(F.sum("changed").alias("churn"), F.count("*").alias("commits"), F.max("at").alias("latest"))


def activity(symbols: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """File activity summed by module, each file once."""
    each = symbols.select(module(F.col("file_path"), depth).alias("module"), "file_path").distinct().join(files, "file_path")
    return each.groupBy("module").agg(F.count("*").alias("files"), F.sum("churn").alias("churn"), F.sum("commits").alias("commits"), F.max("latest").alias("latest"))


def strongest(symbols: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """The best connected symbol of each module, ties to the smallest id."""
    ends = links.select(F.col("src").alias("id")).union(links.where("dst is not null").select("dst"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree")).join(symbols.select("id", module(F.col("file_path"), depth).alias("module")), "id")
    nth = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("degree"), "id"))
    return degree.withColumn("nth", nth).where("nth = 1").select("module", "id", "degree")


def compact(modules: DataFrame, most: int = 18) -> DataFrame:
    """At most ``most`` modules (module, members) as far as parents allow: the smallest goes into its parent, again and again.

    Modules are path prefixes, a handful for each top folder; they are merged one
    by one on the driver.
    """
    spark, schema = modules.sparkSession, modules.schema
    left = {r["module"]: r["members"] for r in modules.collect()}
    while len(left) > most:
        inner = [m for m in left if "/" in m]
        if not inner:
            break
        least = min(inner, key=lambda m: (left[m], m))
        parent = least.rpartition("/")[0]
        left[parent] = left.get(parent, 0) + left.pop(least)
    return spark.createDataFrame(sorted(left.items()), schema)
