"""Exact deduplication with skew-safe combining.

Three stages, each comparing the full text and not just its digest:

1. *local*: the map-side half of the first aggregation leaves one row for each
   text of a partition before anything is shuffled, since all rows of a
   partition have one salt;
2. *salted*: partial winners meet by (digest, text, salt), so that a text with
   millions of copies is spread over ``salts`` tasks;
3. *global*: the at most ``salts`` winners of each text meet by (digest, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

SALTS = 16


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS, copies: str | None = None) -> DataFrame:
    """The earliest row of each distinct text, with all its columns.

    Earliest: the smallest ``key``, null keys last; among equal keys the row
    whose columns are smallest in turn, nulls first, so the result doesn't
    depend on partitioning. Nulls: rows with a null text are copies of one
    another; an empty text differs from null. Texts of any length are compared
    in full. Repeated rows leave one. An empty table gives an empty table. Extra
    columns are kept, whatever their names. ``copies`` names a column to add
    with the number of rows that the kept one stands for (an input column of
    that name is replaced; it can't be ``text`` or ``key``).
    """
    if copies is not None and copies.lower() in (text.lower(), key.lower()):
        raise ValueError("copies needs a name of its own")
    columns = [c for c in docs.columns if copies is None or c.lower() != copies.lower()]
    rest = [c for c in columns if c.lower() != text.lower()]
    kinds = dict(docs.dtypes)
    ties = [F.to_json(F.struct(named(c))) if "map<" in kinds[c] or "variant" in kinds[c] else named(c) for c in rest]
    ranked = docs.select(
        F.xxhash64(named(text)).alias("digest"),
        named(text).alias("whole"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        F.struct(named(key).isNull().alias("a"), named(key).alias("b"), *[c.alias(f"t{i}") for i, c in enumerate(ties)]).alias("rank"),
        F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"),
    )
    by_salt = ranked.groupBy("digest", "whole", "salt").agg(F.min_by(F.struct("rank", "row"), "rank").alias("win"), F.count("*").alias("n"))
    final = by_salt.groupBy("digest", "whole").agg(F.min_by("win.row", "win.rank").alias("row"), F.sum("n").alias("n"))
    out = [F.col("whole").alias(c) if c.lower() == text.lower() else F.col(f"row.c{rest.index(c)}").alias(c) for c in columns]
    return final.select(*out, *([F.col("n").alias(copies)] if copies else []))


ORACLE_SQL = """
SELECT doc_id, text, lang, source, n_chars, copies
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS nth, count(*) OVER (PARTITION BY text) AS copies FROM documents)
WHERE nth = 1
"""
