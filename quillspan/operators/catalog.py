"""The catalog of chunks, embeddings, symbols, edges and branch membership.

Tables are immutable: a change takes the old frame and gives the new one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower


# ---- lookups
def only(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; a semi-join, so a repeated key changes nothing."""
    return table.join(keys.select(key), key, "left_semi")


def missing(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Asked keys that the table lacks, repeats and order columns kept."""
    return asked.join(table.select(key), key, "left_anti")


def exists(table: DataFrame, condition: Column) -> DataFrame:
    """One row with one flag."""
    return table.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def chunks_by_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).orderBy("start_line", "chunk_id")


def by_name(table: DataFrame, name: str, any_case: bool = False) -> DataFrame:
    """Exact, or without regard to ASCII case."""
    return table.where(ascii_lower(F.col("name")) == ascii_lower(F.lit(name))) if any_case else table.where(F.col("name") == name)


def committed_between(chunks: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Chunk ids by commit time, bounds included; chunks without one never match."""
    at = F.col("blame_committed_at")
    keep = at.isNotNull()
    if since is not None:
        keep &= at >= since
    if until is not None:
        keep &= at <= until
    return chunks.where(keep).select("chunk_id")


def on_branch(table: DataFrame, membership: DataFrame, branch: str, key: str, member: str) -> DataFrame:
    ids = membership.where(F.col("branch") == branch).select(F.col(member).alias(key))
    return table.join(ids, key, "left_semi")


def still_referenced(ids: DataFrame, membership: DataFrame, member: str) -> DataFrame:
    """The ids, once each, that any branch still holds."""
    return ids.select(member).distinct().join(membership.select(member), member, "left_semi")


# ---- sets
def all_branches(*memberships: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [m.select("branch") for m in memberships]).distinct()


def branch_delta(membership: DataFrame, branch: str, base: str, member: str) -> DataFrame:
    """(member, change): what one branch has beyond another, and lacks."""
    own, other = (membership.where(F.col("branch") == b).select(member).distinct() for b in (branch, base))
    return own.join(other, member, "left_anti").withColumn("change", F.lit("added")).union(other.join(own, member, "left_anti").withColumn("change", F.lit("removed")))


def restricted(ids: DataFrame, *restrictions: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """Intersection in which None stands for no restriction."""
    for r in restrictions:
        if r is not None:
            ids = ids.join(r.select(key), key, "left_semi")
    return ids


# ---- changes
def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their keys.

    Of changes to one key that with the highest ``order`` counts. Columns in
    ``keep`` hold their old value where there is one.
    """
    if order:
        latest = Window.partitionBy(*keys).orderBy(F.desc(order))
        changes = changes.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth", order)
    if not keep:
        return table.join(changes, keys, "left_anti").unionByName(changes.select(*table.columns))
    old, new = table.alias("old"), changes.withColumn("_new", F.lit(True)).alias("new")
    both = old.join(new, F.expr(" and ".join(f"old.`{k}` = new.`{k}`" for k in keys)), "full")
    return both.select(*[
        (F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in keep or c in keys else F.when(F.col("new._new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))).alias(c)
        for c in table.columns
    ])


def add_members(membership: DataFrame, new: DataFrame) -> DataFrame:
    return membership.union(new.select(*membership.columns)).distinct()


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def clear_branch(membership: DataFrame, branch: str) -> DataFrame:
    return membership.where(~F.col("branch").eqNullSafe(branch))


def unresolve(edges: DataFrame, symbols: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose target is among ``symbols`` lose it."""
    gone = symbols.select(F.col(key).alias("to_symbol_id"), F.lit(True).alias("_gone")).distinct()
    joined = edges.join(gone, "to_symbol_id", "left")
    hit = F.col("_gone").isNotNull()
    return joined.select(*[F.when(~hit, F.col(c)).alias(c) if c == "to_symbol_id" else (F.col(c) & ~hit).alias(c) if c == "is_resolved" else F.col(c) for c in edges.columns])


def orphan_embeddings(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select("content_hash"), "content_hash", "left_anti")


def orphan_chunks(chunks: DataFrame, branch_chunks: DataFrame) -> DataFrame:
    return chunks.join(branch_chunks.select("chunk_id"), "chunk_id", "left_anti")


def orphan_symbols(symbols: DataFrame, branch_symbols: DataFrame) -> DataFrame:
    return symbols.join(branch_symbols.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def orphan_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return edges.join(symbols.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_anti")


def replace_branch(chunks: DataFrame, membership: DataFrame, branch: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, membership) after ``branch`` is made to hold ``ids``; chunks that no branch holds any more go."""
    now = clear_branch(membership, branch).union(ids.select(F.lit(branch), "chunk_id").distinct())
    dropped = membership.where(F.col("branch") == branch).select("chunk_id").join(now.select("chunk_id"), "chunk_id", "left_anti")
    return delete(chunks, dropped, "chunk_id"), now


def stats(chunks: DataFrame, embeddings: DataFrame, branch_chunks: DataFrame, symbols: DataFrame, edges: DataFrame, branch_symbols: DataFrame) -> DataFrame:
    """One row of six counts, as one plan."""
    parts = [
        embeddings.agg(F.count("*").alias("embeddings")), chunks.agg(F.count("*").alias("chunks")), branch_chunks.agg(F.count("*").alias("branch_chunks")),
        all_branches(branch_chunks, branch_symbols).agg(F.count("*").alias("branches")), symbols.agg(F.count("*").alias("symbols")), edges.agg(F.count("*").alias("call_edges")),
    ]
    return reduce(DataFrame.crossJoin, parts)


def index_status(stored: DataFrame, found: DataFrame) -> DataFrame:
    """One row: changed, added and removed files between (path, hash) tables, and the reason for being stale."""
    s, f = stored.select("path", F.col("hash").alias("old")), found.select("path", F.col("hash").alias("new"))
    n = s.join(f, "path", "full").agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in {"added": F.col("old").isNull(), "removed": F.col("new").isNull(), "changed": F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))}.items()])
    return n.withColumn("reason", F.when((F.col("added") != 0) | (F.col("removed") != 0), "count-mismatch").when(F.col("changed") > 0, "hash-mismatch").otherwise("fresh"))
