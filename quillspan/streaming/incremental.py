"""Change detection, debouncing and running aggregates, as batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, type): add, change or unlink between snapshots (path, size, mtime_ms)."""
    b, n = before.select("path", F.struct("size", "mtime_ms").alias("old")), now.select("path", F.struct("size", "mtime_ms").alias("new"))
    kind = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "unlink").when(F.col("old") != F.col("new"), "change")
    return b.join(n, "path", "full").select("path", kind.alias("type")).where("type is not null")


def bursts(changes: DataFrame, quiet_ms: int = 1000, order: str = "seq") -> DataFrame:
    """(burst, path, type): changes (ts, path, type) up to a pause of ``quiet_ms``; the last of a path counts.

    One clock for all paths, so the pause is sought in the whole stream order: in
    an interval of time at a time, whose edges are then compared, so that no task
    sorts everything.
    """
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms")
    cut = changes.select("ts", ms, order, "path", "type").withColumn("slice", F.floor(F.col("ms") / 86_400_000))
    before = F.lag("ms").over(Window.partitionBy("slice").orderBy("ms", order))
    inside = cut.withColumn("before", before)
    edges = inside.groupBy("slice").agg(F.max("ms").alias("end"))
    carried = edges.withColumn("carried", F.lag("end").over(Window.orderBy("slice"))).select("slice", "carried")  # one row a slice
    marked = inside.join(carried, "slice").withColumn("start", (F.col("ms") - F.coalesce("before", "carried") >= quiet_ms) | F.coalesce("before", "carried").isNull())
    starts = marked.groupBy("slice").agg(F.sum(F.col("start").cast("long")).alias("k"))
    offsets = starts.withColumn("offset", F.sum("k").over(Window.orderBy("slice")) - F.col("k")).select("slice", "offset")
    nth = F.sum(F.col("start").cast("long")).over(Window.partitionBy("slice").orderBy("ms", order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("nth", nth).join(offsets, "slice").withColumn("burst", F.col("nth") + F.col("offset"))
    return numbered.groupBy("burst", "path").agg(F.max_by("type", F.struct("ms", order)).alias("type"))


def changed_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Files (path, hash) that have to be indexed: new ones and those with another hash."""
    return found.join(stored.select("path", "hash"), ["path", "hash"], "left_anti")


def removed_chunks(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.join(current.select("chunk_id"), "chunk_id", "left_anti")


def latest_failures(records: DataFrame) -> DataFrame:
    """The latest record of each chunk, with the number of attempts."""
    w = Window.partitionBy("chunk_id")
    nth = F.row_number().over(w.orderBy(F.desc("at"), F.desc("record_id")))
    return records.withColumns({"nth": nth, "attempts": F.count("*").over(w)}).where("nth = 1").drop("nth")


def branch_changes(heads: DataFrame) -> DataFrame:
    """Rows (repo, ts, branch) at which a repository's branch differs from the one before."""
    before = F.lag("branch").over(Window.partitionBy("repo").orderBy("ts", "seq"))
    return heads.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("branch")))


# ---- streams
def telemetry_stream(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts by window and type of an event stream (ts, event_type, value); state is bounded by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def burst_stream(changes: DataFrame, quiet: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """The last type of each path in each burst of a change stream: sessions of one constant key, as there is one clock."""
    sessions = changes.withWatermark("ts", late).withColumn("all", F.lit(0))
    return sessions.groupBy(F.session_window("ts", quiet), "all").agg(F.collect_list(F.struct("ts", "path", "type")).alias("c")).select("session_window", F.explode(F.map_from_entries(F.transform(F.array_distinct(F.transform("c", lambda x: x["path"])), lambda p: F.struct(p, F.element_at(F.array_sort(F.filter("c", lambda x: x["path"] == p)), -1)["type"])))).alias("path", "type"))


def upsert_stream(changes: DataFrame, target: str, keys: list[str], order: str, checkpoint: str):
    """Keeps the latest row of each key in Parquet versions ``target/v=<batch>``; a batch that is run again writes the same version."""

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.catalog import upsert

        spark = batch.sparkSession
        latest = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        if number:
            latest = upsert(spark.read.parquet(f"{target}/v={number - 1}"), latest, keys)
        latest.write.mode("overwrite").parquet(f"{target}/v={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
