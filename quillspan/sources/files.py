"""Files, failed batches and golden datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILED = "version int, record_id string, chunks array<struct<chunk_id:string,text:string>>, error string, attempts int, at string"
GOLDEN = "version string, name string, queries array<struct<id:string,query:string,queryType:string,expected:struct<filePath:string,acceptableFiles:array<string>,symbol:string>>>"
MARKERS = ("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Gemfile", "composer.json", "setup.py", "CMakeLists.txt", "Makefile", ".git", "requirements.txt")


def read_files(spark: SparkSession, root: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, size, mtime, hash, content) of the text files below a folder; larger ones are left out before they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most_bytes)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.xxhash64("content").alias("hash"), F.decode("content", "UTF-8").alias("content"))


def has_marker(names: DataFrame) -> DataFrame:
    """One flag: whether a listing (name) holds a project's marker file."""
    return names.agg(F.coalesce(F.max(F.col("name").isin(*MARKERS)), F.lit(False)).alias("project"))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failed batches from JSON lines, malformed ones dropped, a row for each chunk."""
    rows = spark.read.schema(FAILED).option("mode", "DROPMALFORMED").json(path)
    return rows.select("record_id", "error", "attempts", "at", F.explode("chunks").alias("c")).select("record_id", "error", "attempts", "at", "c.*")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A row for each query and acceptable file of golden datasets."""
    rows = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select("name", F.explode("queries").alias("q"))
    files = F.array_distinct(F.filter(F.concat(F.array("q.expected.filePath"), F.coalesce("q.expected.acceptableFiles", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    return rows.select("name", F.col("q.id").alias("query_id"), F.col("q.query").alias("query"), F.explode(files).alias("file_path"))


def publish(df: DataFrame, target: str) -> None:
    """Write a table beside its place, then rename: readers see the old one or the new one, whole."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    staged, final, old = path(target + ".staged"), path(target), path(target + ".old")
    df.write.mode("overwrite").parquet(target + ".staged")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(final):
        fs.rename(final, old)
    fs.rename(staged, final)
    fs.delete(old, True)
