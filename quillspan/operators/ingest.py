"""From files to chunks and embedding texts."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dirname, estimated_tokens, language, matches_any

INCLUDE = [f"**/*.{e}" for e in "c cc cpp go h hpp java js jsx md mjs php py rb rs ts tsx".split()]
EXCLUDE = [f"**/{d}/**" for d in "dist node_modules target vendor".split()] + ["**/*.lock", "**/*.min.js"]


def included(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files whose path matches an include glob, no exclude glob and has no hidden or build segment."""
    path = F.col("path")
    hidden = F.exists(F.split(path, "/"), lambda s: (s.startswith(".") & (s != ".") & (s != "..")) | (F.lower(s) == "build"))
    return files.where(matches_any(path, INCLUDE if include is None else include) & ~matches_any(path, EXCLUDE if exclude is None else exclude) & ~hidden)


def smallest_per_directory(files: DataFrame, most: int = 100) -> DataFrame:
    """Every file with ``kept``: whether it is among the ``most`` smallest of its directory, ties by path."""
    nth = F.row_number().over(Window.partitionBy("dir").orderBy("size", "path"))
    return files.withColumn("dir", dirname(F.col("path"))).withColumn("kept", nth <= most)


def union_roots(*scans: DataFrame) -> DataFrame:
    """Files of several roots, each path once, from the first root that has it."""
    out = None
    for i, s in enumerate(scans):
        s = s.withColumn("_root", F.lit(i))
        out = s if out is None else out.unionByName(s)
    nth = F.row_number().over(Window.partitionBy("path").orderBy("_root"))
    return out.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_root")


def _windows(lines: Column, n: Column, size: int, step: int) -> Column:
    """(first, last) of line windows, the last being the first that reaches the end."""
    count = F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step + 1).alias("start_line"), F.least(i * step + size, n).alias("end_line"), F.array_join(F.slice(lines, i * step + 1, size), "\n").alias("content")))


def line_chunks(files: DataFrame, size: int = 30) -> DataFrame:
    """(path, start_line, end_line, content): windows of lines, overlapping by a tenth, blank ones dropped."""
    step = size - min(3, size // 4)
    body = F.regexp_replace(F.col("content"), r"\n\z", "")
    lines = F.split(body, "\n", -1)
    out = files.withColumn("_lines", lines).select("path", F.explode(_windows(F.col("_lines"), F.size("_lines"), size, step)).alias("c")).select("path", "c.*")
    return out.where(F.col("content").rlike(r"\S"))


def split_large(chunks: DataFrame, most: int = 2000, size: int = 12, step: int = 9, least: int = 50) -> DataFrame:
    """Chunks of more than ``most`` bytes cut into windows, windows under ``least`` bytes dropped."""
    large = F.octet_length("content") > most
    lines = F.split("content", "\n", -1)
    cut = chunks.where(large).withColumn("_l", lines).select("path", F.col("start_line").alias("_s"), F.explode(_windows(F.col("_l"), F.size("_l"), size, step)).alias("c"))
    cut = cut.select("path", (F.col("_s") + F.col("c.start_line") - 1).alias("start_line"), (F.col("_s") + F.col("c.end_line") - 1).alias("end_line"), "c.content").where(F.octet_length("content") >= least)
    return chunks.where(~large).select("path", "start_line", "end_line", "content").union(cut)


def coverage_sample(chunks: DataFrame, limit: int, group: str = "path", order: tuple[str, ...] = ("start_line",)) -> DataFrame:
    """At most ``limit`` rows of each group, evenly spaced from first to last; the middle one for a limit of 1."""
    w = Window.partitionBy(group)
    at, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    placed = chunks.withColumns({"_at": at, "_n": n})
    if limit == 1:
        wanted = F.col("_at") == F.floor(F.col("_n") / 2)
    else:
        # the row is wanted if it is round(i (n - 1) / (limit - 1)) for some i
        i = F.round(F.col("_at") * (limit - 1) / (F.col("_n") - 1))
        hit = lambda j: (j >= 0) & (j < limit) & (F.floor(j * (F.col("_n") - 1) / (limit - 1) + 0.5) == F.col("_at"))
        wanted = hit(i) | hit(i - 1) | hit(i + 1)
    return placed.where((F.col("_n") <= limit) | wanted).drop("_at", "_n")


HINTS = [("async", r"\basync\b|\bawait\b|promise"), ("http", r"\bhttps?\b|fetch\(|request"), ("database", r"\bselect\b|\binsert\b|query"), ("error-handling", r"\btry\b|\bcatch\b|\bexcept\b|\braise\b"), ("test", r"\bassert\b|\bexpect\(|\bdescribe\("), ("config", r"\bconfig\b|\benv\b"), ("cache", r"\bcach(e|ing)\b"), ("auth", r"\btoken\b|\bauth"), ("loop", r"\bfor\b|\bwhile\b"), ("class", r"\bclass\b"), ("export", r"\bexport\b|\bpub\b")]


#: Every match of a tag's pattern holds one of these: a plain search spares most texts the pattern.
NEEDLES = {"async": "async await promise", "http": "http fetch( request", "database": "select insert query", "error-handling": "try catch except raise", "test": "assert expect( describe(", "config": "config env", "cache": "cach", "auth": "token auth", "loop": "for while", "class": "class", "export": "export pub"}


def hint_tags(text: Column, most: int = 6) -> Column:
    """The first ``most`` tags, in order, whose pattern occurs."""
    low = F.lower(text)
    held = {t: reduce(or_, [low.contains(x) for x in words.split()]) for t, words in NEEDLES.items()}
    # joined and split again, as a lambda over the patterns would keep them from being compiled, and the text would be lowered for each
    tags = F.concat_ws(",", *[F.when(held[t] & low.rlike(p), F.lit(t)) for t, p in HINTS])
    return F.slice(F.filter(F.split(tags, ","), lambda x: x != ""), 1, most)


def embedding_text(chunks: DataFrame, most: int = 2000) -> DataFrame:
    """(path, start_line, part, parts, text): a header of language, directory and hints, then the content, in overlapping parts if long."""
    overlap = max(128, min(512, most * 15 // 100))
    n = F.greatest(F.lit(1), F.ceil((F.length("content") - overlap) / (most - overlap)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("content"), i * (most - overlap) + 1, F.lit(most)))
    head = F.concat_ws(" | ", language(F.col("path")), dirname(F.col("path")), F.array_join(hint_tags(F.col("content")), ", "))
    # the header before the parts: else it is made again from the whole content for each of them
    each = chunks.select("path", "start_line", "content", head.alias("head")).select("path", "start_line", "head", n.alias("parts"), F.posexplode(parts).alias("part", "body"))
    note = F.when(F.col("parts") > 1, F.concat(F.lit("\nPart "), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"))).otherwise("")
    return each.select("path", "start_line", F.col("part") + 1, "parts", F.concat("head", note, F.lit("\n"), "body").alias("text")).toDF("path", "start_line", "part", "parts", "text")


def pool(parts: DataFrame, key: str = "chunk_id", vector: str = "embedding", weight: str = "tokens", expected: str = "parts") -> DataFrame:
    """Weighted mean of the part vectors of each complete chunk; weights under 1 count as 1."""
    w = F.greatest(F.col(weight), F.lit(1)).cast("double")
    whole = parts.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") == F.col(expected))
    each = whole.select(key, w.alias("w"), F.posexplode(vector).alias("dim", "v")).groupBy(key, "dim").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w")).alias("v"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias(vector))


def cost_estimate(files: DataFrame, price_per_million: float, tokens_a_chunk: int = 150, chunk_bytes: int = 400) -> DataFrame:
    chunks = F.coalesce(F.sum(F.ceil(F.col("size") / chunk_bytes)), F.lit(0))
    out = files.agg(F.count("*").alias("files"), chunks.alias("chunks")).withColumn("tokens", F.col("chunks") * tokens_a_chunk)
    return out.withColumn("cost", F.round(F.col("tokens") / 1e6 * price_per_million, 6))


def dry_run(files: DataFrame) -> DataFrame:
    """Chunks and tokens that indexing would make, without writing."""
    return line_chunks(files).agg(F.count("*").alias("chunks"), F.sum(estimated_tokens(F.col("content"))).alias("tokens"))


def merge_blame(lines: DataFrame) -> DataFrame:
    """(chunk_id, sha): the commit with most lines of a chunk, ties to the latest, then to the greatest sha."""
    n = lines.groupBy("chunk_id", "sha").agg(F.count("*").alias("n"), F.max("committed_at").alias("at"))
    return n.groupBy("chunk_id").agg(F.max(F.struct("n", "at", "sha")).alias("m")).select("chunk_id", "m.sha", F.col("m.n").alias("lines"))


def _blocks(first: Column, last: Column) -> Column:
    """(level, block) of the fewest aligned blocks of 2**level lines that make up first..last, two of a level at most."""
    end = last + 1

    def of_level(level: Column) -> Column:
        lo, hi = -F.call_function("shiftright", -first, level), F.call_function("shiftright", end, level)
        left, right = (F.when((lo < hi) & (F.pmod(x, F.lit(2)) == 1), F.struct(level.alias("level"), at.alias("block"))) for x, at in ((lo, lo), (hi, hi - 1)))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.floor(F.log2((end - first).cast("double"))).cast("int") + 1)  # one more, should the logarithm be rounded down
    return F.filter(F.flatten(F.transform(levels, of_level)), lambda x: x.isNotNull())


def enclosing_symbol(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call site (site_id, file_path, line) with the narrowest symbol around it, ties to the later start, then the id.

    Symbols are cut into aligned blocks of lines, of which each keeps its best
    symbol alone; a line is in one block of each level. So a file's sites never
    meet all its symbols.
    """
    lines = F.col("start_line").cast("long"), F.col("end_line").cast("long")
    best = F.min(F.struct((lines[1] - lines[0]).alias("width"), (-lines[0]).alias("later"), F.col("id").alias("symbol_id"))).alias("best")
    spans = symbols.where("start_line <= end_line and file_path is not null").groupBy("file_path", lines[0].alias("start_line"), lines[1].alias("end_line")).agg(best)
    held = spans.select("file_path", "best", F.explode(_blocks(F.col("start_line"), F.col("end_line"))).alias("b")).groupBy("file_path", "b.level", "b.block").agg(F.min("best").alias("best"))
    highest = held.groupBy("file_path").agg(F.max("level").alias("highest"))
    asked = sites.where("line is not null").select("file_path", F.col("line").cast("long").alias("line")).distinct().join(highest, "file_path")
    at = asked.select("file_path", "line", F.explode(F.sequence(F.lit(0), F.col("highest"))).alias("level")).withColumn("block", F.call_function("shiftright", F.col("line"), F.col("level")))
    around = at.join(held, ["file_path", "level", "block"]).groupBy("file_path", "line").agg(F.min("best").alias("best"))
    out = sites.select("site_id", "file_path", F.col("line").cast("long").alias("line")).join(around, ["file_path", "line"])
    return out.groupBy("site_id").agg(F.min("best").alias("best")).select("site_id", "best.symbol_id")


def distinct_calls(calls: DataFrame, specificity: dict[str, int]) -> DataFrame:
    """Of calls at one place (file_path, name, line), that of the most specific type."""
    rank = F.create_map(*[F.lit(x) for p in specificity.items() for x in p])[F.col("call_type")]
    nth = F.row_number().over(Window.partitionBy("file_path", "name", "line").orderBy(F.desc(F.coalesce(rank, F.lit(-1))), "call_type"))
    return calls.withColumn("nth", nth).where("nth = 1").drop("nth")


def _python_symbols(content: str) -> list[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(x.name, kinds[type(x)], x.lineno, x.end_lineno) for x in ast.walk(tree) if type(x) in kinds]


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line) of the definitions in Python files; files that don't parse give none."""

    def run(batches):
        for batch in batches:
            rows = [(p, *s) for p, c in zip(batch["path"], batch["content"], strict=True) for s in _python_symbols(c or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "start_line", "end_line"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, kind string, start_line int, end_line int")


def merge_small(chunks: DataFrame, small: int = 100, most: int = 2000) -> DataFrame:
    """Touching chunks of a file folded from the top: a chunk under ``small`` bytes takes the next as long as both fit ``most``.

    Files follow one another in a task, so that none costs a call of its own.
    """
    schema = pa.schema([("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        last: list | None = None
        for batch in batches:
            out = []
            for path, first, end, content, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and last[0] == path and last[4] < small and last[4] + size <= most and last[2] + 1 >= first:
                    last[2], last[3], last[4] = max(last[2], end), last[3] + "\n" + content, last[4] + 1 + size
                    continue
                if last:
                    out.append(last)
                last = [path, first, end, content, size]
            yield batch_of(out)
        if last:
            yield batch_of([last])

    rows = chunks.select("path", "start_line", "end_line", "content", F.octet_length("content").alias("size"))
    return rows.repartition("path").sortWithinPartitions("path", "start_line", "end_line", "content").mapInArrow(fold, "path string, start_line int, end_line int, content string")


def batches(items: DataFrame, most_tokens: int = 7500, most_items: int = 64, group: str = "file_path") -> DataFrame:
    """(group, id, batch): each group's items in order of id, a new batch where the next would not fit."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        rows, batch, used, held = [], 0, 0, 0
        for key, i, n in part.sort_values("id")[[group, "id", "tokens"]].itertuples(index=False):
            if held and (used + n > most_tokens or held >= most_items):
                batch, used, held = batch + 1, 0, 0
            used, held = used + n, held + 1
            rows.append((key, i, batch))
        return pd.DataFrame(rows, columns=[group, "id", "batch"])

    return items.groupBy(group).applyInPandas(pack, f"{group} string, id long, batch int")


def same_file_targets(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (id, file_path, target_name) with the symbol of that name in the file, if it is the only one."""
    only = symbols.groupBy("file_path", F.col("name").alias("target_name")).agg(F.count("*").alias("n"), F.min("id").alias("to_symbol_id")).where("n = 1").drop("n")
    return calls.join(only, ["file_path", "target_name"], "left")


def fallback_to_lines(semantic: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """Semantic chunks of each path, or its line chunks where there are more than ``most``."""
    many = semantic.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return semantic.join(many, "path", "left_anti").unionByName(lines.join(many, "path", "left_semi"))


def coalesce_failures(records: DataFrame) -> DataFrame:
    """One record for each (attempts, at, error), with all its chunks in order."""
    return records.groupBy("attempts", "at", "error").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
