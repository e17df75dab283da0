"""Packing of documents into windows by lexical retrieval.

Documents lie in shards, each with an inverted index in memory. In a shard the
first unused document seeds a window; BM25 with the seed's words as the query
ranks all other unused documents, which fill the window greedily: in rank
order, each that still fits. So every document is used once.

Number of documents, average length and document frequencies are those of the
whole corpus; words are counted in 2**22 hash slots, so the statistics have one
size whatever the corpus. A shard is a few thousand documents at any scale.
Alike documents meet in one: a document goes by the word of its own that a
weighted minimum of hashes picks, rare words weighing most, and two documents
pick the same word with the probability of their weighted similarity. Neighbours
are exact within the shard; they are not sought in others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lower_texts, materialize, mix, named, pieces, row_bounds, small_batches, text_buffers, words

SLOTS = 1 << 22
WINDOW = 8192
SHARD_DOCS = 4096
K1, B = 1.2, 0.75


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, slots in order, times) of each text."""
    flat, offsets = text_buffers(lower_texts(column))
    for lo, hi in pieces(offsets):
        hashes, row = words(flat[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        bounds = row_bounds(row, hi - lo)
        slots = (hashes >> np.uint64(42)).astype(np.uint32)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(e - s), *np.unique(slots[s:e], return_counts=True)


def idf_of(df: np.ndarray, docs: int) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5))


class Idf:
    """``idf_of`` by slot from document frequencies in 32 bits, half of what all its values would take."""

    def __init__(self, df: np.ndarray, docs: int) -> None:
        self.df, self.docs = df.astype(np.uint32), docs

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        return idf_of(self.df[slots].astype(np.float64), self.docs)


def route(slots: np.ndarray, idf: np.ndarray | Idf) -> int:
    """The slot that stands for a document: the weighted minimum of hashes, -1 without words."""
    if not len(slots):
        return -1
    u = (mix(slots.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) + 1
    return int(slots[np.argmin(-np.log(u / 2.0**53) / np.maximum(idf[slots], 1e-6) ** 2)])


def weights(times: np.ndarray, length: int, average: float) -> np.ndarray:
    return times * (K1 + 1) / (times + K1 * (1 - B + B * length / max(average, 1e-9)))


def fill(lengths: list[int], slots: list[np.ndarray], times: list[np.ndarray], idf: np.ndarray | Idf, average: float, window: int) -> list[tuple[int, int, int, int, int, float | None]]:
    """(document, window, place, first word, words, score) of all parts of the documents of one shard, which are in order.

    A document longer than a window fills as many alone as it can; its rest is
    packed like a short document.
    """
    n = len(lengths)
    size = np.array(lengths, np.int64)
    rest = np.where(size > window, size % window, size)
    out, used, at = [], np.zeros(n, bool), 0
    for d in np.flatnonzero(size > window).tolist():
        for first in range(0, int(size[d] - rest[d]), window):
            out.append((d, at, 0, first, window, None))
            at += 1
        used[d] = rest[d] == 0
    every = np.concatenate([*slots, np.zeros(0, np.uint32)])
    doc = np.repeat(np.arange(n), [len(s) for s in slots])
    value = np.concatenate([*(weights(t, m, average) for t, m in zip(times, lengths, strict=True)), np.zeros(0)]) * idf[every]
    order = np.argsort(every, kind="stable")
    terms, start = np.unique(every[order], return_index=True)
    stop = np.append(start[1:], len(every))
    doc, value = doc[order], value[order]
    for seed in range(n):
        if used[seed]:
            continue
        used[seed] = True
        out.append((seed, at, 0, int(size[seed] - rest[seed]), int(rest[seed]), None))
        left, place = window - int(rest[seed]), 1
        t = np.searchsorted(terms, slots[seed])
        reach = stop[t] - start[t]
        index = np.repeat(start[t] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum()) if len(t) else np.zeros(0, np.int64)
        score = np.bincount(doc[index], value[index], minlength=n)
        free = np.flatnonzero(~used & (rest <= left))
        for d in free[np.argsort(-np.round(score[free], 6), kind="stable")].tolist():
            if rest[d] <= left:
                used[d] = True
                left -= int(rest[d])
                out.append((d, at, place, int(size[d] - rest[d]), int(rest[d]), float(score[d])))
                place += 1
        at += 1
    return out


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(key, shard, window, place, first, words, score): where each part of each row of ``docs`` lies.

    ``window`` is the number of the window in its shard, ``place`` the order in
    it, ``first`` and ``words`` the range of the document's words, ``score`` the
    BM25 score for the seed (null for seeds). Every row is placed once, whole
    unless it is longer than a window. Texts without words, null ones among them,
    take no room and are placed with 0 words. Order in a shard, for seeds and ties:
    key, nulls last, then a hash of the text; rows that repeat both are alike.
    Null keys stay null. An empty table gives an empty table. Other columns are
    not read.
    """
    if window < 1 or shard_docs < 1:
        raise ValueError("window and shard_docs must be positive")
    narrow = docs.select(named(key).alias("key"), F.xxhash64(named(text)).alias("th"), named(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    @lean
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(term_counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("th"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([s.astype("<u4").tobytes() for _, s, _ in got], pa.binary()), pa.array([t.astype("<u2" if t.max(initial=0) < 1 << 16 else "<u4").tobytes() for *_, t in got], pa.binary())],
                ["key", "th", "words", "slots", "times"],
            )

    table = materialize(narrow.mapInArrow(vectors, f"key {kind}, th long, words long, slots binary, times binary"), "vectors")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SLOTS, np.int32)  # of one task's rows
        for batch in batches:
            slots, n = np.unique(np.frombuffer(b"".join(batch.column("slots").to_pylist()), "<u4"), return_counts=True)
            df[slots] += n.astype(np.int32)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(held.astype(np.int32)), "n": pa.array(df[held].astype(np.int64))})

    many, total = table.agg(F.count("*"), F.sum("words")).first()
    with small_batches(docs.sparkSession):
        got = table.select("slots").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SLOTS, np.uint32)
    df[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    average = (total or 0) / max(1, many)
    held = docs.sparkSession.sparkContext.broadcast(Idf(df, many))

    @F.arrow_udf("int")
    @lean
    def routed(slots: pa.Array) -> pa.Array:
        return pa.array([route(np.frombuffer(s, "<u4"), held.value) for s in slots.to_pylist()], pa.int32())

    located = table.withColumn("route", routed("slots"))
    half = max(1, shard_docs // 2)
    crowded = located.groupBy("route").count().where(F.col("count") > half).withColumn("ways", F.ceil(F.col("count") / half)).select("route", "ways")
    shards = max(1, -(-many // shard_docs))
    way = F.when(F.col("ways").isNull(), 0).otherwise(F.pmod(F.xxhash64("th", "key"), F.col("ways")))
    sharded = located.join(crowded, "route", "left").withColumn("shard", F.pmod(F.xxhash64("route", way), F.lit(shards)).cast("int")).select("shard", "key", "th", "words", "slots", "times")

    @lean
    def run(part: pa.Table) -> pa.Table:
        part = part.append_column("no_key", part.column("key").is_null()).sort_by([("no_key", "ascending"), ("key", "ascending"), ("th", "ascending")])
        slots = [np.frombuffer(s, "<u4") for s in part.column("slots").to_pylist()]
        times = [np.frombuffer(t, "<u2" if len(t) == 2 * len(s) else "<u4").astype(np.float64) for t, s in zip(part.column("times").to_pylist(), slots, strict=True)]
        rows = fill(part.column("words").to_pylist(), slots, times, held.value, average, window)
        d, at, place, first, length, score = zip(*rows, strict=True) if rows else [()] * 6
        d = pa.array(d, pa.int64())
        return pa.table({"key": part.column("key").take(d), "shard": part.column("shard").take(d), "window": pa.array(at, pa.int32()), "place": pa.array(place, pa.int32()), "first": pa.array(first, pa.int64()), "words": pa.array(length, pa.int64()), "score": pa.array(score, pa.float64())})

    out = sharded.groupBy("shard").applyInArrow(run, f"key {kind}, shard int, window int, place int, first long, words long, score double")
    return out.withColumnRenamed("key", key) if key != "key" else out
