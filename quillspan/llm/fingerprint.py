"""Quartile bucket digests of documents and their nearest neighbours by digest.

Each three consecutive bytes of a text are hashed to one of 128 buckets. The
digest holds, for every bucket, in which quartile of the 128 counts its count
lies (2 bits), and a code of the text's length. The difference score is the sum
of the quartile differences plus that of the length codes; it is bounded: what
is beyond ``BOUND`` is as good as unlike.

Neighbours are found exactly: digests with a score of at most ``BOUND`` differ
in at most ``BOUND`` buckets, so of ``BOUND + 1`` segments one is equal, and
their length codes lie in one range of ``BOUND + 1`` codes or in adjacent ones.
Digests meet by (segment, its bits, range of length codes), each pair once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named, pieces, text_buffers

BUCKETS = 128
BOUND = 7
STEP = 1.1
TILE_ROWS = 100_000


def bucket_counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte triplets, a row for each text."""
    n = len(offsets) - 1
    if len(flat) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    x = flat.astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
    h = (h ^ h >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(25)
    row = np.repeat(np.arange(n), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return np.bincount((row[:-2] * BUCKETS + h)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)


def digests(column: pa.Array) -> Iterator[bytes | None]:
    """33 bytes for each text: the length code, then 2 bits a bucket. None for a text of fewer than three bytes, or null."""
    flat, offsets = text_buffers(column)
    for lo, hi in pieces(offsets):
        part = offsets[lo: hi + 1] - offsets[lo]
        counts = bucket_counts(flat[offsets[lo]: offsets[hi]], part)
        order = np.sort(counts, axis=1)
        codes = sum((counts > order[:, [BUCKETS * k // 4 - 1]]).astype(np.uint8) for k in (1, 2, 3))
        packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
        for size, body in zip(np.diff(part).tolist(), packed, strict=True):
            yield bytes([length_code(size)]) + body.tobytes() if size >= 3 else None


def length_code(size: int) -> int:
    return min(255, int(math.log(size) / math.log(STEP)))


def unary(raw: np.ndarray) -> np.ndarray:
    """Digests (n x 33) as bits in which the score is a Hamming distance: 6 words for each."""
    codes = np.stack([raw[:, 1:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(raw), BUCKETS)
    bits = np.concatenate([codes > k for k in range(3)], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


def score(a: bytes, b: bytes, bound: int = BOUND) -> int:
    """Bounded difference of two digests: ``bound + 1`` stands for anything beyond ``bound``."""
    x, y = (unary(np.frombuffer(d, np.uint8)[None, :])[0] for d in (a, b))
    return min(bound + 1, int(np.bitwise_count(x ^ y).sum()) + abs(a[0] - b[0]))


def segment_keys(raw: np.ndarray, bound: int = BOUND) -> np.ndarray:
    """(n, bound + 1) hashes of the digests' segments."""
    cuts = [32 * k // (bound + 1) for k in range(bound + 2)]
    keys = np.zeros((len(raw), bound + 1), np.uint64)
    for k in range(bound + 1):
        h = np.full(len(raw), np.uint64(k + 1))
        for j in range(cuts[k], cuts[k + 1]):
            h = (h ^ raw[:, 1 + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        keys[:, k] = h
    return keys


def _near(distinct: DataFrame, bound: int) -> DataFrame:
    """(a, b, score) of all pairs of distinct digests with a score of at most ``bound``, once."""

    span, odd = bound + 1, np.uint64(0x9E3779B97F4A7C15)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, 33)
            k = segment_keys(raw, bound)
            for longer in (0, 1):
                size = (raw[:, 0].astype(np.uint64) // np.uint64(span) + np.uint64(longer)) * odd
                for s in range(bound + 1):
                    yield pa.RecordBatch.from_arrays([pa.array((k[:, s] ^ size).view(np.int64)), pa.array(np.full(len(raw), s, np.int32)), batch.column("digest")], ["k", "s", "digest"])

    def run(part: pa.Table) -> pa.Table:
        k, s = part.column("k").to_numpy(), part.column("s").to_numpy()
        held = part.column("digest").to_pylist()
        raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 33)
        order = np.lexsort((raw[:, 0], s, k))
        k, s, raw = k[order], s[order], raw[order]
        edges = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]), [True]])) if len(k) else np.zeros(0, np.int64)
        out: list[list] = [[], [], []]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            own = raw[lo:hi]
            segments, size = segment_keys(own, bound), own[:, 0].astype(np.int64)
            # the longer one of a pair, the later here, must be of this range itself
            mine = (size // span).astype(np.uint64) * odd == k[lo:lo + 1].view(np.uint64) ^ segments[0, s[lo]]
            if not mine.any():
                continue
            bits, least = unary(own), np.searchsorted(size, size - bound)
            for j in np.flatnonzero(mine).tolist():
                at = int(least[j])
                far = np.bitwise_count(bits[at:j] ^ bits[j]).sum(axis=1, dtype=np.int64) + size[j] - size[at:j]
                for i in (at + np.flatnonzero(far <= bound)).tolist():
                    if int(np.flatnonzero(segments[i] == segments[j])[0]) == s[lo]:
                        a, b = sorted((own[i].tobytes(), own[j].tobytes()))
                        out[0].append(a)
                        out[1].append(b)
                        out[2].append(int(far[i - at]))
        return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary()), "score": pa.array(out[2], pa.int32())})

    keyed = distinct.select("digest").mapInArrow(keys, "k long, s int, digest binary")
    groups = max(12, distinct.count() * 2 * (bound + 1) // TILE_ROWS)
    return keyed.groupBy(F.pmod(F.xxhash64("k"), F.lit(groups)).alias("g")).applyInArrow(run, "a binary, b binary, score int")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", bound: int = BOUND) -> DataFrame:
    """(key, digest, matches, nearest, score) for every row.

    ``matches`` counts the other rows whose digest differs by at most ``bound``,
    whatever part of that lies in the length codes; ``nearest`` is the key of the
    best of them (by score, then by key; null keys last), ``score`` its score. Texts of
    fewer than three bytes and nulls have no digest and match nothing. Repeated
    rows match one another. An empty table gives an empty table. Whole texts are
    read, other columns are not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(digests(batch.column("text"))), pa.binary())], ["key", "digest"])

    narrow = docs.select(named(key).alias("key"), named(text).alias("text"))
    table = materialize(narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, digest binary"), "digests")
    distinct = materialize(table.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("least")), "distinct")
    near = materialize(_near(distinct, bound), "near")
    ways = near.union(near.select("b", "a", "score")).join(distinct.withColumnRenamed("digest", "b"), "b")
    best = F.min(F.struct("score", F.col("least").isNull().alias("z"), "least"))
    across = ways.groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("others"), best.alias("best"))
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("key").asc_nulls_last())
    placed = table.withColumns({"nth": F.row_number().over(order), "same": F.count("*").over(group), "first": F.first("key").over(order), "next": F.lead("key").over(order)})
    joined = placed.join(across, "digest", "left")
    alone = F.col("same") == 1
    found = joined.select(
        F.col("key").alias(key), F.hex("digest").alias("digest"),
        F.when(F.col("digest").isNull(), 0).otherwise(F.col("same") - 1 + F.coalesce("others", F.lit(0))).alias("matches"),
        F.when(F.col("digest").isNotNull(), F.when(alone, F.col("best.least")).otherwise(F.when(F.col("nth") == 1, F.col("next")).otherwise(F.col("first")))).alias("nearest"),
        F.when(F.col("digest").isNotNull(), F.when(alone, F.col("best.score")).otherwise(0)).alias("score"),
    )
    return found
