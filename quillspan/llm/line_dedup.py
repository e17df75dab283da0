"""Line deduplication over a whole corpus by a deletion-neighbourhood join.

Of each set of lines within one edit (in UTF-8 bytes), the earliest stays.

1. *Equal lines* meet by their SHA-256 digest; the first place of each is kept.
2. *Variants.* Two lines one edit apart have an equal variant: the line itself
   or the line without one byte. A line of L bytes has L + 1 variants, so they
   are made only where they can meet: a line is cut into ``PARTS`` parts, and
   two lines one edit apart agree outside of one part. Lines first meet by
   hashes of all but a part, for their own length and for one byte more; a line
   then emits the variants that lack a byte of the parts that another line
   shares. Nothing is lost by that.
3. *Verification.* Lines with an equal variant are compared by edit distance;
   the later of the two goes.

The texts move once, to meet the numbers of the lines that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODES, bloom, discard, drop_clashes, fresh, materialize, mix, named, prefix_hash, range_hash

PARTS = 5
LEAST = 20


def _cuts(length: Column) -> list[Column]:
    return [F.floor(length * p / PARTS).cast("int") for p in range(PARTS + 1)]


def _part_keys(raw: Column) -> Column:
    """Hashes of all but each part, of the line and of any line that it would become by one more byte."""
    size = F.length(raw)
    keys = []
    for more in (0, 1):
        cut = _cuts(size + more)
        for p in range(PARTS):
            tail = size + more - cut[p + 1]
            keys.append(F.xxhash64(F.lit(p), size + more, F.substring(raw, F.lit(1), cut[p]), F.substring(raw, size - tail + 1, tail)))
    return F.array(*keys)


def _variants(lines: DataFrame) -> DataFrame:
    """(variant, id) of each line: itself, and without each byte of its marked parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, who = [], []
            for raw, i, marks in zip(batch.column("raw").to_pylist(), batch.column("id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                prefix, n = prefix_hash(BYTE_CODES[np.frombuffer(raw, np.uint8)]), len(raw)
                whole = mix(range_hash(prefix, np.zeros(1, np.int64), np.full(1, n)) + np.uint64(n))
                at = np.concatenate([np.arange(n * p // PARTS, n * (p + 1) // PARTS) for p in range(PARTS) if marks >> p & 1] or [np.zeros(0, np.int64)]).astype(np.int64)
                left = prefix[at]
                right = range_hash(prefix, at + 1, np.full(len(at), n))
                out.append(np.concatenate([whole, mix(left + right * _power(at) + np.uint64(n - 1))]))
                who.append(np.full(len(at) + 1, i, np.int64))
                if sum(map(len, out)) > 500_000:
                    yield pa.RecordBatch.from_pydict({"variant": np.concatenate(out).view(np.int64), "id": np.concatenate(who)})
                    out, who = [], []
            if out:
                yield pa.RecordBatch.from_pydict({"variant": np.concatenate(out).view(np.int64), "id": np.concatenate(who)})

    return lines.select("raw", "id", "parts").mapInArrow(run, "variant long, id long")


def _power(at: np.ndarray) -> np.ndarray:
    from .common import powers

    return powers(int(at.max(initial=0)) + 1)[0][at]


def near_lines(each: DataFrame) -> DataFrame:
    """Pairs of distinct lines of ``each`` (digest, raw) that are one edit apart: (digest_a, digest_b), both ways."""
    long = each.where(F.length("raw") >= LEAST - 1)
    keyed = long.select(F.xxhash64("digest").alias("id"), _part_keys(F.col("raw")).alias("keys"), "digest", "raw")
    met = keyed.select("id", F.explode("keys").alias("k")).groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b")
    met = materialize(met.select("k"), "met")
    inside = bloom(met, "k")
    some = keyed.select("id", "raw", F.posexplode("keys").alias("p", "k")).where(inside("k")).join(met, "k", "left_semi")
    mark = F.when(F.col("p") < PARTS, F.expr("shiftleft(1, p)")).otherwise(0)
    found = materialize(some.groupBy("id", "raw").agg(F.bit_or(mark).alias("parts")), "lines")
    groups = _variants(found).distinct().groupBy("variant").agg(F.collect_list("id").alias("ids"), F.count("*").alias("n")).where("n > 1")
    pairs = groups.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b").distinct()
    lines = found.select("id", "raw")
    both = pairs.join(lines.toDF("a", "raw_a"), "a").join(lines.toDF("b", "raw_b"), "b")
    near = both.where((F.length("raw_a") >= LEAST) & (F.length("raw_b") >= LEAST) & (F.abs(F.length("raw_a") - F.length("raw_b")) <= 1) & (F.levenshtein(F.col("raw_a").cast("string"), F.col("raw_b").cast("string"), 1) >= 0))
    digests = [F.unhex(F.sha2(c, 256)) for c in ("raw_a", "raw_b")]
    out = materialize(near.select(digests[0].alias("a"), digests[1].alias("b")), "near")
    discard(met, found)
    return out.union(out.select("b", "a"))


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", removed: str = "removed") -> DataFrame:
    """Every row of ``docs``, its text without lines that occur earlier or almost do, and their number in ``removed``.

    A line goes if an equal line occurs earlier, or if it has at least ``LEAST``
    bytes and the first occurrence of a line of at least ``LEAST`` bytes within
    one edit of it is earlier than its own, whether that line stays or not.
    Earlier: in a row with a smaller ``key`` (nulls last), among equal keys in
    the row whose columns hash lowest, in one row further up. Lines end at
    ``\\n``. Lines of nothing but spaces always stay. Of repeated rows, all but
    one lose all other lines. A row stays when its text becomes empty; a null
    text stays null. Lines of any length are compared whole. An empty table
    gives an empty table. An input column ``removed`` is replaced.
    """
    docs = drop_clashes(docs, removed)
    columns = docs.columns
    one, two, no, line, at, keep, lines, copy, left = (fresh(docs, s) for s in ("one", "two", "no", "line", "at", "keep", "lines", "copy", "left"))
    orderable = [named(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    docs = docs.withColumns({one: F.xxhash64(*orderable), two: F.xxhash64(F.lit(1), *orderable)})
    split = F.split(named(text), "\n", -1)

    each = docs.select(named(key).alias(at), one, two, F.posexplode(split).alias(no, line)).where(F.trim(line) != "")
    place = F.struct(F.col(at).isNull().alias("a"), F.col(at).alias("b"), F.col(one).alias("c"), F.col(two).alias("d"), F.col(no).alias("e"))
    digest = F.unhex(F.sha2(F.col(line).cast("binary"), 256))
    first = materialize(each.groupBy(digest.alias("digest")).agg(F.min(place).alias(at)), "first")
    near = near_lines(each.select(digest.alias("digest"), F.col(line).cast("binary").alias("raw")))
    later = near.join(first.toDF("a", "at_a"), "a").join(first.toDF("b", "at_b"), "b").where("at_a > at_b").select(F.col("a").alias("digest")).distinct()
    first = first.join(later, "digest", "left_anti")
    kept = first.groupBy(F.col(f"{at}.c").alias(one), F.col(f"{at}.d").alias(two)).agg(F.collect_list(f"{at}.e").alias(keep))

    none = F.array().cast("array<int>")
    joined = docs.join(kept, [one, two], "left").withColumn(copy, F.row_number().over(Window.partitionBy(one, two).orderBy(F.lit(1))))
    found = joined.withColumn(lines, split).withColumn(keep, F.when(F.col(copy) == 1, F.coalesce(F.col(keep), none)).otherwise(none))
    blank = F.filter(F.transform(F.col(lines), lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    found = found.withColumn(left, F.array_sort(F.concat(F.col(keep), blank)))
    out = F.array_join(F.transform(F.col(left), lambda i: F.get(F.col(lines), i)), "\n")
    return found.select(*[out.alias(c) if c == text else named(c) for c in columns], F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines) - F.size(left)).alias(removed))


ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM split),
firsts AS (SELECT line, doc_id, nth, left(line, 5) AS l, right(line, 5) AS r FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, nth) AS k FROM each WHERE trim(line) <> '') WHERE k = 1),
long AS (SELECT * FROM firsts WHERE strlen(line) >= {LEAST}),
pairs AS (
  SELECT a.line AS line, a.doc_id AS da, a.nth AS na, b.doc_id AS db, b.nth AS nb, b.line AS other FROM long a JOIN long b ON a.l = b.l AND a.line <> b.line
  UNION ALL
  SELECT a.line, a.doc_id, a.nth, b.doc_id, b.nth, b.line FROM long a JOIN long b ON a.r = b.r AND a.line <> b.line),
near AS (SELECT DISTINCT line FROM (SELECT * FROM pairs WHERE abs(strlen(line) - strlen(other)) <= 1 AND (db < da OR (db = da AND nb < na))) WHERE levenshtein(line, other) <= 1),
marked AS (SELECT *, trim(line) = '' OR (row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, nth) = 1 AND line NOT IN (SELECT line FROM near)) AS stays FROM each),
joined AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (stays), '') AS text, CAST(count(*) FILTER (NOT stays) AS INTEGER) AS removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN j.text END AS text, d.lang, d.source, d.n_chars, coalesce(j.removed, 0) AS removed
FROM documents d LEFT JOIN joined j USING (doc_id)
"""
