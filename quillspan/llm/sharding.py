"""Reproducible global shuffle and sharding by a Feistel permutation.

Rows get dense global numbers 0..n-1 in a total order. A keyed Feistel network
over the grid ``a x b`` (``a = ceil(sqrt(n))``, ``b = ceil(n / a)``) permutes
``0..a*b-1``; positions at or beyond n walk on along their cycle until they
fall below n, which gives a permutation of 0..n-1. Shard and slot follow from
the position by arithmetic, so any row can be located, and any slot traced back
to its row, without a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_clashes, fresh, materialize

MASK = 0x7FFFFFFF
MULTIPLIERS = (747796405, 277803737, 1103515245, 1597334677)
ROUNDS = 6
SEED = 20240229
SHARDS = 64


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0..n-1; works on ints, NumPy int64 arrays and Spark columns."""

    n: int
    seed: int = SEED
    rounds: int = ROUNDS

    @property
    def a(self) -> int:
        return max(1, math.isqrt(max(self.n - 1, 0)) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.n // self.a))

    def key(self, r: int) -> int:
        return (self.seed * MULTIPLIERS[r % 4] + 0x9E3779B1 * (r + 1)) & MASK

    def mixed(self, half, r: int):
        """Round function: 31-bit arithmetic that stays below 2**62."""
        x = (half + self.key(r)) % (MASK + 1)
        x = (x * MULTIPLIERS[r % 4] + self.key(r + 1)) % (MASK + 1)
        x = x + (x - x % 32768) / 32768 if isinstance(x, Column) else x + x // 32768
        x = (x.cast("long") if isinstance(x, Column) else x) % (MASK + 1)
        return (x * MULTIPLIERS[(r + 1) % 4] + self.key(r + 2)) % (MASK + 1)

    def once(self, x):
        """One pass over 0..a*b-1."""
        left, right = (F.floor(x / self.b).cast("long"), x % self.b) if isinstance(x, Column) else (x // self.b, x % self.b)
        for r in range(self.rounds):
            if r % 2 == 0:
                left = (left + self.mixed(right, r)) % self.a
            else:
                right = (right + self.mixed(left, r)) % self.b
        return left * self.b + right

    def back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for r in reversed(range(self.rounds)):
            if r % 2 == 0:
                left = (left - self.mixed(right, r)) % self.a
            else:
                right = (right - self.mixed(left, r)) % self.b
        return left * self.b + right

    def inside(self, x: int) -> None:
        if not 0 <= x < self.n:
            raise ValueError(f"{x} is not in 0..n-1 for n = {self.n}")

    def position(self, x: int) -> int:
        self.inside(x)
        x = self.once(x)
        while x >= self.n:
            x = self.once(x)
        return x

    def row(self, position: int) -> int:
        """The row number at a position: the inverse of ``position``."""
        self.inside(position)
        x = self.back(position)
        while x >= self.n:
            x = self.back(x)
        return x

    def longest_walk(self) -> int:
        """Steps that the longest walk outside 0..n-1 takes; fewer than ``a`` (about sqrt(n)) points lie there.

        Cycles that lie wholly outside don't count: no walk from a row gets
        there. What hasn't come back after as many steps as points lies on one.
        """
        if not self.n:
            return 0
        x = np.arange(self.n, self.a * self.b, dtype=np.int64)
        longest = 0
        for step in range(1, len(x) + 1):
            before = len(x)
            x = self.once(x)
            x = x[x >= self.n]
            if len(x) < before:
                longest = step
            if not len(x):
                break
        return longest

    def walked(self, df: DataFrame, source: str, to: str) -> DataFrame:
        """``df`` with column ``to``: ``position`` of column ``source``.

        One pass, then one for each step of the longest walk, for the rows that
        are still outside. Each half round is a projection of its own: in one
        expression, the halves would be repeated some 30,000 times.
        """
        x, left, right = (fresh(df, s) for s in ("x", "left", "right"))
        df = df.withColumn(x, F.col(source))
        for step in range(1 + self.longest_walk()):
            df = df.withColumns({left: F.floor(F.col(x) / self.b).cast("long"), right: F.col(x) % self.b})
            for r in range(self.rounds):
                half, other, size = (left, right, self.a) if r % 2 == 0 else (right, left, self.b)
                df = df.withColumn(half, (F.col(half) + self.mixed(F.col(other), r)) % size)
            new = F.col(left) * self.b + F.col(right)
            df = df.withColumn(x, new if step == 0 else F.when(F.col(x) >= self.n, new).otherwise(F.col(x)))
        return df.withColumn(to, F.col(x)).drop(x, left, right)


def numbered(df: DataFrame, key: str = "doc_id", to: str = "number") -> tuple[DataFrame, int]:
    """``df`` with dense numbers 0..n-1 in column ``to``, and n.

    Order: ``key``, nulls last; among equal keys the row whose columns hash
    lowest, so only rows that are alike in every column can change places.
    Only a count for each partition goes to the driver.
    """
    df = drop_clashes(df, to)
    null, tie, part, at = (fresh(df, s) for s in ("null", "tie", "part", "at"))
    orderable = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    order = (null, f"`{key}`", tie)
    ranged = df.withColumns({null: F.col(f"`{key}`").isNull(), tie: F.xxhash64(*orderable)}).repartitionByRange(*order).sortWithinPartitions(*order).drop(null, tie)
    held = materialize(ranged.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    n, offsets = 0, []
    for p, rows in sorted(held.groupBy(part).count().collect()):
        offsets.append((p, n))
        n += rows
    starts = df.sparkSession.createDataFrame(offsets, f"`{part}` int, `{to}` long")
    return held.join(F.broadcast(starts), part).withColumn(to, F.col(to) + F.col(at)).drop(part, at), n


def shard(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row of ``df`` with its ``number``, shuffled ``position``, ``shard`` and ``slot``.

    Positions go round the shards in turn, so shard sizes differ by one at most.
    Input columns of these names are replaced. An empty table gives an empty table.
    """
    df, n = numbered(drop_clashes(df, "number", "position", "shard", "slot"), key)
    df = Feistel(n, seed).walked(df, "number", "position")
    return df.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards).cast("long")})


def place(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    slot, at = divmod(Feistel(n, seed).position(number), shards)
    return at, slot


def number_at(at: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard and slot: the inverse of ``place``."""
    return Feistel(n, seed).row(slot * shards + at)


def _oracle_sql() -> str:
    f = Feistel(0)  # the keys don't depend on n
    m = MASK + 1

    def mixed(half: str, r: int) -> str:
        once = f"((({half} + {f.key(r)}) % {m}) * {MULTIPLIERS[r % 4]} + {f.key(r + 1)}) % {m}"
        return f"(((({once}) + ({once}) // 32768) % {m}) * {MULTIPLIERS[(r + 1) % 4]} + {f.key(r + 2)}) % {m}"

    passed = "SELECT doc_id, n, a, b, steps, x // b AS l, x % b AS r FROM walk WHERE steps = 0 OR x >= n"
    for r in range(ROUNDS):
        halves = f"(l + {mixed('r', r)}) % a AS l, r" if r % 2 == 0 else f"l, (r + {mixed('l', r)}) % b AS r"
        passed = f"SELECT doc_id, n, a, b, steps, {halves} FROM ({passed})"
    return f"""
WITH RECURSIVE counted AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) - 1 AS number, count(*) OVER () AS n FROM documents),
sized AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM counted),
walk(doc_id, n, a, b, steps, x) AS (
  SELECT doc_id, n, a, (n + a - 1) // a, 0, number FROM sized
  UNION ALL
  SELECT doc_id, n, a, b, steps + 1, l * b + r FROM ({passed})
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.number, w.x AS position, CAST(w.x % {SHARDS} AS INTEGER) AS shard, w.x // {SHARDS} AS slot
FROM documents d JOIN counted c USING (doc_id) JOIN walk w USING (doc_id) WHERE w.steps > 0 AND w.x < w.n
"""


ORACLE_SQL = _oracle_sql()
