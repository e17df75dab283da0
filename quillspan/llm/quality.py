"""Document quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text. Preference pairs (a good
labelled document, a poor one) say which of two should rank higher;
P(i before j) = 1 / (1 + exp(-(s_i - s_j))), and the weights minimise the
logistic loss on feature differences. The threshold is a quantile of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, named, pieces, row_bounds, text_buffers, words

NAMES = ("log_words", "symbols", "digits", "upper", "bytes_a_word", "distinct", "repeats", "lines_a_word", "same_lines", "marks", "spaces", "top_word")
MAX_LABELLED = 20_000
PAIRS_EACH = 8
RIDGE = 1e-3
LOST = 4.0  # a good document lost counts as so many poor ones kept

_CLASS = np.full(256, 0, np.uint8)
_CLASS[[*b"#$%&*+/<=>@\\^`|~[]{}_"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[65:91] = 3
_CLASS[[*b"!?;:,.'\"()-"]] = 4
_CLASS[[*b" \t\r"]] = 5
_CLASS[10] = 6


def text_features(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text, all 0 for one without words."""
    flat, offsets = text_buffers(column)
    out = []
    for lo, hi in pieces(offsets):
        part = offsets[lo: hi + 1] - offsets[lo]
        own, n = flat[offsets[lo]: offsets[hi]], hi - lo
        hashes, row = words(own, part)
        bounds = row_bounds(row, n)
        size = np.maximum(1, np.diff(part)).astype(float)
        kinds = np.zeros((7, n))
        for k in range(1, 7):
            seen = np.concatenate([[0], np.cumsum(_CLASS[own] == k)])
            kinds[k] = seen[part[1:]] - seen[part[:-1]]
        many = np.diff(bounds).astype(float)
        again = np.concatenate([[0], np.cumsum((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])), [0]])[: len(hashes) + 1] if len(hashes) else np.zeros(1)
        f = np.zeros((n, len(NAMES)))
        for i in np.flatnonzero(many > 0):
            s, e = bounds[i], bounds[i + 1]
            _, times = np.unique(hashes[s:e], return_counts=True)
            f[i, 5], f[i, 11] = len(times) / many[i] ** 0.9, times.max() / many[i]
            f[i, 6] = (again[e - 1] - again[s]) / many[i]
            if kinds[6, i]:
                lines = own[part[i]: part[i + 1]].tobytes().split(b"\n")
                f[i, 8] = 1 - len(set(lines)) / len(lines)
        w = np.maximum(1, many)
        f[:, 0], f[:, 1], f[:, 2], f[:, 3] = np.log1p(many), kinds[1] / size, kinds[2] / size, kinds[3] / size
        f[:, 4], f[:, 7], f[:, 9], f[:, 10] = size / w, kinds[6] / w, kinds[4] / size, kinds[5] / size
        f[many == 0] = 0
        out.append(f)
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(NAMES)))
    threshold: float = -np.inf

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights


def fit_pairs(good: np.ndarray, poor: np.ndarray, seed: int = 0) -> Ranker:
    """Weights from ``PAIRS_EACH`` preference pairs for each document of either class, by Newton's method."""
    every = np.vstack([good, poor])
    model = Ranker(every.mean(axis=0), every.std(axis=0) + 1e-6)
    if not len(good) or not len(poor):
        return model
    rng = np.random.default_rng(seed)
    n = PAIRS_EACH * max(len(good), len(poor))
    i, j = np.resize(rng.permutation(len(good)), n), rng.integers(0, len(poor), n)
    d = model.expand(good)[i] - model.expand(poor)[j]
    w = model.weights
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w)), d.T @ p / n - RIDGE * w)
        w = w + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def _features(docs: DataFrame, text: str, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    narrow = docs.select(named(key).alias("doc_id"), named(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, x array<float>")


def _scored(model: Ranker):
    held = model

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(held.score(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(NAMES))), pa.float64())

    return scored


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> tuple[Ranker, DataFrame]:
    """The ranker and a table (doc_id, x) of every row's features.

    Weights are learnt from at most about ``max_labelled`` labelled rows, those
    with the lowest hashes. The threshold is a quantile of the scores of all
    labelled rows: of the levels around the share of poor ones among them, that
    with the fewest errors, where losing a good document counts ``LOST`` times.
    It does not move with the share of poor documents in ``docs``. Null labels are left out, of
    contradicting labels of one document the lower holds. Without labels of
    both classes every document is kept.
    """
    table = materialize(_features(docs, text, key), "features")
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    labelled = materialize(table.join(said, "doc_id").select("doc_id", "x", "quality"), "labelled")
    n = {r[0]: r[1] for r in labelled.groupBy("quality").count().collect()}
    total = sum(n.values())
    share = min(1.0, max_labelled / max(1, total))
    some = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("x", "quality").toArrow()
    x = np.array(some.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    good = some.column("quality").to_numpy() > 0
    model = fit_pairs(x[good], x[~good]) if len(x) else Ranker(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    if n.get(0) and len(n) > 1 and model.weights.any():
        at = n[0] / total
        scored = labelled.select(_scored(model)("x").alias("s"), "quality")
        levels = [at * (0.5 + i / 100) for i in range(101) if at * (0.5 + i / 100) < 1]
        cuts = scored.agg(F.percentile_approx("s", levels, 100_000)).first()[0]
        wrong = scored.agg(*[F.sum(F.when((F.col("quality") > 0) & (F.col("s") < c), LOST).when((F.col("quality") <= 0) & (F.col("s") >= c), 1.0).otherwise(0.0)).alias(f"w{i}") for i, c in enumerate(cuts)]).first()
        least = min(wrong)
        model.threshold = float(cuts[min(i for i, v in enumerate(wrong) if v == least)])
    discard(labelled)
    return model, table


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, keep) for every row; kept where the score is at least the threshold.

    A null or empty text has all features 0 and is scored like that. Repeated
    rows get equal scores, null keys stay, an empty table gives an empty table.
    Whole texts are read; other columns are not.
    """
    model, table = fit(docs, labels, text, key)
    return table.select(F.col("doc_id").alias(key), _scored(model)("x").alias("score")).withColumn("keep", F.col("score") >= model.threshold)


def drop_poor(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model, table = fit(docs, labels, text, key)
    discard(table)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(text_features(texts).astype(np.float32).astype(np.float64)), pa.float64())

    to = fresh(docs, "score")
    return docs.withColumn(to, scored(named(text))).where(F.col(to) >= model.threshold).drop(to)
