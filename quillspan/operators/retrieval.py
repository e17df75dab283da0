"""Keyword and vector search, fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import cosine, search_tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, tf): the inverted index."""
    return docs.select(F.col(key), F.explode(search_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key), F.size(search_tokens(F.col(text))).alias("dl"))


def corpus_stats(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row: number of documents, average length (100 for an empty corpus)."""
    return lengths(docs, key, text).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(100.0)).alias("avgdl"))


def document_frequency(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return postings(docs, key, text).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "id", text: str = "text", limit: int = 100) -> DataFrame:
    """(query_id, key, score, rank) for every query (query_id, query) at once.

    Query terms keep their multiplicity; scores are divided by the best of the
    query where that is above 1. The terms of the queries filter the tokens
    before anything is counted, so one shuffle carries only what can score.
    """
    asked = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    sized = docs.select(F.col(key), search_tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    stats = sized.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(100.0)).alias("avgdl"))
    terms = asked.select("term").distinct()
    tf = sized.select(key, "dl", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = asked.join(df, "term").crossJoin(stats).withColumn("w", F.col("qtf") * idf)
    scored = tf.join(weighted, "term").groupBy("query_id", key).agg(F.sum(F.col("w") * norm).alias("raw"))
    best = Window.partitionBy("query_id")
    scored = scored.withColumn("score", F.col("raw") / F.greatest(F.lit(1.0), F.max("raw").over(best)))
    return top_k(scored.select("query_id", key, "score"), ["query_id"], key, limit)


def top_k(ranked: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    """The best ``limit`` rows of each group by score, then key, with their rank."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))).where(F.col("rank") <= limit)


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """The k vectors nearest to one query by cosine. ``allowed`` restricts the keys before the search."""
    if allowed is not None:
        vectors = vectors.join(allowed, key, "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(max(0, k))


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows of doubles, their lengths): short rows are filled with zeros, nulls and vectors that hold a null have length -1."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat, at = pc.list_flatten(vectors), np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    out[np.arange(out.shape[1]) < size[:, None]] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    size = np.where(pc.is_valid(vectors).to_numpy(zero_copy_only=False), size, -1)
    size[at[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    return out, size


def _sum(products: Iterator[np.ndarray], n: int) -> np.ndarray:
    """One after the other, as SQL adds them, so that equal vectors get equal scores."""
    out = np.zeros(n)
    for p in products:
        out += p
    return out


def _best(x: np.ndarray, y: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each x, not-a-number first, ties to the least y."""
    order = np.lexsort((y, -np.nan_to_num(score, nan=2.0), x))
    x = x[order]
    kept = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[kept], y[order][kept], score[order][kept]


@np.errstate(all="ignore")
def _nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, cosine) of the k best rows of v for each row of q, ties to the first.

    A matrix product finds the rows that may be among the best; the cosines of
    these alone are then computed as SQL does.
    """
    qq, vv = _sum((x * x for x in q.T), len(q)), _sum((x * x for x in v.T), len(v))
    # without a direction the cosine is not a number, whatever the other vector: only the first k can count
    none = np.isnan(vv) | (vv == 0)
    rows = np.flatnonzero(~none | (np.cumsum(none) <= k))
    v, vv = v[rows], vv[rows]
    plain_q, plain_v = ((1e-150 < n) & (n < 1e150) for n in (qq, vv))
    none, odd = np.isnan(qq) | (qq == 0), np.flatnonzero(~plain_v)
    qn, vn = (np.where(p[:, None], m / np.sqrt(n)[:, None], 0) for m, n, p in ((q, qq, plain_q), (v, vv, plain_v)))
    wide = max(1, min(32, len(v) // (8 * k)))
    whole, step, found = len(v) // wide * wide, max(1, 4_000_000 // max(1, len(v))), []
    for at in range(0, len(q), step):
        alike = qn[at : at + step] @ vn.T
        hit = np.ones(alike.shape, bool)
        if len(v) > k:
            alike[:, odd] = -2
            # the k-th best of the groups' maxima is at most the k-th best of all; products are wrong by rounding only
            top = alike[:, :whole].reshape(len(alike), -1, wide).max(2)
            hit = alike >= np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k, None] - 1e-9
            hit[:, odd] = True
            hit[~plain_q[at : at + step]] = True
            hit[none[at : at + step], k:] = False
        a, b = np.nonzero(hit)
        scores = [np.zeros(0)]
        for i in range(0, len(a), 1_000_000):
            x, y = a[i : i + 1_000_000] + at, b[i : i + 1_000_000]
            scores.append(np.clip(_sum((n[x] * m[y] for n, m in zip(q.T, v.T, strict=True)), len(x)) / np.sqrt(qq[x] * vv[y]), -1.0, 1.0))
        found.append(_best(a + at, b, np.concatenate(scores), k))
    x, y, score = map(np.concatenate, zip(*found, strict=True))
    return x, rows[y], score


def _cell(v: pa.Table, q: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, key, score) of the k best rows of ``v``, which is in order of its keys, for each row of ``q``."""
    if not (len(v) and len(q) and k > 0):
        return
    (mv, nv), (mq, nq) = (_matrix(t["vector"].combine_chunks()) for t in (v, q))
    for d in np.unique(nq):
        asked, held = np.flatnonzero(nq == d), np.flatnonzero((nv == d) & (d >= 0))
        other = np.setdiff1d(np.arange(len(v)), held)[: max(0, k - len(held))]  # these have no cosine, and come last
        x, y = np.repeat(asked, len(other)), np.tile(other, len(asked))
        score = pa.nulls(len(x), pa.float64())
        if len(held):
            a, b, s = _nearest(mq[asked, : max(d, 1)], mv[held, : max(d, 1)], k)
            x, y = np.concatenate([asked[a], x]), np.concatenate([held[b], y])
            score = pa.concat_arrays([pa.array(s, from_pandas=False), score])
        yield from pa.table({"query_id": q["query_id"].take(pa.array(x)), "key": v["key"].take(pa.array(y)), "score": score}).to_batches(100_000)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", blocks: int = 16) -> DataFrame:
    """(query_id, key, score, rank): the k nearest of every query.

    Both sides are cut into blocks of bounded size, the vectors into ``blocks``
    at least; a task keeps k for each query of one pair of blocks before the
    pairs meet, so no side has to fit anywhere as a whole.
    """
    n = vectors.agg(F.count("*").alias("v"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("wide")).crossJoin(queries.agg(F.count("*").alias("q"))).first()
    most = max(1, min(16_384, 4_000_000 // max(1, n["wide"])))
    down, over = max(blocks, -(-n["v"] // most)), max(1, -(-n["q"] // most))

    def block(c: str, of: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(of)).cast("int")

    def every(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    key_type, id_type = vectors.schema[key].dataType, queries.schema["query_id"].dataType
    left = vectors.select(F.col(key).alias("key"), F.lit(None).cast(id_type).alias("query_id"), F.col(vector).alias("vector"), block(key, down).alias("d"), every(over).alias("o"), F.lit(False).alias("asks"))
    right = queries.select(F.lit(None).cast(key_type).alias("key"), "query_id", F.col(vector).alias("vector"), every(down).alias("d"), block("query_id", over).alias("o"), F.lit(True).alias("asks"))
    cells = left.unionByName(right).select("key", "query_id", "vector", "asks", (F.col("o") * down + F.col("d")).alias("cell")).repartitionById(down * over, F.col("cell")).sortWithinPartitions("cell", "asks", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            asks = table["asks"].to_numpy()
            first = int(np.argmax(asks)) if asks.any() else len(asks)
            return _cell(table[:first], table[first:], k)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)] if len(of) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("cell")[0].as_py() != of[a]:
                    yield from cell(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from cell(held)

    near = cells.mapInArrow(run, StructType([StructField("query_id", id_type), StructField("key", key_type), StructField("score", DoubleType())]))
    return top_k(near.select("query_id", F.col("key").alias(key), "score"), ["query_id"], key, k)


# ---- fusion
def _both(semantic: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    s, k = semantic.select(key, F.col("score").alias("s")), keyword.select(key, F.col("score").alias("k"))
    return s.join(k, key, "full")


def fuse_weighted(semantic: DataFrame, keyword: DataFrame, weight: float, key: str = "id") -> DataFrame:
    """(1 - weight) semantic + weight keyword, 0 where a list lacks the key."""
    both = _both(semantic, keyword, key)
    return both.select(key, ((1 - weight) * F.coalesce("s", F.lit(0.0)) + weight * F.coalesce("k", F.lit(0.0))).alias("score"))


def _ranked(frame: DataFrame, key: str, to: str) -> DataFrame:
    return frame.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias(to))


def fuse_reciprocal(semantic: DataFrame, keyword: DataFrame, k: int = 60, key: str = "id") -> DataFrame:
    """Reciprocal-rank fusion, scaled so that the first of both lists gets 1. The lists are top-k lists."""
    both = _ranked(semantic, key, "rs").join(_ranked(keyword, key, "rk"), key, "full")
    part = [F.coalesce(1 / (k + F.col(c)), F.lit(0.0)) for c in ("rs", "rk")]
    return both.select(key, ((part[0] + part[1]) / (2 / (k + 1))).alias("score"))


def best_of(semantic: DataFrame, keyword: DataFrame, key: str = "id") -> DataFrame:
    """Union with the higher score of each key; the keyword's counts only if strictly higher."""
    both = semantic.select(key, "score", F.lit("semantic").alias("source"), F.lit(0).alias("o")).union(keyword.select(key, "score", F.lit("keyword").alias("source"), F.lit(1).alias("o")))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "o"))
    return both.withColumn("nth", nth).where("nth = 1").select(key, "score", "source")


def merge_tiers(tiers: list[DataFrame], limit: int, key: str = "id") -> DataFrame:
    """Ranked lists one after the other, each key at its first place: (key, score, tier, rank)."""
    every = None
    for i, t in enumerate(tiers):
        t = t.select(key, "score", F.lit(i).alias("tier"))
        every = t if every is None else every.union(t)
    first = Window.partitionBy(key).orderBy("tier", F.desc("score"))
    kept = every.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    ordered = kept.orderBy("tier", F.desc("score"), key).limit(limit)
    return ordered.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), key))).select(key, "score", "tier", "rank")


def diversify(ranked: DataFrame, by: list[str], group: str = "file_path", exact: str = "exact") -> DataFrame:
    """Round robin over groups: pinned rows first in their order, then one of each group in the order in which groups appear."""
    part = [F.col(c) for c in by]
    rest = ranked.where(~F.col(exact))
    turn = F.row_number().over(Window.partitionBy(*part, group).orderBy("rank"))
    seen = F.min("rank").over(Window.partitionBy(*part, group))
    placed = ranked.where(exact).withColumns({"turn": F.lit(0), "seen": F.col("rank")}).unionByName(rest.withColumns({"turn": turn, "seen": seen}))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("turn", "seen", "rank"))).drop("turn", "seen")


def hard_filters(rows: DataFrame, ext: str | None = None, directory: str | None = None, kind: str | None = None, author: str | None = None, sha: str | None = None, since: int | None = None, until: int | None = None, min_score: float | None = None) -> DataFrame:
    """Conjunction of the filters that are given; rows without blame fail the blame filters."""
    keep: list[Column] = []
    if ext:
        keep.append(F.lower(F.col("file_path")).endswith("." + ext.lower().lstrip(".")))
    if directory:
        root = directory.strip("/")
        keep.append((F.col("file_path") == root) | F.col("file_path").startswith(root + "/"))
    if kind:
        keep.append(F.col("node_type") == kind)
    if author:
        keep.append((F.lower("blame_author") == author.lower()) | (F.lower("blame_author_email") == author.lower()))
    if sha:
        keep.append(F.lower("blame_sha").startswith(sha.lower()))
    if since is not None:
        keep.append(F.col("blame_committed_at") >= since)
    if until is not None:
        keep.append(F.col("blame_committed_at") <= until)
    if min_score is not None:
        keep.append(F.col("score") >= min_score)
    for c in keep:
        rows = rows.where(c)
    return rows


def cached_query(cache: DataFrame, query: str, now: int, ttl: int = 300, least: float = 0.85) -> DataFrame:
    """The most similar live entry of a query cache (query, at), by Jaccard of search tokens."""
    from ..functions.text import jaccard

    alike = jaccard(F.array_distinct(search_tokens(F.col("query"))), F.array_distinct(search_tokens(F.lit(query))))
    return cache.where(F.col("at") > now - ttl).withColumn("similarity", alike).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "query").limit(1)


def first_attempt(attempts: list[DataFrame]) -> DataFrame:
    """Rows of the first of several attempts that has any, with its number: a recovery ladder in one plan."""
    every = None
    for i, a in enumerate(attempts):
        a = a.withColumn("attempt", F.lit(i))
        every = a if every is None else every.unionByName(a)
    return every.withColumn("first", F.min("attempt").over(Window.partitionBy(F.lit(0)))).where("attempt = first").drop("first") if every is not None else every
