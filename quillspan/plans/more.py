"""Registered queries over functions, modules, activity and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, ingest, modules, ranking, retrieval
from ..streaming import incremental
from .queries import ORACLE_SQL, QUERIES, query, rounded  # noqa: F401
from .standins import Tables

PATH = "'Src/' || c_mktsegment || '/x_' || c_nationkey || CASE c_custkey % 3 WHEN 0 THEN '.TS' WHEN 1 THEN '.py' ELSE '' END"


def _paths(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey", f"{PATH} as p")


@query(f"SELECT c_custkey, regexp_extract(p, '[^/]*$') AS base, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(p, '\\.([^./]+)$', 1)) AS ext FROM (SELECT c_custkey, {PATH} AS p FROM customer) c")
def path_parts(t: Tables) -> DataFrame:
    p = F.col("p")
    return _paths(t).select("c_custkey", T.basename(p).alias("base"), T.dirname(p).alias("dir"), T.extension(p).alias("ext"))


@query(f"SELECT c_custkey, CASE lower(regexp_extract(p, '\\.([^./]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' ELSE 'text' END AS language FROM (SELECT c_custkey, {PATH} AS p FROM customer) c")
def language_of_path(t: Tables) -> DataFrame:
    return _paths(t).select("c_custkey", T.language(F.col("p")).alias("language"))


@query(f"SELECT c_custkey, array_to_string(list_filter(string_split_regex(lower(p), '[/._-]+'), lambda x: x <> ''), ' ') AS tokens FROM (SELECT c_custkey, {PATH} AS p FROM customer) c")
def path_tokens(t: Tables) -> DataFrame:
    return _paths(t).select("c_custkey", F.array_join(T.path_tokens(F.col("p")), " ").alias("tokens"))


CAMEL = "upper(substr(p_brand, 1, 1)) || lower(p_type) || 'XMLNode' || p_size || '_' || replace(p_name, ' ', '-')"
WORDS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(s, '(\\p{Lu}+)(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' +'), lambda x: x <> '')"


@query(f"SELECT p_partkey, array_to_string({WORDS}, ' ') AS words, array_to_string({WORDS}, '_') AS snake FROM (SELECT p_partkey, {CAMEL} AS s FROM part) p")
def identifier_split(t: Tables) -> DataFrame:
    w = T.identifier_words(F.col("s"))
    return t.part.selectExpr("p_partkey", f"{CAMEL} as s").select("p_partkey", F.array_join(w, " ").alias("words"), F.array_join(w, "_").alias("snake"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS slice FROM documents")
def line_context(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.line_slice(F.col("text"), F.lit(2), F.lit(4))).alias("slice"))


@query("SELECT doc_id, md5(CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '... (' || (len(l) - 3) || ' more lines)' ELSE text END) AS head FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) d")
def truncated_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.truncated(F.col("text"), 3)).alias("head"))


@query("SELECT DISTINCT o_orderpriority, regexp_replace(o_orderpriority, '[^a-zA-Z0-9_-]', '_', 'g') AS branch FROM orders")
def safe_branch_names(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority", T.safe_branch(F.col("o_orderpriority")).alias("branch")).distinct()


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?(-?[0-9]+)', 1) AS INTEGER) AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, CAST(floor(epoch_us(date_trunc('day', ts)) / 1000000) + 86399 AS BIGINT) AS day_end FROM events")
def date_bounds(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.unix_seconds(ts).alias("s"), (F.unix_seconds(F.date_trunc("day", ts)) + 86399).alias("day_end"))


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("hash"))


# ---- ingest
@query("SELECT id, file_path, target_name, s.only AS to_symbol_id FROM (SELECT e.id, y.file_path, e.target_name FROM edges e JOIN symbols y ON y.id = e.from_symbol_id) c LEFT JOIN (SELECT file_path AS f, name, min(id) AS only FROM symbols GROUP BY 1, 2 HAVING count(*) = 1) s ON s.f = c.file_path AND s.name = c.target_name")
def same_file_edges(t: Tables) -> DataFrame:
    calls = t.edges.join(t.symbols.select(F.col("id").alias("from_symbol_id"), "file_path"), "from_symbol_id").select("id", "file_path", "target_name")
    return ingest.same_file_targets(calls, t.symbols)


@query("""WITH s AS (SELECT l_suppkey AS path, l_orderkey AS n FROM lineitem), m AS (SELECT path FROM s GROUP BY 1 HAVING count(*) > 600)
SELECT path, n FROM s WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT s_suppkey, -1 FROM supplier WHERE s_suppkey IN (SELECT path FROM m)""")
def chunk_limit_fallback(t: Tables) -> DataFrame:
    return ingest.fallback_to_lines(t.lineitem.selectExpr("l_suppkey as path", "l_orderkey as n"), t.supplier.selectExpr("s_suppkey as path", "-1L as n"), 600)


@query("SELECT o_shop AS attempts, late AS at, error, array_to_string(list(CAST(o_custkey AS VARCHAR) ORDER BY o_custkey), ',') AS ids FROM (SELECT CAST(o_orderkey % 3 AS INTEGER) AS o_shop, o_orderpriority AS late, o_orderstatus AS error, o_custkey FROM orders WHERE o_orderkey < 3000) o GROUP BY 1, 2, 3")
def coalesced_failures(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderkey < 3000").selectExpr("cast(o_orderkey % 3 as int) as attempts", "o_orderpriority as at", "o_orderstatus as error", "o_custkey as chunk_id")
    return ingest.coalesce_failures(rows).select("attempts", "at", "error", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query()
def split_large_chunks(t: Tables) -> DataFrame:
    return ingest.split_large(ingest.line_chunks(t.files))


@query()
def merge_small_chunks(t: Tables) -> DataFrame:
    return ingest.merge_small(ingest.line_chunks(t.files, 4))


@query()
def token_batches(t: Tables) -> DataFrame:
    return ingest.batches(t.chunks.select("file_path", F.col("chunk_id").alias("id"), (F.col("chunk_id") % 900).alias("tokens")))


# ---- ranking
@query("""SELECT query_id, o_orderkey, round(least(1.0, score / 700001 + CASE WHEN file_path = 'repo/src/7.py' THEN 0.45 WHEN file_path LIKE '%7.py' THEN 0.25 ELSE 0 END), 6) AS score FROM results""")
def identifier_promotion(t: Tables) -> DataFrame:
    bonus = F.when(F.col("file_path") == "repo/src/7.py", 0.45).when(F.col("file_path").endswith("7.py"), 0.25).otherwise(0.0)
    return rounded(t.results.select("query_id", "o_orderkey", F.least(F.lit(1.0), F.col("score") / 700001 + bonus).alias("score")), "score")


@query("SELECT id, CASE WHEN name = 'SMALL_RING_0' THEN 4.0 WHEN lower(name) = 'small_ring_0' THEN 3.6 WHEN list_sort(string_split(lower(name), '_')) = list_sort(['small', 'ring', '0']) THEN 1.6 WHEN contains(lower(name), 'small_ring_0') OR contains('small_ring_0', lower(name)) THEN 1.2 ELSE 0.0 END::DOUBLE AS strength FROM symbols")
def name_strength(t: Tables) -> DataFrame:
    return t.symbols.select("id", ranking.name_strength(F.col("name"), F.lit("SMALL_RING_0")).alias("strength"))


@query("SELECT chunk_id, file_path FROM chunks WHERE blame_committed_at >= epoch(TIMESTAMP '2023-11-20 00:00:00') AND blame_committed_at <= epoch(TIMESTAMP '2023-12-01 00:00:00') + 86399")
def temporal_filter(t: Tables) -> DataFrame:
    since, until = (F.unix_timestamp(F.lit(d), "yyyy-MM-dd") for d in ("2023-11-20", "2023-12-01"))
    at = F.col("blame_committed_at")
    return t.chunks.where((at >= since) & (at <= until + 86399)).select("chunk_id", "file_path")


@query("WITH f AS (SELECT *, node_type = 'function' AS i FROM chunks), g AS (SELECT *, bool_or(i) OVER (PARTITION BY file_path) AS fit FROM f) SELECT chunk_id, file_path FROM g WHERE i OR NOT fit")
def implementation_narrowing(t: Tables) -> DataFrame:
    return ranking.narrow(t.chunks.withColumn("fits", F.col("node_type") == "function"), ["file_path"]).select("chunk_id", "file_path")


@query()
def intent_rerank(t: Tables) -> DataFrame:
    rows = t.results.where("rank <= 40").select("query_id", F.lit("tests for src").alias("query"), F.col("o_orderkey").alias("id"), (F.col("score") / 700001).alias("score"), "rank", F.col("file_path").alias("name"), "file_path")
    return ranking.rerank(rows)


@query()
def similar_chunks(t: Tables) -> DataFrame:
    vector = t.embeddings.where("vec_id = 3").first()["embedding"]
    return retrieval.knn(t.embeddings.where("vec_id != 3"), vector, 10, "vec_id").where("score >= 0.1")


# ---- modules and activity
MODULE = "array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/')"


@query(f"SELECT {MODULE} AS module, count(*) AS members, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'method') AS methods FROM symbols GROUP BY 1")
def module_derivation(t: Tables) -> DataFrame:
    return modules.derive(t.symbols, 2)


@query(f"""WITH d AS (SELECT DISTINCT {MODULE} AS module, file_path FROM symbols), a AS (SELECT 'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || p_partkey % 9 || '.py' AS file_path, CAST(sum(p_size) AS BIGINT) AS churn, count(*) AS commits, max(p_partkey) AS latest FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT module, count(*) AS files, CAST(sum(churn) AS BIGINT) AS churn, CAST(sum(commits) AS BIGINT) AS commits, max(latest) AS latest FROM d JOIN a USING (file_path) GROUP BY 1""")
def module_activity(t: Tables) -> DataFrame:
    log = t.symbols.where("id % 2 = 0").select("file_path", ((F.col("start_line") / 10).cast("long")).alias("changed"), F.col("id").alias("at"))
    return modules.activity(t.symbols, modules.file_activity(log), 2)


@query(f"""WITH n AS (SELECT {MODULE} AS module, s.id, count(*) AS degree FROM symbols s JOIN (SELECT from_symbol_id AS id FROM edges UNION ALL SELECT to_symbol_id FROM edges WHERE to_symbol_id IS NOT NULL) e ON e.id = s.id GROUP BY 1, 2)
SELECT module, id, degree FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY degree DESC, id) AS k FROM n) x WHERE k = 1""")
def strongest_nodes(t: Tables) -> DataFrame:
    links = t.edges.select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"))
    return modules.strongest(t.symbols, links, 2)


@query()
def module_compaction(t: Tables) -> DataFrame:
    return modules.compact(modules.derive(t.symbols, 3).select("module", "members"), 18)


# ---- metrics
@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS average, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def operational_metrics(t: Tables) -> DataFrame:
    out = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.avg("value").alias("average"), F.max_by("value", "event_id").alias("last"))
    return rounded(out, "average")


@query("SELECT n_nationkey, CAST(cur - base AS DOUBLE) AS change, round(CASE WHEN base = 0 THEN CASE WHEN cur = 0 THEN 0 ELSE 100 END ELSE (cur - base) / CAST(base AS DOUBLE) * 100 END, 6) AS percent FROM (SELECT n_nationkey, n_nationkey % 4 AS base, n_nationkey % 7 AS cur FROM nation) n")
def metric_delta(t: Tables) -> DataFrame:
    change, percent = evaluation.delta((F.col("n_nationkey") % 7).cast("double"), (F.col("n_nationkey") % 4).cast("double"))
    return rounded(t.nation.select("n_nationkey", change.alias("change"), percent.alias("percent")), "percent")


@query("""WITH s AS (SELECT n_nationkey AS setting, n_nationkey % 5 / 5.0 AS hit_5, n_nationkey % 3 / 3.0 AS mrr, n_nationkey * 7 % 11 AS p95 FROM nation) SELECT setting, CAST(round(hit_5, 6) AS DOUBLE) AS hit_5, CAST(round(mrr, 6) AS DOUBLE) AS mrr FROM s ORDER BY s.hit_5 DESC, s.mrr DESC, p95, setting LIMIT 1""")
def sweep_best(t: Tables) -> DataFrame:
    s = t.nation.selectExpr("n_nationkey as setting", "n_nationkey % 5 / 5.0D as hit_5", "n_nationkey % 3 / 3.0D as mrr", "n_nationkey * 7 % 11 as p95")
    return rounded(evaluation.best_setting(s).select("setting", "hit_5", "mrr"), "hit_5", "mrr")


@query("SELECT query_id, CASE WHEN first <= 10 THEN 'none' WHEN first IS NOT NULL THEN 'ranked-low' WHEN query_id % 2 = 0 THEN 'wrong-symbol' ELSE 'not-retrieved' END AS bucket FROM (SELECT e.query_id, min(r.rank) AS first FROM expected e LEFT JOIN results r ON r.query_id = e.query_id AND (r.file_path = e.file_path OR r.file_path LIKE '%/' || e.file_path) GROUP BY 1) f")
def failure_buckets(t: Tables) -> DataFrame:
    hits = evaluation.first_hits(t.results, t.expected)
    return hits.select("query_id", evaluation.failure_bucket(F.col("first"), F.col("query_id") % 2 == 0).alias("bucket"))


@query("SELECT c_custkey AS chunk_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def removed_chunks(t: Tables) -> DataFrame:
    return incremental.removed_chunks(t.customer.selectExpr("c_custkey as chunk_id"), t.orders.selectExpr("o_custkey as chunk_id"))


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def telemetry_hourly(t: Tables) -> DataFrame:
    out = incremental.telemetry_stream(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.floor(F.unix_seconds("window.start") / 3600).alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT query_id, o_orderkey, round(score / max(score) OVER (PARTITION BY query_id), 6) AS share, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY first_seen) AS INTEGER) AS group_no FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, file_path) AS first_seen FROM results) r")
def normalised_groups(t: Tables) -> DataFrame:
    by = Window.partitionBy("query_id")
    seen = t.results.withColumn("seen", F.min("rank").over(Window.partitionBy("query_id", "file_path")))
    return rounded(seen.select("query_id", "o_orderkey", (F.col("score") / F.max("score").over(by)).alias("share"), F.dense_rank().over(by.orderBy("seen")).alias("group_no")), "share")
