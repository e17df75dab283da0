"""Registered queries: an operator applied to the stand-in tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, evaluation, graph, ingest, ranking, retrieval
from ..streaming import incremental
from .standins import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- keyword and vector search
TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]', ' ', 'g'), ' +'), lambda x: strlen(x) > 2)"
BM25 = f"""
WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n, coalesce(avg(len(t)), 100) AS avgdl FROM d),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS term FROM asked) u GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT q.query_id, tf.doc_id, sum(q.qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM tf JOIN q USING (term) JOIN df USING (term), stats GROUP BY ALL),
scored AS (SELECT query_id, doc_id, raw / greatest(1, max(raw) OVER (PARTITION BY query_id)) AS score FROM raw)
"""


@query(BM25 + "SELECT query_id, doc_id, round(score, 6) AS score FROM scored WHERE doc_id % 2 = 0 AND score > 0.4")
def bm25_scores(t: Tables) -> DataFrame:
    docs = t.documents
    out = retrieval.bm25(docs, t.asked, "doc_id", "text", limit=1 << 30)
    return rounded(out.where("doc_id % 2 = 0 and score > 0.4").select("query_id", "doc_id", "score"), "score")


@query(BM25 + "SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) r WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return rounded(retrieval.bm25(t.documents, t.asked, "doc_id", "text", limit=10), "score")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) u GROUP BY term")
def bm25_document_frequency(t: Tables) -> DataFrame:
    return retrieval.document_frequency(t.documents, "doc_id")


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) u GROUP BY ALL")
def bm25_postings(t: Tables) -> DataFrame:
    return retrieval.postings(t.documents, "doc_id")


@query(f"SELECT count(*) AS n, round(coalesce(avg(len({TOKENS.format('text')})), 100), 6) AS avgdl FROM documents")
def bm25_df_stats(t: Tables) -> DataFrame:
    return rounded(retrieval.corpus_stats(t.documents, "doc_id"), "avgdl")


def _first_vector(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 0").first()["embedding"]


COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY {COSINE} DESC, e.vec_id LIMIT 20")
def knn_topk(t: Tables) -> DataFrame:
    return rounded(retrieval.knn(t.embeddings, _first_vector(t), 20, "vec_id"), "score")


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.label = 1 ORDER BY {COSINE} DESC, e.vec_id LIMIT 20")
def knn_filtered(t: Tables) -> DataFrame:
    allowed = t.embeddings.where("label = 1").select("vec_id")
    return rounded(retrieval.knn(t.embeddings, _first_vector(t), 20, "vec_id", allowed=allowed), "score")


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 10 = 0) q) r WHERE rank <= 5")
def knn_batch(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(retrieval.knn_batch(t.embeddings, queries, 5, "vec_id"), "score")


# ---- fusion
BOTH = "semantic s FULL JOIN keyword k ON s.id = k.id"


@query(f"SELECT coalesce(s.id, k.id) AS id, round(0.7 * coalesce(s.score, 0) + 0.3 * coalesce(k.score, 0), 6) AS score FROM {BOTH}")
def fusion_weighted(t: Tables) -> DataFrame:
    return rounded(retrieval.fuse_weighted(t.semantic, t.keyword, 0.3), "score")


@query("""WITH s AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM semantic), k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM keyword)
SELECT coalesce(s.id, k.id) AS id, round((coalesce(1 / (60 + s.r), 0) + coalesce(1 / (60 + k.r), 0)) / (2.0 / 61), 6) AS score FROM s FULL JOIN k ON s.id = k.id""")
def fusion_rrf(t: Tables) -> DataFrame:
    return rounded(retrieval.fuse_reciprocal(t.semantic, t.keyword), "score")


@query(f"SELECT coalesce(s.id, k.id) AS id, round(CASE WHEN s.id IS NULL OR k.score > s.score THEN k.score ELSE s.score END, 6) AS score, CASE WHEN s.id IS NULL OR k.score > s.score THEN 'keyword' ELSE 'semantic' END AS source FROM {BOTH}")
def union_best_score(t: Tables) -> DataFrame:
    return rounded(retrieval.best_of(t.semantic, t.keyword), "score")


@query("""WITH u AS (SELECT id, score, 0 AS tier FROM semantic WHERE score > 0.8 UNION ALL SELECT id, score, 1 FROM keyword),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, score DESC) AS nth FROM u) v WHERE nth = 1)
SELECT id, round(score, 6) AS score, tier, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY tier, score DESC, id) AS rank FROM f) r WHERE rank <= 300""")
def tiered_merge(t: Tables) -> DataFrame:
    return rounded(retrieval.merge_tiers([t.semantic.where("score > 0.8"), t.keyword], 300), "score")


@query("""WITH r AS (SELECT query_id, id, o_orderkey, rank, file_path, id % 9 = 0 AS exact FROM results),
x AS (SELECT *, CASE WHEN exact THEN 0 ELSE row_number() OVER (PARTITION BY query_id, file_path, exact ORDER BY rank) END AS turn, CASE WHEN exact THEN rank ELSE min(rank) OVER (PARTITION BY query_id, file_path, exact) END AS seen FROM r)
SELECT query_id, id, o_orderkey, rank, file_path, exact, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, seen, rank) AS INTEGER) AS place FROM x""")
def diversify_round_robin(t: Tables) -> DataFrame:
    rows = t.results.select("query_id", "id", "o_orderkey", "rank", "file_path", (F.col("id") % 9 == 0).alias("exact"))
    return retrieval.diversify(rows, ["query_id"])


@query("SELECT chunk_id, file_path FROM chunks WHERE lower(file_path) LIKE '%.ts' AND file_path LIKE 'src/building/%' AND node_type = 'function' AND (lower(blame_author) = 'author3' OR lower(blame_author_email) = 'author3') AND blame_committed_at >= 1700000000")
def hard_filters(t: Tables) -> DataFrame:
    return retrieval.hard_filters(t.chunks, ext="ts", directory="src/building", kind="function", author="AUTHOR3", since=1700000000).select("chunk_id", "file_path")


@query("SELECT chunk_id FROM chunks WHERE blame_sha LIKE 'a%' AND blame_committed_at <= 1702000000")
def hard_filters_commit(t: Tables) -> DataFrame:
    return retrieval.hard_filters(t.chunks, sha="A", until=1702000000).select("chunk_id")


@query(f"""WITH c AS (SELECT query_id, list_distinct({TOKENS.format('query')}) AS t FROM asked)
SELECT a.query_id AS a, b.query_id AS b, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS similarity FROM c a JOIN c b ON a.query_id < b.query_id""")
def jaccard_near_queries(t: Tables) -> DataFrame:
    c = t.asked.select("query_id", F.array_distinct(T.search_tokens(F.col("query"))).alias("t"))
    pairs = c.alias("x").join(c.alias("y"), F.expr("x.query_id < y.query_id"))
    return pairs.select(F.col("x.query_id").alias("a"), F.col("y.query_id").alias("b"), F.round(T.jaccard(F.col("x.t"), F.col("y.t")), 6).alias("similarity"))


@query("SELECT id, name, 1 AS attempt FROM symbols WHERE name LIKE 'small%'")
def recovery_ladder(t: Tables) -> DataFrame:
    s = t.symbols.select("id", "name")
    return retrieval.first_attempt([s.where("name = 'no such name'"), s.where("name like 'small%'"), s])


# ---- catalog
@query("SELECT vec_id FROM embeddings WHERE md5(CAST(vec_id AS VARCHAR)) NOT IN (SELECT content_hash FROM chunks WHERE chunk_id % 7 = 0)")
def missing_embeddings(t: Tables) -> DataFrame:
    return catalog.missing(t.vectors, t.chunks.where("chunk_id % 7 = 0"), "content_hash").select("vec_id")


@query("SELECT vec_id, content_hash FROM vectors WHERE content_hash IN (SELECT content_hash FROM chunks)")
def embeddings_batch(t: Tables) -> DataFrame:
    return catalog.only(t.vectors, t.chunks, "content_hash").select("vec_id", "content_hash")


@query("SELECT count(*) > 0 AS found FROM vectors WHERE content_hash = md5('7')")
def embedding_exists(t: Tables) -> DataFrame:
    return catalog.exists(t.vectors, F.col("content_hash") == F.md5(F.lit("7")))


@query("SELECT chunk_id, start_line, end_line FROM chunks WHERE file_path = 'src/building/3.ts'")
def chunks_by_file(t: Tables) -> DataFrame:
    return catalog.chunks_by_file(t.chunks, "src/building/3.ts").select("chunk_id", "start_line", "end_line")


@query("SELECT chunk_id, name FROM chunks WHERE name = 'CUSTOMER#000000002'")
def chunks_by_name(t: Tables) -> DataFrame:
    return catalog.by_name(t.chunks, "CUSTOMER#000000002").select("chunk_id", "name")


@query("SELECT chunk_id, name FROM chunks WHERE lower(name) = 'customer#000000002'")
def chunks_by_name_ci(t: Tables) -> DataFrame:
    return catalog.by_name(t.chunks, "cUsTOMER#000000002", any_case=True).select("chunk_id", "name")


@query("SELECT chunk_id FROM chunks WHERE blame_committed_at BETWEEN 1700003600 AND 1701000000")
def blame_window(t: Tables) -> DataFrame:
    return catalog.committed_between(t.chunks, 1700003600, 1701000000)


@query("SELECT chunk_id FROM chunks WHERE blame_committed_at >= 1702000000")
def blame_since(t: Tables) -> DataFrame:
    return catalog.committed_between(t.chunks, since=1702000000)


@query("SELECT id, name FROM symbols WHERE id IN (SELECT symbol_id FROM branch_symbols WHERE branch = 'dev')")
def branch_membership(t: Tables) -> DataFrame:
    return catalog.on_branch(t.symbols, t.branch_symbols, "dev", "id", "symbol_id").select("id", "name")


@query("SELECT id, file_path FROM symbols WHERE file_path IN (SELECT DISTINCT file_path FROM symbols WHERE id < 20) AND id IN (SELECT symbol_id FROM branch_symbols WHERE branch = 'main')")
def symbols_for_files(t: Tables) -> DataFrame:
    own = catalog.on_branch(t.symbols, t.branch_symbols, "main", "id", "symbol_id")
    return catalog.only(own, t.symbols.where("id < 20"), "file_path").select("id", "file_path")


@query("SELECT symbol_id, 'added' AS change FROM branch_symbols WHERE branch = 'dev' AND symbol_id NOT IN (SELECT symbol_id FROM branch_symbols WHERE branch = 'main') UNION ALL SELECT symbol_id, 'removed' FROM branch_symbols WHERE branch = 'main' AND symbol_id NOT IN (SELECT symbol_id FROM branch_symbols WHERE branch = 'dev')")
def branch_delta(t: Tables) -> DataFrame:
    return catalog.branch_delta(t.branch_symbols, "dev", "main", "symbol_id")


@query("SELECT branch FROM branch_chunks UNION SELECT branch FROM branch_symbols")
def all_branches(t: Tables) -> DataFrame:
    return catalog.all_branches(t.branch_chunks, t.branch_symbols)


@query("SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id % 2 = 0 AND chunk_id IN (SELECT chunk_id FROM branch_chunks)")
def referenced_ids(t: Tables) -> DataFrame:
    return catalog.still_referenced(t.chunks.where("chunk_id % 2 = 0"), t.branch_chunks, "chunk_id")


@query("SELECT chunk_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM branch_chunks WHERE branch = '1-URGENT') AND blame_committed_at >= 1702000000")
def restricted_ids(t: Tables) -> DataFrame:
    return catalog.restricted(t.chunks.select("chunk_id"), t.branch_chunks.where("branch = '1-URGENT'"), None, catalog.committed_between(t.chunks, since=1702000000))


@query("""SELECT (SELECT count(*) FROM vectors) AS embeddings, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM branch_chunks) AS branch_chunks, (SELECT count(*) FROM (SELECT branch FROM branch_chunks UNION SELECT branch FROM branch_symbols) b) AS branches,
(SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS call_edges""")
def catalog_stats(t: Tables) -> DataFrame:
    return catalog.stats(t.chunks, t.vectors, t.branch_chunks, t.symbols, t.edges, t.branch_symbols)


@query("""SELECT o_custkey AS k, o_orderkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) x WHERE n = 1
UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def upsert_latest(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    new = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("at"))
    return catalog.upsert(old, new, ["k"], "at")


@query("SELECT coalesce(a.c_custkey, b.k) AS k, CASE WHEN b.k IS NULL THEN 'old' ELSE 'new' END AS model, CASE WHEN a.c_custkey IS NULL THEN 'text' ELSE a.c_name END AS chunk_text FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.k")
def upsert_keeping_text(t: Tables) -> DataFrame:
    old = t.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey as k", "'old' as model", "c_name as chunk_text")
    new = t.customer.where("c_custkey % 3 = 0").selectExpr("c_custkey as k", "'new' as model", "'text' as chunk_text")
    return catalog.upsert(old, new, ["k"], keep=("chunk_text",))


@query("SELECT branch, symbol_id FROM branch_symbols UNION SELECT 'dev', id FROM symbols WHERE id % 9 = 0")
def add_to_branch(t: Tables) -> DataFrame:
    return catalog.add_members(t.branch_symbols, t.symbols.where("id % 9 = 0").select(F.lit("dev").alias("branch"), F.col("id").alias("symbol_id")))


@query("SELECT branch, symbol_id FROM branch_symbols WHERE branch <> 'dev'")
def clear_branch(t: Tables) -> DataFrame:
    return catalog.clear_branch(t.branch_symbols, "dev")


@query("SELECT chunk_id FROM chunks WHERE file_path NOT LIKE 'src/building/%'")
def delete_by_file(t: Tables) -> DataFrame:
    return catalog.delete(t.chunks, t.chunks.where("file_path like 'src/building/%'"), "file_path").select("chunk_id")


@query("SELECT id, CASE WHEN to_symbol_id % 5 = 0 THEN NULL ELSE to_symbol_id END AS to_symbol_id, coalesce(is_resolved AND NOT coalesce(to_symbol_id % 5 = 0, false), false) AS is_resolved FROM edges")
def unresolve_edges(t: Tables) -> DataFrame:
    return catalog.unresolve(t.edges, t.symbols.where("id % 5 = 0")).select("id", "to_symbol_id", "is_resolved")


@query("SELECT vec_id FROM vectors WHERE content_hash NOT IN (SELECT content_hash FROM chunks WHERE chunk_id % 2 = 0)")
def gc_orphan_embeddings(t: Tables) -> DataFrame:
    return catalog.orphan_embeddings(t.vectors, t.chunks.where("chunk_id % 2 = 0")).select("vec_id")


@query("SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM branch_chunks)")
def gc_orphan_chunks(t: Tables) -> DataFrame:
    return catalog.orphan_chunks(t.chunks, t.branch_chunks).select("chunk_id")


@query("SELECT id FROM symbols WHERE id NOT IN (SELECT symbol_id FROM branch_symbols)")
def gc_orphan_symbols(t: Tables) -> DataFrame:
    return catalog.orphan_symbols(t.symbols, t.branch_symbols).select("id")


@query("SELECT id FROM edges WHERE from_symbol_id NOT IN (SELECT id FROM symbols WHERE id % 4 = 0)")
def gc_orphan_edges(t: Tables) -> DataFrame:
    return catalog.orphan_edges(t.edges, t.symbols.where("id % 4 = 0")).select("id")


@query("""WITH now AS (SELECT branch, chunk_id FROM branch_chunks WHERE branch <> '5-LOW' UNION ALL SELECT '5-LOW', chunk_id FROM chunks WHERE chunk_id % 10 = 1)
SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM branch_chunks WHERE branch = '5-LOW' AND chunk_id NOT IN (SELECT chunk_id FROM now))""")
def replace_branch(t: Tables) -> DataFrame:
    return catalog.replace_branch(t.chunks, t.branch_chunks, "5-LOW", t.chunks.where("chunk_id % 10 = 1").select("chunk_id"))[0].select("chunk_id")


@query("""SELECT CAST(count(*) FILTER (o.p IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (n.p IS NULL) AS BIGINT) AS removed, CAST(count(*) FILTER (o.h <> n.h) AS BIGINT) AS changed, 'count-mismatch' AS reason
FROM (SELECT c_custkey AS p, c_nationkey AS h FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS p, c_nationkey % 20 AS h FROM customer WHERE c_custkey % 5 <> 0) n ON o.p = n.p""")
def index_status(t: Tables) -> DataFrame:
    stored = t.customer.where("c_custkey % 3 <> 0").selectExpr("c_custkey as path", "c_nationkey as hash")
    return catalog.index_status(stored, t.customer.where("c_custkey % 5 <> 0").selectExpr("c_custkey as path", "c_nationkey % 20 as hash"))


# ---- call graph
OWN = "own AS (SELECT * FROM symbols WHERE id IN (SELECT symbol_id FROM branch_symbols WHERE branch = 'main'))"
LINKS = f"""{OWN}, uniq AS (SELECT lower(name) AS k, min(id) AS by_name FROM own GROUP BY 1 HAVING count(*) = 1),
links AS (SELECT e.id, e.from_symbol_id AS src, coalesce(o.id, u.by_name) AS dst, e.call_type FROM edges e JOIN own s ON s.id = e.from_symbol_id LEFT JOIN own o ON o.id = e.to_symbol_id LEFT JOIN uniq u ON u.k = lower(e.target_name))"""


def _links(t: Tables) -> DataFrame:
    return graph.resolved(t.edges, t.symbols, t.branch_symbols, "main")


@query(f"WITH {OWN} SELECT e.id, s.name AS caller, s.file_path AS caller_path FROM edges e JOIN own s ON s.id = e.from_symbol_id WHERE e.target_name LIKE 'SMALL%' AND CASE WHEN s.language IN ('apex', 'php') THEN lower(e.target_name) = 'small_ring_0' ELSE e.target_name = 'SMALL_RING_0' END")
def callers_context(t: Tables) -> DataFrame:
    return graph.callers(t.edges, t.symbols, t.branch_symbols, "SMALL_RING_0", "main").where("target_name like 'SMALL%'").select("id", "caller", "caller_path")


@query(f"WITH {OWN} SELECT e.id, e.call_type FROM edges e JOIN own s ON s.id = e.from_symbol_id WHERE e.call_type = 'Call' AND CASE WHEN s.language IN ('apex', 'php') THEN lower(e.target_name) = 'red_widget_1' ELSE e.target_name = 'red_widget_1' END")
def callers(t: Tables) -> DataFrame:
    return graph.callers(t.edges, t.symbols, t.branch_symbols, "red_widget_1", "main", "Call").select("id", "call_type")


@query("SELECT id, target_name, to_symbol_id, call_type FROM edges WHERE from_symbol_id = 13 AND from_symbol_id IN (SELECT symbol_id FROM branch_symbols WHERE branch = 'main')")
def callees(t: Tables) -> DataFrame:
    return graph.callees(t.edges, t.branch_symbols, 13, "main").select("id", "target_name", "to_symbol_id", "call_type")


@query(f"WITH {LINKS} SELECT id, src, dst, call_type FROM links")
def resolved_edges(t: Tables) -> DataFrame:
    return _links(t)


@query(f"WITH {LINKS} SELECT id, src FROM links WHERE dst = 20")
def callers_of_symbol(t: Tables) -> DataFrame:
    return graph.callers_of_symbol(t.edges, t.symbols, t.branch_symbols, 20, "main").select("id", "src")


@query(f"WITH {LINKS} SELECT o.id, coalesce(i.n, 0) AS callers, coalesce(u.n, 0) AS callees, coalesce(i.n, 0) + coalesce(u.n, 0) AS total FROM own o LEFT JOIN (SELECT dst, count(*) AS n FROM links WHERE dst IS NOT NULL GROUP BY 1) i ON i.dst = o.id LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY 1) u ON u.src = o.id")
def centrality(t: Tables) -> DataFrame:
    return graph.centrality(t.edges, t.symbols, t.branch_symbols, "main")


def _reach_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {LINKS}, step AS (SELECT DISTINCT {a} AS a, {b} AS b FROM links WHERE dst IS NOT NULL), walk AS (SELECT id, 0 AS depth FROM symbols WHERE id IN (1, 2, 3) UNION SELECT s.b, w.depth + 1 FROM walk w JOIN step s ON s.a = w.id WHERE w.depth < 4)
SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0"""


@query(_reach_sql("src", "dst"))
def reachability(t: Tables) -> DataFrame:
    return graph.reach(_links(t), t.symbols.where("id in (1, 2, 3)").select("id"), "callees", 4)


@query(_reach_sql("dst", "src"))
def reachability_callers(t: Tables) -> DataFrame:
    return graph.reach(_links(t), t.symbols.where("id in (1, 2, 3)").select("id"), "callers", 4)


@query(f"""WITH RECURSIVE {LINKS}, step AS (SELECT DISTINCT src AS a, dst AS b FROM links WHERE dst IS NOT NULL), goal AS (SELECT max(b) AS g FROM step WHERE a = (SELECT max(b) FROM step WHERE a = (SELECT min(a) FROM step))),
walk AS (SELECT min(a) AS id, 0 AS depth FROM step UNION SELECT s.b, w.depth + 1 FROM walk w JOIN step s ON s.a = w.id WHERE w.depth < 4)
SELECT CAST(coalesce(min(depth), -1) AS INTEGER) AS length FROM walk, goal WHERE id = g""")
def shortest_path_len(t: Tables) -> DataFrame:
    links = graph.cut(_links(t), "links")
    step = links.where("dst is not null")
    start = step.agg(F.min("src")).first()[0]
    middle = step.where(F.col("src") == start).agg(F.max("dst")).first()[0]
    goal = step.where(F.col("src") == middle).agg(F.max("dst")).first()[0]
    path = graph.shortest_path(links, start, goal if goal is not None else -1, 4)
    return path.agg(F.coalesce(F.max("step"), F.lit(-1)).alias("length"))


@query(f"""WITH RECURSIVE {LINKS}, e AS (SELECT DISTINCT src, dst FROM links WHERE dst IS NOT NULL AND src <> dst), ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
walk AS (SELECT DISTINCT src AS id, src AS root FROM ways UNION SELECT w.dst, k.root FROM walk k JOIN ways w ON w.src = k.id WHERE k.root < w.dst)
SELECT id, min(root) AS component FROM walk GROUP BY id""")
def connected_components(t: Tables) -> DataFrame:
    return graph.components(_links(t))


@query()
def communities(t: Tables) -> DataFrame:
    return graph.communities(_links(t))


LABELS = "labels AS (SELECT id, id % 7 AS label FROM own)"


def _labels(t: Tables) -> DataFrame:
    return catalog.on_branch(t.symbols, t.branch_symbols, "main", "id", "symbol_id").select("id", (F.col("id") % 7).alias("label"))


@query(f"""WITH {LINKS}, {LABELS}, x AS (SELECT DISTINCT l.src, l.dst, a.label AS la, b.label AS lb FROM links l JOIN labels a ON a.id = l.src JOIN labels b ON b.id = l.dst WHERE a.label <> b.label)
SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS coupling, array_to_string(list_slice(list(src || '>' || dst ORDER BY src, dst), 1, 5), ',') AS examples FROM x GROUP BY 1, 2""")
def couplings_given_labels(t: Tables) -> DataFrame:
    return graph.couplings(_links(t), _labels(t))


HUBS = f"""WITH {LINKS}, {LABELS}, w AS (SELECT src, dst FROM links WHERE dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM links WHERE dst IS NOT NULL AND src <> dst),
hubs AS (SELECT w.src AS id, count(*) AS neighbours FROM w JOIN labels a ON a.id = w.src JOIN labels b ON b.id = w.dst WHERE a.label <> b.label GROUP BY 1 HAVING count(*) >= 2)"""


@query(HUBS + " SELECT id, neighbours FROM hubs")
def hubs(t: Tables) -> DataFrame:
    return graph.hubs(_links(t), _labels(t))


@query(f"WITH {OWN}, {LABELS} SELECT label, count(*) AS members, min(id) AS first FROM labels GROUP BY 1 HAVING count(*) >= 2")
def community_summary(t: Tables) -> DataFrame:
    return graph.community_summary(_labels(t))


@query(f"""WITH {LINKS}, m AS (SELECT id, array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') AS m FROM symbols)
SELECT a.m AS source, b.m AS target, count(*) AS weight, count(*) FILTER (call_type = 'Call') AS calls, count(*) FILTER (call_type = 'MethodCall') AS methods FROM links l JOIN m a ON a.id = l.src JOIN m b ON b.id = l.dst WHERE a.m <> b.m GROUP BY 1, 2""")
def module_edges(t: Tables) -> DataFrame:
    return graph.module_edges(_links(t), t.symbols)


@query(f"""WITH {LINKS}, i AS (SELECT id FROM symbols WHERE file_path LIKE 'src/economy/%'), k AS (SELECT src, dst FROM links WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i))
SELECT id, count(*) AS degree FROM (SELECT src AS id FROM k UNION ALL SELECT dst FROM k) u GROUP BY 1 ORDER BY degree DESC, id LIMIT 50""")
def visualization_subgraph(t: Tables) -> DataFrame:
    return graph.subgraph(_links(t), t.symbols, "src/economy", 50)


@query(HUBS.replace("WITH", "WITH RECURSIVE", 1) + """, direct AS (SELECT id FROM own WHERE file_path IN (SELECT DISTINCT file_path FROM symbols WHERE id < 3)), step AS (SELECT DISTINCT dst AS a, src AS b FROM links WHERE dst IS NOT NULL),
walk AS (SELECT id, 0 AS depth FROM direct UNION SELECT s.b, w.depth + 1 FROM walk w JOIN step s ON s.a = w.id WHERE w.depth < 2), every AS (SELECT DISTINCT id FROM walk),
n AS (SELECT (SELECT count(*) FROM direct) AS direct, (SELECT count(*) FROM every WHERE id NOT IN (SELECT id FROM direct)) AS reached, (SELECT count(*) FROM hubs WHERE id IN (SELECT id FROM every)) AS hubs)
SELECT direct, reached, hubs, CASE WHEN direct + reached < 5 AND hubs = 0 THEN 'LOW' WHEN direct + reached > 20 OR hubs > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM n""")
def pr_impact_risk(t: Tables) -> DataFrame:
    own = graph.on_branch(t.symbols, t.branch_symbols, "main")
    changed = t.symbols.where("id < 3").select(F.col("file_path").alias("path")).distinct()
    return graph.impact(_links(t), own, changed, _labels(t), 2)


@query("""WITH h AS (SELECT * FROM symbols WHERE name LIKE 'small%' AND name = (SELECT min(name) FROM symbols WHERE name LIKE 'small%'))
SELECT id, file_path, start_line, CASE WHEN (SELECT count(*) FROM h) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM h ORDER BY file_path, start_line, id LIMIT 5""")
def resolve_symbol(t: Tables) -> DataFrame:
    name = t.symbols.where("name like 'small%'").agg(F.min("name")).first()[0]
    return graph.resolve_symbol(t.symbols, name or "")


# ---- ingest
@query("SELECT path FROM files WHERE path NOT LIKE '%/.cache/%' AND path NOT LIKE '%/dist/%' AND path NOT LIKE '%.lock'")
def glob_filter(t: Tables) -> DataFrame:
    return ingest.included(t.files).select("path")


@query("SELECT path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY size, path) <= 5 AS kept FROM files")
def top_n_per_dir(t: Tables) -> DataFrame:
    return ingest.smallest_per_directory(t.files, 5).select("path", "kept")


@query("SELECT path, size FROM files")
def union_roots(t: Tables) -> DataFrame:
    f = t.files.select("path", "size")
    return ingest.union_roots(f.where("size % 2 = 0"), f)


WINDOWS = """WITH b AS (SELECT path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS l FROM files), w AS (SELECT path, l, len(l) AS n, unnest(range(CAST(greatest(1, ceil((len(l) - 30) / 27.0) + 1) AS BIGINT))) AS i FROM b),
c AS (SELECT path, CAST(i * 27 + 1 AS INTEGER) AS start_line, CAST(least(i * 27 + 30, n) AS INTEGER) AS end_line, array_to_string(l[i * 27 + 1:i * 27 + 30], chr(10)) AS content FROM w)"""


@query(WINDOWS + " SELECT path, start_line, end_line, md5(content) AS hash FROM c WHERE trim(regexp_replace(content, '\\s', ' ', 'g')) <> ''")
def line_chunks(t: Tables) -> DataFrame:
    return ingest.line_chunks(t.files).select("path", "start_line", "end_line", F.md5("content").alias("hash"))


@query(WINDOWS + " SELECT count(*) AS chunks, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens FROM c WHERE trim(regexp_replace(content, '\\s', ' ', 'g')) <> ''")
def dry_run(t: Tables) -> DataFrame:
    return ingest.dry_run(t.files)


@query("""WITH x AS (SELECT chunk_id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) - 1 AS a, count(*) OVER (PARTITION BY file_path) AS n FROM chunks)
SELECT chunk_id, file_path FROM x WHERE n <= 7 OR a IN (SELECT CAST(floor(i * (x.n - 1) / 6.0 + 0.5) AS BIGINT) FROM range(7) t(i))""")
def coverage_sample(t: Tables) -> DataFrame:
    return ingest.coverage_sample(t.chunks, 7, "file_path", ("start_line", "chunk_id")).select("chunk_id", "file_path")


HINT = "list_slice(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(content), '{p}') THEN '{h}' END" for h, p in ingest.HINTS) + "], lambda x: x IS NOT NULL), 1, 6)"


@query(f"SELECT path, array_to_string({HINT}, ',') AS hints FROM files")
def hint_tags(t: Tables) -> DataFrame:
    return t.files.select("path", F.array_join(ingest.hint_tags(F.col("content")), ",").alias("hints"))


@query("SELECT count(*) AS files, CAST(sum(ceil(size / 400.0)) AS BIGINT) AS chunks, CAST(sum(ceil(size / 400.0)) AS BIGINT) * 150 AS tokens, round(CAST(sum(ceil(size / 400.0)) AS BIGINT) * 150 / 1e6 * 0.02, 6) AS cost FROM files")
def cost_estimate(t: Tables) -> DataFrame:
    return ingest.cost_estimate(t.files, 0.02)


@query("""WITH b AS (SELECT l_orderkey AS chunk_id, l_suppkey AS sha, count(*) AS n, max(l_partkey) AS late FROM lineitem GROUP BY 1, 2)
SELECT chunk_id, sha, n AS lines FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, late DESC, sha DESC) AS k FROM b) x WHERE k = 1""")
def blame_mode(t: Tables) -> DataFrame:
    return ingest.merge_blame(t.lineitem.selectExpr("l_orderkey as chunk_id", "l_suppkey as sha", "l_partkey as committed_at"))


@query("""SELECT site_id, symbol_id FROM (SELECT c.chunk_id AS site_id, s.id AS symbol_id, row_number() OVER (PARTITION BY c.chunk_id ORDER BY s.end_line - s.start_line, s.start_line DESC, s.id) AS k
FROM (SELECT c_custkey AS chunk_id, 'src/economy/brand' || c_nationkey || '/' || c_custkey % 9 || '.py' AS file_path, c_custkey % 500 AS line FROM customer) c JOIN symbols s ON s.file_path = c.file_path AND c.line BETWEEN s.start_line AND s.end_line) x WHERE k = 1""")
def enclosing_symbol(t: Tables) -> DataFrame:
    sites = t.customer.selectExpr("c_custkey as site_id", "concat('src/economy/brand', c_nationkey, '/', c_custkey % 9, '.py') as file_path", "c_custkey % 500 as line")
    return ingest.enclosing_symbol(sites, t.symbols)


@query("SELECT file_path, name, line, call_type FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name, line ORDER BY CASE call_type WHEN 'Constructor' THEN 2 WHEN 'MethodCall' THEN 1 ELSE 0 END DESC, call_type) AS k FROM (SELECT l_suppkey AS file_path, l_returnflag AS name, l_linenumber AS line, CASE l_partkey % 3 WHEN 0 THEN 'Call' WHEN 1 THEN 'MethodCall' ELSE 'Constructor' END AS call_type FROM lineitem) c) x WHERE k = 1")
def distinct_calls(t: Tables) -> DataFrame:
    calls = t.lineitem.selectExpr("l_suppkey as file_path", "l_returnflag as name", "l_linenumber as line", "case l_partkey % 3 when 0 then 'Call' when 1 then 'MethodCall' else 'Constructor' end as call_type")
    return ingest.distinct_calls(calls, {"Call": 0, "MethodCall": 1, "Constructor": 2})


@query("SELECT label AS chunk_id, d AS dim, round(sum(v * greatest(w, 1)) / sum(greatest(w, 1)), 5) AS v FROM (SELECT label, vec_id % 5 AS w, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS d FROM embeddings) e GROUP BY 1, 2")
def embed_pool(t: Tables) -> DataFrame:
    parts = t.embeddings.join(t.embeddings.groupBy("label").agg(F.count("*").alias("parts")), "label").selectExpr("label as chunk_id", "embedding", "vec_id % 5 as tokens", "parts")
    return ingest.pool(parts).select("chunk_id", F.posexplode("embedding").alias("dim", "v")).select("chunk_id", F.col("dim").cast("long").alias("dim"), F.round("v", 5).alias("v"))


@query()
def embedding_text(t: Tables) -> DataFrame:
    return ingest.embedding_text(ingest.line_chunks(t.files))


@query()
def parse_symbols(t: Tables) -> DataFrame:
    code = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("(x):\n    return x\n\nclass C:\n    def g(self):\n        pass\n"))
    return ingest.python_symbols(t.files.select("path", code.alias("content")))


# ---- ranking
def _case(rules: list[tuple[str, str]], column: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"


@query(f"SELECT path, {_case(ranking.PATHS, 'path', 'implementation')} AS class FROM files")
def path_classifiers(t: Tables) -> DataFrame:
    return t.files.select("path", ranking.path_class(F.col("path")).alias("class"))


ASK = "CASE {k} % 5 WHEN 0 THEN 'Where is ' WHEN 1 THEN 'who calls ' WHEN 2 THEN 'tests for ' WHEN 3 THEN 'how does it fail: ' ELSE '' END"


@query(f"SELECT p_partkey, {_case(ranking.INTENTS, ASK.format(k='p_partkey') + ' || p_name', 'implementation')} AS intent FROM part")
def intent_cascade(t: Tables) -> DataFrame:
    asked = F.expr(f"concat({ASK.format(k='p_partkey')}, p_name)")
    return t.part.select("p_partkey", ranking.intent(asked).alias("intent"))


@query("SELECT query_id, o_orderkey, used FROM (SELECT *, CAST(sum(id % 40) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM results) x WHERE used <= 800")
def context_budget(t: Tables) -> DataFrame:
    return ranking.context_budget(t.results.withColumn("tokens", F.col("id") % 40), 800).select("query_id", "o_orderkey", "used")


@query("SELECT query_id, file_path AS name, CAST(nth AS INTEGER) AS nth FROM (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS nth FROM results GROUP BY query_id, file_path) x WHERE nth <= 3")
def exact_handoff(t: Tables) -> DataFrame:
    return ranking.handoff_names(t.results.withColumn("name", F.col("file_path")))


@query("WITH r AS (SELECT query_id, o_orderkey, rank, file_path, id % 50 AS start_line, id % 50 + o_orderkey % 30 AS end_line FROM results) SELECT query_id, o_orderkey FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.query_id = b.query_id AND a.file_path = b.file_path AND b.rank < a.rank AND b.start_line <= a.start_line AND b.end_line >= a.end_line)")
def without_nested(t: Tables) -> DataFrame:
    rows = t.results.selectExpr("query_id", "o_orderkey", "rank", "file_path", "id % 50 as start_line", "id % 50 + o_orderkey % 30 as end_line")
    return ranking.without_nested(rows).select("query_id", "o_orderkey")


# ---- evaluation
FIRST = "first AS (SELECT e.query_id, min(r.rank) AS first FROM expected e LEFT JOIN results r ON r.query_id = e.query_id AND (r.file_path = e.file_path OR r.file_path LIKE '%/' || e.file_path) GROUP BY 1)"


@query(f"WITH {FIRST} SELECT count(*) AS queries, " + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 6) AS mrr FROM first")
def eval_hit_mrr(t: Tables) -> DataFrame:
    return rounded(evaluation.summary(evaluation.first_hits(t.results, t.expected)), "hit_1", "hit_3", "hit_5", "hit_10", "mrr")


@query(f"WITH {FIRST} SELECT query_id, first FROM first")
def eval_first_hit(t: Tables) -> DataFrame:
    return evaluation.first_hits(t.results, t.expected)


@query(f"WITH {FIRST} SELECT f.query_id, round(CASE WHEN first <= 10 THEN 1 / log2(first + 1) ELSE 0 END, 6) AS ndcg FROM first f")
def eval_ndcg(t: Tables) -> DataFrame:
    return rounded(evaluation.ndcg(t.results, t.expected), "ndcg")


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events GROUP BY 1")
def latency_percentiles(t: Tables) -> DataFrame:
    return rounded(evaluation.percentiles(t.events, "value", ["event_type"]), "p50", "p95", "p99")


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) x WHERE k = ceil(n * 0.95)")
def latency_nearest_rank(t: Tables) -> DataFrame:
    return evaluation.nearest_rank(t.events, "value", 0.95, ["event_type"])


LATENCY = "CASE WHEN value <= 10 THEN '<=10' WHEN value <= 50 THEN '<=50' WHEN value <= 100 THEN '<=100' WHEN value <= 500 THEN '<=500' ELSE '>500' END"


@query(f"SELECT 'route' AS dimension, event_type AS bucket, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'latency', {LATENCY}, count(*) FROM events GROUP BY 2")
def telemetry_histograms(t: Tables) -> DataFrame:
    return evaluation.histograms(t.events, {"route": F.col("event_type"), "latency": evaluation.latency_bucket(F.col("value"))})


@query(f"WITH {FIRST}, m AS (SELECT avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END) AS hit_5, avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END) AS mrr FROM first) SELECT 'hit_5' AS metric, round(hit_5, 6) AS value, CAST(0.99 AS DOUBLE) AS bound FROM m WHERE hit_5 < 0.99 UNION ALL SELECT 'mrr', round(mrr, 6), 0.01 FROM m WHERE mrr > 0.01")
def budget_gate(t: Tables) -> DataFrame:
    m = evaluation.summary(evaluation.first_hits(t.results, t.expected))
    return rounded(evaluation.budget_violations(m, {"hit_5": ("min", 0.99), "mrr": ("max", 0.01)}), "value")


@query("SELECT event_type, round(sum(value * user_id) / sum(user_id), 6) AS average, round(median(value), 6) AS median FROM events GROUP BY 1")
def weighted_metrics(t: Tables) -> DataFrame:
    return rounded(evaluation.weighted_average(t.events, "value", "user_id", ["event_type"]), "average", "median")


# ---- incremental
@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS path, CASE WHEN a.c_custkey IS NULL THEN 'add' WHEN b.c_custkey IS NULL THEN 'unlink' ELSE 'change' END AS type
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_custkey % 4 = 0""")
def snapshot_diff(t: Tables) -> DataFrame:
    before = t.customer.where("c_custkey % 3 <> 0").selectExpr("c_custkey as path", "c_nationkey as size", "c_acctbal as mtime_ms")
    now = t.customer.where("c_custkey % 5 <> 0").selectExpr("c_custkey as path", "c_nationkey as size", "c_acctbal + if(c_custkey % 4 = 0, 1, 0) as mtime_ms")
    return incremental.snapshot_diff(before, now)


@query("""WITH x AS (SELECT event_id, user_id AS path, event_type, epoch_us(ts) / 1000 AS ms FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (ORDER BY ms, event_id) < 300000 THEN 0 ELSE 1 END AS s FROM x),
b AS (SELECT *, CAST(sum(s) OVER (ORDER BY ms, event_id) AS BIGINT) AS burst FROM g) SELECT burst, path, arg_max(event_type, ms) AS type FROM b GROUP BY 1, 2""")
def debounce_sessions(t: Tables) -> DataFrame:
    changes = t.events.select("ts", F.col("event_id").alias("seq"), F.col("user_id").alias("path"), F.col("event_type").alias("type"))
    return incremental.bursts(changes, 300_000)


@query("SELECT o_custkey AS chunk_id, o_orderkey AS record_id, n AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) x WHERE k = 1")
def latest_failed_record(t: Tables) -> DataFrame:
    return incremental.latest_failures(t.orders.selectExpr("o_custkey as chunk_id", "o_orderkey as record_id", "o_orderdate as at")).select("chunk_id", "record_id", "attempts")


@query("SELECT c_custkey AS path, c_nationkey % 20 AS hash FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey >= 20")
def changed_files(t: Tables) -> DataFrame:
    stored = t.customer.where("c_custkey % 3 <> 0").selectExpr("c_custkey as path", "c_nationkey as hash")
    return incremental.changed_files(stored, t.customer.selectExpr("c_custkey as path", "c_nationkey % 20 as hash"))


@query("SELECT user_id AS repo, event_id AS seq, event_type AS branch FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) x WHERE b <> event_type")
def branch_changes(t: Tables) -> DataFrame:
    return incremental.branch_changes(t.events.selectExpr("user_id as repo", "ts", "event_id as seq", "event_type as branch")).select("repo", "seq", "branch")
