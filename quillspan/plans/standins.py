"""The engine's tables, as views of the driver's tables.

Each is one SELECT that Spark and DuckDB both run; tables it needs are in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "symbols": """SELECT CAST(p_partkey AS BIGINT) AS id, 'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/' || CAST(p_partkey % 9 AS STRING) || '.py' AS file_path,
        CASE WHEN p_partkey % 5 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') END || '_' || CAST(p_partkey % 30 AS STRING) AS name,
        CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'php' WHEN 2 THEN 'apex' ELSE 'rust' END AS language,
        p_size * 10 AS start_line, p_size * 10 + CAST(p_partkey % 40 AS INT) AS end_line FROM {part}""",
    "edges": """SELECT e.id, e.from_symbol_id, s.name AS target_name, CASE WHEN e.flag = 'R' THEN NULL ELSE e.target END AS to_symbol_id, e.call_type, e.flag <> 'R' AS is_resolved FROM (
        SELECT l_orderkey * 8 + l_linenumber AS id, min(l_partkey) AS from_symbol_id, min(l_suppkey * 20 + l_partkey % 20) AS target, min(l_returnflag) AS flag,
        CASE l_linenumber % 3 WHEN 0 THEN 'Call' WHEN 1 THEN 'MethodCall' ELSE 'Constructor' END AS call_type FROM {lineitem} WHERE l_quantity <= 2 GROUP BY l_orderkey, l_linenumber) e JOIN {symbols} s ON s.id = e.target""",
    "branch_symbols": "SELECT 'main' AS branch, id AS symbol_id FROM {symbols} WHERE id % 10 < 8 UNION ALL SELECT 'dev' AS branch, id AS symbol_id FROM {symbols} WHERE id % 3 <> 0",
    "chunks": """SELECT c_custkey AS chunk_id, md5(CAST(c_custkey % 1201 AS STRING)) AS content_hash,
        'src/' || lower(c_mktsegment) || '/' || CAST(c_nationkey AS STRING) || CASE c_custkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.md' END AS file_path,
        CAST(c_custkey % 200 + 1 AS INT) AS start_line, CAST(c_custkey % 200 + 1 + c_custkey % 37 AS INT) AS end_line,
        CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'block' END AS node_type,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 1700000000 + c_custkey * 3600 END AS blame_committed_at, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'Author' || CAST(c_nationkey AS STRING) END AS blame_author,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'a' || CAST(c_nationkey AS STRING) || '@Example.org' END AS blame_author_email, md5(c_name) AS blame_sha FROM {customer}""",
    "branch_chunks": "SELECT DISTINCT o_orderpriority AS branch, o_custkey AS chunk_id FROM {orders} WHERE o_orderkey % 3 = 0 AND o_custkey % 13 <> 0",
    "vectors": "SELECT md5(CAST(vec_id AS STRING)) AS content_hash, vec_id FROM {embeddings}",
    "files": """SELECT 'src/' || source || '/' || CASE doc_id % 7 WHEN 6 THEN '.cache/' WHEN 5 THEN 'dist/' ELSE '' END || CAST(doc_id AS STRING) ||
        CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.lock' ELSE '.rs' END AS path, text AS content, n_chars AS size, doc_id FROM {documents}""",
    "semantic": "SELECT c_custkey AS id, (c_custkey * 104729 % 100003) / CAST(100003 AS DOUBLE) AS score FROM {customer} WHERE c_custkey % 3 = 0",
    "keyword": "SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / CAST(10007 AS DOUBLE) AS score FROM {customer} WHERE c_custkey % 2 = 0",
    "asked": "SELECT item_id AS query_id, substring(text, 1, 60) AS query FROM {benchmark} WHERE item_id < 8",
    "results": """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o_orderkey) AS INT) AS rank, 'repo/src/' || CAST(o_custkey % 50 AS STRING) || '.py' AS file_path, o_custkey AS id,
        o_orderkey, o_totalprice AS score FROM (SELECT o_orderkey % 97 AS query_id, o_orderkey, o_custkey, o_totalprice FROM {orders}) o""",
    "expected": "SELECT n AS query_id, 'src/' || CAST(n * 7 % 50 AS STRING) || '.py' AS file_path, CAST(n % 3 + 1 AS INT) AS relevance FROM (SELECT DISTINCT o_orderkey % 97 AS n FROM {orders}) o",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Views of the tables in a folder, made when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                sql = VIEWS[name]
                self.made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in _needs(sql)})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.made[name]


def with_views(sql: str, recursive: bool = False) -> str:
    """The statement with the views that it mentions as common table expressions."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in wanted:
            for n in _needs(VIEWS[name]):
                add(n)
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\s+(AS\s+)?\w+\s+WHERE|\bIN\s+{name}\b", sql):
            add(name)
    views = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in wanted)
    if not views:
        return sql
    rest = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {'RECURSIVE ' if recursive or rest and rest[1] else ''}{views}{', ' + sql[rest.end():] if rest else ' ' + sql}"
