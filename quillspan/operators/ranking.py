"""Query intents, path classes and the rules of reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_words, path_tokens, ranking_tokens

INTENTS = [
    ("definition", r"\b(where is|definition of|defined|declare)\b"), ("usage", r"\b(who calls|callers?|usages?|used by)\b"), ("test", r"\b(tests?|specs?)\b"),
    ("configuration", r"\b(config|configuration|settings?|env)\b"), ("documentation", r"\b(docs?|readme|guide)\b"), ("error", r"\b(errors?|exceptions?|fail(s|ed|ure)?)\b"), ("flow", r"\b(how does|flow|pipeline|lifecycle)\b"),
]


def intent(query: Column) -> Column:
    """The first intent whose pattern occurs, else ``implementation``."""
    out = None
    for name, pattern in INTENTS:
        hit = F.lower(query).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("implementation")


PATHS = [
    ("test", r"(^|/)(tests?|__tests__|spec)(/|$)|[._](test|spec)\.[a-z]+$|(^|/)test_[^/]*$"), ("fixture", r"(^|/)(fixtures?|mocks?|testdata)(/|$)"), ("docs", r"(^|/)docs?(/|$)|\.mdx?$"),
    ("generated", r"(^|/)(dist|vendor|generated|node_modules)(/|$)|\.min\.js$"), ("config", r"\.(json|ya?ml|toml|ini)$"),
]


def path_class(path: Column) -> Column:
    out = None
    for name, pattern in PATHS:
        hit = F.lower(path).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("implementation")


def name_strength(name: Column, hint: Column) -> Column:
    """4 for the same name, 3.6 but for case, 1.6 for the same words, 1.2 where one contains the other, else 0."""
    n, h = F.lower(name), F.lower(hint)
    return F.when(name == hint, 4.0).when(n == h, 3.6).when(F.array_sort(identifier_words(name)) == F.array_sort(identifier_words(hint)), 1.6).when(n.contains(h) | h.contains(n), 1.2).otherwise(0.0)


def overlap(query: Column, name: Column, path: Column) -> Column:
    """Share of the query's words that occur in the name or the last three parts of the path."""
    asked = ranking_tokens(query)
    words = F.array_union(identifier_words(name), F.slice(F.reverse(path_tokens(path)), 1, 3))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, words)) / F.size(asked))


def rerank(ranked: DataFrame, top: int = 20) -> DataFrame:
    """The head of each query's list by adjusted score; the tail keeps its order, and all keep their raw scores.

    ``ranked``: query_id, query, id, score, rank, name, file_path.
    """
    kind, want = path_class(F.col("file_path")), intent(F.col("query"))
    boost = F.when((want == "test") & (kind == "test"), 0.3).when((want == "documentation") & (kind == "docs"), 0.3).when((want == "configuration") & (kind == "config"), 0.3).when((want == "implementation") & kind.isin("test", "docs", "generated"), -0.2).otherwise(0.0)
    adjusted = F.col("score") + boost + 0.2 * overlap(F.col("query"), F.col("name"), F.col("file_path"))
    head = F.col("rank") <= top
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.round(adjusted, 9)), F.when(head, -F.col("score")), "rank", "id")
    return ranked.withColumn("place", F.row_number().over(order))


def context_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The longest beginning of each query's list whose tokens fit the budget."""
    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where(F.col("used") <= budget)


def handoff_names(ranked: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` distinct names of at most 64 characters of each query's list."""
    named = ranked.where(F.col("name").isNotNull() & (F.length("name") <= 64)).groupBy("query_id", "name").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return named.withColumn("nth", nth).where(F.col("nth") <= most).select("query_id", "name", "nth")


def without_nested(ranked: DataFrame) -> DataFrame:
    """Rows that lie inside no better ranked row of the same query and file."""
    a, b = ranked.alias("a"), ranked.select("query_id", "file_path", "rank", "start_line", "end_line").alias("b")
    inside = F.expr("a.query_id = b.query_id and a.file_path = b.file_path and b.rank < a.rank and b.start_line <= a.start_line and b.end_line >= a.end_line")
    return a.join(b, inside, "left_anti")


def narrow(rows: DataFrame, by: list[str], flag: str = "fits") -> DataFrame:
    """Only rows that fit, in each group that has any; all of the others."""
    return rows.withColumn("_any", F.max(flag).over(Window.partitionBy(*by))).where(F.col(flag) | ~F.col("_any")).drop("_any")
