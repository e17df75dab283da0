"""The engine's questions in one place, over a catalog of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.embed import embed_text, hashed_embedding
from .functions.text import line_slice
from .operators import catalog, graph, ingest, ranking, retrieval
from .streaming.incremental import changed_files

LIMIT = 20


@dataclass
class CodeIndex:
    """``chunks`` (id, path, start_line, end_line, content, embedding), ``files`` (path, hash), and the call graph's tables."""

    chunks: DataFrame
    files: DataFrame
    symbols: DataFrame | None = None
    edges: DataFrame | None = None
    branch_symbols: DataFrame | None = None

    @classmethod
    def build(cls, files: DataFrame, **tables: DataFrame) -> CodeIndex:
        """Index files (path, content): included ones, cut into chunks that cover every line, and embedded."""
        kept = ingest.included(files)
        chunks = ingest.split_large(ingest.line_chunks(kept))
        ident = F.xxhash64("path", "start_line", "end_line", "content")
        return cls(chunks.withColumns({"id": ident, "embedding": hashed_embedding()("content")}), kept.select("path", F.xxhash64("content").alias("hash")), **tables)

    def update(self, files: DataFrame) -> CodeIndex:
        """The index of ``files`` now: only files with another hash are cut and embedded again."""
        kept = ingest.included(files)
        hashed = kept.select("path", F.xxhash64("content").alias("hash"))
        fresh = CodeIndex.build(kept.join(changed_files(self.files, hashed), "path", "left_semi"))
        old = self.chunks.join(hashed.join(self.files, ["path", "hash"], "left_semi"), "path", "left_semi")
        return CodeIndex(old.unionByName(fresh.chunks), hashed, self.symbols, self.edges, self.branch_symbols)

    def status(self, files: DataFrame) -> DataFrame:
        return catalog.index_status(self.files, ingest.included(files).select("path", F.xxhash64("content").alias("hash")))

    # ---- search
    def search(self, query: str, limit: int = LIMIT, weight: float | None = None, directory: str | None = None) -> DataFrame:
        """(id, score, path, start_line, end_line, content): vector and keyword lists fused, by reciprocal rank unless a weight is given."""
        if limit < 1:
            raise ValueError("limit must be positive")
        chunks = self.chunks
        if directory:
            chunks = retrieval.hard_filters(chunks.withColumnRenamed("path", "file_path"), directory=directory).withColumnRenamed("file_path", "path")
        asked = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
        keyword = retrieval.bm25(chunks, asked, "id", "content", limit * 4).select("id", "score")
        vector = embed_text(query)
        semantic = retrieval.knn(chunks.where("embedding is not null"), vector, limit * 4) if vector else keyword.limit(0)
        fused = retrieval.fuse_reciprocal(semantic, keyword) if weight is None else retrieval.fuse_weighted(semantic, keyword, weight)
        best = fused.orderBy(F.desc("score"), "id").limit(limit)
        return best.join(chunks.drop("embedding"), "id").orderBy(F.desc("score"), "id")

    def peek(self, query: str, limit: int = LIMIT) -> DataFrame:
        """Places only, no content."""
        return self.search(query, limit).drop("content")

    def similar(self, snippet: str, limit: int = LIMIT, exclude: str | None = None, least: float = 0.1) -> DataFrame:
        vector = embed_text(snippet)
        chunks = self.chunks.where("embedding is not null")
        if exclude:
            chunks = chunks.where(F.col("path") != exclude)
        found = retrieval.knn(chunks, vector, limit) if vector else chunks.select("id", F.lit(0.0).alias("score")).limit(0)
        return found.where(F.col("score") >= least).join(chunks.drop("embedding"), "id").orderBy(F.desc("score"), "id")

    def context(self, query: str, budget: int = 2000) -> DataFrame:
        """The best results whose tokens fit the budget, nested ones left out."""
        found = self.search(query).select(F.lit(0).alias("query_id"), F.col("path").alias("file_path"), "start_line", "end_line", "content", "score", "id")
        ranked = retrieval.top_k(found, ["query_id"], "id", LIMIT).withColumn("tokens", F.ceil(F.length("content") / 4))
        return ranking.context_budget(ranking.without_nested(ranked), budget)

    def read(self, files: DataFrame, path: str, first: int, last: int) -> DataFrame:
        return files.where(F.col("path") == path).select("path", line_slice(F.col("content"), F.lit(first), F.lit(last)).alias("content"))

    # ---- call graph
    def definition(self, name: str, path: str | None = None) -> DataFrame:
        return graph.resolve_symbol(self.symbols, name, path)

    def callers(self, name: str, branch: str) -> DataFrame:
        return graph.callers(self.edges, self.symbols, self.branch_symbols, name, branch)

    def callees(self, symbol: int, branch: str) -> DataFrame:
        return graph.callees(self.edges, self.branch_symbols, symbol, branch)

    def links(self, branch: str) -> DataFrame:
        return graph.resolved(self.edges, self.symbols, self.branch_symbols, branch)

    def path(self, start: int, goal: int, branch: str, depth: int = 10) -> DataFrame:
        return graph.shortest_path(self.links(branch), start, goal, depth)

    def communities(self, branch: str, least: int = 2) -> DataFrame:
        return graph.community_summary(graph.communities(self.links(branch)), least)

    def impact(self, changed: DataFrame, branch: str, depth: int = 5) -> DataFrame:
        links = self.links(branch)
        return graph.impact(links, graph.on_branch(self.symbols, self.branch_symbols, branch), changed, graph.communities(links), depth)
