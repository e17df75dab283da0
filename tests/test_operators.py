import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import catalog, graph, ingest, ranking, retrieval
from quillspan.streaming import incremental


def values(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells)) if cells else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert values(spark, T.search_tokens(F.col("s")), s="The quick_brown fox, an Äh 日!") == ["the", "quick", "brown", "fox", "äh", "日"]
    assert values(spark, T.identifier_words(F.col("s")), s="parseHTTPRequest2x_y") == ["parse", "http", "request2x", "y"]
    assert values(spark, T.identifier_variants(F.col("s")), s="fooBar") == ["foobar", "foo_bar", "foo-bar"]
    assert values(spark, T.extension(F.col("s")), s="a/b.C/x.TSX") == "tsx"
    assert values(spark, T.language(F.col("s")), s="a/noext") == "text"
    assert values(spark, T.line_slice(F.col("s"), F.lit(2), F.lit(9)), s="a\nb\nc") == "b\nc"
    assert values(spark, T.truncated(F.col("s"), 2), s="a\nb\nc\nd") == "a\nb\n... (2 more lines)"
    assert values(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert values(spark, T.redacted(F.col("s")), s="http://u:pw@h api_key=abc x") == "http://u:***@h api_key=*** x"
    assert values(spark, T.path_matches(F.col("a"), F.col("b")), a="x/src/a.py", b="src/a.py") and not values(spark, T.path_matches(F.col("a"), F.col("b")), a="xsrc/a.py", b="src/a.py")


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("*.py", "x/a.py", False), ("a?.{ts,js}", "ab.js", True), ("src/**", "src/x/y", True), ("**/dist/**", "dist/x", True), ("a.b", "axb", False)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(T.glob_regex(glob), path)) == hit


def test_empty_corpus_and_queries(spark):
    docs = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "some words")], "query_id long, query string")
    assert retrieval.corpus_stats(docs).first()["avgdl"] == 100.0
    assert retrieval.bm25(docs, asked).count() == 0
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "id long, text string")
    assert [r.id for r in retrieval.bm25(docs, spark.createDataFrame([(1, "beta beta")], "query_id long, query string")).collect()] == [1]
    assert retrieval.knn(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"), [1.0], 0).count() == 0


def test_first_in_both_lists_scores_one(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    b = spark.createDataFrame([(1, 7.0)], "id long, score double")
    got = {r.id: r.score for r in retrieval.fuse_reciprocal(a, b).collect()}
    assert abs(got[1] - 1) < 1e-9 and abs(got[2] - 61 / 62 / 2) < 1e-9


def test_upsert_takes_the_latest_and_keeps_columns(spark):
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", None)], "k long, v string, t string")
    new = spark.createDataFrame([(1, "x", "t9", 1), (1, "y", "t8", 2), (2, None, "t2", 1), (3, "z", "t3", 1)], "k long, v string, t string, at long")
    assert sorted(map(tuple, catalog.upsert(old, new, ["k"], "at").collect())) == [(1, "y", "t8"), (2, None, "t2"), (3, "z", "t3")]
    assert sorted(map(tuple, catalog.upsert(old, new, ["k"], "at", keep=("t",)).collect())) == [(1, "y", "t1"), (2, None, "t2"), (3, "z", "t3")]


def test_graph_walks(spark):
    links = spark.createDataFrame([(i, i, i + 1, "Call") for i in range(1, 6)] + [(10, 1, 4, "Call"), (11, 6, None, "Call"), (12, 8, 9, "Call"), (13, 4, 4, "Call")], "id long, src long, dst long, call_type string")
    roots = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.depth) for r in graph.reach(links, roots).collect()} == {(2, 1), (4, 1), (3, 2), (5, 2), (6, 3)}
    assert {r.id for r in graph.reach(links, spark.createDataFrame([(4,)], "id long"), "both").collect()} == {1, 2, 3, 5, 6}
    assert [r.id for r in graph.shortest_path(links, 1, 6).orderBy("step").collect()] == [1, 4, 5, 6]
    assert graph.shortest_path(links, 1, 9).count() == 0 and [r.id for r in graph.shortest_path(links, 3, 3).collect()] == [3]
    assert {(r.id, r.component) for r in graph.components(links).collect()} == {(i, 1) for i in range(1, 7)} | {(8, 8), (9, 8)}


def test_communities(spark):
    edges = [(a, b) for g in ((1, 2, 3), (11, 12, 13)) for a, b in itertools.combinations(g, 2)] + [(5, 5)]
    links = spark.createDataFrame([(i, a, b, "Call") for i, (a, b) in enumerate(edges)], "id long, src long, dst long, call_type string")
    assert {(r.id, r.label) for r in graph.communities(links).collect()} == {(x, 2) for x in (1, 2, 3)} | {(x, 12) for x in (11, 12, 13)}
    assert {r.id for r in graph.communities(links, spark.createDataFrame([(2,), (99,)], "id long")).collect()} == {1, 2, 3}


def test_chunks_against_plain_python(spark):
    rng = random.Random(0)
    files = [(f"f{n}", "\n".join(rng.choice(["x", "", "word word"]) for _ in range(n)) + "\n" * (n % 2)) for n in (0, 1, 2, 29, 30, 31, 57, 58, 200)]
    want = []
    for path, content in files:
        lines = (content[:-1] if content.endswith("\n") else content).split("\n")
        at = 0
        while True:
            end = min(at + 30, len(lines))
            if "\n".join(lines[at:end]).strip():
                want.append((path, at + 1, end, "\n".join(lines[at:end])))
            if end >= len(lines):
                break
            at += 27
    got = ingest.line_chunks(spark.createDataFrame(files, "path string, content string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_embedding_text_covers_everything(spark):
    chunk = spark.createDataFrame([("a/b.py", 1, "x" * 5000), ("c.md", 3, "short")], "path string, start_line int, content string")
    rows = ingest.embedding_text(chunk).orderBy("path", "part").collect()
    assert [r.part for r in rows] == [1, 2, 3, 1] and all("Part" in r.text for r in rows[:3]) and rows[3].text.endswith("\nshort")
    assert sum(r.text.count("x") for r in rows[:3]) >= 5000


def test_rerank_keeps_the_tail_and_raw_scores(spark):
    rows = [(1, "tests for parser", i, 1 - i / 100, i, f"n{i}", "src/a.py" if i != 3 else "tests/test_a.py") for i in range(1, 31)]
    out = ranking.rerank(spark.createDataFrame(rows, "query_id long, query string, id long, score double, rank int, name string, file_path string")).orderBy("place").collect()
    assert out[0].id == 3 and out[0].score == 0.97 and [r.id for r in out[20:]] == list(range(21, 31))


def test_bursts_against_one_clock(spark):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1, 23, 59, 58)
    rows, at = [], start
    for i in range(200):
        at += datetime.timedelta(milliseconds=rng.choice([10, 400, 999, 1000, 1001, 5000, 40_000_000 if i % 50 == 0 else 20]))
        rows.append((at, i, f"p{rng.randrange(5)}", rng.choice(["add", "change", "unlink"])))
    want, burst, last = {}, 0, None
    for ts, _, path, kind in rows:
        if last is None or (ts - last).total_seconds() * 1000 >= 1000:
            burst += 1
        want[burst, path] = kind
        last = ts
    got = incremental.bursts(spark.createDataFrame(rows, "ts timestamp, seq long, path string, type string"))
    assert {(r.burst, r.path): r.type for r in got.collect()} == want


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(datetime.datetime(2024, 1, 1, 0, 0, 0, 100_000 * i), f"p{i % 2}", "add" if i < 4 else "change") for i in range(5)] + [(datetime.datetime(2024, 1, 1, 0, 1), "p0", "unlink")]
    spark.createDataFrame(rows, "ts timestamp, path string, type string").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, path string, type string").parquet(str(source))
    incremental.burst_stream(stream).writeStream.outputMode("complete").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.path, r.type) for r in spark.table("bursts").collect()) == [("p0", "change"), ("p0", "unlink"), ("p1", "add")]
    target = str(tmp_path / "out")
    incremental.upsert_stream(stream, target, ["path"], "ts", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.path, r.type) for r in spark.read.parquet(f"{target}/v=0").collect()) == [("p0", "unlink"), ("p1", "add")]
