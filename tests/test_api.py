import pytest

from quillspan.api import CodeIndex
from quillspan.functions.embed import embed_text
from quillspan.sources import files as sources

FILES = [("src/parser.py", "def parse_request(body):\n    return json.loads(body)\n"), ("src/cache.py", "class Cache:\n    def get(self, key):\n        return self.entries.get(key)\n"), ("dist/x.py", "parse request"), ("docs/guide.md", "How requests are parsed and cached.\n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_index_search_and_update(spark):
    index = CodeIndex.build(frame(spark, FILES))
    found = index.search("parse request body").collect()
    assert found[0].path == "src/parser.py" and "dist/x.py" not in {r.path for r in found}
    assert {r.path for r in index.search("parse request", directory="docs").collect()} <= {"docs/guide.md"}
    assert index.similar("entries get key cache", exclude="src/parser.py").first().path == "src/cache.py"
    assert "content" not in index.peek("cache").columns and index.context("cache", 1).count() == 0
    changed = [*FILES[:1], ("src/cache.py", "class Store:\n    pass  # persistent storage\n")]
    assert index.status(frame(spark, changed)).first().reason == "count-mismatch" and index.status(frame(spark, FILES)).first().reason == "fresh"
    new = index.update(frame(spark, changed))
    assert {r.path for r in new.chunks.collect()} == {"src/parser.py", "src/cache.py"} and new.search("persistent storage").first().path == "src/cache.py"
    assert index.search("?!").count() == 0
    with pytest.raises(ValueError):
        index.search("x", limit=0)


def test_call_graph_questions(spark):
    symbols = spark.createDataFrame([(i, f"f{i}", f"src/m{i % 2}.py", "python", 1, 9) for i in range(1, 6)], "id long, name string, file_path string, language string, start_line int, end_line int")
    edges = spark.createDataFrame([(i, i, f"f{i + 1}", i + 1 if i != 2 else None, "Call") for i in range(1, 5)], "id long, from_symbol_id long, target_name string, to_symbol_id long, call_type string")
    members = spark.createDataFrame([("main", i) for i in range(1, 6)], "branch string, symbol_id long")
    index = CodeIndex(frame(spark, []), frame(spark, []), symbols, edges, members)
    assert [r.caller for r in index.callers("f3", "main").collect()] == ["f2"] and index.callees(2, "main").count() == 1
    assert [r.id for r in index.path(1, 5, "main").orderBy("step").collect()] == [1, 2, 3, 4, 5]
    assert index.definition("f1").first().outcome == "resolved" and index.communities("main").agg({"members": "sum"}).first()[0] >= 4
    assert index.impact(spark.createDataFrame([("src/m1.py",)], "path string"), "main").first().risk in ("LOW", "MEDIUM", "HIGH")


def test_embedding():
    v = embed_text("Some words, some more")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == embed_text("some WORDS some more") and embed_text("  ") is None and embed_text(None) is None


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\n")
    (tmp_path / "big.txt").write_text("x" * 3000)
    assert [r.content for r in sources.read_files(spark, str(tmp_path), 2000).collect()] == ["print(1)\n"]
    assert sources.has_marker(spark.createDataFrame([("README",), ("go.mod",)], "name string")).first().project
    (tmp_path / "failed.jsonl").write_text('{"version":1,"record_id":"r","chunks":[{"chunk_id":"c1","text":"t"}],"error":"e","attempts":2,"at":"now"}\nnot json\n')
    assert [(r.record_id, r.chunk_id, r.attempts) for r in sources.read_failures(spark, str(tmp_path / "failed.jsonl")).collect()] == [("r", "c1", 2)]
    (tmp_path / "golden.json").write_text('{"version":"1","name":"g","queries":[{"id":"q","query":"x","expected":{"filePath":"a.py","acceptableFiles":["b.py","a.py"]}}]}')
    assert sorted(r.file_path for r in sources.read_golden(spark, str(tmp_path / "golden.json")).collect()) == ["a.py", "b.py"]
    target = str(tmp_path / "table")
    for n in (3, 5):
        sources.publish(spark.range(n), target)
        assert spark.read.parquet(target).count() == n
