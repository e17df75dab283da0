"""Operators mended for large inputs: against brute force, and that their plans stay bounded."""

import random
import re

from pyspark.sql import functions as F

from quillspan.operators import graph, ingest, retrieval


def test_knn_batch_against_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(300)] + [(300, None), (301, [0.0] * 4), (302, [1.0, 2.0])]
    queries = [(i, v) for i, v in vectors if i % 20 == 0] + [(400, [2.0, 1.0])]

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        aa, bb, ab = (sum(x * y for x, y in zip(p, q)) for p, q in ((a, a), (b, b), (a, b)))
        return max(-1.0, min(1.0, ab / (aa * bb) ** 0.5)) if aa * bb else float("nan")

    def place(score):
        return (0, 0.0) if score is not None and score != score else (1, -score) if score is not None else (2, 0.0)

    want = {}
    for q, a in queries:
        scored = sorted(((cosine(a, b), i) for i, b in vectors), key=lambda x: (place(x[0]), x[1]))
        want |= {(q, rank + 1): (i, repr(s)) for rank, (s, i) in enumerate(scored[:7])}
    v, q = spark.createDataFrame(vectors, "id long, embedding array<float>"), spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.id, repr(r.score)) for r in retrieval.knn_batch(v, q, 7, blocks=3).collect()}
    assert got == want
    assert retrieval.knn_batch(v, q, 0).count() == 0 and retrieval.knn_batch(v.limit(0), q, 5).count() == 0 and retrieval.knn_batch(v, q.limit(0), 5).count() == 0


def test_knn_batch_joins_no_pairs(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, embedding array<float>")
    plan = retrieval.knn_batch(v, v.withColumnRenamed("id", "query_id"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "zip_with" not in plan


def test_enclosing_symbol_against_brute_force(spark):
    rng = random.Random(2)
    symbols = [(i, f"f{rng.randrange(3)}", a := rng.randrange(-40, 300), a + rng.choice([-1, 0, 1, 2, 7, 8, 40, 100])) for i in range(400)] + [(900, "f0", -(2**31), 2**31 - 1), (901, None, 1, 5), (902, "f1", None, 5)]
    sites = [(i, rng.choice(["f0", "f1", "f2", "g", None]), rng.choice([None, *range(-60, 350)])) for i in range(600)] + [(5, "f1", 17)]
    want = {}
    for site, path, line in sites:
        around = [(e - s, -s, i) for i, p, s, e in symbols if path and p == path and None not in (line, s) and s <= line <= e]
        if around:
            want[site] = min([*around, want.get(site, around[0])])
    got = ingest.enclosing_symbol(spark.createDataFrame(sites, "site_id long, file_path string, line int"), spark.createDataFrame(symbols, "id long, file_path string, start_line int, end_line int"))
    assert sorted(map(tuple, got.collect())) == sorted((s, b[2]) for s, b in want.items())


def test_enclosing_symbol_meets_few_symbols_a_site(spark):
    sites = spark.range(20_000).selectExpr("id as site_id", "'f' as file_path", "id as line")
    symbols = spark.range(20_000).selectExpr("id", "'f' as file_path", "id as start_line", "id + 10000 as end_line")
    got = ingest.enclosing_symbol(sites, symbols)
    assert got.agg({"symbol_id": "sum", "site_id": "count"}).first() == (20_000, sum(range(20_000)))
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all(">=" not in x and "<=" not in x for x in joins)


def links(spark, pairs):
    return spark.createDataFrame([(i, a, b, "Call") for i, (a, b) in enumerate(pairs)], "id long, src long, dst long, call_type string")


def test_components_of_a_shuffled_path_take_few_rounds(spark, monkeypatch):
    rng = random.Random(3)
    ids = list(range(1, 1501))
    rng.shuffle(ids)
    loose = [(10_000 + rng.randrange(300), 10_000 + rng.randrange(300)) for _ in range(120)]
    root = {x: x for p in loose for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in loose:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rounds, own = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: rounds.append(name) or own(df, name))
    got = graph.components(links(spark, [*zip(ids, ids[1:], strict=False), *loose, (5, None)]))
    assert sorted(map(tuple, got.collect())) == sorted([(x, 1) for x in ids] + list(root.items()))
    assert len(rounds) <= 12
    assert graph.components(links(spark, [(1, 1), (2, None)])).count() == 0


def test_walks_and_components_send_no_table_to_the_driver(spark):
    pairs = links(spark, [(1, 2), (2, 3), (7, 8)])
    for df in (graph.components(pairs), graph.communities(pairs), graph.reach(pairs, spark.createDataFrame([(1,)], "id long"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_walk_works_out_its_links_once(spark):
    met = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            met.add(len(batch))
            yield batch

    pairs = links(spark, [(i, i + 1) for i in range(1, 9)])
    watched = pairs.mapInPandas(seen, pairs.schema)
    assert graph.reach(watched, spark.createDataFrame([(1,)], "id long"), "both", 4).count() == 4
    assert met.value == 8


def test_merge_small_against_one_file_at_a_time(spark):
    rng = random.Random(4)
    rows = []
    for f in range(40):
        at = 1
        for _ in range(rng.randrange(1, 30)):
            n = rng.randrange(1, 5)
            rows.append((f"f{f}", at, at + n - 1, rng.choice(["x", "é" * 20, "y" * 99, "z" * 100, "w" * 1950]) + f" {at}"))
            at += n + rng.choice([0, 0, 0, -1, 1])
    want = []
    for f in range(40):
        out = []
        for path, first, last, content in sorted(r for r in rows if r[0] == f"f{f}"):
            if out and len(out[-1][3].encode()) < 100 and len(out[-1][3].encode()) + len(content.encode()) <= 2000 and out[-1][2] + 1 >= first:
                out[-1] = (path, out[-1][1], max(out[-1][2], last), out[-1][3] + "\n" + content)
            else:
                out.append((path, first, last, content))
        want += out
    rng.shuffle(rows)
    got = ingest.merge_small(spark.createDataFrame(rows, "path string, start_line int, end_line int, content string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # a call for each file
    assert ingest.merge_small(spark.createDataFrame([], "path string, start_line int, end_line int, content string")).count() == 0


def test_hint_tags_against_their_patterns(spark):
    rng = random.Random(5)
    words = "async await promises http https fetch( xfetch requests selected select insert queries try retry catch except raise braise assert expect( describe( config reconfig env envy cache caching cached token tokens author for forty while class classy export pub public É, 日 WHILE".split()
    texts = [(i, rng.choice([" ", "_", ".", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(600)] + [(600, None), (601, "")]
    want = {i: [t for t, p in ingest.HINTS if x and re.search(p, x.lower())][:6] for i, x in texts}
    assert {t: set(w.split()) for t, w in ingest.NEEDLES.items()}.keys() == dict(ingest.HINTS).keys()
    assert {r.id: r.h for r in spark.createDataFrame(texts, "id int, x string").select("id", ingest.hint_tags(F.col("x")).alias("h")).collect()} == want


def test_embedding_text_makes_its_header_before_the_parts(spark):
    chunk = spark.createDataFrame([("a/b.py", 1, "while x: await y\n" * 900)], "path string, start_line int, content string")
    got = ingest.embedding_text(chunk)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("RLIKE")
    rows = got.orderBy("part").collect()
    assert len(rows) == 9 and all(r.text.startswith(f"python | a | async, loop\nPart {i + 1}/9\n") for i, r in enumerate(rows))


def test_blank_chunks_are_dropped(spark):
    files = [("a", "\n \t\f\r\x0b\n"), ("b", " "), ("c", ""), ("d", None), ("e", " \n x")]
    assert {r.path for r in ingest.line_chunks(spark.createDataFrame(files, "path string, content string")).collect()} == {"b", "e"}
