import random

from quillspan.llm.line_dedup import LEAST, line_dedup

from .oracle import both

SCHEMA = "doc_id long, text string"


def distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    first = {}
    for d, text in sorted(docs):
        for k, line in enumerate(text.split("\n")):
            first.setdefault(line, (d, k))
    long = [x for x in first if len(x.encode()) >= LEAST]
    gone = {x for x in long if any(first[y] < first[x] and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 1 for y in long if y != x)}
    out = {}
    for d, text in docs:
        lines = text.split("\n")
        stay = [x for k, x in enumerate(lines) if not x.strip() or first[x] == (d, k) and x not in gone]
        out[d] = ("\n".join(stay), len(lines) - len(stay))
    return out


def test_nulls_ties_repeated_rows_and_blank_lines(spark):
    docs = [(2, "a\nb\n\nc"), (1, "b\n\n  \nb"), (3, None), (4, ""), (5, "c"), (6, "d\n"), (6, "d\n"), (None, "e\nc"), (7, "e"), (8, "C\nc ")]
    want = [(2, "a\n\nc", 1), (1, "b\n\n  ", 1), (3, None, 0), (4, "", 0), (5, "", 1), (6, "d\n", 0), (6, "", 1), (None, "", 2), (7, "e", 0), (8, "C\nc ", 0)]
    for k in (1, 5):
        out = line_dedup(spark.createDataFrame(docs, SCHEMA).repartition(k))
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_edits_against_brute_force(spark):
    rng = random.Random(2)
    lines = ["x" * LEAST, "ab" * 15, "é" * 12 + " fin de ligne", "0123456789" * 30, "short", "0123456789012345678"]
    for _ in range(150):
        x = list(rng.choice(lines))
        for _ in range(rng.choice([1, 1, 2])):
            at = rng.randrange(len(x))
            x[at: at + rng.randrange(2)] = rng.choice(["", "q", "é", "7"])
        lines.append("".join(x))
    docs = [(i, "\n".join(rng.choices(lines, k=4))) for i in range(60)]
    got = {r.doc_id: (r.text, r.removed) for r in line_dedup(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    assert got == brute(docs)


def test_empty_table_long_lines_and_clashing_names(spark):
    out = line_dedup(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "text", "removed"] and out.count() == 0
    long = "word " * 20_000
    docs = spark.createDataFrame([(1, long, "p", "q", 9), (2, long[:50_000] + "z" + long[50_000:], "p", "q", 9)], "doc_id long, text string, digest string, `a.b` string, removed int")
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "digest", "a.b", "removed"]
    assert sorted((r.doc_id, len(r.text), r.removed) for r in out.collect()) == [(1, 100_000, 0), (2, 0, 1)]


def test_query_and_oracle(spark):
    _, got, want = both(spark, "op3_line_dedup", "/root/testdata/sf0.01")
    assert got == want and len(got) == 1000
