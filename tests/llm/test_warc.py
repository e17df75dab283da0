from quillspan.llm.warc import canonical_url, merge_headers, resolve_revisits

from .oracle import both

SCHEMA = "record_id long, uri string, date long, kind string, status int, headers map<string,string>, payload string, base string, outcome string"


def run(spark, rows):
    return {r.record_id: r for r in resolve_revisits(spark.createDataFrame([(*r, "kept", "gone") for r in rows], SCHEMA)).collect()}


def test_canonical_url(spark):
    cases = {
        "HTTP://Ex.COM:80": "http://ex.com/", "https://a.b:443/X?b=2&utm_source=q&a=1#f": "https://a.b/X?a=1&b=2", "http://a.b/?ref=x": "http://a.b/",
        "https://a.b:80/p": "https://a.b:80/p", "notes#1": "notes", None: None, "http://a.b/?reference=1&&": "http://a.b/?reference=1", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(df.u).alias("c")).collect()} == cases


def test_outcomes(spark):
    ok = {"ETag": '"1"', "Content-Type": "text/html", "X": "old", "Date": "d1"}
    got = run(spark, [
        (1, "http://a/", 1, "response", 200, ok, "one"),
        (2, "HTTP://A", 2, "revisit", 304, {"etag": 'W/"1"', "date": "d2", "content-type": "no", "X": "no"}, None),
        (3, "http://a/", 3, "response", 200, {"ETag": '"2"', "Last-Modified": "m"}, "two"),
        (4, "http://a/#f", 4, "revisit", 304, {"ETag": '"1"'}, None),
        (5, "http://a/", 4, "revisit", 304, {"Last-Modified": "m"}, None),
        (6, "http://a/", 4, "revisit", 304, None, None),
        (7, "http://b/", 4, "revisit", 304, ok, None),
        (8, "http://a/", None, "revisit", 304, ok, None),
        (9, None, 9, "revisit", 304, ok, None),
        (10, "http://a/", 5, "response", 404, ok, "gone"),
        (11, "http://a/", 5, "response", 200, ok, None),
        (12, "http://a/", 6, "revisit", 304, {"ETAG": '"2"'}, None),
        (13, "http://a/", 6, "response", 200, {"etag": '"2"'}, "same day" * 100_000),
        (14, None, 8, "response", 200, ok, "nowhere"),
        (15, "http://a/", 7, None, None, None, None),
    ])
    assert {k: (r.outcome, r.refers_to) for k, r in got.items()} == {
        1: ("full", None), 2: ("resolved", 1), 3: ("full", None), 4: ("mismatch", None), 5: ("resolved", 3), 6: ("no validator", None), 7: ("no response", None), 8: ("no response", None),
        9: ("no response", None), 10: ("full", None), 11: ("full", None), 12: ("resolved", 13), 13: ("full", None), 14: ("full", None), 15: ("full", None)}
    assert got[2].payload == "one" and got[2].status == 200 and got[2].base == "kept"
    assert got[2].headers == {"etag": 'W/"1"', "content-type": "text/html", "x": "old", "date": "d2"}
    assert got[6].status == 304 and got[6].payload is None and len(got[12].payload) == 800_000


def test_repeated_rows_ties_and_empty_table(spark):
    rows = [(1, "http://a/", 1, "response", 200, {"ETag": "1"}, "p")] * 2 + [(2, "http://a/", 1, "revisit", 304, {"ETag": "1", "etag": "1"}, None)] * 3
    out = resolve_revisits(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(3)).collect()
    assert len(out) == 5 and all(r.payload == "p" for r in out)
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merge_is_null_safe(spark):
    df = spark.createDataFrame([(None, {"date": "d", "x": "y"}), ({"x": "y"}, None)], "a map<string,string>, b map<string,string>")
    assert [r.m for r in df.select(merge_headers(df.a, df.b).alias("m")).collect()] == [{"date": "d"}, {"x": "y"}]


def test_query_and_oracle(spark):
    columns, got, want = both(spark, "op5_warc_revisits")
    assert got == want and {r[columns.index("outcome")] for r in got} >= {"full", "resolved", "mismatch", "no validator"}
