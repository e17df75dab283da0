import pytest

from quillspan.llm.exact_dedup import exact_dedup

from .oracle import both

SCHEMA = "doc_id long, text string, lang string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(5, "x", "a"), (2, "x", "b"), (None, "x", "c"), (7, None, "a"), (6, None, "b"), (8, "", "a"), (9, "y", "a"), (9, "y", "a"), (None, "z", "a"), (1, "X", "a"), (3, "x ", "a")]
    out = rows(exact_dedup(spark.createDataFrame(docs, SCHEMA), copies="copies"))
    assert out == sorted([(2, "x", "b", 3), (6, None, "b", 2), (8, "", "a", 1), (9, "y", "a", 2), (None, "z", "a", 1), (1, "X", "a", 1), (3, "x ", "a", 1)], key=str)


def test_ties_do_not_depend_on_partitions_or_salts(spark):
    docs = spark.createDataFrame([(1, "x", str(i)) for i in range(50)], SCHEMA)
    kept = [rows(exact_dedup(docs.repartition(k), salts=s, copies="copies")) for k, s in ((1, 16), (7, 16), (5, 1))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1 and kept[0][0][-1] == 50


def test_long_texts_are_compared_whole(spark):
    long = "a" * 300_000
    assert exact_dedup(spark.createDataFrame([(1, long + "b", ""), (2, long + "c", ""), (3, long + "b", "")], SCHEMA)).count() == 2


def test_empty_table(spark):
    out = exact_dedup(spark.createDataFrame([], SCHEMA), copies="copies")
    assert out.columns == ["doc_id", "text", "lang", "copies"] and out.count() == 0


def test_ties_with_nulls_and_clashing_names(spark):
    docs = [(1, "x", None, 1, {"k": 1}), (1, "x", 1, None, {"k": 2})]
    schema = "doc_id long, text string, digest int, `a`` .b` int, win map<string,int>"
    kept = [exact_dedup(spark.createDataFrame(d, schema).repartition(k)).collect() for d in (docs, docs[::-1]) for k in (1, 3)]
    assert all(tuple(k[0]) == docs[0] and len(k) == 1 for k in kept)
    with pytest.raises(ValueError):
        exact_dedup(spark.createDataFrame(docs, schema), copies="Text")


def test_local_stage_leaves_one_row_a_text(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'x' as text").coalesce(1)
    out = exact_dedup(docs)
    out.collect()
    assert out.count() == 1 and out.first().doc_id == 0


def test_query_and_oracle(spark):
    _, got, want = both(spark, "op10_exact_dedup")
    assert got == want and len(got) < 200
