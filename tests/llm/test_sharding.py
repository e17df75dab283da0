import pytest

from quillspan.llm.sharding import SHARDS, Feistel, number_at, place, shard

from .oracle import both


def test_column_walk_is_position(spark):
    for n in (1, 2, 3, 7, 101, 997):
        f = Feistel(n)
        got = {r.id: r.p for r in f.walked(spark.range(n), "id", "p").collect()}
        assert got == {x: f.position(x) for x in range(n)}
        assert sorted(got.values()) == list(range(n))


def test_longest_walk_ends_where_a_cycle_lies_outside():
    assert any(f.once(x) == x for n in range(1, 40) if (f := Feistel(n)) for x in range(n, f.a * f.b))
    for n in range(1, 40):
        f, most = Feistel(n), 0
        for x in range(n):
            x, steps = f.once(x), 0
            while x >= n:
                x, steps = f.once(x), steps + 1
            most = max(most, steps)
        assert f.longest_walk() == most


def test_place_and_back():
    for n in (1, 5, 200):
        for x in range(n):
            at, slot = place(x, n, 8)
            assert 0 <= at < 8 and number_at(at, slot, n, 8) == x


def test_every_row_with_nulls_ties_and_repeated_rows(spark):
    rows = [(3, "a"), (1, "b"), (None, "c"), (1, "a"), (1, "a"), (None, None), (2, "")]
    schema = "doc_id long, text string"
    runs = [sorted(map(tuple, shard(spark.createDataFrame(rows, schema).repartition(k), shards=3).collect()), key=str) for k in (1, 5)]
    assert runs[0] == runs[1]
    out = shard(spark.createDataFrame(rows, schema), shards=3).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id and r.text) == sorted(r for r in rows if r[0] and r[1])
    assert sorted(r.number for r in out) == sorted(r.position for r in out) == list(range(len(rows)))
    assert [r.doc_id for r in sorted(out, key=lambda r: r.number)] == [1, 1, 1, 2, 3, None, None]
    assert all((r.shard, r.slot) == place(r.number, len(rows), 3) for r in out)


def test_empty_table(spark):
    assert Feistel(0).longest_walk() == 0
    out = shard(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "text", "number", "position", "shard", "slot"] and out.count() == 0


def test_outside_positions_raise():
    for n, x in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            Feistel(n).position(x)
        with pytest.raises(ValueError):
            Feistel(n).row(x)


def test_query_and_oracle(spark):
    columns, got, want = both(spark, "op4_sharding")
    assert got == want and len(got) == 200 and len({r[columns.index("shard")] for r in got}) == SHARDS
