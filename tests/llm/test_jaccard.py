import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import jaccard as J
from quillspan.llm.jaccard import jaccard_join, near_dedup

from .oracle import both

SCHEMA = "doc_id long, text string, a string, size string, th string"


def brute(docs, n=5, t=0.5):
    def grams(text):
        w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    best = {}
    for (x, a), (y, b) in itertools.combinations([(d[0], grams(d[1])) for d in docs if d[0] is not None], 2):
        if a and b and x != y and len(a & b) >= t * len(a | b):
            pair = (min(x, y), max(x, y))
            best[pair] = max(best.get(pair, (0, 0)), (len(a & b) / len(a | b), len(a & b)))
    return {(*p, o, round(j, 9)) for p, (j, o) in best.items()}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ß", "ÜBER", "the", "of"]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 30, 200])) + passage * (rng.random() < 0.5)
        texts.append(" ".join(w))
    return texts


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", "y", "z") for d in docs], SCHEMA)


def classes(docs, n=5, t=0.5):
    """(key, class, links) by brute force; keys are all different."""
    pairs = brute(docs, n, t)
    group = {d: d for d, _ in docs}
    for _ in docs:
        for x, y, *_ in pairs:
            group[x] = group[y] = min(group[x], group[y])
    return {(d, group[d], sum(d in p[:2] for p in pairs)) for d, _ in docs}


SMALL = {"BUCKET_KEYS": 100, "CHUNK_GRAMS": 300, "SLICE_BYTES": 100, "TASK_GRAMS": 200, "PART_GRAMS": 150, "PART_SETS": 4, "CELLS": 50, "DENSE_SETS": 3, "DENSE_CELLS": 30}


@pytest.mark.parametrize(("n", "t", "small"), [(5, 0.5, {}), (5, 0.5, SMALL), (3, 0.8, {"DENSE_SETS": 2}), (1, 0.3, {"PART_SETS": 3})])
def test_against_brute_force(spark, n, t, small, monkeypatch):
    for name, value in small.items():
        monkeypatch.setattr(J, name, value)
    docs = list(enumerate(corpus(n + len(small))))
    got = {tuple(r) for r in jaccard_join(frame(spark, docs).repartition(3), n=n, threshold=t).collect()}
    assert got == classes(docs, n, t) and sum(r[2] for r in got) > 20


def test_a_group_gives_one_row_a_document(spark):
    """Rows and links of near copies of one text, all of them similar to each other."""
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join([*base[:i], "new", *base[i + 1:]])) for i in range(90)] + [(90, " ".join(base)), (91, " ".join(base).upper())]
    got = sorted(tuple(r) for r in jaccard_join(frame(spark, docs)).collect())
    assert got == [(i, 0, 91) for i in range(92)]


def test_nulls_empty_ties_and_repeated_rows(spark):
    a, b = "one two three four five six seven", "one two three four five six eight"
    docs = [(1, a), (1, a), (2, a.upper()), (3, b), (3, "unlike"), (None, a), (4, None), (5, ""), (6, " ... "), (7, "hi"), (8, "Hi!"), (9, "hi hi"), (None, "alone here"), (None, None)]
    got = sorted((tuple(r) for r in jaccard_join(frame(spark, docs)).collect()), key=repr)
    assert got == sorted([(1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 1, 4), (3, 3, 0), (None, 1, 4), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 1), (8, 7, 1), (9, 9, 0), (None, None, 0), (None, None, 0)], key=repr)
    kept = near_dedup(frame(spark, docs[:12])).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (3, "unlike"), (4, None), (5, ""), (6, " ... "), (7, "hi"), (9, "hi hi")], key=repr)


def test_groups_against_brute_force(spark):
    docs = list(enumerate(corpus(7, 80)))
    kept = near_dedup(frame(spark, docs).repartition(3))
    assert kept.columns == ["doc_id", "text", "a", "size", "th"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in classes(docs)})


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(empty).count() == 0 and near_dedup(empty).count() == 0 and near_dedup(empty).columns == empty.columns
    long = " ".join(f"w{i}" for i in range(150_000))
    got = jaccard_join(frame(spark, [(1, long), (2, long + " x"), (3, long[: len(long) // 3])])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


@pytest.mark.parametrize(("cells", "dense"), [(7, 2), (1 << 20, 5), (40, 1000)])
def test_overlaps_against_brute_force(cells, dense, monkeypatch):
    monkeypatch.setattr(J, "CELLS", cells)
    monkeypatch.setattr(J, "DENSE_SETS", dense)
    rng = np.random.default_rng(cells)
    group = np.sort(rng.integers(0, 6, 60))
    sets = [rng.choice(40, rng.integers(1, 30), replace=False).astype(np.uint64) for _ in group]
    got = {}
    for a, b, common in J.overlaps(group, np.array([len(s) for s in sets]), np.concatenate(sets)):
        for x, y, z in zip(a.tolist(), b.tolist(), common.tolist(), strict=True):
            assert (x, y) not in got
            got[x, y] = z
    want = {(x, y): len(np.intersect1d(sets[x], sets[y])) for x, y in itertools.combinations(range(60), 2) if group[x] == group[y]}
    assert got == {p: z for p, z in want.items() if z}


def test_packed_grams():
    grams = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 500, np.uint64))
    assert (J.unpack(J.pack(grams)) == grams).all()


def test_gram_sets():
    sets = list(J.gram_sets(pa.array(["a b c d e f", "A b, c-d e f", None, "", "a b c d e"])))
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1] and (sets[0] == sets[1]).all() and np.isin(sets[4], sets[0]).all()


def test_query_and_oracle(spark):
    _, got, want = both(spark, "op1_jaccard_join")
    assert got == want and len(got) > 5


def test_parts_of_a_large_group_meet_once_and_each_round_moves_a_row_twice_at_most(spark):
    for parts in (2, 5, 6):
        rows = spark.createDataFrame([(p, parts) for p in range(parts)], "part long, parts long")
        met = []
        for r in range(parts // 2 + 1):
            units = [(x.part, x.unit.i, x.unit.j) for x in J._rounds(rows, r, r).collect()]
            assert len(units) <= 2 * parts
            met += units
        assert sorted(met) == sorted((p, i, j) for i in range(parts) for j in range(i, parts) for p in {i, j})
        assert sorted(met) == sorted((x.part, x.unit.i, x.unit.j) for x in J._rounds(rows, 0, parts).collect())


def test_a_large_group_takes_several_jobs(spark, monkeypatch):
    texts = [" ".join(f"w{k}" for k in range(40)) + f" x{i} y{i}" for i in range(30)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    monkeypatch.setattr(J, "PART_SETS", 5)
    written, plain = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, name: written.append(name) or plain(df, name))
    got = J.jaccard_join(docs).collect()
    assert {(r.class_id, r.links) for r in got} == {(0, 29)} and len(got) == 30
    assert written.count("linked") >= 4
