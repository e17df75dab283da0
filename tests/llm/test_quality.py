import random

import numpy as np
import pyarrow as pa

from quillspan.llm import quality as Q
from quillspan.llm import queries

SCHEMA = "doc_id long, text string, score string, x string"


def corpus(seed, n):
    rng = random.Random(seed)
    words = [a + b for a in ("lo", "mi", "ra", "tu", "se", "an") for b in ("na", "ket", "dor", "li", "s", "men")]
    texts, good = [], []
    for _ in range(n):
        w = rng.choices(words, k=rng.randrange(20, 150))
        poor = rng.random() < 0.3
        if poor:
            w = rng.choice(([x + "%%%" for x in w], w[:2] * len(w), [x.upper() + "!!" for x in w], [f"{x} |" for x in w]))
        texts.append(" ".join(w) + ".")
        good.append(int(not poor))
    return texts, good


def test_features_against_plain_python():
    texts = ["One two  two\nONE 12 $%", "", None, "a\na\nb", "..."]
    f = Q.text_features(pa.array(texts))
    assert f.shape == (5, len(Q.NAMES)) and not f[[1, 2, 4]].any()
    t = texts[0]
    assert np.allclose(f[0, [0, 1, 2, 3, 4, 6, 7, 9, 10]], [np.log1p(5), 2 / len(t), 2 / len(t), 4 / len(t), len(t) / 5, 1 / 5, 1 / 5, 0, 5 / len(t)])
    assert abs(f[3, 8] - 1 / 3) < 1e-9 and abs(f[3, 11] - 2 / 3) < 1e-9


def test_pairs_against_plain_gradient_descent():
    rng = np.random.default_rng(0)
    good, poor = rng.normal(0.5, 1, (80, len(Q.NAMES))), rng.normal(0, 1, (60, len(Q.NAMES)))
    m = Q.fit_pairs(good, poor)
    gen = np.random.default_rng(0)
    n = Q.PAIRS_EACH * 80
    i, j = np.resize(gen.permutation(80), n), gen.integers(0, 60, n)
    d = m.expand(good)[i] - m.expand(poor)[j]
    gradient = d.T @ (1 / (1 + np.exp(d @ m.weights))) / n - Q.RIDGE * m.weights
    assert np.abs(gradient).max() < 1e-5
    assert not Q.fit_pairs(good, poor[:0]).weights.any()


def test_held_out_and_edge_cases(spark):
    texts, good = corpus(5, 500)
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, texts[0], "a", "b"), (600, None, "a", "b"), (601, "", "a", "b"), (602, texts[1] * 3000, "a", "b"), (7, texts[7], "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, good[i]) for i in range(250)] + [(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    out = Q.quality(docs, labels)
    assert out.columns == ["doc_id", "score", "keep"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.keep for r in got}
    right = [by[i] == bool(good[i]) for i in range(250, 500)]
    assert np.mean(right) > 0.97
    kept = Q.drop_poor(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    assert Q.quality(docs, labels.where("quality = 1")).where("keep").count() == len(rows)
    assert Q.quality(docs.limit(0), labels).count() == 0


def test_query_on_labelled_documents(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r.keep for r in queries.op6_quality(spark, d).collect()}
    said = duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet' where quality is not null").fetchall()
    assert len(got) == 1000
    assert np.mean([got[i] for i, q in said if q]) > 0.97 and np.mean([not got[i] for i, q in said if not q]) > 0.6
