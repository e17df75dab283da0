import math
import random
import re
from functools import lru_cache

import numpy as np

from quillspan.llm import packing as P
from quillspan.llm import queries
from quillspan.llm.common import word_hash


@lru_cache(None)
def slot(word):
    return word_hash(word) >> 42


def brute(docs, shards, window):
    """The packing by its definition, with plain dictionaries; shards: key to shard."""
    counts = {k: {} for k, _ in docs}
    for k, t in docs:
        for w in re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower()):
            w = slot(w)
            counts[k][w] = counts[k].get(w, 0) + 1
    n = {k: sum(c.values()) for k, c in counts.items()}
    df = {}
    for c in counts.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    average = sum(n.values()) / len(docs)
    idf = {w: math.log1p((len(docs) - f + 0.5) / (f + 0.5)) for w, f in df.items()}

    def score(q, d):
        return sum(idf[w] * counts[d][w] * 2.2 / (counts[d][w] + 1.2 * (0.25 + 0.75 * n[d] / average)) for w in counts[q] if w in counts[d])

    out = {}
    for shard in set(shards.values()):
        keys = sorted(k for k in shards if shards[k] == shard)
        at, unused = 0, []
        for k in keys:
            if n[k] > window:
                for i in range(n[k] // window):
                    out[k, i * window] = (shard, at, 0, window)
                    at += 1
            if n[k] <= window or n[k] % window:
                unused.append(k)
        rest = {k: n[k] if n[k] <= window else n[k] % window for k in keys}
        while unused:
            seed = unused.pop(0)
            left, place = window - rest[seed], 1
            out[seed, n[seed] - rest[seed]] = (shard, at, 0, rest[seed])
            for k in sorted(unused, key=lambda k: (-round(score(seed, k), 6), k)):
                if rest[k] <= left:
                    left -= rest[k]
                    out[k, n[k] - rest[k]] = (shard, at, place, rest[k])
                    place += 1
                    unused.remove(k)
            at += 1
    return out


def placed(df):
    return {(r.doc_id, r["first"]): (r.shard, r.window, r.place, r.words) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 20, 60, 100, 130, 333])))) for i in range(90)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, shard string")
    for shard_docs in (1000, 20):
        got = placed(P.pack(df, window=100, shard_docs=shard_docs))
        shards = {k: s for (k, _), (s, *_) in got.items()}
        assert got == brute(docs, shards, 100) and (len(set(shards.values())) > 1) == (shard_docs == 20)
        assert got == placed(P.pack(df.repartition(5), window=100, shard_docs=shard_docs))


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    docs = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, "long " * 95_000), (5, "..."), (None, None)]
    out = P.pack(spark.createDataFrame(docs, schema), window=10_000)
    assert out.columns == ["doc_id", "shard", "window", "place", "first", "words", "score"]
    rows = out.collect()
    assert sum(r.words for r in rows) == 95_008 and len(rows) == len(docs) + 9
    assert sorted(r["first"] for r in rows if r.doc_id == 4) == [10_000 * i for i in range(10)]
    windows = {}
    for r in rows:
        windows[r.shard, r.window] = windows.get((r.shard, r.window), 0) + r.words
    assert max(windows.values()) <= 10_000
    assert P.pack(spark.createDataFrame([], schema)).count() == 0


def test_copies_meet_in_one_shard():
    rng = np.random.default_rng(0)
    idf = rng.uniform(0.1, 9, P.SLOTS).astype(np.float32)
    same = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, P.SLOTS, 300).astype(np.uint32))
        b = np.unique(np.concatenate([a[15:], rng.integers(0, P.SLOTS, 15).astype(np.uint32)]))
        same += P.route(a, idf) == P.route(b, idf)
    assert same > 240


def test_query_uses_every_document_once(spark):
    rows = queries.op9_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {(r.doc_id, r["first"]): (r.shard, r.window, r.place, r.words) for r in rows}
    assert len(got) == len(rows) and got == brute(list(docs.items()), {r.doc_id: r.shard for r in rows}, P.WINDOW)
