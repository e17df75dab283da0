import random

import numpy as np
import pyarrow as pa

from quillspan.llm import fingerprint as P
from quillspan.llm import queries


def texts(seed, n):
    rng = random.Random(seed)
    words = [a + b for a in ("lo", "mi", "ra", "tu") for b in ("na", "ket", "dor", "")]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.choice([1, 2, 40, 300]))
        out.append(" ".join(w))
    return out


def plain_digest(t):
    raw = t.encode()
    counts = [0] * 128
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a << 16 | b << 8 | c) * 2654435761 % 2**32
        h = (h ^ h >> 15) * 2246822519 % 2**32 >> 25
        counts[h] += 1
    q = [sorted(counts)[32 * k - 1] for k in (1, 2, 3)]
    return [P.length_code(len(raw))] + [sum(c > x for x in q) for c in counts]


def plain_score(a, b):
    return sum(abs(x - y) for x, y in zip(a, b, strict=True))


def test_digests_against_plain_python():
    sample = [t for t in texts(1, 90) if len(t) > 2][:60] + ["abc", "aaaaaaa", "é日本"]
    got = list(P.digests(pa.array([*sample, "ab", "", None])))
    assert got[-3:] == [None] * 3
    want = [plain_digest(t) for t in sample]
    for d, w in zip(got, want, strict=False):
        assert [d[0]] + [d[1 + i // 4] >> 2 * (i % 4) & 3 for i in range(128)] == w
    for i in range(0, 60, 7):
        for j in range(60):
            assert P.score(got[i], got[j], 10**6) == plain_score(want[i], want[j])


def test_neighbours_against_brute_force(spark):
    sample = texts(2, 120)
    rows = list(enumerate(sample)) + [(None, sample[0]), (500, ""), (501, None), (3, sample[3])]
    d = [plain_digest(t) if t and len(t.encode()) >= 3 else None for _, t in rows]
    out = sorted(map(tuple, P.fingerprints(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")).select("doc_id", "matches", "nearest", "score").collect()), key=str)
    want = []
    for i, (k, _) in enumerate(rows):
        near = sorted((plain_score(d[i], d[j]), rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if j != i and d[i] and d[j] and abs(d[i][0] - d[j][0]) <= 1 and plain_score(d[i], d[j]) <= P.BOUND)
        want.append((k, len(near), None if not near or near[0][1] else near[0][2], near[0][0] if near else None))
    assert out == sorted(want, key=str) and sum(w[3] not in (None, 0) for w in want) > 5


def test_length_codes_that_differ_by_more_than_one(spark):
    sample = ["abc", "abcd", "abcde", "aaa", "aaaa", "aaaaa", "aaaaaa", "é", "éé", "nadornadorna", "nadornadornador", "nadornadornadornador"] + [w * n for w in ("tuket", "mi ra ", "lo") for n in (2, 3, 4, 5)] + texts(5, 40)
    d = [plain_digest(t) if len(t.encode()) >= 3 else None for t in sample]
    want = []
    for i in range(len(sample)):
        near = sorted((plain_score(d[i], d[j]), j) for j in range(len(sample)) if j != i and d[i] and d[j] and plain_score(d[i], d[j]) <= P.BOUND)
        want.append((i, len(near), near[0][1] if near else None, near[0][0] if near else None))
    apart = [abs(x[0] - y[0]) for x in d for y in d if x and y and plain_score(x, y) <= P.BOUND]
    assert {2, 3, 4, 5} <= set(apart)
    got = P.fingerprints(spark.createDataFrame(list(enumerate(sample)), "doc_id long, text string")).select("doc_id", "matches", "nearest", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_empty_table(spark):
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    got = queries.op2_fingerprints(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    d = {k: plain_digest(t) for k, t in text.items()}
    assert len(got) == 200
    for r in got:
        near = sorted((plain_score(d[r.doc_id], d[j]), j) for j in d if j != r.doc_id and abs(d[r.doc_id][0] - d[j][0]) <= 1)
        near = [x for x in near if x[0] <= P.BOUND]
        assert (r.matches, r.nearest, r.score) == (len(near), near[0][1] if near else None, near[0][0] if near else None)
    assert np.mean([r.matches > 0 for r in got]) > 0.02
