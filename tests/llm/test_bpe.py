import base64
import random

import pytest
import tiktoken

from quillspan.llm import bpe, queries

TEXTS = ["", "Hello world's  end\n\n  x", "   ", "don't we'll 123456 ünïcödé 日本語 \U0001f600", "a" * 300, " " * 200 + "b", "\x00\x7f", "<|endoftext|>", "thththererehehe ionionion", "!?!?!?..." * 20]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def both():
    return bpe.vocabulary(), reference()


def random_text(rng):
    return "".join(rng.choices("abcdeftionhr ,.'\n1é日", k=rng.randrange(0, 60)))


def test_against_another_implementation(both):
    v, r = both
    rng = random.Random(0)
    for t in TEXTS + [random_text(rng) for _ in range(500)]:
        got = v.encode(t)
        assert got == r.encode_ordinary(t) and v.decode_bytes(got) == t.encode()


def test_batches_against_another_implementation(both):
    v, r = both
    rng = random.Random(5)
    marks = ["'s", "'re", "'sabc", "''s", " 's", "\n's", "1's", "!'s", "'", " ", "  ", "\n", "\t ", "é", "ÀB", "x", "9", "#", "²", "\xa0", "日", "\x1c", "\x85", "_", "'ll", "'LL", "ª", "×"]
    texts = TEXTS + ["".join(rng.choices(marks, k=rng.randrange(0, 12))) for _ in range(3000)] + [random_text(rng) for _ in range(500)]
    flat, offsets = bpe.encode_batch(v, texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i]: offsets[i + 1]].tolist() == r.encode_ordinary(t), t
    assert bpe.encode_batch(v, [])[1].tolist() == [0]


def test_every_prefix_has_its_last_token(both):
    v, r = both
    for t in ("internationalization", "aaaaaaaaaaaaaaaa", "thereionththe"):
        last = v.extend(t.encode(), [])
        assert last == [r.encode_ordinary(t[: i + 1])[-1] for i in range(len(t))]


def test_appends_and_edits_equal_a_new_encoding(both):
    v, r = both
    rng = random.Random(1)
    e = bpe.Encoded("", v)
    for _ in range(60):
        e.append(random_text(rng)[:7])
        assert e.tokens == r.encode_ordinary(e.text)
    for _ in range(200):
        a = rng.randrange(len(e.text) + 1)
        b = min(len(e.text), a + rng.choice([0, 0, 1, 5]))
        want = e.text[:a] + (new := random_text(rng)[:4]) + e.text[b:]
        e.replace(a, b, new)
        assert e.text == want and e.tokens == r.encode_ordinary(want)
    long = bpe.Encoded("some words here " * 2000, v)
    assert long.replace(16_000, 16_004, "other") < 10 and long.tokens == r.encode_ordinary(long.text)
    with pytest.raises(ValueError):
        long.replace(5, 4, "x")


def test_table(spark, both):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (1, TEXTS[1], "x")], "doc_id long, text string, tokens string")
    out = bpe.decode(bpe.encode(docs), to="again")
    assert out.columns == ["doc_id", "text", "tokens", "again"]
    for r in out.collect():
        assert r.again == r.text and (r.tokens is None) == (r.text is None) and (r.text is None or r.tokens == both[1].encode_ordinary(r.text))
    assert bpe.encode(docs.limit(0)).count() == 0


def test_query_round_trip(spark, both):
    rows = queries.op8_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts) == 200 and all(r.exact for r in rows)
    assert all(r.tokens == both[1].encode_ordinary(texts[r.doc_id]) for r in rows)
