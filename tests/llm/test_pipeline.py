import random

import corpus_pipeline
from quillspan.llm import packing as P
from quillspan.llm import quality as Q
from quillspan.llm import toxicity as T

from .test_jaccard import brute as brute_pairs
from .test_packing import brute as brute_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160):
    rng = random.Random(11)
    words = [a + b for a in ("lo", "mi", "ra", "tu", "se", "an") for b in ("na", "ket", "dor", "li", "s", "men")]
    docs, labels = [], []
    for i in range(n):
        kind = rng.choice(["clean", "clean", "clean", "toxic", "poor", "copy", "near"])
        w = rng.choices(words, k=rng.randrange(40, 120))
        if kind == "toxic":
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "vilest", "vileness"]))
        elif kind == "poor":
            w = [x + rng.choice(["%%%", "***", "$$$"]) for x in w]
        elif kind in ("copy", "near") and docs:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            if kind == "near":
                w[rng.randrange(len(w))] = "other"
        text = " ".join(w)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int("%%%" not in text and "***" not in text and "$$$" not in text), int("vile" in text)))
    return docs + [(None, None, None, None, None), (900, "", "en", "s", 0)], labels


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, labels = corpus()
    write(spark, folder, docs, labels)
    frame, said = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, folder)
        got, before = out.collect(), {r.doc_id: r.text for r in frame.collect()}
        kept = {r.doc_id for r in got}
        if name == "toxicity":
            assert kept == {r.doc_id for r in T.toxicity(frame, said).collect() if not r.toxic}
            wrong = [i for i, _, toxic in labels if (i in kept) == bool(toxic)]
            assert len(wrong) <= 2
        elif name == "quality":
            assert kept == {r.doc_id for r in Q.quality(frame, said).collect() if r.keep}
            assert not [i for i, good, _ in labels if good and i in before and i not in kept]
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before, key=lambda d: (d is None, d)):
                first.setdefault(before[d], d)
            assert kept == set(first.values()) and len(got) == len(first)
        elif name == "near_dedup":
            group = {d: d for d in before}
            pairs = brute_pairs([(d, t) for d, t in before.items() if d is not None])
            for _ in before:
                for a, b, *_ in pairs:
                    group[a] = group[b] = min(group[a], group[b])
            assert kept == set(group.values()) and len(kept) < len(before)
        else:
            placed = {(r.doc_id, r["first"]): (r.shard, r.window, r.place, r.words) for r in got if r.doc_id is not None}
            assert len(got) == len(before) and all(r.words == 0 for r in got if r.doc_id is None)
            known = {d: t for d, t in before.items() if d is not None}
            if None not in before:
                assert placed == brute_packing(list(known.items()), {r.doc_id: r.shard for r in got}, P.WINDOW)
            break
        assert out.columns == frame.columns
        out.write.parquet(f"{folder}/stage{number}")
        frame = spark.read.parquet(f"{folder}/stage{number}")
    final = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, r["first"]) for r in final.collect()} == {(r.doc_id, r["first"]) for r in got}


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
