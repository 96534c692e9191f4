import hashlib
import random
from collections import Counter

from lumenq.llm import suffix

from .cases import SCHEMA, rows, sentence


def brute(data):
    """Per distinct (id, text), in order; strings are judged on the input."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    pairs = spark.createDataFrame([(r[0], r[1] or "") for r in data], "i long, t string").selectExpr("i", "t", "xxhash64(t) h").distinct().collect()
    seen, out = set(), {}
    for r in sorted(pairs, key=lambda r: (r.i is not None, r.i or 0, r.h)):
        text = r.t.encode()
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            s = text[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[r.i, r.t] = (r.i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return Counter(out[r[0], r[1] or ""] for r in data)


def data():
    rng = random.Random(3)
    out = rows(70)
    base = [sentence(rng, "en", 80) for _ in range(6)]
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["x", "edit", "zz"])
        a, b = sorted(rng.sample(range(len(w)), 2))
        out.append((5000 + i, " ".join(w[a:b]) + rng.choice(["", sentence(rng, "fr", 20), " ".join(w[:20])]), *[None] * 7))
    return out


def test_matches_brute_force(spark, monkeypatch):
    d = data()
    assert Counter(tuple(r) for r in suffix.remove(spark.createDataFrame(d, SCHEMA).repartition(6)).collect()) == brute(d)
    monkeypatch.setattr(suffix, "GROUP", 2)
    monkeypatch.setattr(suffix, "BITS", 7)  # all buckets collide: more work, the same result
    assert Counter(tuple(r) for r in suffix.remove(spark.createDataFrame(d, SCHEMA)).collect()) == brute(d)


def test_pointers_do_not_depend_on_what_stands_around():
    import numpy as np

    rng = random.Random(1)
    text = sentence(rng, "de", 90).encode()
    alone = suffix.pointers(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    more = suffix.pointers(np.frombuffer(b"abc" * 50 + text, np.uint8), np.array([0, 150, 150 + len(text)]))
    mine = more[3] == 1
    assert (alone[5] == more[5][mine]).all() and (alone[0] + 150 == more[0][mine]).all()
    assert alone[1][-1] == len(text) - 100 and (alone[0][1:] == alone[1][:-1] + 1).all()


def test_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter(tuple(r) for r in suffix.remove(docs).collect())
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_ids_with_two_texts_and_a_passage_in_all(spark, monkeypatch):
    rng = random.Random(8)
    passage = sentence(rng, "en", 40)
    d = [(i // 2 if i % 3 else None, f"{sentence(rng, 'de', rng.randrange(12))} {passage}{sentence(rng, 'fr', rng.randrange(30))}") for i in range(150)]
    d += d[:20]
    docs = spark.createDataFrame(d, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix.remove(docs.repartition(5)).collect()) == brute(d)
    monkeypatch.setattr(suffix, "GROUP", 10)  # the passage's buckets are refined by shuffles
    monkeypatch.setattr(suffix, "_TOGETHER", 1)
    assert Counter(tuple(r) for r in suffix.remove(docs.repartition(5)).collect()) == brute(d)


def test_one_very_long_text(spark):
    rng = random.Random(9)
    text = sentence(rng, "en", 500)
    d = [(1, text + " " + sentence(rng, "fr", 400_000)), (2, sentence(rng, "de", 200) + text), (3, "na " * 200_000)]
    got = {r.doc_id: r for r in suffix.remove(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert got[1].n_bytes > 2 << 20 and got[1].n_removed == 0
    assert (got[2].n_spans, got[2].n_removed >= len(text.encode())) == (1, True)
    assert (got[3].n_spans, got[3].n_removed) == (1, 600_000 - 3)


def test_empty(spark):
    assert suffix.remove(spark.createDataFrame([], SCHEMA)).count() == 0
