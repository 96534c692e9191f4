import random

import numpy as np

from lumenq.llm import decontam

from .cases import SCHEMA, rows, sentence


def plain_align(a, b):
    """Best local score by the full table."""
    best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_the_full_table():
    rng = random.Random(4)
    for _ in range(200):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))])
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))])
        score, first, last = decontam.align(a, b)
        assert score == plain_align(a, b)
        if score:
            assert 0 <= first < last <= len(b)
            assert plain_align(a, b[first:last]) == score


def edited(rng, text, share):
    out = []
    for w in text.split():
        dice = rng.random()
        out += [] if dice < share / 3 else [w.upper(), "new"] if dice < share * 2 / 3 else ["other"] if dice < share else [w]
    return " ".join(out)


def test_finds_copies_and_edits_and_nothing_else(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 60)))) for k in range(30)]
    items += [(90, items[3][1]), (91, "too short"), (92, None), (None, "no id at all but words enough here")]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    data, want = [], set()
    for k in range(200):
        text = noise(rng.randrange(0, 300))
        if k % 4 == 0:
            item = rng.randrange(30)
            text += ".\n" + edited(rng, items[item][1], rng.choice([0, 0.1, 0.2])) + "! " + noise(40)
            want.add((k, item))
        data.append((k, text, *[None] * 7))
    data += [(1000 + i, r[1], *r[2:]) for i, r in enumerate(rows(30))]
    docs = spark.createDataFrame(data, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id is not None} == want
    assert all(0.5 <= r.score <= 1 for r in got)
    left = decontam.clean(docs, bench)
    assert left.schema == docs.schema
    assert {r.doc_id for r in left.collect()} == {r[0] for r in data} - {d for d, _ in want}


def test_hot_item_and_blocks(spark, monkeypatch):
    """An item in most texts is still found, and blocks give the same."""
    rng = random.Random(2)
    items = [(k, sentence(rng, "en", 30)) for k in range(8)]
    data = [(k, (items[0][1] if k % 3 else items[k % 7 + 1][1]) + " tail words", *[None] * 7) for k in range(120)]
    docs, bench = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert {(k, 0 if k % 3 else k % 7 + 1) for k in range(120)} <= one
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    assert one == {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}


def test_recall_against_all_alignments(spark, sf):
    """Every item against every text, copies with 10, 20 and 30 % of the words edited among them."""
    import pyarrow as pa

    rng = random.Random(31)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    for k in range(90):
        base = texts[k % len(texts)][1] or ""
        texts.append((100_000 + k, base[:800] + "\n" + edited(rng, items[k % len(items)][1], (0.1, 0.2, 0.3)[k % 3]) + "\n" + base[800:1600]))
    held = decontam.Items(items)
    keys, owner = decontam.words(*decontam.text_bytes(pa.array([t for _, t in texts], pa.string())))
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    want = set()
    for name, words in zip(held.ids, held.words, strict=True):
        need = decontam.SHARE * min(len(words), decontam.PASSAGE)
        for i, (doc, _) in enumerate(texts):
            mine = keys[cut[i] : cut[i + 1]]
            if np.isin(mine, words).sum() >= need and decontam.align(words, mine)[0] >= need:
                want.add((doc, name))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert len({d for d, _ in got if d >= 100_000}) >= 80


def test_items_without_id_and_long_texts(spark):
    rng = random.Random(6)
    item = " ".join(f"w{rng.randrange(2000)}" for _ in range(40))
    docs = spark.createDataFrame([(1, "pad words " * 300_000 + item + " more" * 1000), (None, item), (2, "pad words"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()), key=str) == [(1, None), (None, None)]
    assert [r.doc_id for r in decontam.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_empty(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0
    full = spark.createDataFrame(rows(10), SCHEMA)
    assert decontam.clean(full, bench).count() == len(rows(10))
