import re
from collections import Counter

from lumenq.llm import quality

from .cases import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def check(spark, data, model):
    docs = spark.createDataFrame(data, SCHEMA)
    got = quality.judge(docs, model).collect()
    assert len(got) == len(data)
    want = Counter((r[0], *brute(r[1])) for r in data)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    return got


def test_counts_match_brute_force(spark):
    got = check(spark, rows(), None)
    assert all(r.kept != r.base_failed for r in got)


def test_small_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(quality, "chunks", lambda o: ((i, i + 1) for i in range(len(o) - 1)))
    data, offsets = quality.text_bytes(__import__("pyarrow").array([r[1] for r in rows()]))
    for (i, j, m), r in zip(quality.measured(__import__("pyarrow").array([r[1] for r in rows()])), rows(), strict=True):
        assert (m.n_words[0], m.n_repeat_words[0]) == (brute(r[1])[0], brute(r[1])[4])


def test_empty_table_and_no_labels(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, labels) is None
    assert quality.judge(docs, None).count() == 0
    assert quality.keep_good(docs, None).columns == docs.columns


def test_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 != 0"))
    found = quality.judge(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r for r in found if r.quality == 1 and not r.base_failed]
    bad = [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = quality.keep_good(docs, None)
    assert kept.schema == docs.schema
    assert kept.count() == sum(not brute(r[1])[-1] for r in rows())


def test_labelled_documents_that_occur_many_times(spark):
    """Each labelled document counts once, so no label crowds out the other."""
    good = [(i, f"a fine plain sentence number {i} about rivers and houses") for i in range(40)]
    bad = [(100 + i, f"$$$ || spam {i} && ### <<>> buy now {i}") for i in range(40)]
    docs = spark.createDataFrame((good + bad) * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    model = quality.train(docs, labels, rows=200)
    once = quality.train(spark.createDataFrame(good + bad, docs.schema), labels, rows=200)
    assert model is not None and (model["weights"] == once["weights"]).all()
    p = {r.doc_id: r.p_good for r in quality.judge(docs, model).collect()}
    assert min(p[i] for i in range(40)) > max(p[100 + i] for i in range(40))
