import random
from collections import Counter

import pytest

from .cases import SCHEMA, rows, sentence

pipeline = pytest.importorskip("corpus_pipeline")

from lumenq.llm import decontam, jaccard, mixing, quality  # noqa: E402


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    now, columns = docs, docs.columns
    for (name, stage), number in zip(pipeline.STAGES, (4, 7, 5, 2, 8), strict=True):
        out = stage(spark, now, sf).cache()
        ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
        if number == 4:
            assert ids(out) == ids(quality.judge(now, quality.train(now, labels)).where("kept"))
        if number == 7:
            assert ids(out) == sorted({r.class_id for r in jaccard.join(now).collect()})
        if number == 5:
            bad = {r.doc_id for r in decontam.contaminated(now, bench).collect()}
            assert ids(out) == [i for i in ids(now) if i not in bad]
        if number == 2:
            assert ids(out) == ids(mixing.mix(now).where("selected"))
        if number == 8:
            assert ids(out) == ids(now) and "shard" in out.columns
        else:
            assert out.columns == columns
        now = out
    assert 0 < now.count() < docs.count()
    assert sorted(pipeline.run(spark, sf).collect()) == sorted(now.collect())


@pytest.fixture
def tables(spark, tmp_path):
    def write(documents, labels=(), benchmark=()):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        for name, data, schema in (("documents", documents, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
            spark.createDataFrame(list(data), schema).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


def test_awkward_rows(spark, tables):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names."""
    data = rows(60)
    a = "one text of more than ten words that has a twin under another id altogether"
    b = "quite another text of more than ten words that nobody else in this table has"
    data += [(9000, a, "en", "s", 1, "x", 1, 2, True), (9001, a, "en", "s", 1, "x", 1, 2, True), (9001, b, "en", "s", 1, "x", 1, 2, False), (9002, sentence(random.Random(1), "en", 60_000), "en", "s", 1, None, None, None, None)]
    folder = tables(data, [(9000, 1, 0), (9000, None, None), (None, 0, 0)], [(1, None), (None, "short")])
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, folder).cache()
        kept = Counter((r.doc_id, r.text) for r in now.collect())
        if name == "near_duplicates":
            assert kept[9000, a] == kept[9001, b] == 1 and not kept[9001, a]
        assert all(t and len(t.split()) >= 10 for _, t in kept)
    assert pipeline.run(spark, folder).count() == now.count() > 0


def test_empty_tables(spark, tables):
    folder = tables([])
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.count() == 0 and out.columns == now.columns
    assert pipeline.run(spark, folder).count() == 0
