import numpy as np
import pytest

from lumenq.llm import mixing

from .cases import SCHEMA, rows


def test_marginals_and_budget(spark):
    docs = spark.createDataFrame(rows(300), SCHEMA)
    targets = {"source": {"src0": 0.5, "src1": 0.2}, "lang": {"en": 0.2, "fr": 0.5}}
    got = mixing.mix(docs, targets=targets, budget=0.3).toPandas()
    assert len(got) == len(rows(300))
    mass = got.n_tokens * got.weight
    share = mass.groupby(got.source).sum() / mass.sum()
    assert share["src0"] == pytest.approx(0.5, abs=0.02) and share["src1"] == pytest.approx(0.2, abs=0.02)
    share = mass.groupby(got.lang).sum() / mass.sum()
    assert share["fr"] == pytest.approx(0.5, abs=0.02)
    assert (got.n_tokens * got.probability).sum() == pytest.approx(0.3 * got.n_tokens.sum(), rel=1e-3)
    assert got.probability.between(0, 1).all()
    known = got[got.doc_id.notna() & (got.n_tokens < 500)]
    assert (known.n_tokens * known.selected).sum() == pytest.approx((known.n_tokens * known.probability).sum(), rel=0.25)


def test_raking_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    cells = [(s, x, t) for s in "abc" for x in "de" for t in "fgh"]
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"d": 0.6, "e": 0.4}, "topic": {"f": 0.1, "g": 0.2, "h": 0.7}}
    now = dict(zip(cells, tokens, strict=True))
    for _ in range(mixing.SWEEPS):
        for d, name in enumerate(mixing.DIMENSIONS):
            for v, share in targets[name].items():
                mine = [c for c in cells if c[d] == v]
                have = sum(now[c] for c in mine)
                for c in mine:
                    now[c] *= share * tokens.sum() / have
    assert mixing.rake(cells, tokens, targets) == pytest.approx([now[c] for c in cells], rel=1e-6)


def test_many_cells_go_the_other_way_to_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows(60), SCHEMA)
    monkeypatch.setattr(mixing, "SWEEPS", 3)
    one = mixing.mix(docs).toPandas()
    monkeypatch.setattr(mixing, "CELLS", 0)
    other = mixing.mix(docs).toPandas()
    order = ["doc_id", "n_tokens", "topic"]
    one, other = (x.sort_values(order).reset_index(drop=True) for x in (one, other))
    assert (one.weight - other.weight).abs().max() < 1e-6
    assert (one.probability - other.probability).abs().max() < 1e-6


def test_sample_keeps_columns_and_whole_budget_keeps_all(spark):
    docs = spark.createDataFrame(rows(40), SCHEMA)
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.sample(docs, budget=1.0).count() == len(rows(40))
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = docs.withColumnRenamed("kept", "mix").withColumnRenamed("part", "cell")
    assert mixing.sample(clash).columns == clash.columns


def test_every_probability_and_draw_match_a_plain_loop(spark):
    """The whole operator, row by row, against dictionaries."""
    import hashlib
    import re

    data = rows(150)
    got = {(r.doc_id, r.source, r.lang, r.topic, r.n_tokens): r for r in mixing.mix(spark.createDataFrame(data, SCHEMA), budget=0.4).collect()}
    table = []
    for r in data:
        text = r[1] or ""
        n, words = max(len(text), 1), len(re.findall(r"[^\x20\x09-\x0D]+", text))
        many = [sum(c in s for c in text) for s in ("|", "#*$%&<>{}=", "0123456789")]
        topic = "none" if not words else "table" if many[0] * 40 > n else "symbols" if many[1] * 12 > n else "numbers" if many[2] * 8 > n else "short" if n < 600 else "prose"
        table.append((r[0], r[3] or "", r[2] or "", topic, words))
    assert set(got) == set(table)
    cells = {}
    for _, s, x, t, n in table:
        cells[s, x, t] = cells.get((s, x, t), 0) + n
    total, now = sum(cells.values()), {c: float(n) for c, n in cells.items()}
    goals = []
    for d, e in enumerate((0.5, 0.7, 0.8)):
        own = {}
        for c, n in cells.items():
            own[c[d]] = own.get(c[d], 0) + n
        powered = {v: n**e for v, n in own.items() if n}
        goals.append({v: p / sum(powered.values()) for v, p in powered.items()})
    for _ in range(400):
        for d in range(3):
            have = {}
            for c, n in now.items():
                have[c[d]] = have.get(c[d], 0) + n
            now = {c: n * goals[d].get(c[d], 0) * total / have[c[d]] if have[c[d]] else n for c, n in now.items()}
    weight = {c: now[c] / n if n else 1.0 for c, n in cells.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * weight[c]) for c, n in cells.items()) < 0.4 * total else (low, mid)
    for key in table:
        i, c, r = key[0], key[1:4], got[key]
        p = min(1, high * weight[c])
        assert r.weight == pytest.approx(weight[c], rel=1e-5) and r.probability == pytest.approx(p, rel=1e-5)
        number = int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.selected == (number < r.probability)


def test_targets_that_the_data_do_not_have(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", f"s{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string")
    share = lambda t: {r.source: r.n_tokens * r.weight / 12 for r in mixing.mix(docs, targets=t).dropDuplicates(["source"]).collect()}
    # the share of zz goes to s0; s1 and s2 keep theirs of what is left
    got = share({"source": {"zz": 0.5, "s0": 0.3}})
    assert got["s0"] == pytest.approx(0.8) and got["s1"] == pytest.approx(0.1) and got["s2"] == pytest.approx(0.1)
    assert share({"source": {"zz": 1.0}}) == pytest.approx({"s0": 1 / 3, "s1": 1 / 3, "s2": 1 / 3})
    contrary = spark.createDataFrame([(1, "a b", "en", "s0"), (2, "a b", "fr", "s1")], docs.schema)
    with pytest.warns(UserWarning, match="targets are not met"):
        mixing.mix(contrary, targets={"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.1, "fr": 0.9}}).count()


def test_sampling_by_many_cells_draws_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame(rows(50), SCHEMA).drop("kept")
    monkeypatch.setattr(mixing, "SWEEPS", 3)
    ids = lambda: sorted((r.doc_id is not None, r.doc_id or 0) for r in mixing.sample(docs, budget=0.5).collect())
    one = ids()
    monkeypatch.setattr(mixing, "CELLS", 0)
    assert ids() == one
    assert one == sorted((r.doc_id is not None, r.doc_id or 0) for r in mixing.mix(docs, budget=0.5).where("selected").collect())
