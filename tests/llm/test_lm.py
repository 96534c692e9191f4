import math
import re
import zlib
from collections import Counter

import numpy as np

from lumenq.llm import lm

from .cases import SCHEMA, rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return [*WORD.findall(low), None]


def check_base(data, got):
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in data}
    counts = Counter(t for r in data if not held[r[0]] for t in split(r[1]))
    total = sum(counts.values())
    norm = math.log10(total + 0.5 * (len(counts) + 1))
    want = Counter()
    for r in data:
        t = split(r[1])
        want[r[0], held[r[0]], len(t), sum(counts[x] > 0 for x in t), total, round(sum(math.log10(counts[x] + 0.5) - norm for x in t), 4)] += 1
    assert Counter((*r[:5], round(r.base_score, 4)) for r in got) == want


def test_base_score_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)  # most tokens go the way of the rare ones
    data = rows(200)
    got = lm.score(spark.createDataFrame(data, SCHEMA)).collect()
    check_base(data, got)


def test_better_than_base_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm.score(docs).collect()
    check_base([tuple(r) for r in docs.select("doc_id", "text").collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small(seed=0, words=40):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    head = pa.table({"token": np.arange(1, words + 1), "kind": np.arange(words, dtype=np.int32) % lm.TAIL, "n": np.sort(rng.integers(1, 50, words))[::-1]})
    kinds = {k: (5 + int(sum(n for i, n in enumerate(head.column("n").to_pylist()) if i % lm.TAIL == k)), 3 + len(range(k, words, lm.TAIL))) for k in range(lm.TAIL)}
    return lm.Vocabulary(head, kinds, sum(n for n, _ in kinds.values()), sum(v for _, v in kinds.values()))


def test_symbols_sum_to_one():
    v = small()
    w = lm.views(lm.fresh(v), v)
    h = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    n = len(v.cls)
    logp, _ = lm.output(w, v, np.repeat(h, n, 0), np.arange(n, dtype=np.int32))
    assert abs(np.exp(logp).sum() - 1) < 1e-5


def test_gradients_match_differences():
    v = small()
    rng = np.random.default_rng(2)
    w = {k: (x * 3).astype(np.float64) if k in "xu" else x.astype(np.float64) + rng.normal(0, 0.3, x.shape) for k, x in lm.views(lm.fresh(v), v).items()}
    symbol = rng.integers(0, len(v.cls), (6, 3)).astype(np.int32)
    symbol[4:, 2] = -1
    begin = np.zeros((6, 3), bool)
    begin[0] = begin[3, 1] = True
    h = np.zeros((3, lm.HIDDEN))
    zeros = lambda: {k: np.zeros_like(x) for k, x in w.items()}
    grads = zeros()
    lm.gradients(w, v, h, symbol, begin, grads)
    for k in w:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w[k].shape)
            if k == "x":
                at = (symbol[0, 0], at[1])
            old = w[k][at]
            w[k][at] = old + 1e-5
            up = lm.gradients(w, v, h, symbol, begin, zeros())[0]
            w[k][at] = old - 1e-5
            down = lm.gradients(w, v, h, symbol, begin, zeros())[0]
            w[k][at] = old
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5 * max(1, abs(grads[k][at])), k


def test_steps_are_those_of_plain_adam():
    rng = np.random.default_rng(4)
    n, width = 60, 3 * lm.HIDDEN
    flat = rng.normal(size=n * width + 500).astype(np.float32)
    want, mean, square = flat.astype(np.float64), np.zeros(len(flat)), np.zeros(len(flat))
    adam = lm.Adam(flat, n)
    for t in range(1, 401):  # over several renewals of the decay that is left out
        rows = np.flatnonzero(rng.random(n) < np.where(np.arange(n) < 5, 0.004, 0.3))
        g = rng.normal(0, 3, len(flat)).astype(np.float32)
        with_gradient = np.ones(len(flat), bool)
        with_gradient[: n * width] = np.repeat(np.isin(np.arange(n), rows), width)
        x = np.clip(g * 0.5, -1, 1) * with_gradient
        mean, square = 0.9 * mean + 0.1 * x, 0.99 * square + 0.01 * x * x
        want -= lm.RATE * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        adam.step(g, 0.5, rows)
        assert not g[n * width :].any()
    assert np.abs(flat - want).max() < 1e-4


def test_places_of_hashes():
    rng = np.random.default_rng(5)
    keys = np.unique(np.append(rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.arange(40, dtype=np.uint64) << np.uint64(3)))  # some share their first bits
    for some in (keys, keys[:1], keys[:0], keys[-1:]):
        wanted = np.concatenate([keys, keys + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        at, known = lm.Places(some)(wanted)
        assert (known == np.isin(wanted, some)).all() and (some[at[known]] == wanted[known]).all()


def test_state_is_carried_over_windows(monkeypatch):
    v = small()
    w = lm.views(lm.fresh(v), v)
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, len(v.cls), n).astype(np.int32) for n in (1, 300, 70, 5, 129)]
    whole = lm.log10_probabilities(w, v, pieces)
    monkeypatch.setattr(lm, "WINDOW", 7)
    monkeypatch.setattr(lm, "SCORE_LANES", 2)
    assert np.allclose(whole, lm.log10_probabilities(w, v, pieces), atol=1e-3)
    one = [lm.log10_probabilities(w, v, [p])[0] for p in pieces]
    assert np.allclose(whole, one, atol=1e-3)


def test_every_training_token_is_learned_from_once(spark, monkeypatch):
    rounds, averaged = [], lm._averaged

    def counted(trained, shards):
        rounds.append(sum(r["n"] for r in trained.select("n").collect()))
        return averaged(trained, shards)

    monkeypatch.setattr(lm, "_averaged", counted)
    monkeypatch.setattr(lm, "SHARD", 3000)
    for length in (5, 64, 700):  # less than a piece, one and two pieces with the end token, many
        rounds.clear()
        data = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(length))) for i in range(24)]
        vocabulary, _, _ = lm.learn(spark.createDataFrame([*data, (None, None), (7, "")], "key long, text string").fillna(5, ["key"]))
        assert sum(rounds) == vocabulary.total == 24 * (length + 1) + 2


def test_scores_do_not_depend_on_how_the_table_lies(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 4000)
    docs = spark.createDataFrame(rows(120), SCHEMA)
    order = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 3)) for r in lm.score(df).collect())
    assert order(docs.repartition(1)) == order(docs.repartition(7))


def test_lanes_of_one_very_long_text_stay_small():
    import tracemalloc

    pieces = [np.zeros(1_000_000, np.int32), *[np.zeros(50, np.int32)] * 2000]
    tracemalloc.start()
    lanes = lm.Lanes(pieces, lm.SCORE_LANES)
    seen = sum(int((symbol >= 0).sum()) for symbol, _, _ in lanes.windows(1 << 14))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 1_100_000 and peak < 400 << 20


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
