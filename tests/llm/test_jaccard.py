import random
import re
from collections import Counter

import numpy as np

from lumenq.llm import jaccard
from lumenq.llm.components import components

from .cases import SCHEMA, rows, sentence

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(data):
    sets = []
    for r in data:
        words = [w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for w in WORD.findall((r[1] or "").encode())]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    n, links, parent = len(sets), Counter(), list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return Counter((r[0], least.get(top(i)) if sets[i] else r[0], links[i]) for i, r in enumerate(data))


def near_copies(n, seed, words=120, edits=4):
    rng = random.Random(seed)
    base = sentence(rng, "en", words).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        yield " ".join(w)


def test_links_match_brute_force(spark, monkeypatch):
    data = rows(80)
    for k in range(4):
        data += [(10_000 + 100 * k + i, t, *[None] * 7) for i, t in enumerate(near_copies(25, k))]
    got = jaccard.join(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == brute(data)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    again = jaccard.join(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter(tuple(r) for r in again) == brute(data)


def test_a_long_chain_is_compared_by_buckets(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2100)]
    data = [(i, " ".join(words[5 * i : 5 * i + 100]), *[None] * 7) for i in range(400)] + rows(20)
    data += [(20_000 + i, t, *[None] * 7) for i, t in enumerate(near_copies(30, 5))]
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "MANY", 2)
    chosen, by_bucket = [], jaccard._by_bucket
    monkeypatch.setattr(jaccard, "_by_bucket", lambda *a: chosen.append(by_bucket(*a)) or chosen[-1])
    got = jaccard.join(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == brute(data)
    assert chosen[0][1].select("node").distinct().count() >= 390


def test_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter(tuple(r) for r in jaccard.join(docs).collect())
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_empty_and_copies_only(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(i, "same words here") for i in range(50)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard.join(docs).collect()} == {(i, 0, 49) for i in range(50)}


def test_keep_one_leaves_one_of_each_group(spark):
    data = rows(60)
    kept = jaccard.keep_one(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = Counter(r.doc_id for r in kept.collect())
    want = {c for _, c, _ in brute(data)}
    assert set(got) == want
    assert all(n == 1 for i, n in got.items() if i is not None)


def test_keep_one_with_ids_that_repeat(spark):
    a, b, c = ("one two three four five six", "quite another text with words", "a third one that none repeats")
    keep = lambda data: sorted((tuple(r) for r in jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string, n int")).collect()), key=str)
    # 5 has a copy of 1 and a text of its own
    assert keep([(1, a, 0), (5, a, 0), (5, b, 0)]) == [(1, a, 0), (5, b, 0)]
    # null ids: a copy goes, the others stay
    assert keep([(3, a, 0), (None, a, 0), (None, c, 0), (None, "", 0), (None, "", 0)]) == sorted([(3, a, 0), (None, c, 0), (None, "", 0), (None, "", 0)], key=str)
    # one row of equal words and id, and always the same one
    assert len(keep([(7, a, 1), (7, a.upper(), 2), (7, a, 3)])) == 1
    assert keep([(7, a, 1), (7, a, 3), (8, b, 0)]) == keep([(8, b, 0), (7, a, 3), (7, a, 1)])
    assert keep([(None, a, 0), (None, a, 0)]) == [(None, a, 0)]


def test_recall_on_a_larger_table(spark, sf):
    """All pairs of sf0.01 that share a shingle, counted exactly."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sets, where = {}, {}
    for i, text in data:
        words = [w.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for w in WORD.findall((text or "").encode())]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    both, links = Counter(), Counter(dict.fromkeys(sets, 0))
    for members in where.values():
        both.update((x, y) for k, x in enumerate(members) for y in members[:k])
    for (x, y), n in both.items():
        if n >= 0.8 * (len(sets[x]) + len(sets[y]) - n) - 1e-9:
            links[x] += 1
            links[y] += 1
    assert {r.doc_id: r.n_links for r in jaccard.join(docs).collect()} == dict(links) and sum(links.values()) > 100


def test_least_matches_is_the_posterior_rule():
    """Against numeric integration of the posterior."""
    x = np.linspace(0, 1, 200_001)
    for n in (16, 64):
        for m in (jaccard.least_matches(n, 0.8, 1e-6), jaccard.least_matches(n, 0.8, 1e-6) - 1):
            logs = m * np.log(np.maximum(x, 1e-300)) + (n - m) * np.log(np.maximum(1 - x, 1e-300))
            density = np.exp(logs - logs.max())
            tail = density[x >= 0.8].sum() / density.sum()
            assert (tail >= 1e-6) == (m == jaccard.least_matches(n, 0.8, 1e-6))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}
