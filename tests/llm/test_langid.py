import zlib

from lumenq.llm import langid

from .cases import SCHEMA, rows


def test_held_out_accuracy_and_und(spark):
    data = rows(400)
    docs = spark.createDataFrame(data, SCHEMA)
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == len(data)
    truth = {r[0]: r for r in data}
    scored = [r for r in got if r.held_out and truth[r.doc_id][2] and any(c.isalpha() for c in truth[r.doc_id][1]) and len(truth[r.doc_id][1]) > 30]
    assert sum(r.lang_pred == truth[r.doc_id][2] for r in scored) >= 0.95 * len(scored) > 20
    for r in got:
        text = truth[r.doc_id][1] or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) or r.doc_id is None
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1


def test_whole_operator_by_hand(spark):
    """Counts, tables, backoff and totals word by word in plain dictionaries."""
    import math
    import re
    from collections import Counter

    data = rows(120)
    docs = spark.createDataFrame(data, SCHEMA)
    split = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    grams = lambda word, n: [word[i : i + n] for i in range(len(word) - n + 1)]
    counts = {k: {} for k in (0, *langid.ORDERS)}
    for r in data:
        if r[2] and r[1] is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5:
            for word in split(r[1]):
                for k in counts:
                    counts[k].setdefault(r[2], Counter()).update([word] if k == 0 else grams(word, k))
    langs = sorted(counts[0])
    distinct = {k: len(set().union(*counts[k].values())) for k in counts}

    def value(k, key, x):
        c = counts[k].get(x, Counter())
        return math.log((c[key] + langid.ADD) / (c.total() + langid.ADD * (distinct[k] + 1)))

    def known(k, key):
        return any(key in c for c in counts[k].values())

    texts = [r[1] for r in data] + ["the rivière zzqx haus", "Forêts walkingly 12 ~ überhausen x", "Ωμ 漢字"]
    names, scores = langid.predict(texts, langid.learn(docs))
    for text, name, score in zip(texts, names, scores, strict=True):
        total = dict.fromkeys(langs, 0.0)
        for word in split(text):
            for k in (0, *langid.ORDERS):
                mine = [g for g in ([word] if k == 0 else grams(word, k)) if known(k, g)]
                if mine:
                    for x in langs:
                        total[x] += sum(value(k, g, x) for g in mine) / len(mine)
                    break
        top = max(total.values())
        want = 1 / sum(math.exp(max(v - top, -50)) for v in total.values()) if re.search(r"[^\W\d_]", text or "") else 0
        assert abs(score - want) < 1e-6 and (name == "und" or abs(total[name] - top) < 1e-6)


def test_every_language_is_learned(spark):
    data = [(i, f"wort{i // 4} stadt{i // 4} haus{i // 4}", f"l{i // 4}") for i in range(2400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.learn(docs, per_lang=50)
    assert len(model["langs"]) >= 599
    got = langid.identify(docs, model).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(got)


def test_one_very_long_text(spark):
    docs = spark.createDataFrame([(1, "maison rivière " * 200_000, "fr"), (2, "haus und straße", "de"), (3, "la maison", "fr"), (7, "das haus", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(docs, fold=None)).collect()}
    assert got[1] == "fr" and got[2] == "de"


def test_without_training_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    model = langid.learn(docs)
    assert langid.identify(docs, model).count() == 0
    assert langid.predict(["abc", None], model)[0] == ["und", "und"]
