import random

from pyspark.sql import functions as F

from lumenq.llm import tokens

from .cases import SCHEMA, rows


def encoder():
    with open(tokens.VOCABULARY, "rb") as file:
        return tokens.Encoder(file.read())


def test_edits_count_as_encoding_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 3)
    e, rng = encoder(), random.Random(6)
    bits = ["don't ", "we'll", "'", "re", "  ", "\n", " \n ", "12", "abc", " über", "!?", "\U0001f600", " ", "\t", "x"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        tree = tokens.Tree(text, e)
        assert tree.n_tokens == len(e.encode(text))
        for _ in range(6):
            a, b = sorted(rng.randrange(len(text) + 2) for _ in range(2))
            new = "".join(rng.choice(bits) for _ in range(rng.randrange(4)))
            a, b = min(a, len(text)), min(b, len(text))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text
            assert tree.n_tokens == len(e.encode(text))
            pieces = e.pattern.findall(text)
            assert [int(x) for c, _ in tree.blocks for x in c] == [len(p) for p in pieces]
            assert tree.n_pieces == len(pieces)
            assert tree.sums[0, 1] == len(text)


def test_only_the_edit_is_encoded_again():
    e = encoder()
    tree = tokens.Tree("plain words here and there " * 2000, e)
    tree.edit(20_000, 20_005, "other")
    assert tree.encoded <= 8


def test_counts_and_awkward_rows(spark):
    data = rows(60)
    docs = spark.createDataFrame(data, SCHEMA)
    middle = F.floor(F.length("text") / 2).cast("int")
    edits = F.array(F.struct(middle.alias("start"), (middle + 9).alias("end"), F.lit(" new part").alias("replacement")), F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("").alias("replacement")))
    got = tokens.count(docs, edits).collect()
    e = encoder()
    want = []
    for r in data:
        text = r[1] or ""
        half = len(text) // 2 if r[1] is not None else 0
        new = (text[:half] + " new part" + text[half + 9 if r[1] is not None else half :])[3:]
        want.append((r[0], len(e.encode(text)), len(e.encode(new))))
    key = lambda t: (t[0] is None, t)
    assert sorted(((r.doc_id, r.n_tokens, r.edited_tokens) for r in got), key=key) == sorted(want, key=key)
    assert tokens.count(spark.createDataFrame([], SCHEMA)).count() == 0
    assert all(r.edited_tokens == r.n_tokens and r.reencoded == 0 for r in tokens.count(docs).collect())
