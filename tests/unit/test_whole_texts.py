"""Queries read texts to their end."""

from collections import Counter

from lumenq.plans import QUERIES, image_queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_metrics_of_whole_texts(spark, tmp_path):
    same = "same words " * 60
    turns = [(1, 0, same + "one two three"), (1, 1, same + "one four"), (2, 0, "كتاب\nبيت"), (2, 1, "كتاب\nباب"), (3, 0, "ab cd"), (3, 1, "ab cd")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    text = {(c, t): " ".join(x.split()) for c, t, x in turns}
    want = {}
    for c in (1, 2, 3):
        t, r = text[c, 0], text[c, 1]
        hits = sum((Counter(t.split()) & Counter(r.split())).values())
        want[c * 1000] = (hits / len(t.split()), edits(r, t) / len(t), edits(r.split(), t.split()) / len(t.split()))
    got = {r.pair_id: r for r in QUERIES["wer"](spark, str(tmp_path)).collect()}
    assert {k: (r.wer, r.truth_words, r.result_words) for k, r in got.items()} == {c * 1000: (round(want[c * 1000][2], 9), len(text[c, 0].split()), len(text[c, 1].split())) for c in (1, 2, 3)}
    mean = QUERIES["evaluation_averages"](spark, str(tmp_path)).first()
    assert (mean.n, mean.recall, mean.cer, mean.wer) == (3, *(round(sum(w[i] for w in want.values()) / 3, 9) for i in range(3)))


def test_every_letter_of_an_item_is_decoded(spark, tmp_path):
    text = "river stone " * 10
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    filler = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "qz" for i in range(2100)]  # more frequent than the item's words
    spark.createDataFrame([(" ".join(filler * 3 + ["riverstone"] * 2),)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["word_break"](spark, str(tmp_path)).collect()
    assert [r.text for r in got] == [" ".join(["riverstone"] * 10)]


def test_words_of_any_length_are_decoded(spark, tmp_path):
    words = ["a", "sea", "stones", "mountains", "neighbourhoods", "characteristically"]
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(" ".join(words),)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    one = {r.word: (r.text, r.conf) for r in QUERIES["dictionary_decode"](spark, str(tmp_path)).collect()}
    joined = {r.text: r.conf for r in QUERIES["dictionary_joins"](spark, str(tmp_path)).collect()}
    assert set(one) == set(joined) == set(words)
    assert all(one[w] == (w, joined[w]) for w in words)
    for name in ("beam_search", "viterbi"):
        assert {r.word for r in QUERIES[name](spark, str(tmp_path)).collect()} == set(words)


def test_pages_hold_all_letters(spark, tmp_path):
    text = "river stone light " * 15 + "x" * 40
    parts = image_queries.page_texts(text)
    assert "".join(parts).replace(" ", "") == text.replace(" ", "") and max(map(len, parts)) <= 100
    assert image_queries.page_texts(None) == [""]
    spark.createDataFrame([(1, text), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["page_layout"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.page_idx) for r in got) == [*((1, k) for k in range(len(parts))), (2, 0)]
    assert image_queries.of_items(spark, str(tmp_path), lambda rows, key: rows.select(key, rows.page_idx.cast("string").alias("text"))).where("item_id = 1").first().text == "\n".join(map(str, range(len(parts))))
