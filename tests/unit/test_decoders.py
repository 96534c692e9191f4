import itertools
import math
import random

from pyspark.sql import functions as F

from lumenq.functions import candidates as cd
from lumenq.operators import decode

BIGRAMS = {"بي": 0.9, "با": 0.1, "يت": 0.5, "تا": 0.2}


def random_cands(rng, n):
    return [[(c, rng.random()) for c in rng.sample("ابتي", 3)] for _ in range(n)]


def path_score(path, bigrams):
    return sum(math.log(max(p, 1e-9)) for _, p in path) + 0.3 * sum(math.log(bigrams.get(a + b, 1e-6)) for (a, _), (b, _) in itertools.pairwise(path))


def test_viterbi_is_the_best_path_and_no_beam_beats_it():
    rng = random.Random(1)
    for _ in range(40):
        cands = random_cands(rng, rng.randrange(1, 6))
        path, score = decode.viterbi(cands, BIGRAMS)
        best = max(path_score(p, BIGRAMS) for p in itertools.product(*cands))
        assert abs(score - best) < 1e-9 and len(path) == len(cands)
        for width in (1, 3, 5):
            assert decode.beams(cands, BIGRAMS, width)[0][0] <= score + 1e-9
        assert abs(decode.beams(cands, BIGRAMS, 10**6)[0][0] - best) < 1e-9
    assert decode.viterbi([], BIGRAMS) == ([], 0.0) and decode.beams([], BIGRAMS) == []


def test_likely_bigram_wins():
    cands = [[("ب", 0.6), ("ت", 0.4)], [("ا", 0.5), ("ي", 0.5)], [("ت", 0.9), ("ا", 0.1)]]
    assert decode.viterbi(cands, BIGRAMS)[0][:2] == ["ب", "ي"]


def test_dictionary_word_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(60):
        cands = [[(c, round(rng.random(), 3)) for c in rng.sample("abcdE", 3)] for _ in range(rng.randrange(1, 5))]
        cands = [sorted(c, key=lambda x: -x[1]) for c in cands]
        lexicon = decode.Lexicon({"".join(rng.choice("abcde") for _ in range(n)) for n in range(1, 5) for _ in range(20)})
        word, conf = decode.dictionary_word(cands, lexicon)
        open_ = [c[:1] if c[0][1] >= 0.75 else c for c in cands]
        found = [(sum(p for _, p in path) / len(path), "".join(c for c, _ in path)) for path in itertools.product(*open_) if lexicon.has("".join(c for c, _ in path))]
        if found:
            assert abs(conf - max(found)[0]) < 1e-9 and lexicon.has(word)
            assert all(w.isupper() == c[0][0].isupper() for w, c in zip(word, cands, strict=True))
        else:
            assert word == "".join(c[0][0] for c in cands)
    assert decode.dictionary_word([[("1", 0.2)], [("2", 0.2)]], decode.Lexicon(["x"]))[0] == "12"
    assert decode.dictionary_word([], None) == ("", 0.0)


def test_line_words_is_the_best_split():
    lexicon = {"بت": 30, "يا": 20, "بتيا": 1}
    bonus = lambda w: 15 * math.log(lexicon.get(w, 0) + 1) / math.log(31) + (0.25 if w in lexicon else 0)
    paws = [[[("ب", 0.9), ("_", 0.1)], [("ت", 0.8), ("ب", 0.2)]], [[("ي", 0.9)]], [[("ا", 0.9)]]]

    def word(part):
        return max(((s + bonus("".join(c for c in p if c != "_")), "".join(c for c in p if c != "_")) for s, p in decode.beams([c for x in part for c in x], None, 50)), key=lambda x: x[0])

    best = max((sum(word(paws[a:b])[0] for a, b in itertools.pairwise((0, *cut, 3))), [word(paws[a:b])[1] for a, b in itertools.pairwise((0, *cut, 3))]) for n in range(3) for cut in itertools.combinations((1, 2), n))
    assert decode.line_words(paws, None, bonus) == best[1] == ["بت", "يا"]
    assert decode.line_words([], None, bonus) == []


def test_columns_and_lines(spark):
    one = [[("ب", 0.9), ("ت", 0.1)]]
    rows = spark.createDataFrame([(1, one), (2, []), (3, None)], f"id int, cands {decode.CANDS}")
    got = rows.select("id", decode.beam_text(F.col("cands"), BIGRAMS).alias("b"), decode.viterbi_text(F.col("cands"), BIGRAMS).alias("v")).orderBy("id").collect()
    assert [(r.b, r.v.text) for r in got] == [("ب", "ب"), ("", ""), ("", "")]
    chars = spark.createDataFrame([(0, p, p, [(c, 0.9)]) for p, c in enumerate("بت")], "line_idx int, paw_idx int, char_idx int, cands array<struct<label string, conf double>>")
    assert decode.line_texts(chars, ["line_idx"], None, {"بت": 5}).collect()[0].text == "بت"


def test_combinations_by_joins_agree(spark):
    rng = random.Random(8)
    words = ["ab", "abc", "bad", "cab", "dab"]
    rows = [(k, [[(c, rng.random() * 0.7) for c in rng.sample("abcd", 3)] for _ in range(rng.randrange(2, 4))]) for k in range(12)]
    frame = spark.createDataFrame(rows, f"id int, cands {decode.CANDS}")
    prefixes = spark.createDataFrame([(w[:n],) for w in words for n in range(len(w) + 1)], "prefix string")
    got = decode.combinations(frame, "id", "cands", prefixes).where(F.col("word").isin(words)).collect()
    best = {}
    for r in got:
        best[r.id] = max(best.get(r.id, 0), r.conf)
    for k, cands in rows:
        word, conf = decode.dictionary_word(cands, decode.Lexicon(words))
        assert (word in words) == (k in best)
        if k in best:
            assert abs(best[k] - conf) < 1e-9


def test_candidate_columns(spark):
    rows = spark.createDataFrame([([("Baa_Start", 0.4), ("Taa_Start", 0.6)],), ([],)], f"c {cd.KIND}")
    c = F.col("c")
    got = rows.select(cd.rerank(c, F.lit(0), F.lit(1)).alias("r"), cd.by_position(c, F.lit("initial")).alias("p"), cd.as_text(c).alias("t"), cd.pad_to(F.array(c), F.lit(2)).alias("two")).collect()
    assert [x.label for x in got[0].r] == ["Baa_Start", "Taa_Start"] and abs(sum(x.conf for x in got[0].r) - 1) < 1e-9
    assert [x.label for x in got[0].p] == ["Baa_Start", "Taa_Start"] and got[1].r == []
    assert [x.label for x in got[0].t] == ["ت", "ب"] and [(x.label, x.conf) for x in got[1].t] == [("_", 1.0)]
    assert len(got[0].two) == 2 and got[0].two[1][0].label == ""
    blend = rows.select(cd.blend(c, F.array(F.lit(0.9), F.lit(0.1))).alias("b")).first().b
    assert [x.label for x in blend] == ["Baa_Start", "Taa_Start"]
