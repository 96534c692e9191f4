"""Letter bigrams, word frequencies and lexicons as tables, and scores against them.

Bigram tables are ``a, b, p``: as many rows as pairs of letters, so they are
broadcast; word tables grow with the corpus and are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def words(corpus: DataFrame, column: str = "text", pattern: str = tx.LATIN) -> DataFrame:
    """One row per token."""
    return corpus.select(F.explode(tx.tokens(F.col(column), pattern)).alias("word"))


def frequencies(corpus: DataFrame, column: str = "text", pattern: str = tx.LATIN) -> DataFrame:
    return words(corpus, column, pattern).groupBy("word").agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent words, equal counts in word order."""
    return counts.orderBy(F.desc("n"), "word").limit(k)


def lexicon(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("n") >= least)


def corpus_statistics(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_words"), F.count_if(F.col("n") == 1).alias("once"))


def _pairs(words: Column) -> Column:
    """Letter pairs of each word; only words are indexed, never whole texts."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 2), of))


def bigram_counts(corpus: DataFrame, column: str = "text", pattern: str = tx.LATIN) -> DataFrame:
    """Pairs within tokens of two letters or more: words are counted first, so
    that pairs are taken once from each distinct word."""
    counts = frequencies(corpus, column, pattern).select(F.explode(_pairs(F.array("word"))).alias("g"), "n")
    grams = counts.groupBy("g").agg(F.sum("n").alias("n"))
    return grams.select(F.substring("g", 1, 1).alias("a"), F.substring("g", 2, 1).alias("b"), "n")


def bigram_counts_across(corpus: DataFrame, column: str = "text", other: str = "[^a-z]") -> DataFrame:
    """Pairs after everything else is dropped, so they cross spaces."""
    letters = F.split(F.regexp_replace(F.lower(F.col(column)), other, ""), "")
    shifted = F.slice(letters, F.lit(2), F.greatest(F.size(letters) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(letters.alias("a"), shifted.alias("b")), lambda x: x["b"].isNotNull() & (x["a"] != "") & (x["b"] != ""))
    return corpus.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """``a, b, p`` with p the share among the pairs that begin alike."""
    by_first = Window.partitionBy("a")
    return counts.select("a", "b", (F.col("n") / F.sum("n").over(by_first)).alias("p"))


def smoothed(counts: DataFrame, add: float = 0.01, alphabet: str = ALPHABET) -> DataFrame:
    """Every pair of the alphabet; the total of a first letter holds all its
    pairs, also those that leave the alphabet."""
    spark = counts.sparkSession
    letters = spark.createDataFrame([(c,) for c in alphabet], "a string")
    grid = letters.crossJoin(letters.withColumnRenamed("a", "b"))  # a fixed alphabet
    totals = counts.groupBy("a").agg(F.sum("n").alias("total"))
    out = grid.join(F.broadcast(counts), ["a", "b"], "left").join(F.broadcast(totals), "a", "left")
    return out.select("a", "b", ((F.coalesce("n", F.lit(0)) + add) / (F.coalesce("total", F.lit(0)) + add * len(alphabet))).alias("p"))


def as_map(bigrams: DataFrame) -> dict[str, float]:
    """Pairs to probabilities, for the decoders: as many as pairs of letters."""
    return {r["a"] + r["b"]: r["p"] for r in bigrams.collect()}


def to_json(bigrams: DataFrame) -> DataFrame:
    """One row: {first: {second: p}}."""
    firsts = bigrams.groupBy("a").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("b", "p")))).alias("nexts"))
    by_letter = lambda x, y: F.when(x["a"] < y["a"], -1).when(x["a"] > y["a"], 1).otherwise(0)
    return firsts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("a", "nexts")), by_letter))).alias("json"))


def from_json(frame: DataFrame, column: str = "json") -> DataFrame:
    """The table from nested JSON; what cannot be read gives no rows."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    return frame.select(F.explode(F.from_json(column, kind)).alias("a", "nexts")).select("a", F.explode("nexts").alias("b", "p"))


def frequencies_from_json(frame: DataFrame, column: str = "json") -> DataFrame:
    return frame.select(F.explode(F.from_json(column, T.MapType(T.StringType(), T.LongType()))).alias("word", "n"))


def score_sum(items: DataFrame, bigrams: DataFrame, word: str = "word", unseen: float = 1e-6) -> DataFrame:
    """``word, score``: sum of log p over a word's pairs; 0 under two letters."""
    distinct = items.select(F.col(word).alias("word")).distinct()
    grams = distinct.select("word", F.explode_outer(_pairs(F.array("word"))).alias("g"))
    table = F.broadcast(bigrams.select(F.concat("a", "b").alias("g"), "p"))
    logs = F.when(F.col("g").isNull(), F.lit(0.0)).otherwise(F.log(F.coalesce("p", F.lit(unseen))))
    return grams.join(table, "g", "left").groupBy("word").agg(F.sum(logs).alias("score"))


def score_mean(items: DataFrame, bigrams: DataFrame, word: str = "word") -> DataFrame:
    """``word, score``: mean of log(p + 1e-10) over the pairs seen, in lower case; 0 if none is."""
    distinct = items.select(F.col(word).alias("word")).distinct()
    grams = distinct.select("word", F.explode_outer(_pairs(F.array(F.lower("word")))).alias("g"))
    table = F.broadcast(bigrams.select(F.concat("a", "b").alias("g"), "p"))
    return grams.join(table, "g", "left").groupBy("word").agg(F.coalesce(F.avg(F.log(F.col("p") + 1e-10)), F.lit(0.0)).alias("score"))


def in_lexicon(items: DataFrame, lex: DataFrame, word: str = "word") -> DataFrame:
    return items.join(lex.select(F.col("word").alias(word)).distinct(), word, "left_semi")


def completions(prefixes: DataFrame, lex: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``prefix, word`` for every lexicon word with the prefix: an equal join on the words' own prefixes."""
    ends = lex.select("word", F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias(prefix))
    return prefixes.select(prefix).distinct().join(ends, prefix)


def known_or_number(items: DataFrame, lex: DataFrame, word: str = "word", prefix: bool = False) -> DataFrame:
    """``items`` with ``known``: in the lexicon (or a prefix of one of its words), or all digits."""
    own = lex.select(F.col("word").alias("_entry"))
    if prefix:
        own = own.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("_entry")), lambda n: F.substring("_entry", F.lit(1), n))).alias("_entry"))
    out = items.join(own.distinct(), F.lower(F.col(word)) == F.col("_entry"), "left")
    return out.withColumn("known", F.col(word).rlike(r"^\d+$") | F.col("_entry").isNotNull()).drop("_entry")


def rescore_words_by_frequency(items: DataFrame, lex: DataFrame, counts: DataFrame, word: str = "word", conf: str = "conf", in_lexicon: float = 0.25, by_frequency: float = 15.0) -> DataFrame:
    """``rescored``: conf, plus a bonus in the lexicon, plus log frequency as a share of the largest."""
    top = counts.agg(F.max("n").alias("_top"))
    out = items.join(lex.select(F.col("word").alias(word), F.lit(in_lexicon).alias("_lex")).distinct(), word, "left")
    out = out.join(counts.select(F.col("word").alias(word), F.col("n").alias("_n")), word, "left").crossJoin(F.broadcast(top))  # one row
    share = F.coalesce(F.log(F.coalesce("_n", F.lit(0)) + 1) / F.log(F.col("_top") + 1), F.lit(0.0))
    return out.withColumn("rescored", F.col(conf) + F.coalesce("_lex", F.lit(0.0)) + by_frequency * share).drop("_lex", "_n", "_top")


def rescore_words_by_bigrams(items: DataFrame, lex: DataFrame, bigrams: DataFrame, word: str = "word", conf: str = "conf", weight: float = 0.3, in_lexicon: float = 0.25) -> DataFrame:
    """``rescored``: 0.7 conf + 0.3 sigmoid of the mean score, a bonus in the lexicon, 1 at most."""
    scores = score_mean(items, bigrams, word).select(F.col("word").alias(word), "score")
    out = items.join(scores, word).join(lex.select(F.col("word").alias("_entry")).distinct(), F.lower(F.col(word)) == F.col("_entry"), "left")
    bonus = F.when(F.col("_entry").isNotNull(), in_lexicon).otherwise(0.0)
    sigmoid = 1 / (1 + F.exp(-F.col("score")))
    return out.withColumn("rescored", F.least(F.lit(1.0), (1 - weight) * F.col(conf) + weight * sigmoid + bonus)).drop("_entry", "score")


def rescore_candidates(cands: Column, previous: Column, bigrams: dict[str, float], weight: float = 0.3, unseen: float = 1e-6, sigmoid: bool = False) -> Column:
    """Candidates with the probability after ``previous`` (or the sigmoid of its log) mixed in, sorted."""
    from ..functions import candidates as cd

    table = F.create_map(*[F.lit(x) for kv in bigrams.items() for x in kv])
    p = lambda c: F.try_element_at(table, F.concat(previous, c["label"]))
    share = (lambda c: F.coalesce(1 / (1 + F.exp(-F.log(p(c) + 1e-10))), F.lit(0.5))) if sigmoid else (lambda c: F.coalesce(p(c), F.lit(unseen)))
    mixed = cd.best_first(F.transform(cands, lambda c: cd.pair(c["label"], (1 - weight) * c["conf"] + weight * share(c))))
    return F.when(previous.isNull() | (previous == ""), cands).otherwise(mixed)


def vocabulary_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words of either, with ``added``: whether only ``b`` has it."""
    marked = a.select("word", F.lit(0).alias("new")).unionByName(b.select("word", F.lit(1).alias("new")))
    return marked.groupBy("word").agg((F.min("new") == 1).alias("added"))


def corrected(items: DataFrame, counts: DataFrame, word: str = "word") -> DataFrame:
    """``word, correction``: itself if known, else the most frequent known word
    within one edit, else within two, else itself. Words meet in buckets of
    equal deletions, so no pair of unlike words is compared."""

    def deletions(w: Column, times: int) -> Column:
        out = F.array(w)
        for _ in range(times):
            drop = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, drop))))
        return out

    wanted = items.select(F.col(word).alias("word")).distinct()
    mine = wanted.select("word", F.explode(deletions(F.col("word"), 2)).alias("k"))
    theirs = counts.select(F.col("word").alias("known"), "n", F.explode(deletions(F.col("word"), 2)).alias("k"))
    near = mine.join(theirs, "k").select("word", "known", "n").distinct().withColumn("d", F.levenshtein("word", "known")).where("d <= 2")
    best = near.groupBy("word").agg(F.min_by("known", F.struct("d", -F.col("n"), F.col("known"))).alias("best"))
    return wanted.join(best, "word", "left").select("word", F.coalesce("best", "word").alias("correction"))
