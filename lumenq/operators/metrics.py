"""Evaluation: text against truth, labels against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def word_recall(pairs: DataFrame, key: str, truth: str = "truth_words", result: str = "result_words") -> DataFrame:
    """``key, recall``: multiset intersection by the truth's size; 1 without truth. Arrays in, one shuffle on the key."""
    one = pairs.select(key, F.explode(truth).alias("word"), F.lit(1).alias("t"), F.lit(0).alias("r"))
    two = pairs.select(key, F.explode(result).alias("word"), F.lit(0).alias("t"), F.lit(1).alias("r"))
    counts = one.unionByName(two).groupBy(key, "word").agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
    hits = counts.groupBy(key).agg(F.sum(F.least("t", "r")).alias("hits"), F.sum("t").alias("size"))
    out = pairs.select(key).join(hits, key, "left")
    return out.select(key, F.when(F.coalesce("size", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("size")).alias("recall"))


def text_pairs(pairs: DataFrame, key: str, truth: str = "truth", result: str = "result") -> DataFrame:
    """``key, recall, cer, wer, truth_words, result_words`` of normalised texts."""
    norm = pairs.select(key, tx.normalise_for_eval(F.col(truth)).alias("_t"), tx.normalise_for_eval(F.col(result)).alias("_r"))
    norm = norm.withColumns({"_tw": tx.words(F.col("_t")), "_rw": tx.words(F.col("_r"))})
    own = norm.select(key, tx.cer(F.col("_t"), F.col("_r")).alias("cer"), tx.wer(F.col("_tw"), F.col("_rw")).alias("wer"), F.size("_tw").alias("truth_words"), F.size("_rw").alias("result_words"))
    return own.join(word_recall(norm, key, "_tw", "_rw"), key)


def macro_average(scores: DataFrame, *columns: str) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def missing(truth: DataFrame, result: DataFrame, key: str) -> DataFrame:
    return truth.select(key).join(result.select(key), key, "left_anti")


def confusion(rows: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """One row per truth label of ``labels``, one column per predicted one."""
    frame = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{truth} {dict(rows.dtypes)[truth]}")
    counts = rows.where(F.col(truth).isin(labels)).groupBy(truth).pivot(predicted, labels).agg(F.count(F.lit(1)))
    return frame.join(counts, truth, "left").na.fill(0)


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support`` of each label on either side; 0 where undefined."""
    sides = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit"))
    counts = sides.groupBy("s.label").agg(F.sum(F.col("s.t") * F.col("hit")).alias("hits"), F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.select("label", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), "support")
    return out.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and weighted means of a class report."""
    names = ("precision", "recall", "f1")
    macro = report.agg(F.lit("macro").alias("kind"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = report.agg(F.lit("weighted").alias("kind"), *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    return macro.unionByName(weighted)


def accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def compare_runs(base: DataFrame, other: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, base_outside, other_outside, distance, change`` of two runs' texts."""
    from ..functions.arabic import outside_script

    both = base.select(key, F.col(text).alias("_a")).join(other.select(key, F.col(text).alias("_b")), key)
    return both.select(key, outside_script(F.col("_a")).alias("base_outside"), outside_script(F.col("_b")).alias("other_outside"), F.levenshtein("_a", "_b").alias("distance"), tx.relative_change(F.col("_a"), F.col("_b")).alias("change"))


def best_of(runs: DataFrame, score: str, *order: str) -> DataFrame:
    """The run with the highest score, the first in ``order`` of equal ones."""
    return runs.orderBy(F.desc(score), *order).limit(1)
