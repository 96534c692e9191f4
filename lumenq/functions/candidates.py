"""Candidate arrays: array<struct<label string, conf double>>, best first.

``conf`` ties keep the order of the array (a stable sort), unless a function
says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arabic

KIND = "array<struct<label:string,conf:double>>"


def pair(label: Column, conf: Column) -> Column:
    return F.struct(label.cast("string").alias("label"), conf.cast("double").alias("conf"))


def total(cands: Column) -> Column:
    return F.aggregate(cands, F.lit(0.0), lambda s, c: s + c["conf"])


def best_first(cands: Column) -> Column:
    numbered = F.transform(cands, lambda c, i: F.struct((-c["conf"]).alias("k"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(numbered), lambda x: x["c"])


def normalised(cands: Column) -> Column:
    whole = total(cands)
    return F.transform(cands, lambda c: pair(c["label"], c["conf"] / F.when(whole == 0, F.lit(1.0)).otherwise(whole)))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    whole = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / whole)


def top_k(labels: Column, probabilities: Column, k: int) -> Column:
    """The k likeliest; of equal ones the later label first."""
    rows = F.zip_with(F.transform(probabilities, lambda p, i: F.struct(p.cast("double").alias("conf"), i.alias("i"))), labels, lambda x, name: F.struct(x["conf"].alias("conf"), x["i"].alias("i"), name.cast("string").alias("label")))
    return F.transform(F.slice(F.sort_array(rows, asc=False), 1, k), lambda x: pair(x["label"], x["conf"]))


def best(cands: Column) -> Column:
    return F.try_element_at(cands, F.lit(1))


def by_position(cands: Column, position: Column) -> Column:
    """Candidates of the form; all if the position is unknown or none fits."""
    suffix = F.try_element_at(F.create_map(*[F.lit(x) for kv in arabic.POSITIONS.items() for x in kv]), position)
    fit = F.filter(cands, lambda c: F.endswith(c["label"], F.concat(F.lit("_"), suffix)))
    return F.when(suffix.isNull() | (F.size(fit) == 0), cands).otherwise(fit)


def by_dots(cands: Column, above: Column, below: Column) -> Column:
    """Candidates whose letter has the dots seen, or is unknown; all if no dot was seen or none fits."""

    def fits(c: Column) -> Column:
        dots = arabic.expected_dots(c["label"])
        return dots.isNull() | ((dots["above"] == above) & (dots["below"] == below))

    fit = F.filter(cands, fits)
    return F.when(((above == 0) & (below == 0)) | (F.size(fit) == 0), cands).otherwise(fit)


def rerank(cands: Column, above: Column, below: Column, boost: float = 0.20, penalty: float = 0.10) -> Column:
    """Confidence up where the dots agree and down where not, then sorted and normalised."""

    def moved(c: Column) -> Column:
        dots = arabic.expected_dots(c["label"])
        agree = (dots["above"] == above.cast("int")) & (dots["below"] == below.cast("int"))
        return pair(c["label"], F.when(dots.isNull(), c["conf"]).when(agree, c["conf"] + boost).otherwise(F.greatest(F.lit(0.0), c["conf"] - penalty)))

    return F.when(F.size(cands) == 0, cands).otherwise(normalised(best_first(F.transform(cands, moved))))


def position_and_dots(cands: Column, position: Column, above: Column, below: Column, boost: float = 0.20, penalty: float = 0.0) -> Column:
    return rerank(by_position(cands, position), above, below, boost, penalty)


def blend(cands: Column, probabilities: Column, alpha: float = 0.6) -> Column:
    """A learned reranker's probabilities mixed in, sorted and normalised."""
    mixed = F.zip_with(cands, probabilities, lambda c, p: pair(c["label"], alpha * c["conf"] + (1 - alpha) * p))
    return normalised(best_first(mixed))


def as_text(cands: Column) -> Column:
    """Labels to glyphs, equal glyphs added up, unknown ones gone; sorted and
    normalised, or one undetected candidate."""
    glyphs = F.filter(F.transform(cands, lambda c: pair(arabic.label_to_text(c["label"]), c["conf"])), lambda c: c["label"] != arabic.UNDETECTED)
    names = F.array_distinct(F.transform(glyphs, lambda c: c["label"]))
    merged = F.transform(names, lambda n: pair(n, total(F.filter(glyphs, lambda c: c["label"] == n))))
    nothing = F.array(pair(F.lit(arabic.UNDETECTED), F.lit(1.0)))
    return F.when((F.size(merged) == 0) | (total(merged) <= 0), nothing).otherwise(normalised(best_first(merged)))


def pad_to(cands: Column, size: Column) -> Column:
    """A list of candidate arrays brought to ``size``: cut, or filled with one empty candidate."""
    blank = F.array(F.array(pair(F.lit(""), F.lit(1.0))))
    more = F.flatten(F.array_repeat(blank, F.greatest(size - F.size(cands), F.lit(0))))
    return F.slice(F.concat(cands, more), F.lit(1), size)


def unreliable(word: Column, conf: Column, least: float = 0.30, marks: float = 0.25) -> Column:
    """Whether a word is to be blanked: empty, unsure, or many question marks."""
    share = F.regexp_count(word, F.lit(r"\?")) / F.greatest(F.length(word), F.lit(1))
    return word.isNull() | (word == "") | (conf < least) | (share >= marks)
