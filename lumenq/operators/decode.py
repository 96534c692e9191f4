"""Decoders over candidate lists: beam, Viterbi, words from sub-words, dictionary words.

A word's candidates are one row (``cands``: array of candidate arrays), so the
decoders are functions over rows; only the word break folds a whole line. The
bigram table is small and travels with the function.
"""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import folded

WEIGHT, FLOOR, UNSEEN, BLANK = 0.3, 1e-9, 1e-6, "_"
CANDS = "array<array<struct<label:string,conf:double>>>"


def _emit(conf: float) -> float:
    return math.log(max(conf, FLOOR))


def beams(cands: list, bigrams: dict[str, float] | None, width: int = 5) -> list[tuple[float, list[str]]]:
    """The ``width`` best paths position by position; of equal scores the earlier one."""
    kept: list[tuple[float, list[str]]] = [(0.0, [])] if cands else []
    for options in cands:
        kept = _grown(kept, options, bigrams, width)
    return kept


def _grown(kept: list[tuple[float, list[str]]], options: list, bigrams: dict[str, float] | None, width: int) -> list[tuple[float, list[str]]]:
    grown = []
    for score, path in kept:
        for label, conf in options:
            step = _emit(conf)
            if path and bigrams is not None:
                step += WEIGHT * math.log(bigrams.get(path[-1] + label, UNSEEN))
            grown.append((score + step, [*path, label]))
    return sorted(grown, key=lambda x: -x[0])[:width]


def viterbi(cands: list, bigrams: dict[str, float]) -> tuple[list[str], float]:
    """The best path of all, and its score; the first of equal ones."""
    if not cands:
        return [], 0.0
    best: dict[str, tuple[float, list[str]]] = {}
    for t, options in enumerate(cands):
        now: dict[str, tuple[float, list[str]]] = {}
        for label, conf in options:
            if t == 0:
                now[label] = (_emit(conf), [label])
                continue
            top = None
            for before, (score, path) in best.items():
                value = score + WEIGHT * math.log(bigrams.get(before + label, UNSEEN))
                if top is None or value > top[0]:
                    top = (value, path)
            if top is not None:
                now[label] = (top[0] + _emit(conf), [*top[1], label])
        best = now
    score, path = max(best.values(), key=lambda x: x[0], default=(0.0, []))
    return path, score


def _listed(cands) -> list:
    return [[(c["label"], float(c["conf"])) for c in options] for options in (cands if cands is not None else [])]


def beam_text(cands: Column, bigrams: dict[str, float] | None, width: int = 5) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: "".join(b[0][1]) if (b := beams(_listed(r), bigrams, width)) else "")

    return run(cands.cast(CANDS))


def viterbi_text(cands: Column, bigrams: dict[str, float]) -> Column:
    """Struct (text, score)."""

    @F.pandas_udf("text string, score double")
    def run(rows: pd.Series) -> pd.DataFrame:
        found = [viterbi(_listed(r), bigrams) for r in rows]
        return pd.DataFrame({"text": ["".join(p) for p, _ in found], "score": [s for _, s in found]})

    return run(cands.cast(CANDS))


def line_words(paws: list[list], bigrams: dict[str, float] | None, bonus, longest: int = 8, width: int = 50, penalty: float = 0.0) -> list[str]:
    """Sub-words of a line to words: every run of up to ``longest`` of them is
    decoded, the split with the best total score wins. ``bonus`` scores a word."""
    best: list[tuple[float, list[str]] | None] = [(0.0, []), *[None] * len(paws)]
    for j in range(len(paws)):
        before = best[j]
        kept, begun = [(0.0, [])], False
        for i in range(j + 1, min(j + longest, len(paws)) + 1):  # a run grows the beams of the one before
            for options in paws[i - 1]:
                kept, begun = _grown(kept, options, bigrams, width), True
            word, score = "", -math.inf
            for s, path in kept if begun else []:
                text = "".join(x for x in path if x != BLANK)
                if s + bonus(text) > score:
                    word, score = text, s + bonus(text)
            value = before[0] + score + (penalty if j else 0.0)
            if best[i] is None or value > best[i][0]:
                best[i] = (value, [*before[1], word] if word.strip() else list(before[1]))
    return best[-1][1]


def line_texts(chars: DataFrame, keys: list[str], bigrams: dict[str, float] | None, lexicon: dict[str, int], paw: str = "paw_idx", char: str = "char_idx", in_lexicon: float = 0.25, by_frequency: float = 15.0, words: set[str] | None = None) -> DataFrame:
    """``keys, text`` of each line of characters with ``cands`` (text candidates).
    ``lexicon`` maps words to counts, ``words`` those that get the lexicon bonus
    (all of ``lexicon`` if not given). One line is one group."""
    top = max(lexicon.values(), default=0)
    members = set(lexicon) if words is None else words
    types = dict(chars.dtypes)

    def bonus(word: str) -> float:
        share = math.log(lexicon.get(word, 0) + 1) / math.log(top + 1) if top else 0.0
        return (in_lexicon if word in members else 0.0) + by_frequency * share

    def fold(rows: list[dict]) -> list[dict]:
        paws: dict = {}
        for r in rows:
            paws.setdefault(r[paw], []).append([(c["label"], float(c["conf"])) for c in r["cands"] or []])
        text = unicodedata.normalize("NFC", " ".join(line_words(list(paws.values()), bigrams, bonus)))
        return [{**{k: rows[0][k] for k in keys}, "text": text}]

    kind = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", text string"
    flat = chars.select(*keys, paw, char, F.col("cands").cast("array<struct<label:string,conf:double>>").alias("cands"))
    return folded(flat, keys, [paw, char], fold, kind)


class Lexicon:
    """Words and their prefixes; numbers always belong."""

    def __init__(self, words):
        self.words = set(words)
        self.prefixes = {w[:k] for w in self.words for k in range(len(w) + 1)}

    def has(self, word: str) -> bool:
        return (word != "" and word.isdigit()) or word.lower() in self.words

    def begins(self, prefix: str) -> bool:
        return (prefix != "" and prefix.isdigit()) or prefix.lower() in self.prefixes


def dictionary_word(cands: list, lexicon: Lexicon | None, lock: float = 0.75) -> tuple[str, float]:
    """The lexicon word with the best mean confidence, sure positions kept at
    their first choice; else all first choices. Case follows the first choices."""
    if not cands:
        return "", 0.0
    firsts = [options[0] for options in cands]
    if lexicon is not None:
        found: tuple[str, float] | None = None
        stack: list[tuple[str, float, int]] = [("", 0.0, 0)]
        while stack:
            word, total, at = stack.pop()
            if at == len(cands):
                if lexicon.has(word) and (found is None or total / at > found[1]):
                    found = (word, total / at)
                continue
            options = cands[at][:1] if firsts[at][1] >= lock else cands[at]
            # pushed backwards, so that the first choices are tried first
            stack += [(word + c, total + p, at + 1) for c, p in reversed(options) if lexicon.begins(word + c)]
        if found is not None:
            word, conf = found
            if len(word) == len(firsts):
                word = "".join(w.upper() if f[0].isupper() else w.lower() for w, f in zip(word, firsts, strict=True))
            return word, conf
    return "".join(c for c, _ in firsts), sum(p for _, p in firsts) / len(firsts)


def dictionary_text(cands: Column, words: list[str] | None, lock: float = 0.75) -> Column:
    """Struct (text, conf). The lexicon must fit a task's memory."""
    lexicon = None if words is None else Lexicon(words)

    @F.pandas_udf("text string, conf double")
    def run(rows: pd.Series) -> pd.DataFrame:
        found = [dictionary_word(_listed(r), lexicon, lock) for r in rows]
        return pd.DataFrame({"text": [w for w, _ in found], "conf": [c for _, c in found]})

    return run(cands.cast(CANDS))


def combinations(rows: DataFrame, key: str, cands: str, prefixes: DataFrame) -> DataFrame:
    """The same search as joins: every position is exploded and cut by a
    semi-join on the prefix table; shorter rows wait unchanged until the longest
    has ended. For lexicons too large for a task."""
    steps = rows.agg(F.max(F.size(cands))).first()[0] or 0
    open_ = rows.select(key, F.col(cands).cast(CANDS).alias("_c"), F.lit("").alias("word"), F.lit(0.0).alias("total")).where(F.size("_c") > 0)
    wait = F.array(F.struct(F.lit("").alias("label"), F.lit(0.0).alias("conf")))
    for at in range(1, steps + 1):
        options = F.when(F.size("_c") >= at, F.get("_c", F.lit(at - 1))).otherwise(wait)
        grown = open_.select(key, "_c", "word", "total", F.explode(options).alias("o"))
        grown = grown.select(key, "_c", F.concat("word", "o.label").alias("word"), (F.col("total") + F.col("o.conf")).alias("total"))
        open_ = grown.join(prefixes.select(F.col("prefix").alias("_p")).distinct(), F.lower("word") == F.col("_p"), "left_semi")
    return open_.select(key, "word", (F.col("total") / F.size("_c")).alias("conf"))
