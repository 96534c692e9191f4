"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN, ARABIC = "[a-z]+", r"[؀-ۿ]+"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column, pattern: str = LATIN) -> Column:
    return found(F.lower(text), pattern)


def dump_text(text: Column, tag: str = "text") -> Column:
    """Lines of all ``<tag ...>...</tag>`` parts, without lines that begin with markup."""
    parts = F.array_join(found(text, rf"(?s)<{tag}\b.*?(?:</{tag}>|\z)"), "\n")
    return F.filter(F.split(parts, "\n"), lambda line: ~line.rlike(r"^\s*[<|{!=\[*#:;]") | line.rlike(rf"^\s*<{tag}\b"))


def body_between(text: Column, start: str, end: str) -> Column:
    """What stands between the line with ``start`` and the one with ``end``; the
    whole text where a marker is missing; line ends as ``\\n``."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    tail = F.regexp_replace(unix, rf"(?s)\A.*?{start}[^\n]*\n", "")
    return F.regexp_replace(F.regexp_replace(tail, rf"(?s){end}.*\z", ""), r"\A\s+|\s+\z", "")


def label_from_filename(stem: Column) -> Column:
    return F.regexp_replace(F.lower(stem), "_[0-9]+$", "")


def crop_key(path: Column, layout: str) -> list[Column]:
    """Numbers of a crop's name by the letters of ``layout``, such as ``fwcx`` for f0_w1_c2_x30.png."""
    pattern = "_".join(f"{c}(-?\\d+)" for c in layout) + r"\.png$"
    return [F.regexp_extract(path, pattern, i + 1).cast("int").alias(c) for i, c in enumerate(layout)]


def normalise_for_eval(text: Column) -> Column:
    """Brackets, runs of _ and *, and what is no letter, digit or space become
    a space; lower case, single spaces, trimmed."""
    out = F.regexp_replace(text, r"[\[\]]", " ")
    out = F.regexp_replace(F.regexp_replace(out, "_+", " "), r"\*+", " ")
    out = F.lower(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s]", " "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def cer(truth: Column, result: Column) -> Column:
    return F.when(F.length(truth) == 0, F.lit(0.0)).otherwise(F.levenshtein(result, truth) / F.length(truth))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over words: each distinct word becomes one character of the
    BMP (from U+3400, below the surrogates), then the character distance."""
    known = F.array_distinct(F.concat(a, b))

    def coded(array: Column) -> Column:
        code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(13311) + F.array_position(known, w)), 4, "0")), "UTF-16BE")
        return F.array_join(F.transform(array, code), "")

    return F.levenshtein(coded(a), coded(b))


def wer(truth: Column, result: Column) -> Column:
    return F.when(F.size(truth) == 0, F.lit(0.0)).otherwise(word_distance(result, truth) / F.size(truth))


def relative_change(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def restore_case(word: Column, model: Column) -> Column:
    """Upper case where ``model`` has an upper-case letter, lower case elsewhere."""
    pair = F.zip_with(F.split(word, ""), F.split(model, ""), lambda w, m: F.when((m != F.lower(m)), F.upper(w)).otherwise(F.lower(w)))
    return F.when(F.length(word) == F.length(model), F.array_join(pair, "")).otherwise(word)


def lower_letter(char: Column) -> Column:
    """A single letter in lower case; all else as it is."""
    return F.when(char.rlike(r"^\p{L}$"), F.lower(char)).otherwise(char)


def clean_line(line: Column) -> Column:
    return F.translate(F.lower(line), "?_", "")


def joined(rows: Column) -> Column:
    """Texts of an array of lines (arrays of texts): empty ones go, words by a space, lines by a line end."""
    return F.array_join(F.transform(rows, lambda line: F.array_join(F.filter(line, lambda t: t != ""), " ")), "\n")


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, filled greedily; a longer word has its own line."""
    start = F.array().cast("array<string>")

    def step(lines: Column, word: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 1 + F.length(word) <= width)
        longer = F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), word)))
        return F.when(fits, longer).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words(text), start, step)
