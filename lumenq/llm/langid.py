"""Language identification with word-first backoff.

A known word adds its log frequency in each language. An unseen word is
scored by its longest character n-grams that are known: n = 5 first, then
shorter ones; the mean over the known n-grams counts as the word's value. The
model is fitted on a bounded sample of rows that have a language: about
``per_lang`` rows of each, taken by hash of the id, so that rare languages are
used whole. Of each language it keeps the WORDS most frequent words and the
GRAMS most frequent n-grams of each order; every language takes part.

A null text, or one without a letter, is ``und`` with score 0; so is every
text if no row has a language. Words are runs of letters, in lower case. Of
languages with equal totals the first by name is taken. Rows are judged one by
one: repeated rows get equal answers, a null id is of the fold of the empty
text; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Prefix, find, release, remainder, runs, saved

#: Of each language: sampled rows, words, n-grams of each order; the orders; the smoothing count.
PER_LANG, WORDS, GRAMS, ORDERS, ADD = 2000, 1 << 15, 1 << 13, (5, 4, 3, 2, 1), 0.1
_LETTERS: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Which code points are letters; made once in a process."""
    if "t" not in _LETTERS:
        _LETTERS["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS["t"]


class Words:
    """Letter words of some texts: starts, ends, owners and hashes."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)])
        self.starts, self.ends, self.owner = runs(letters()[codes], offsets)
        self.prefix = Prefix(codes)
        self.hashes = self.prefix(self.starts, self.ends, salt=99)

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of the words with these numbers, and the place of each one's word in ``words``."""
        many = np.maximum(self.ends[words] - self.starts[words] - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), many)
        at = np.repeat(self.starts[words] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(words) else self.starts[words], many) + np.arange(len(owner))
        return self.prefix(at, at + n, salt=n), owner


def pieces(column: pa.Array, limit: int = 1 << 20):
    """(first, last, texts) with at most ``limit`` characters, or one text."""
    texts = column.to_pylist()
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t or "") > limit:
            yield first, k, texts[first:k]
            first, size = k, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts), texts[first:]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, fold: int | None = 5) -> dict:
    """The model from rows whose id is not in the held-out fold (crc32 mod ``fold`` = 0)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if fold:
        rows = rows.where(remainder("id", fold) != 0)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).collect()  # as many as there are languages
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return {"langs": []}
    number = {x: i for i, x in enumerate(langs)}
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["rows"])) for r in sizes], "lang string, share double")
    hashed = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.join(F.broadcast(shares), "lang").where(hashed < F.col("share")).select("text", "lang")

    def count(batches):
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            for i, j, texts in pieces(batch.column("text")):
                w = Words(texts)
                mine = lang[i:j]
                everyone = np.arange(len(w.hashes))
                for kind in (0, *ORDERS):
                    keys, owner = (w.hashes, w.owner) if kind == 0 else (lambda g: (g[0], w.owner[g[1]]))(w.grams(everyone, kind))
                    order = np.argsort(keys, kind="stable")
                    k, who = keys[order], mine[owner[order]]
                    pair = np.lexsort((who, k))
                    k, who = k[pair], who[pair]
                    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (who[1:] != who[:-1])])) if len(k) else np.zeros(0, np.int64)
                    n = np.diff(np.append(new, len(k)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), kind), pa.int32()), pa.array(k[new].view(np.int64)), pa.array(who[new], pa.int32()), pa.array(n, pa.int64())], names=["kind", "key", "lang", "n"])

    counts = saved(picked.mapInArrow(count, "kind int, key long, lang int, n long").where("lang >= 0").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")), "counts")
    place = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "key"))
    top = counts.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS)).select("kind", "key").distinct()
    table = counts.join(top, ["kind", "key"], "left_semi").toArrow()  # at most WORDS + 5 * GRAMS keys of each language
    sizes = np.zeros((max(ORDERS) + 1, len(langs)))
    for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect():
        sizes[r["kind"], r["lang"]] = r["n"]
    distinct = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.countDistinct("key").alias("n")).collect()}
    release(counts)
    kind, key, lang, n = (table.column(c).to_numpy() for c in ("kind", "key", "lang", "n"))
    model: dict = {"langs": langs}
    for k in (0, *ORDERS):
        mine = np.flatnonzero(kind == k)
        mine = mine[np.lexsort((lang[mine], key[mine].view(np.uint64)))]
        keys, first = np.unique(key[mine].view(np.uint64), return_index=True)
        unseen = np.log(ADD / (sizes[k] + ADD * (distinct.get(k, 0) + 1)))
        # log frequency of a key in a language: that of an unseen one, and what its count adds
        model[k] = (keys, np.append(first, len(mine)), lang[mine].astype(np.int64), np.log((n[mine] + ADD) / ADD), unseen)
    return model


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    langs = model["langs"]
    w = Words(texts)
    lettered = np.bincount(w.owner, minlength=w.n) > 0
    if not langs:
        return ["und"] * w.n, np.zeros(w.n)
    total = np.zeros(w.n * len(langs))

    def add(kind: int, at: np.ndarray, owner: np.ndarray, share: np.ndarray) -> None:
        _, cuts, lang, more, unseen = model[kind]
        total.reshape(w.n, -1)[:] += np.bincount(owner, weights=share, minlength=w.n)[:, None] * unseen
        many = cuts[at + 1] - cuts[at]
        entry = np.repeat(cuts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        total[:] += np.bincount(np.repeat(owner, many) * len(langs) + lang[entry], weights=np.repeat(share, many) * more[entry], minlength=len(total))

    at, known = find(model[0][0], w.hashes)
    add(0, at[known], w.owner[known], np.ones(known.sum()))
    left = np.flatnonzero(~known)
    for n in ORDERS:
        if not len(left) or not len(model[n][0]):
            continue
        grams, owner = w.grams(left, n)
        at, known = find(model[n][0], grams)
        hits = np.bincount(owner[known], minlength=len(left))
        add(n, at[known], w.owner[left[owner[known]]], 1 / hits[owner[known]])
        left = left[hits == 0]
    total = total.reshape(w.n, -1)
    best = total.argmax(1)
    p = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -50, 0)).sum(1)
    return [langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p, 0.0)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", fold: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row; only the text decides."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: WORDS and GRAMS entries of each language

    def run(batches):
        for batch in batches:
            for i, j, texts in pieces(batch.column("text")):
                names, score = predict(texts, shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, fold) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
