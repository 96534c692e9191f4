"""Quality rules: fixed text rules, then a calibrated classifier.

The classifier is a logistic regression over hashed word 1- and 2-grams and
byte-level character 3- and 4-grams (mean weight per gram of each family),
trained on labelled quality rows and Platt-calibrated on a held-out fifth of
them. Scoring reads texts once in Arrow batches; no shuffle of documents.

Null or empty texts have no words and fail the base rule. Without labelled
rows of both kinds the classifier keeps all. Repeated label rows of one id
count once, with the lowest label; null labels are ignored. Of documents that
share a labelled id, one is learned from, that with the least hash of its text.
Every row is judged by itself, so repeated rows get equal verdicts; an empty
table gives no rows. A probability equal to the threshold keeps the text.
Equality of lines and of words is that of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Prefix, chunks, mix, runs, separators, text_bytes, windows

#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Width of each hashed family, labelled rows used for fitting, keep threshold.
BUCKETS, TRAIN_ROWS, KEEP_AT = 1 << 15, 1500, 0.5
FAMILIES = 4


class Measured:
    """Base counts of the texts of one chunk, and what the features need."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.n, self.data, self.offsets = n, data, offsets
        inside = ~separators()[data]
        starts, ends, owner = runs(inside, offsets)
        self.prefix = Prefix(data)
        self.words, self.owner = self.prefix(starts, ends), owner
        self.n_words = np.bincount(owner, minlength=n)
        text_of = np.repeat(np.arange(n), np.diff(offsets))
        self.text_of = text_of
        points = inside & ((data & 0xC0) != 0x80)
        self.word_chars = np.bincount(text_of[points], minlength=n)
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        self.n_symbols = np.bincount(text_of[symbol[data]], minlength=n)
        self.n_dup_lines = self._dup_lines(inside)
        self.n_repeat_words = self._repeat_words()

    def _dup_lines(self, inside: np.ndarray) -> np.ndarray:
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([breaks, self.offsets[1:]]))
        filled = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        real = filled[ends] > filled[starts]
        starts, ends = starts[real], ends[real]
        owner = np.searchsorted(self.offsets, starts, "right") - 1
        key = self.prefix(starts, ends, salt=3) ^ mix(owner.astype(np.uint64) + np.uint64(1))
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return np.bincount(owner[first], weights=counts - 1, minlength=self.n).astype(np.int64)

    def _repeat_words(self) -> np.ndarray:
        keys, at = windows(self.words, self.owner, WINDOW)
        if not len(keys):
            return np.zeros(self.n, np.int64)
        keys = keys ^ mix(self.owner[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, at[twice], 1)
        np.add.at(steps, at[twice] + WINDOW, -1)
        return np.bincount(self.owner[np.cumsum(steps[:-1]) > 0], minlength=self.n)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

    def grams(self):
        """(family, bucket of each gram, its text) of the four families."""
        bits = np.uint64(64 - BUCKETS.bit_length() + 1)
        yield 0, (mix(self.words) >> bits).astype(np.int64), self.owner
        keys, at = windows(self.words, self.owner, 2)
        yield 1, (keys >> bits).astype(np.int64), self.owner[at]
        data = self.data.astype(np.uint32)
        for family, size in ((2, 3), (3, 4)):
            m = len(data) - size + 1
            if m <= 0:
                yield family, np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            code = data[:m].copy()
            for k in range(1, size):
                code = (code << np.uint32(8)) | data[k : k + m]
            whole = self.text_of[:m] == self.text_of[size - 1 :]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            yield family, code[whole].astype(np.int64), self.text_of[:m][whole]


def measured(column: pa.Array):
    """(first, last, Measured) over the chunks of a string column."""
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets):
        yield i, j, Measured(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _features(batches):
    """Per labelled text: label and its gram shares, as packed arrays."""
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for i, j, m in measured(batch.column("text")):
            own = [[] for _ in range(m.n)]
            for family, bucket, owner in m.grams():
                total = np.maximum(np.bincount(owner, minlength=m.n), 1)
                key, counts = np.unique(owner * BUCKETS + bucket, return_counts=True)
                text = key // BUCKETS
                cuts = np.searchsorted(text, np.arange(m.n + 1))
                for t in range(m.n):
                    a, b = cuts[t], cuts[t + 1]
                    own[t].append(((key[a:b] % BUCKETS + family * BUCKETS).astype(np.int32), (counts[a:b] / total[t]).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(labels[i:j], pa.int32()),
                    pa.array([np.concatenate([x for x, _ in o]).tobytes() for o in own], pa.binary()),
                    pa.array([np.concatenate([x for _, x in o]).tobytes() for o in own], pa.binary()),
                ],
                names=["label", "at", "share"],
            )


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, by Newton steps."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _logistic(a * z + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, steps: int = 60) -> dict | None:
    """Weights and calibration from at most ``rows`` labelled rows, the first in
    hash order of their ids; None without rows of both kinds."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id", F.lit(41)), "id").limit(rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most ``rows`` rows of two numbers; of an id's texts the one with the least hash, so as many come back
    joined = texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = joined.mapInArrow(_features, "label int, at binary, share binary").collect()
    found = sorted(found, key=lambda r: (r["label"], r["at"], r["share"]))
    y = np.array([float(r["label"] > 0) for r in found])
    if not len(y) or y.min() == y.max():
        return None
    at = [np.frombuffer(r["at"], np.int32) for r in found]
    share = [np.frombuffer(r["share"], np.float32) for r in found]
    row = np.repeat(np.arange(len(y)), [len(x) for x in at])
    at, share = np.concatenate(at), np.concatenate(share) * 30
    held = np.random.default_rng(7).permutation(len(y)) % 5 == 0
    if len(y) < 50 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    used = ~held[row]
    r, a, s = row[used], at[used], share[used]
    balance = np.where(y > 0, 0.5 / max(y[~held].mean(), 1e-9), 0.5 / max(1 - y[~held].mean(), 1e-9)) * ~held
    w, bias = np.zeros(FAMILIES * BUCKETS), 0.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(r, weights=w[a] * s, minlength=len(y)) + bias
        g = (_logistic(z) - y) * balance / max(balance.sum(), 1)
        grad = np.append(np.bincount(a, weights=g[r] * s, minlength=len(w)) + 1e-5 * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        move = 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    z = np.bincount(row, weights=w[at] * share, minlength=len(y)) + bias
    over = held if held.any() else ~held
    slope, shift = _platt(z[over], y[over])
    return {"weights": (w * 30).astype(np.float32), "bias": bias, "slope": slope, "shift": shift}


def probability(m: Measured, model: dict) -> np.ndarray:
    z = np.full(m.n, model["bias"])
    for family, bucket, owner in m.grams():
        w = model["weights"][family * BUCKETS : (family + 1) * BUCKETS]
        z += np.bincount(owner, weights=w[bucket], minlength=m.n) / np.maximum(np.bincount(owner, minlength=m.n), 1)
    return _logistic(model["slope"] * z + model["shift"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The base counts, verdicts and the calibrated probability of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 4 * BUCKETS weights

    def score(batches):
        for batch in batches:
            ids = batch.column("id")
            for i, j, m in measured(batch.column("text")):
                failed = m.base_failed()
                p = np.ones(m.n) if shipped.value is None else probability(m, shipped.value)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *[pa.array(getattr(m, c), pa.int64()) for c in COUNTS], pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p)],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "p_good"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, p_good double")


def keep_good(docs: DataFrame, model: dict | None, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches):
        for batch in batches:
            for i, j, m in measured(batch.column(text_col)):
                good = ~m.base_failed()
                if shipped.value is not None:
                    good &= probability(m, shipped.value) >= keep_at
                yield batch.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(sift, docs.schema)
