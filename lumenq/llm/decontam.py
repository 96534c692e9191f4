"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

Words are runs of letters, digits and non-ASCII bytes, A-Z lowered, so
punctuation and case do not matter. Every 3-gram of an item is counted over
the whole corpus; those not far above the median of their item's are its rare
seeds (so an item that was copied a million times keeps its seeds). Where a
text has a rare seed, or a share EVIDENCE of all grams of an item, the words
around them are aligned with the item: match 1, mismatch and gap -0.5. A text
is contaminated if the best local score reaches SHARE of the item's words, or
of PASSAGE words for longer items.

The corpus is read twice and never shuffled; what moves is one count for each
seed and the hits. The benchmark is broadcast in blocks of about BLOCK_BYTES
of text, one at a time; a larger one takes its readings of the corpus block by
block, and what a block found or left is written before the next.

Items with equal words are one item, under its smallest id; null ids come
last and are given as null. Null texts have no words; items of under MIN_WORDS
words are too short to be evidence and match nothing. Every row is judged by
itself, so repeated rows give repeated hits, null ids are no matter, and of
alignments with equal scores the first in the text is given. Without items or
without rows nothing is found.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Prefix, chunks, find, lowered, release, runs, saved, text_bytes, windows

GRAM, COMMON, EVIDENCE, SHARE, PASSAGE, MIN_WORDS, BLOCK_BYTES = 3, 10, 0.15, 0.5, 50, 5, 32 << 20
PENALTY = 0.5


def word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x80:] = True
    for a, b in (b"09", b"az", b"AZ"):
        table[a : b + 1] = True
    return table


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, owner = runs(word_bytes()[data], offsets)
    return Prefix(lowered(data))(starts, ends, salt=21), owner


class Items:
    """The words of a block of items, and where each 3-gram of theirs stands."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        data, offsets = text_bytes(pa.array([t for _, t in rows], pa.string()))
        keys, owner = words(data, offsets)
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        by_words: dict[bytes, int | None] = {}
        for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
            if cuts[k + 1] - cuts[k] >= MIN_WORDS:
                by_words.setdefault(keys[cuts[k] : cuts[k + 1]].tobytes(), rows[k][0])
        self.ids = list(by_words.values())
        self.words = [np.frombuffer(w, np.uint64) for w in by_words]
        grams = [windows(w, np.zeros(len(w), np.int8), GRAM)[0] for w in self.words]
        self.gram = np.concatenate([np.zeros(0, np.uint64), *grams])
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        self.keys = np.unique(self.gram)

    def choose(self, counts: dict[int, int]) -> None:
        """Drop grams that the corpus has not; tell the rare ones, those not far
        more frequent than the median of their item's."""
        n = np.array([counts.get(int(k), 0) for k in self.gram.view(np.int64)], np.int64)
        rare = np.zeros(len(n), bool)
        cuts = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = a + np.flatnonzero(n[a:b] > 0)
            if len(mine):
                rare[mine] = n[mine] <= COMMON * np.median(n[mine]) + COMMON
        some = np.flatnonzero(n > 0)
        some = some[np.argsort(self.gram[some], kind="stable")]
        self.seed, self.seed_item, self.seed_at, self.rare = self.gram[some], self.item[some], self.at[some], rare[some]
        self.needed = np.array([max(2, EVIDENCE * (len(w) - GRAM + 1)) for w in self.words])


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local score, and the words of ``text`` that it spans."""
    m = len(text)
    ramp = PENALTY * np.arange(m)
    row, begin = np.zeros(m + 1), np.arange(m + 1)
    best = (0.0, 0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(text == w, 1.0, -PENALTY)
        start = begin[:-1].copy()
        up = row[1:] - PENALTY
        higher = up > diagonal
        score = np.where(higher, up, diagonal)
        start[higher] = begin[1:][higher]
        low = score <= 0
        score[low] = 0
        start[low] = np.flatnonzero(low) + 1
        # gaps in the item: the best cell to the left, less the way from there
        level = score + ramp
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level >= top, np.arange(m), 0))
        along = top - ramp
        start = np.where(along > score, start[source], start)
        row, begin = np.concatenate([[0], np.maximum(score, along)]), np.concatenate([[0], start])
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(begin[k]), k)
    return best


def hits(items: Items, column: pa.Array):
    """(row, item, score by words needed, first and last word) of contaminated texts."""
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets):
        keys, owner = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        grams, at = windows(keys, owner, GRAM)
        low = np.searchsorted(items.seed, grams)
        found = np.flatnonzero(find(items.seed, grams)[1])
        many = np.searchsorted(items.seed, grams[found], "right") - low[found]
        place = np.repeat(at[found], many)
        seed = np.repeat(low[found], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        who, which = owner[place], items.seed_item[seed]
        order = np.lexsort((place, which, who))
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        if not len(order):
            continue
        group = np.flatnonzero(np.concatenate([[True], (np.diff(who[order]) != 0) | (np.diff(which[order]) != 0)]))
        ends = np.append(group[1:], len(order))
        worth = np.add.reduceat(items.rare[seed[order]], group, dtype=np.int64) > 0
        worth |= ends - group >= items.needed[which[order[group]]]
        for a, b in zip(group[worth], ends[worth], strict=True):
            doc, item = int(who[order[a]]), int(which[order[a]])
            goal = items.words[item]
            size, best = len(goal), (0.0, 0, 0)
            spots = place[order[a:b]]
            back = items.seed_at[seed[order[a:b]]]
            starts, ends = spots - back - size // 2 - 2, spots - back + size + size // 2 + 2
            by_start = np.argsort(starts, kind="stable")
            starts, ends = starts[by_start], np.maximum.accumulate(ends[by_start])
            new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
            for x, y in zip(new, [*new[1:], len(starts)], strict=True):
                first = max(int(starts[x]), int(cut[doc]))
                score, p, q = align(goal, keys[first : min(int(ends[y - 1]), int(cut[doc + 1]))])
                if score > best[0]:
                    best = (score, first + p - int(cut[doc]), first + q - int(cut[doc]))
            if best[0] >= SHARE * min(size, PASSAGE):
                yield i + doc, item, min(1.0, best[0] / min(size, PASSAGE)), best[1], best[2]


def _items(docs: DataFrame, rows: DataFrame, text_col: str) -> Broadcast:
    """One block of items with its seeds chosen by their counts in the corpus."""
    items = Items([tuple(r) for r in rows.collect()])
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast(items.keys)

    def count(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            total = np.zeros(len(shipped.value), np.int64)
            for i, j in chunks(offsets):
                keys, owner = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, known = find(shipped.value, windows(keys, owner, GRAM)[0])
                total += np.bincount(at[known], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(shipped.value[some].view(np.int64)), pa.array(total[some])], names=["gram", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    items.choose({r["gram"]: r["n"] for r in counted.collect()})  # one row at most for each gram of the block
    shipped.unpersist()
    return context.broadcast(items)


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> list[DataFrame]:
    """The benchmark in blocks of about BLOCK_BYTES; rows are dealt by a hash of the text."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    return [rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each contaminated row and item: ``doc_id, item_id, score``
    (1 is a whole copy), and the words of the text that align."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks, found = _blocks(benchmark, item_col, item_text), []
    for block in blocks:
        shipped = _items(rows, block, "text")

        def run(batches, shipped=shipped):
            for batch in batches:
                out = [(row, shipped.value.ids[item], score, a, b) for row, item, score, a, b in hits(shipped.value, batch.column("text"))]
                if out:
                    row, item, score, first, last = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(score), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, last_word long")
        found.append(saved(part, "found") if len(blocks) > 1 else part)
        if len(blocks) > 1:
            shipped.unpersist()
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that are not contaminated, with the columns they came with."""
    blocks, now = _blocks(benchmark, item_col, item_text), docs
    for k, block in enumerate(blocks):
        shipped = _items(docs, block, text_col)

        def sift(batches, shipped=shipped):
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                bad[[h[0] for h in hits(shipped.value, batch.column(text_col))]] = True
                yield batch.filter(pa.array(~bad))

        after = now.mapInArrow(sift, docs.schema)
        if k + 1 < len(blocks):
            after = saved(after, "left")
            if now is not docs:
                release(now)
            shipped.unpersist()
        now = after
    return now
