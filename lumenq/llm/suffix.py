"""Removal of bytes in 100-byte strings that start earlier in the corpus.

Suffixes need only be told apart over LENGTH bytes, so bucket-pointer
refinement ends there. Initial buckets are q-grams: of the q-grams inside a
100-byte string the one with the smallest hash is its pointer, so equal
strings meet in the same bucket, at the same distance from its q-gram, and a
bucket entry stands for a run of neighbouring strings. Buckets with one entry
are done. Entries with equal runs keep their first only. Of buckets with
different runs, the first of each run are refined by sorting on the bucket
identifiers of later offsets: the identifiers of a width give those of twice
the width from the pairs at (p, p + width), and so on to LENGTH; singletons
drop out at every level.

Scale: pass one ships one narrow row for each pointer to its bucket, sorted;
rows are read as a stream, so a bucket of any size needs no memory, and equal
runs of some MB of text are put together before, so a passage that is in a
third of all documents sends one row for each such piece. Pass two reads the
texts again and ships the bytes of runs in buckets with different runs, which
it knows from a bitmap of fixed size (collisions only cost time). A bucket of
more than GROUP runs is refined by shuffles before it goes to a task: its
strings are halved by their distance from the q-gram, and the bytes that all
strings of a half have in common tell its buckets apart; halves of halves
follow until a bucket is small or its strings are equal. Documents without a
span are hashed where they are; only the texts of others are shuffled, once.

Equality of runs rests on two 64-bit hashes, of q-gram and run; what refinement
finds is compared byte by byte.

A document is its id and text: a repeated row is the same document, counts
once, and every copy of the row gets the same result; documents that share an
id are ordered by a hash of the text; null ids come first. A null text is
empty. Texts of under LENGTH bytes lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Prefix, chunks, find, mix, saved, spread, text_bytes

LENGTH, Q = 100, 32
#: Distances of a string from the end of its pointer's q-gram: 0 .. REACH.
REACH = LENGTH - Q
#: Bits of a bitmap (as a power of two), runs of a bucket refined in one task.
BITS, GROUP = 27, 20_000
_CHUNK, _TOGETHER = 1 << 20, 16 << 20
_U = np.uint64


def pointers(data: np.ndarray, offsets: np.ndarray):
    """Runs of neighbouring strings with one pointer: first and last start,
    pointer, text, and the hashes of the pointer's q-gram and of the run."""
    n = len(data)
    if n < LENGTH:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero, zero.view(_U), zero.view(_U)
    prefix = Prefix(data)
    at = np.arange(n - Q + 1)
    bits = _U(n.bit_length())
    keys = (prefix(at, at + Q, salt=5) >> bits << bits) | at.astype(_U)
    reach, low = 1, keys
    while reach * 2 <= LENGTH - Q + 1:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = LENGTH - Q + 1 - reach
    low = np.minimum(low[: len(low) - rest], low[rest:])  # of the strings at 0 .. n - LENGTH
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + LENGTH <= end)
    pointer = (low[start] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], pointer[1:] != pointer[:-1]])) if len(start) else np.zeros(0, np.int64)
    first, last = start[new], start[np.append(new[1:], len(start)) - 1] if len(new) else start[new]
    pointer = pointer[new]
    owner = np.searchsorted(offsets, first, "right") - 1
    gram = prefix(pointer, pointer + Q, salt=6)
    run = mix(prefix(first, last + LENGTH, salt=7) ^ (pointer - first).astype(_U))
    return first, last, pointer, owner, gram, run


def _least(gram: np.ndarray, run: np.ndarray, doc: np.ndarray, hash_: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order, repeated rows dropped, and which are the first of their run."""
    order = np.lexsort((first, hash_, doc, run, gram))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(gram[order]) != 0) | (np.diff(run[order]) != 0)
    other = new.copy()
    other[1:] |= (np.diff(doc[order]) != 0) | (np.diff(hash_[order]) != 0) | (np.diff(first[order]) != 0)
    return order[other], new[other]


class _Held:
    """Entries of some MB of text: their columns, and their bytes if asked for."""

    def __init__(self):
        self.columns, self.raw, self.size = [], [], 0

    def __getitem__(self, k: int) -> np.ndarray:
        return np.concatenate([c[k] for c in self.columns])

    def bytes(self, wanted: np.ndarray) -> list[bytes]:
        ends = np.cumsum([len(c[0]) for c in self.columns])
        chunk = np.searchsorted(ends, wanted, "right")
        local = wanted - (ends - [len(c[0]) for c in self.columns])[chunk]
        return [self.raw[c][0][self.raw[c][1][k] : self.raw[c][2][k] + LENGTH] for c, k in zip(chunk.tolist(), local.tolist(), strict=True)]


def _entries(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[_Held]:
    """Entries (gram, run, doc, hash, first, strings after it, distance of the
    pointer) of some MB of text at a time; ``wanted`` picks them by their q-gram."""
    held = _Held()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        doc, hash_ = batch.column("doc").to_numpy(), batch.column("hash").to_numpy()
        for i, j in chunks(offsets, _CHUNK):
            mine, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            first, last, pointer, owner, gram, run = pointers(mine, cuts)
            if wanted is not None and len(gram):
                keep = np.flatnonzero(wanted(gram))
                first, last, pointer, owner, gram, run = (x[keep] for x in (first, last, pointer, owner, gram, run))
            held.size += len(mine)
            if len(gram):
                held.columns.append([gram.view(np.int64), run.view(np.int64), doc[i:j][owner], hash_[i:j][owner], first - cuts[owner], last - first, pointer - first])
                if wanted is not None:
                    held.raw.append((mine.tobytes(), first.tolist(), last.tolist()))
            if held.size >= _TOGETHER and held.columns:
                yield held
                held = _Held()
    if held.columns:
        yield held


#: An entry in one number: start, strings after the first, and whether an earlier entry near it has the same run.
_PLACE = "gram long, run long, doc long, hash long, place long"


def _pointer_rows(batches):
    for held in _entries(batches):
        gram, run, doc, hash_, first, more = (held[k] for k in range(6))
        order, new = _least(gram, run, doc, hash_, first)
        gram, run, doc, hash_, place = gram[order], run[order], doc[order], hash_[order], first[order] << 9 | more[order] << 1 | ~new
        # what is known to be later has no business in the bucket: it goes anywhere
        gram = np.where(new, gram, mix((doc ^ place).view(_U)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, run, doc, hash_, place)], names=["gram", "run", "doc", "hash", "place"])


_FOUND = "doc long, hash long, mark long, gram long"


def _found(doc, hash_, mark, gram=None) -> pa.RecordBatch:
    none = pa.nulls(len(mark) if gram is None else len(gram), pa.int64())
    columns = [doc, hash_, mark, none] if gram is None else [none, none, none, gram]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "hash", "mark", "gram"])


def _later(batches):
    """Marks of entries that are not the first of their run, and the buckets with
    different runs. Rows come sorted; only the last one is kept in mind."""
    last = None
    for batch in batches:
        gram, run, doc, hash_, place = (batch.column(c).to_numpy() for c in ("gram", "run", "doc", "hash", "place"))
        if not len(gram):
            continue
        new_gram, new_run = np.ones(len(gram), bool), np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_run[1:] = new_gram[1:] | (run[1:] != run[:-1])
        start = place >> 9
        lead_doc, lead_hash, lead_start = 0, 0, 0
        if last is not None and last[0] == gram[0]:
            new_gram[0] = False
            if last[1] == run[0]:
                new_run[0] = False
                lead_doc, lead_hash, lead_start = last[2:]
        lead = np.maximum.accumulate(np.where(new_run, np.arange(len(gram)), -1))
        led = lambda x, outside: np.where(lead >= 0, x[np.maximum(lead, 0)], outside)  # noqa: E731, B023
        first = [led(doc, lead_doc), led(hash_, lead_hash), led(start, lead_start)]
        again = (doc != first[0]) | (hash_ != first[1]) | (start != first[2]) | (place & 1 != 0)
        more = place >> 1 & 255
        if again.any():
            yield _found(doc[again], hash_[again], (start << 32 | (start + more + LENGTH))[again])
        mixed = np.unique(gram[new_run & ~new_gram])
        if len(mixed):
            yield _found(None, None, None, mixed)
        last = (gram[-1], run[-1], *[x[-1] for x in first])


def bitmap(values: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITS bits with a bit for the high bits of each value of one long column."""
    bit = F.shiftrightunsigned(values.columns[0], 64 - BITS)
    words = values.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({values.columns[0]}, {64 - BITS}) % 64 as int))").alias("one"))
    words = words.groupBy("word").agg(F.bit_or("one").alias("some")).toArrow()  # at most 2**(BITS - 6) rows
    out = np.zeros(1 << max(BITS - 6, 0), _U)
    out[words.column("word").to_numpy()] = words.column("some").to_numpy().view(_U)
    return out


def among(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in a bitmap."""
    bit = values >> _U(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) != 0


def _refine(sets: list[tuple]) -> list[tuple[int, int, int]]:
    """Strings of some runs that an earlier run has: (set, first, last) starts in
    the run. A set is (order, bytes); whole buckets must be given."""
    data = np.frombuffer(b"".join(s[1] for s in sets), np.uint8)
    size = np.array([len(s[1]) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size)])
    rank = np.empty(len(sets), np.int64)
    rank[sorted(range(len(sets)), key=lambda k: sets[k][0])] = np.arange(len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    place = np.arange(len(data)) - begin[owner]
    at = np.flatnonzero(place + LENGTH <= size[owner])
    prefix = Prefix(data)

    def identify(where: np.ndarray, width: int) -> np.ndarray:
        """Bucket identifiers of the bytes from each offset, from those of half the width."""
        if width <= Q:
            return np.unique(prefix(where, where + width, salt=8), return_inverse=True)[1]
        half = max(w for w in widths if w < width)
        both = np.unique(np.concatenate([where, where + width - half]))
        ids = identify(both, half)
        pairs = ids[find(both, where)[0]] * (len(both) + 1) + ids[find(both, where + width - half)[0]]
        return np.unique(pairs, return_inverse=True)[1]

    widths = [Q]
    while widths[-1] < LENGTH:
        widths.append(min(2 * widths[-1], LENGTH))
    ids = np.zeros(len(at), np.int64)
    for width in widths:
        ids = identify(at, width)
        several = np.bincount(ids, minlength=1)[ids] > 1
        at, ids = at[several], ids[several]
        if not len(at):
            return []
    order = np.lexsort((at, rank[owner[at]], ids))
    new = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    lead = at[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = np.concatenate([(strings[at[order][k : k + 65536]] == strings[lead[k : k + 65536]]).all(1) for k in range(0, len(order), 65536)])
    later = ~new & same
    if not (new | same).all():  # two strings with one hash: tell them apart by their bytes
        for k in np.flatnonzero(np.isin(ids[order], ids[order][~new & ~same])):
            mine = np.flatnonzero(ids[order][:k] == ids[order][k])
            later[k] = any(strings[at[order][m]].tobytes() == strings[at[order][k]].tobytes() for m in mine)
    at = np.sort(at[order][later])
    if not len(at):
        return []
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
    starts, ends = at[np.concatenate([[0], cut])], at[np.append(cut, len(at)) - 1]
    return [(int(owner[a]), int(place[a]), int(place[b])) for a, b in zip(starts, ends, strict=True)]


_RUN = ("gram", "run", "doc", "hash", "first", "away", "bytes")
#: Marks, or runs of buckets too large for a task.
_REFINED = "doc long, hash long, mark long, gram long, first long, away int, bytes binary"


def _refine_runs(batches):
    """Rows sorted by bucket and run; some thousand runs of whole buckets are
    refined at a time. Of rows with one run (null: it is unlike any other) the first counts."""
    schema = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("mark", pa.int64()), ("gram", pa.int64()), ("first", pa.int64()), ("away", pa.int32()), ("bytes", pa.binary())])
    waiting, size, bucket, large, last = [], 0, [], False, (None, None)

    def refined():
        out = [(waiting[k][2], waiting[k][3], (waiting[k][4] + a) << 32 | (waiting[k][4] + b + LENGTH)) for k, a, b in _refine([((r[2], r[3], r[4]), r[6]) for r in waiting])]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("doc", "hash", "mark"), o, strict=True)) for o in out], schema)

    def passed_on():
        return pa.RecordBatch.from_pylist([{c: v for c, v in zip(_RUN, r, strict=True) if c != "run"} for r in bucket], schema)

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in _RUN], strict=True):
            if row[0] != last[0]:
                if large:
                    yield passed_on()
                elif len(bucket) > 1:
                    waiting += bucket
                    size += sum(len(r[6]) for r in bucket)
                bucket, large = [], False
                if size > 1 << 20:
                    yield from refined()
                    waiting, size = [], 0
            elif row[1] is not None and row[1] == last[1]:
                continue
            last = row[:2]
            bucket.append(row)
            if len(bucket) > GROUP:
                large = True
                yield passed_on()
                bucket = []
    if large:
        yield passed_on()
    else:
        waiting += bucket
    if len(waiting) > 1:
        yield from refined()


def _halves(runs: DataFrame) -> DataFrame:
    """The parts of each run in the two halves of its bucket's distances
    ``low .. high``, filed under a new bucket: the old one and the bytes that
    all strings of the half have in common. A string at distance d has the bytes
    ``-d .. LENGTH - d`` of the q-gram's place, a run those of its strings; its
    first one is the farthest, at distance ``away``."""
    least = F.col("away") - (F.octet_length("bytes") - LENGTH)
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    range_ = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    half = F.explode(F.array(range_(F.col("low"), middle), range_(middle + 1, F.col("high")))).alias("half")
    cut = runs.select("*", least.alias("least"), half).where("half.low <= half.high and least <= half.high and away >= half.low")
    far, near = F.least(F.col("away"), F.col("half.high")), F.greatest(F.col("least"), F.col("half.low"))
    common = F.substring("bytes", F.col("away") - F.col("half.low") + 1, F.lit(LENGTH) + F.col("half.low") - F.col("half.high"))
    return cut.select(
        F.xxhash64("gram", "half.low", common).alias("gram"), "doc", "hash", (F.col("first") + F.col("away") - far).alias("first"), far.alias("away"),
        F.substring("bytes", F.col("away") - far + 1, far - near + LENGTH).alias("bytes"), "half.low", "half.high",
    )


def _sorted_runs(runs: DataFrame) -> DataFrame:
    return spread(runs, "gram").sortWithinPartitions("gram", "run", "doc", "hash", "first").select(*_RUN)


def _refine_large(runs: DataFrame) -> list[DataFrame]:
    """Marks of the strings of large buckets that an earlier run of the bucket has."""
    out, now = [], runs.select("gram", "doc", "hash", "first", "away", "bytes", F.lit(0).alias("low"), F.lit(REACH).alias("high"))
    while not now.isEmpty():
        parts = saved(_halves(now), "halves")
        several = parts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
        parts = saved(parts.join(several, "gram"), "halves")
        # equal strings: the first one stays
        single = parts.where("low = high")
        least = single.groupBy("gram", "bytes").agg(F.min(F.struct("doc", "hash", "first")).alias("one"))
        later = single.join(least, ["gram", "bytes"]).where(F.struct("doc", "hash", "first") != F.col("one"))
        out.append(saved(later.select("doc", "hash", (F.shiftleft("first", 32) + F.col("first") + LENGTH).alias("mark")), "marks"))
        small = parts.where((F.col("low") < F.col("high")) & (F.col("n") <= GROUP)).withColumn("run", F.lit(None).cast("long"))
        out.append(saved(_sorted_runs(small).mapInArrow(_refine_runs, _REFINED).select("doc", "hash", "mark"), "marks"))
        now = parts.where((F.col("low") < F.col("high")) & (F.col("n") > GROUP)).drop("n")
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, the document's order (doc, hash) and its text. The hash is 0
    where no id has two texts."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("hash"), "text")
    clash = rows.groupBy("doc").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a != b")
    return rows.withColumn("hash", F.lit(0).cast("long")) if clash.isEmpty() else rows


def _marks(texts: DataFrame) -> DataFrame:
    narrow = texts.select("doc", "hash", "text")
    rows = spread(narrow.mapInArrow(_pointer_rows, _PLACE), "gram").sortWithinPartitions("gram", "run", "doc", "hash", "place")
    found = saved(rows.mapInArrow(_later, _FOUND), "marks")
    shipped = texts.sparkSession.sparkContext.broadcast(bitmap(found.where("gram is not null").select("gram")))  # 2**BITS bits

    def run_rows(batches):
        for held in _entries(batches, lambda gram: among(shipped.value, gram)):
            columns = [held[k] for k in range(7)]
            order, new = _least(*columns[:5])
            order = order[new]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[order]) for c in columns[:5]], pa.array(columns[6][order], pa.int32()), pa.array(held.bytes(order), pa.binary())], names=list(_RUN))

    runs = narrow.mapInArrow(run_rows, "gram long, run long, doc long, hash long, first long, away int, bytes binary")
    refined = saved(_sorted_runs(runs).mapInArrow(_refine_runs, _REFINED), "refined")
    spans = [found.where("mark is not null"), refined.where("mark is not null"), *_refine_large(refined.where("mark is null"))]
    out = spans[0].select("doc", "hash", "mark")
    for more in spans[1:]:
        out = out.unionByName(more.select("doc", "hash", "mark"))
    return out


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, hash, mark`` of each span to remove (start << 32 | end, in bytes);
    spans of one document overlap."""
    return _marks(_texts(docs, id_col, text_col))


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out = []
        for k, (mine, n_bytes, sha) in enumerate(zip(batch.column("marks").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("sha").to_pylist(), strict=True)):
            text = data[offsets[k] : offsets[k + 1]]
            if sha is not None or not mine:
                out.append((n_bytes, 0, 0, sha or hashlib.sha256(text).hexdigest()))
                continue
            spans = np.array(mine, np.int64)
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, spans >> 32, 1)
            np.add.at(step, spans & 0xFFFFFFFF, -1)
            gone = np.cumsum(step[:-1]) > 0
            n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((n_bytes, int(gone.sum()), n_spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        n_bytes, n_removed, n_spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    texts = _texts(docs, id_col, text_col)
    spans = _marks(texts)
    shipped = texts.sparkSession.sparkContext.broadcast(bitmap(spans.select(F.xxhash64("doc", "hash").alias("key"))))  # 2**BITS bits

    def sift(batches):
        """Texts that surely have no span are hashed here and go no further."""
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            maybe = among(shipped.value, batch.column("key").to_numpy().view(_U))
            sha = [None if m else hashlib.sha256(data[a:b]).hexdigest() for m, a, b in zip(maybe.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            text = pc.if_else(pa.array(maybe), batch.column("text"), None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "doc", "hash")], text, pa.array(np.diff(offsets), pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "doc", "hash", "text", "n_bytes", "sha"])

    rows = texts.select("doc_id", "doc", "hash", "text", F.xxhash64("doc", "hash").alias("key")).mapInArrow(sift, "doc_id long, doc long, hash long, text string, n_bytes long, sha string")
    by_doc = spans.groupBy("doc", "hash").agg(F.collect_list("mark").alias("marks"))
    return rows.join(by_doc, ["doc", "hash"], "left").select("doc_id", "text", "marks", "n_bytes", "sha").mapInArrow(_cut, _KEPT)
