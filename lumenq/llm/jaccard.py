"""Jaccard join of texts on word 5-grams, 0.8 or more.

Equal word sequences are merged into classes first (a hash aggregation, so a
text with any number of copies is one row). Class representatives get MinHash
band keys; a bucket ties its members to its smallest one, and the connected
components of these ties split the candidates into groups that contain every
candidate pair. A group is cut into blocks of at most about BLOCK members and
every pair of blocks is one unit of work, so no task holds a large group. A
group of over MANY blocks that hangs together by small buckets (a long chain of
texts, each like the next) is compared bucket by bucket instead, where that
ships fewer sets; a pair counts in its first common bucket.
Within a unit, MinHash values are compared step by step and a pair is dropped
as soon as the posterior probability that its similarity reaches the threshold
falls below TOLERANCE (uniform prior); the rest is verified exactly on the
shingle sets. Units return one row per linked member, never pairs: its number
of partners and its tie to the unit's component.

With BANDS keys of ROWS values a pair at the threshold misses every bucket
with probability (1 - 0.8**6)**40 = 5e-6; TOLERANCE adds less.

Words are ``[^ \\t-\\r]+`` with A-Z lowered. A text of 1 to 4 words has one
shingle, all its words; a text without words (or null) is linked to nothing
and is its own class. ``n_links`` counts the other rows at the threshold,
copies included. Ids may repeat: rows are told apart by their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Prefix, chunks, lowered, mix, release, runs, saved, separators, spread, text_bytes, windows

SHINGLE, THRESHOLD, ROWS, BANDS, TOLERANCE = 5, 0.8, 6, 40, 1e-6
#: Members of a block; candidate rows (of 32 bytes) up to which they are broadcast.
BLOCK, BROADCAST_ROWS = 512, 500_000
#: Blocks of a group from which it may be compared by buckets.
MANY = 16
#: Ids (of 8 bytes) up to which those to remove are broadcast.
GONE_ROWS = 2_000_000
#: MinHash values compared after each step.
STEPS = (16, 32, 64, 128, ROWS * BANDS)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64))
    return seeds[::2].astype(np.uint32) | np.uint32(1), seeds[1::2].astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in text order, their cuts by text, and a hash of each text's word sequence."""
    n = len(offsets) - 1
    starts, ends, owner = runs(~separators()[data], offsets)
    words = Prefix(lowered(data))(starts, ends)
    many = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(many)])
    place = mix(np.arange(len(words), dtype=np.uint64) - first[owner].astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ place), dtype=np.uint64)])
    whole = mix(sums[first[1:]] - sums[first[:-1]] + many.astype(np.uint64))
    keys, at = windows(words, owner, SHINGLE)
    keys_owner = owner[at]
    short = np.flatnonzero((many > 0) & (many < SHINGLE))
    keys, keys_owner = np.concatenate([keys, whole[short]]), np.concatenate([keys_owner, short])
    order = np.argsort(keys_owner, kind="stable")
    return keys[order], np.concatenate([[0], np.cumsum(np.bincount(keys_owner, minlength=n))]), whole


def signatures(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """MinHash values (texts x hashes) of non-empty sets."""
    a, b = _multipliers()
    x = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(cuts) - 1, len(a)), np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(x * a[k] + b[k], cuts[:-1]) if len(cuts) > 1 else 0
    return out


def _fingerprint(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in chunks(offsets):
            keys, cuts, whole = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sizes = np.diff(cuts)
            full = sizes > 0
            bands = np.zeros((j - i, BANDS), np.int64)
            if full.any():
                sig = signatures(keys, np.append(cuts[:-1][full], len(keys)))
                for k in range(BANDS):
                    key = np.full(len(sig), k + 1, np.uint64)
                    for c in range(k * ROWS, (k + 1) * ROWS):
                        key = mix(key) + sig[:, c]
                    bands[full, k] = mix(key).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(whole.view(np.int64)), pa.array(full), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]), pa.int32()), pa.array(bands[full].ravel()))],
                names=["doc_id", "node", "full", "bands"],
            )


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among ``compared`` values that leave the pair a chance:
    with m matches the posterior is Beta(m+1, n-m+1), whose upper tail at the
    threshold is the chance of at most m successes in n+1 trials."""
    p, total = (1 - threshold) ** (compared + 1), 0.0
    for m in range(compared + 1):
        total += p
        if total >= tolerance:
            return m
        p *= (compared + 1 - m) / (m + 1) * threshold / (1 - threshold)
    return compared


def unit_links(sets: list[np.ndarray], side: np.ndarray, cross: bool, threshold: float = THRESHOLD, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one unit that reach the threshold; only pairs of two sides
    if ``cross``, and none that agree in a column of ``earlier``."""
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    if cross:
        ok &= side[i] != side[j]
    i, j = i[ok], j[ok]
    if earlier is not None and earlier.shape[1] and len(i):
        new = np.concatenate([~(earlier[i[a : a + 65536]] == earlier[j[a : a + 65536]]).any(1) for a in range(0, len(i), 65536)])
        i, j = i[new], j[new]
    if not len(i):
        return i, j
    keys = np.concatenate(sets)
    cuts = np.concatenate([[0], np.cumsum(size)])
    sig = signatures(keys, cuts)
    matches, done = np.zeros(len(i), np.int64), 0
    for step in STEPS:
        for a in range(0, len(i), 1 << 16):
            part = slice(a, a + (1 << 16))
            matches[part] += (sig[i[part], done:step] == sig[j[part], done:step]).sum(1)
        left = matches >= least_matches(step, threshold, TOLERANCE)
        i, j, matches, done = i[left], j[left], matches[left], step
    if not len(i):
        return i, j
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(used)), size[used])
    _, column, counts = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts > 1)
    column_of = np.full(len(counts), -1)
    column_of[common] = np.arange(len(common))
    column = column_of[column]
    row, column = row[column >= 0], column[column >= 0]
    words = len(common) // 64 + 1
    bits = np.zeros((len(used), words), np.uint64)
    np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    both = np.empty(len(i), np.int64)
    step = max(1, (1 << 21) // words)
    for a in range(0, len(i), step):
        b = slice(a, a + step)
        both[b] = np.bitwise_count(bits[place[i[b]]] & bits[place[j[b]]]).sum(1, dtype=np.int64)
    real = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[real], j[real]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, by hooking and shortcutting."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _units(batches):
    """Rows come sorted by unit; a unit is worked on when the next begins."""
    held, unit = [], None

    def work():
        node = np.array([h[0] for h in held], np.int64)
        _, keep = np.unique(node, return_index=True)  # a repeated row gives its set twice
        node = node[keep]
        copies = np.array([held[k][1] for k in keep], np.int64)
        side = np.array([held[k][2] for k in keep])
        number = unit[3]  # of the band, in a unit of one bucket
        earlier = None if number is None else np.array([held[k][4][:number] for k in keep], np.int64).reshape(len(keep), number)
        i, j = unit_links([np.frombuffer(held[k][3], np.uint64) for k in keep], side, unit[1] != unit[2], earlier=earlier)
        if len(i):
            n = len(node)
            partners = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
            root = _roots(n, i, j)
            mine = partners > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(node[root[mine]]), pa.array(partners[mine], pa.int64()), pa.array(links[mine].astype(np.int64))], names=["node", "buddy", "partners", "links"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("comp", "low", "high", "k", "node", "copies", "side", "set", "bands")]
        for comp, low, high, k, node, copies, side, packed, bands in zip(*columns, strict=True):
            if unit != (comp, low, high, k):
                if len(held) > 1:
                    yield from work()
                held, unit = [], (comp, low, high, k)
            held.append((node, copies, side, packed, bands))
    if len(held) > 1:
        yield from work()


def _sets(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        node = batch.column("node").to_numpy()
        for i, j in chunks(offsets):
            keys, cuts, whole = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            mine = np.flatnonzero(whole.view(np.int64) == node[i:j])
            packed = [np.unique(keys[cuts[k] : cuts[k + 1]]).tobytes() for k in mine]
            part = batch.slice(i, j - i).take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("comp", "blocks", "node", "copies")], pa.array(packed, pa.binary())], names=["comp", "blocks", "node", "copies", "set"])


def _by_bucket(classes: DataFrame, groups: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The groups to be compared by pairs of blocks, and of the others each
    node's buckets (comp, k, blocks): large groups that ship fewer sets so."""
    large = sizes.where(F.col("members") > MANY * BLOCK)
    if large.isEmpty():
        return groups, None
    filed = classes.select("node", F.posexplode("bands").alias("k", "comp")).join(groups.join(large.select("root"), "root"), "node")
    buckets = filed.groupBy("root", "k", "comp").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    buckets = saved(buckets, "buckets")
    costs = buckets.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("sets")).join(large, "root")
    chains = saved(costs.where(F.col("sets") < F.col("members") * F.ceil(F.col("members") / BLOCK)).select("root"), "chains")
    found = filed.join(buckets.join(chains, "root", "left_semi").select("k", "comp", "blocks"), ["k", "comp"])
    return groups.join(chains, "root", "left_anti"), saved(found.select("node", "k", "comp", "blocks"), "by_bucket")


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingle sets of the wanted nodes; ids only are broadcast, if there are not too many."""
    small = wanted.count() <= BROADCAST_ROWS
    sets = texts.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "comp", "blocks", "node", "copies")
    return sets.mapInArrow(_sets, "comp long, blocks int, node long, copies long, set binary")


def _units_of(sets: DataFrame) -> DataFrame:
    """Each set once for every pair of blocks that its own is in."""
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = sets.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    return units.select("comp", "low", "high", "k", "node", "copies", "side", "set", "bands")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows as ``doc_id, node, full`` (the word sequence, whether it has words); of
    each node ``class_id``, ``n_links`` and its class's best row: the one with the
    smallest id, among equal ids the one with the smallest node; and the saved
    tables behind both."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = texts.mapInArrow(_fingerprint, "doc_id long, node long, full boolean, bands array<long>")
    rows = saved(prints.select("doc_id", "node", "full", F.when(F.col("full"), F.col("bands")).alias("bands")), "prints")
    classes = rows.where("full").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = saved(classes, "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared_bands = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    ties = banded.join(shared_bands, "band").where("node != pivot").select("node", "pivot")
    groups = components(ties)
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    groups, buckets = _by_bucket(classes, groups, sizes)
    wanted = groups.join(sizes, "root").join(classes.select("node", "rep", "copies"), "node")
    wanted = saved(wanted.select(F.col("root").alias("comp"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), "node", "rep", "copies"), "wanted")
    none = [F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<long>").alias("bands")]
    units = _units_of(_sets_of(texts, wanted).select("*", *none))
    if buckets is not None:
        single = buckets.select("node").distinct().join(classes.select("node", "rep", "copies"), "node").select(F.col("node").alias("comp"), F.lit(1).alias("blocks"), "node", "rep", "copies")
        sets = saved(_sets_of(texts, single).select("node", "copies", "set"), "sets").join(classes.select("node", "bands"), "node")
        units = units.unionByName(_units_of(buckets.join(sets, "node")))
    units = spread(units, "comp", "low", "high", "k").sortWithinPartitions("comp", "low", "high", "k", "node")
    linked = saved(units.mapInArrow(_units, "node long, buddy long, partners long, links long"), "links")
    ends = components(linked.select("node", "buddy"))
    best = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("node").alias("node"))
    heads = ends.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"), F.min(best).alias("best"))
    found = ends.join(heads, "root").select("node", "class_id", "best").join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    found = classes.select("node", "rep", "copies").join(found, "node", "left")
    found = found.select("node", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("best", best).alias("best"))
    release(wanted)
    return rows.select("doc_id", "node", "full"), found, [rows, classes, linked]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links`` of each row; ``class_id`` is the smallest id
    of the rows connected with it by links, its own if there are none."""
    rows, found, _ = classes_of(docs, id_col, text_col)
    out = rows.where("full").select("doc_id", "node").join(found, "node", "left").select("doc_id", "class_id", "n_links")
    return out.unionByName(rows.where("not full").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _with_node(docs: DataFrame, text_col: str) -> DataFrame:
    """Whole rows with last columns ``_lq_node, _lq_full``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.columns[at].cast(pa.string()))
            for i, j in chunks(offsets):
                _, cuts, whole = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(whole.view(np.int64)), pa.array(np.diff(cuts) > 0)], names=[*part.schema.names, "_lq_node", "_lq_full"])

    return docs.mapInArrow(run, docs.withColumn("_lq_node", F.lit(0).cast("long")).withColumn("_lq_full", F.lit(True)).schema)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class stays, with the columns it came with: the one with
    the smallest id (null ids come last), among equal ids the smallest word
    sequence by hash, among equal words the least by a hash of text and all
    columns that have one. Rows without words all stay. Ids may repeat: where
    all rows of an id go, the id decides; where some do, id and words decide.
    An empty table gives no rows. Names that begin with ``_lq_`` are ours."""
    rows, found, behind = classes_of(docs, id_col, text_col)
    judged = rows.join(found.select("node", "best"), "node", "left")
    stays = ~F.col("full") | ((F.col("best.node") == F.col("node")) & F.col("best.id").eqNullSafe(F.col("doc_id")))
    judged = saved(judged.select(F.col("doc_id").alias("_lq_id"), "node", "full", stays.alias("stays")), "judged")
    for table in behind:
        release(table)
    ids = saved(judged.groupBy("_lq_id").agg(F.count("*").alias("n"), F.count_if("stays").alias("n_stay"), F.count_if("full").alias("n_full")).where("n_stay < n or n > 1"), "ids")
    on = F.col(id_col).cast("long").eqNullSafe(F.col("_lq_id"))
    # ids only, if there are not too many of them; else texts are shuffled
    few = lambda keys: F.broadcast(keys) if keys.count() <= GONE_ROWS else keys
    kept = docs.join(few(ids.where("n_stay = 0").select("_lq_id")), on, "left_anti")
    unclear = ids.where("n_stay > 0 and n > 1 and n_full > 0").select("_lq_id")
    if unclear.isEmpty():
        return kept
    unclear = few(unclear)
    some = _with_node(kept.join(unclear, on, "left_semi"), text_col)
    best = judged.where("full and stays").select("_lq_id", F.col("node").alias("_lq_best")).distinct()
    chosen = some.where("_lq_full").join(best, on & (F.col("_lq_node") == F.col("_lq_best")), "left_semi")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = chosen.groupBy(F.col(id_col).cast("long").alias("_lq_id"), "_lq_node").agg(F.min_by(whole, F.xxhash64(*hashed)).alias("_lq_row")).select("_lq_row.*")
    return kept.join(unclear, on, "left_anti").unionByName(some.where("not _lq_full").select(*[F.col(f"`{c}`") for c in docs.columns])).unionByName(chosen)
