"""Contiguous shards of near equal size (law ``bytes``).

Rows are range-partitioned in id order and checkpointed once, with their sizes
only. Per-partition totals give each partition its global prefix; a row goes
to the shard in which the middle of its bytes falls. Three narrow passes over
the small table, no window over all rows, nothing larger than the number of
partitions (times shards) on the driver.

Null texts have no bytes; null ids come first; repeated rows are rows of their
own; an empty table gives an empty result. Shards may stay empty when there
are fewer rows than shards.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

OVERHEAD = 8


def _by_part(batches):
    """Rows come part by part, each part whole and in order within a task."""
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.diff(parts)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(parts)], strict=True):
            if b > a:
                yield int(parts[a]), batch.slice(a, b - a)


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row;
    ``keep`` names further columns to carry along."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        *[F.col(c) for c in keep or []],
    )
    order = ["doc_id", "text_crc32", "size"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.withColumn("part", F.spark_partition_id()))
    totals = {r["part"]: (r["n"], r["bytes"]) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    start, at, total = {}, 0, sum(b for _, b in totals.values())
    for part in sorted(totals):
        start[part], at = at, at + totals[part][1]

    def place(batches):
        done: Counter = Counter()
        for part, batch in _by_part(batches):
            size = batch.column("size").to_numpy()
            before = start[part] + done[part] + np.cumsum(size) - size
            done[part] += int(size.sum())
            # the middle of the row, doubled to stay in whole numbers
            where = [min(n_shards - 1, (2 * int(b) + int(s)) * n_shards // (2 * total)) for b, s in zip(before, size, strict=True)] if total > 1 << 56 else np.minimum(n_shards - 1, (2 * before + size) * n_shards // (2 * total))
            yield batch, part, np.asarray(where, np.int32)

    count_schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())])

    def count(batches):
        seen: Counter = Counter()
        for _, part, where in place(batches):
            for s, n in zip(*np.unique(where, return_counts=True), strict=True):
                seen[part, int(s)] += int(n)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=count_schema)

    cells = rows.mapInArrow(count, "part int, shard int, n long").groupBy("part", "shard").agg(F.sum("n").alias("n")).collect()
    first, filled = {}, Counter()
    for part, s, n in sorted((r["part"], r["shard"], r["n"]) for r in cells):
        first[part, s] = filled[s]
        filled[s] += n

    names = ["doc_id", "size", "text_crc32", *(keep or [])]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", law string, shard int, slot long, grown_shard int"

    def number(batches):
        used: Counter = Counter()
        for batch, part, where in place(batches):
            slot = np.empty(len(where), np.int64)
            for s in np.unique(where):
                mine = np.flatnonzero(where == s)
                slot[mine] = first[part, int(s)] + used[part, int(s)] + np.arange(len(mine))
                used[part, int(s)] += len(mine)
            arrays = [batch.column(c) for c in names] + [pa.array(["bytes"] * len(where)), pa.array(where), pa.array(slot), pa.nulls(len(where), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "law", "shard", "slot", "grown_shard"])

    return rows.mapInArrow(number, schema)

