"""Ordered folds over the rows of a key, for what no window can express."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``fold`` of each key's rows in order. Rows are dealt out by key and sorted,
    then streamed: a task holds one key's rows at a time, and small keys cost no
    call of their own into Python."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        held: list[dict] = []
        out: list[dict] = []
        key = None
        for batch in batches:
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if mine != key and held:
                    out += fold(held)
                    held = []
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                key = mine
                held.append(row)
        if held:
            out += fold(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
