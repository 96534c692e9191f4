import zlib
from collections import Counter

from lumenq.llm import sharding

from .cases import SCHEMA, rows


def test_shards_match_brute_force(spark):
    data = rows()
    got = sharding.shard(spark.createDataFrame(data, SCHEMA).repartition(5), 7).collect()
    size = lambda t: len((t or "").encode()) + 8
    order = sorted((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), size(r[1])) for r in data)
    total, before, want, slots = sum(o[3] for o in order), 0, Counter(), Counter()
    for known, i, crc, n in order:
        s = min(6, (2 * before + n) * 7 // (2 * total))
        want[i if known else None, n, crc, "bytes", s, slots[s], None] += 1
        slots[s] += 1
        before += n
    assert Counter(tuple(r) for r in got) == want


def test_balance_and_gapless(spark, sf):
    got = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    by = got.groupby("shard")
    assert (by.slot.max() + 1 == by.size()).all() and (by.slot.nunique() == by.size()).all()
    assert got.sort_values("doc_id").shard.is_monotonic_increasing
    assert (by["size"].sum() - got["size"].sum() / 24).abs().max() <= got["size"].max()


def test_empty_and_kept_columns(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sharding.shard(spark.createDataFrame(rows(), SCHEMA), 3, keep=["source"])
    assert "source" in got.columns and got.count() == len(rows())
