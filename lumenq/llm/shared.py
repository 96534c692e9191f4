"""What the operators of this subpackage share: saved tables and text kernels.

Text kernels work on a whole Arrow batch at once: the concatenated codes of
its texts, the offsets of the texts in them, and one prefix sum of
``code_value * BASE**i`` modulo 2**64, from which the hash of any span is two
lookups and one multiplication.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
#: Kernels take at most this many bytes of text at once, one text at least.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a temporary one in
    local mode; on a cluster each machine would have its own, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumenq-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage,
    and a lost executor costs no recomputation of what is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenq-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenq_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; partitions and their order stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files behind a frame from ``saved``; it is of no use later."""
    path = getattr(df, "_lumenq_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def one_thread(spark: SparkSession) -> None:
    """Matrix products of the Python workers started from here on use one thread
    each: tasks fill the cores, and threads that wait for small products only burn time."""
    spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"


def spread(df: DataFrame, *keys) -> DataFrame:
    """Deal rows over the configured number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo: the fold rule of the contracts."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- text kernels


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if "n" not in _POWERS or len(_POWERS["n"]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        inverse = pow(BASE, -1, 1 << 64)
        for key, base in (("n", BASE), ("i", inverse)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["n"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any spans of an array of codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        values = codes.astype(np.uint64)
        values += np.uint64(0x632BE59BD9B4E019)
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        values *= up[: len(codes)]
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        out = self.raw(starts, ends)
        out += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        if salt:
            out ^= np.uint64(salt * 0x9FB21C651E98DF25 & (1 << 64) - 1)
        return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and the texts' offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (first, last) of texts with at most ``limit`` bytes each, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the maximal runs of ``inside`` in each text."""
    n = len(inside)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = inside[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive items of one owner, and where they begin."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + m]
    at = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return mix(out[at]), at


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``keys``, and whether each wanted key is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted
