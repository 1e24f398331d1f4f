"""Helpers shared by the training-data operators: shared storage, ranks without one big window, word hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offergrid.shared import erase, shared_dir

_open: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    A result that is read later stays until the cluster clears its folder; within ``scratch``, only with ``keep``.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables ``written`` within are deleted at its end: for steps whose outcome is itself written with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            erase(spark, path)


def bucketed(df: DataFrame, name: str, part: str, key: str, n: int) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in folders by ``part`` and bucketed by ``key``.

    A later grouping or join by ``key`` reads it in place, without a shuffle of this side.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/{table}").partitionBy(part).bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


def buckets_of(spark: SparkSession) -> int:
    """How many hash buckets work is dealt into: what the cluster sets for its shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scalable_rank(df: DataFrame, keys: list[str], order: Column, tie: list[Column], out: str, subs: int = 64) -> DataFrame:
    """Add ``out``: the 0-based rank in each group of ``keys`` by the hash ``order`` (a BIGINT), then ``tie``.

    A group is cut into ``subs`` ranges of the hash, ranked apart and shifted by the sizes of the earlier ranges,
    so a key that holds a third of all rows is dealt over ``subs`` tasks. The table of sizes has keys x subs rows.
    """
    width = (1 << 63) // subs + 1
    cut = df.withColumn("_h", order).withColumn("_sub", F.expr(f"cast((_h & {(1 << 63) - 1}L) div {width}L as int)"))
    sizes = cut.groupBy(*keys, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_sub").orderBy((F.col("_h").bitwiseAND((1 << 63) - 1)), *tie)
    ranked = cut.withColumn("_r", F.row_number().over(within) - 1)
    cond = [ranked[k].eqNullSafe(starts[k]) for k in keys] + [ranked["_sub"] == starts["_sub"]]
    both = cond[0]
    for c in cond[1:]:
        both = both & c
    return ranked.join(starts, both).select(*[ranked[c] for c in df.columns], (F.col("_r") + F.col("_start")).cast("long").alias(out))


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and where each begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and each text's first word in them.

    The result is the same in every process: no seed of Python's own hashes is involved.
    """
    global _POW
    if lower:
        data = _LOWER[data]
    ns = ~_SEP[data]
    start = ns.copy()
    start[1:] &= ~ns[:-1]
    firsts_of = offs[:-1][offs[:-1] < offs[1:]]
    start[firsts_of] = ns[firsts_of]
    starts = np.flatnonzero(start)
    woffs = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), woffs
    seen = np.cumsum(ns, dtype=np.int64)
    first = seen[starts] - 1
    lens = np.diff(np.append(first, seen[-1]))
    if lens.max() > len(_POW):
        _POW = powers(int(_BASE), int(lens.max()) * 2)
    where = np.arange(seen[-1], dtype=np.int64) - np.repeat(first, lens)
    parts = (data[ns].astype(np.uint64) + np.uint64(1)) * _POW[where]
    return mix(np.add.reduceat(parts, first) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), woffs


def slices(offs: np.ndarray, most: int = 2_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; one longer text stands alone."""
    out, begin = [], 0
    while begin < len(offs) - 1:
        end = max(begin + 1, int(np.searchsorted(offs, offs[begin] + most, "right")) - 1)
        out.append((begin, end))
        begin = end
    return out


def squeeze(raw: bytes | np.ndarray, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw.tobytes() if isinstance(raw, np.ndarray) else raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def batched(batches, rows: int = 2000, most: int = 4_000_000, column: str = "text"):
    """Record batches cut so that each holds at most ``rows`` rows and about ``most`` bytes of ``column``."""
    for batch in batches:
        _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
        for a, b in slices(offs, most):
            for c in range(a, b, rows):
                yield batch.slice(c, min(rows, b - c))
