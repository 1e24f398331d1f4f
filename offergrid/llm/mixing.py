"""Mixing sources to target weights: Pfair windows and earliest-deadline-first over blocks of rows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import scalable_rank

MOST_SOURCES = 20_000


def tempered_weights(docs: DataFrame, alpha: float = 0.5, source_col: str = "source") -> dict:
    """Target weights: each source's share of all rows to the power ``alpha``. The number of sources is checked."""
    rows = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    return {r[0]: r["n"] ** alpha for r in rows}


def whole_weights(weights: list[float]) -> list[int]:
    """Integers in exactly the proportions of the weights: a float is a whole number over a power of two."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    most = max((d for _, d in ratios), default=1)
    return [n * (most // d) for n, d in ratios]


def timetable(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, k, slot, release, deadline) of every block of all sources, by earliest deadline first.

    Block k of a source with the share w = weight / all weights is released at floor(k / w) and due at
    ceil((k + 1) / w). In each slot the released block with the earliest deadline goes; every deadline is met, so
    after t slots each source that still has blocks is within one block of t w, however long the schedule. Slots in
    which no block is released stay empty. Only one block of a source is held at a time.
    """
    total = sum(weights)
    window = lambda i, k: (k * total // weights[i], -(-(k + 1) * total // weights[i]))
    coming = [(0, i, 0) for i, n in enumerate(blocks) if n]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, i, k = heapq.heappop(coming)
            heapq.heappush(ready, (window(i, k)[1], i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        yield i, k, slot, release, deadline
        if k + 1 < blocks[i]:
            heapq.heappush(coming, (window(i, k + 1)[0], i, k + 1))
        slot += 1


def _scheduled(weights: list[int], blocks: list[int], rows: int = 20_000):
    def run(batches):
        names = ["_s", "_k", "_slot", "_release", "_deadline"]
        for batch in batches:
            plan = timetable(weights, blocks) if len(batch) else iter(())
            while part := list(islice(plan, rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names)

    return run


def checked_weights(weights: dict) -> None:
    """Raise a ValueError that names the source for weights that no schedule can follow."""
    for s, w in weights.items():
        if isinstance(w, bool) or not isinstance(w, int | float) or not math.isfinite(w) or w < 0:
            raise ValueError(f"the weight of {s!r} is {w!r}: weights are finite numbers, none a weight below 0")


def mix(docs: DataFrame, weights: dict, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 16, tie: list[str] | None = None) -> DataFrame:
    """Give every row its place in a mixture that follows ``weights`` (source to weight; null is a source too).

    Each source's rows are put in a hashed order (ranked in ranges, so a hot source is dealt over many tasks) and
    cut into blocks of ``block_rows``. The Pfair schedule of all blocks, from the exact weights, is streamed by one
    task that holds one block a source, and joined by source and block. A source that runs out leaves its slots empty;
    the others keep to their weights, so every row is placed exactly once and none is dropped or repeated.

    Adds block (in the source), release, deadline and slot (of the endless schedule) and place (row in the slot).
    Sources that ``weights`` doesn't name get its smallest weight above 0. A weight of 0 means none: such rows stay, with
    nulls for all of these. Weights that are below 0, infinite or no number are errors, and so are weights so far
    apart that a slot of a source's last block would not fit 64 bits; both are told before any row moves. Repeated rows take a place each; an empty table gives none; other
    columns pass through, but for those named like an added one, which it replaces.
    """
    checked_weights(weights)
    # Within, columns go by numbers, so that no name of docs meets one of these steps.
    added = ["block", "release", "deadline", "slot", "place"]
    names = [c for c in docs.columns if c not in added]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = lambda c: f"c{names.index(c)}"
    none = F.lit(False)
    for s in [s for s, w in weights.items() if w == 0]:
        none = none | F.col(at(source_col)).eqNullSafe(F.lit(s))
    given = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    out = _placed(inner.where(~none), weights, at(id_col), at(source_col), block_rows, [at(c) for c in tie or []]).select(*given, *added)
    if any(w == 0 for w in weights.values()):
        out = out.unionByName(inner.where(none).select(*given, *[F.lit(None).cast("int" if c == "place" else "long").alias(c) for c in added]))
    return out


def _placed(docs: DataFrame, weights: dict, id_col: str, source_col: str, block_rows: int, tie: list[str]) -> DataFrame:
    spark = docs.sparkSession
    found = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    found = sorted(((r[0], r["n"]) for r in found), key=lambda r: (r[0] is None, str(r[0])))
    low = min((w for w in weights.values() if w > 0), default=1.0)
    shares = whole_weights([max(weights.get(s, low), low) for s, _ in found])
    blocks = [-(-n // block_rows) for _, n in found]
    if any(-(-n * sum(shares) // w) >= 1 << 63 for n, w in zip(blocks, shares, strict=True)):
        raise ValueError("weights too far apart: a slot of the schedule would not fit 64 bits")
    kind = docs.schema[source_col].dataType.simpleString()
    plan = spark.range(0, 1, 1, 1).mapInArrow(_scheduled(shares, blocks), "_s long, _k long, _slot long, _release long, _deadline long")
    numbers = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(found)], f"_name {kind}, _number long")
    ranked = scalable_rank(docs, [source_col], F.xxhash64(F.col(id_col), F.lit("mix")), [F.col(id_col), *[F.col(c) for c in tie]], "_rank")
    numbered = ranked.join(F.broadcast(numbers), F.col(source_col).eqNullSafe(F.col("_name"))).withColumn("_block", F.expr(f"_rank div {block_rows}"))
    # A task's output has no known size, and the schedule grows with the rows: it must not be broadcast.
    placed = numbered.join(plan.hint("merge"), (F.col("_number") == F.col("_s")) & (F.col("_block") == F.col("_k")))
    return placed.select(*docs.columns, F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), (F.col("_rank") % block_rows).cast("int").alias("place"))
