"""Attempts resolved as they arrive, in any order, with a few tries of state for each product and location."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from offergrid.operators.offers import WRITE_ORDER, attempt_resolution
from offergrid.sources.keyed_table import KeyedTable

RESOLVED = "asin string, pincode string, attempt int, status string, failure_reason string, seller string, price double, attempts int, rev long"


def resolve(tries: list[tuple[bool, bool, str | None, float | None]], max_attempts: int) -> tuple[int, bool, str | None, float | None, int]:
    """(attempt, ok, seller, price, attempts) of tries in order, each (met a challenge, ok, seller, price).

    A challenge gives its attempt one more try, whose outcome counts. The first attempt that is OK, else the last.
    """
    ended, i = [], 0
    while i < len(tries) and len(ended) < max_attempts:
        i += bool(tries[i][0] and i + 1 < len(tries))
        ended.append(tries[i])
        i += 1
    good = next((k for k, t in enumerate(ended) if t[1]), len(ended) - 1)
    return good + 1, ended[good][1], *ended[good][2:], len(ended)


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, max_attempts: int, final_reason: str, idle_ms: int) -> Iterator[pd.DataFrame]:
    """Keep the first tries of a pair and tell its resolution when it changes; forget the pair when it has been idle."""
    if state.hasTimedOut:
        state.remove()
        return
    rev, said, held, latest = (*state.get[:2], json.loads(state.get[2]), state.get[3]) if state.exists else (0, "", [], 0)
    for f in frames:
        latest = max(latest, int(f["at_ms"].max()))
        for order, met, ok, seller, price in zip(f["place"], f["met"], f["ok"], f["seller"], f["price"], strict=True):
            held.append([[int(x) for x in order], bool(met), bool(ok), seller, None if price is None or price != price else float(price)])
        held = sorted(held, key=lambda t: t[0])[: 2 * max_attempts]
    attempt, ok, seller, price, attempts = resolve([tuple(t[1:]) for t in held], max_attempts)
    now = json.dumps([attempt, ok, seller, price, attempts])
    if now != said:
        rev += 1
        row = (*key, attempt, "OK" if ok else "FAILED", "" if ok else final_reason, seller, price, attempts, rev)
        names = [c.split()[0] for c in RESOLVED.split(", ")]
        yield pd.DataFrame({n: [v] for n, v in zip(names, row, strict=True)}).astype({"attempt": "int32", "attempts": "int32", "price": "float64"})
    state.update((rev, now, json.dumps(held), latest))
    state.setTimeoutTimestamp(max(latest + idle_ms, state.getCurrentWatermarkMs() + 1))


def attempt_stream(tries: DataFrame, order: tuple[str, ...] = WRITE_ORDER, max_attempts: int = 3, final_reason: str = "Failed after retries", challenge: str = "CAPTCHA", late: str = "7 days", idle_s: int = 7 * 86400) -> DataFrame:
    """``attempt_resolution`` over a stream: RESOLVED rows, one each time a pair's resolution changes (``rev`` counts them).

    A resolution depends on a pair's first 2 x ``max_attempts`` tries by ``order``, wherever in the stream these arrive, so
    this many are the state of a pair. It is forgotten once the watermark (``late`` behind the newest try) is ``idle_s``
    past the pair's last try; tries that are ``late`` are left out. ``order`` holds numbers and times, first the event time.
    """
    place = [F.unix_micros(F.col(c).cast("timestamp")) if "timestamp" in tries.schema[c].dataType.simpleString() else F.col(c).cast("long") for c in order]
    met = F.coalesce(F.col("failure_reason") == challenge, F.lit(False))
    rows = tries.select("asin", "pincode", F.col(order[0]).cast("timestamp").alias("at"), F.array(*place).alias("place"), met.alias("met"), F.coalesce(F.col("status") == "OK", F.lit(False)).alias("ok"), "seller", "price")
    rows = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    step = partial(_step, max_attempts=max_attempts, final_reason=final_reason, idle_ms=idle_s * 1000)
    return rows.groupBy("asin", "pincode").applyInPandasWithState(step, RESOLVED, "rev long, said string, held string, latest long", "update", GroupStateTimeout.EventTimeTimeout)


def resolved_table(tries: DataFrame, root: str, checkpoint: str, order: tuple[str, ...] = WRITE_ORDER, max_attempts: int = 3, **more) -> KeyedTable:
    """The newest resolution of each pair in a keyed table under ``root``; ``more`` goes to ``attempt_resolution``.

    The first 2 x ``max_attempts`` tries of a pair lie beside it in a keyed table of their own, a row a try. A batch meets
    the held tries of its pairs in one window, commits the first ones again and resolves these pairs from them, so that no
    step is taken pair by pair and any try, however late, counts. Both commits bear the batch's number: one that comes
    again after the first of them is resolved from all held tries.
    """
    pair, spark = ("asin", "pincode"), tries.sparkSession
    held, out = KeyedTable(spark, f"{root}/held", (*pair, "slot"), ("rev",), pair[:1]), KeyedTable(spark, root, pair, ("rev",))
    columns = list(dict.fromkeys([*pair, *order, "status", "failure_reason", "seller", "price"]))

    def step(batch: DataFrame, i: int) -> None:
        batch, now = batch.select(*columns), held.snapshot()
        again = now["writers"].get(checkpoint, -1) >= i
        if not again:
            if now["runs"]:
                pairs = batch.select(*pair).distinct()
                batch = batch.unionByName(held.read(only=pairs).join(pairs, list(pair), "left_semi").select(*columns))
            slot = F.row_number().over(Window.partitionBy(*pair).orderBy(*order))
            first = batch.withColumn("slot", slot).where(F.col("slot") <= 2 * max_attempts).withColumn("rev", F.lit(now["version"] + 1).cast("long"))
            held.commit(first, checkpoint, i)
        if out.snapshot()["writers"].get(checkpoint, -1) < i:
            kinds = StructType.fromJson(held.snapshot()["schema"])
            added = [] if again else held.added(now["version"])
            rows = held.read() if again else spark.read.schema(kinds).parquet(*added) if added else spark.createDataFrame([], kinds)
            resolved = attempt_resolution(rows, order, pair, max_attempts, **more).withColumn("rev", F.lit(held.snapshot()["version"]).cast("long"))
            out.commit(resolved, checkpoint, i)

    query = tries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out
