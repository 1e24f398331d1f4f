"""Sharding by a consistent-hash ring with virtual nodes and bounded loads. Only DataFrame and SQL functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offergrid.llm.common import scalable_rank, written

RING = 1 << 16


def ring_slots(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(slot, arc, owner): which virtual node each of the RING slots belongs to, the next one clockwise.

    RING rows whatever the data's size. Arcs are numbered in ring order.
    """
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("owner"), F.floor(F.col("id") / shards).alias("replica"))
    nodes = nodes.select("owner", F.pmod(F.xxhash64(F.lit("vnode"), "owner", "replica"), F.lit(RING)).alias("slot"))
    nodes = nodes.groupBy("slot").agg(F.min("owner").alias("owner"))
    nodes = nodes.withColumn("arc", F.row_number().over(Window.orderBy("slot")) - 1)
    clockwise = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    marked = spark.range(RING).select(F.col("id").alias("slot")).join(nodes, "slot", "left")
    filled = marked.withColumn("at", F.last(F.when(F.col("arc").isNotNull(), F.struct("arc", "owner")), ignorenulls=True).over(clockwise))
    # Past the last virtual node the ring begins again.
    first = nodes.where("arc = 0").select(F.struct("arc", "owner").alias("begin"))
    filled = filled.crossJoin(F.broadcast(first)).select("slot", F.coalesce("at", "begin").alias("at"))
    return filled.select("slot", "at.arc", "at.owner")


def place(demand: list[int], owner: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from_rank, to_rank, shard, first_slot): arcs fill their own shard; what overflows goes on clockwise.

    Works on the counts of the virtual nodes alone; a full shard is passed over.
    """
    left, used, given = list(capacity), [0] * len(capacity), [0] * len(demand)
    out, n = [], len(demand)
    waiting = [a for a in range(n) if demand[a]]
    for step in range(n):
        for a in waiting:
            s = owner[(a + step) % n]
            take = min(left[s], demand[a] - given[a])
            if take > 0:
                out.append((a, given[a], given[a] + take, s, used[s]))
                left[s] -= take
                used[s] += take
                given[a] += take
        waiting = [a for a in waiting if given[a] < demand[a]]
        if not waiting:
            break
    return out


def shard(docs: DataFrame, key: Column, tie: list[Column], shards: int = 24, vnodes: int = 64) -> DataFrame:
    """Add shard (0 to shards-1) and slot (gapless from 0 in each shard) to every row of ``docs``.

    Each row's ``key`` hashes to a slot of the ring and so to a virtual node. Shards hold floor(n/shards) rows, the
    first n mod shards of them one more; rows that overflow their shard continue clockwise to the next one with
    room. So counts differ by at most one, and most rows stay where plain consistent hashing puts them. In each
    arc rows are ranked by hash in ranges (no arc is one window), and only the counts of the shards x vnodes
    arcs come to the driver. Null keys hash like any value; repeated rows take a slot each; an empty table gives
    no rows; all columns of ``docs`` pass through, but for those named like an added one, which it replaces.
    """
    spark = docs.sparkSession
    ring = ring_slots(spark, shards, vnodes)
    # Within, columns go by numbers, so that no name of docs meets one of these steps.
    names = [c for c in docs.columns if c not in ("shard", "slot", "home_shard")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], key.alias("_key"), *[t.alias(f"_tie{i}") for i, t in enumerate(tie)])
    key, tie = F.col("_key"), [F.col(f"_tie{i}") for i in range(len(tie))]
    hashed = inner.withColumn("_slot", F.pmod(F.xxhash64(key, F.lit("ring")), F.lit(RING)))
    on_ring = hashed.join(F.broadcast(ring.select(F.col("slot").alias("_slot"), F.col("arc").alias("_arc"), F.col("owner").alias("_owner"))), "_slot").drop("_slot")
    ranked = written(scalable_rank(on_ring, ["_arc"], F.xxhash64(key, *tie), [key, *tie], "_rank", subs=8), "ring")
    counts = {r["_arc"]: r["n"] for r in ranked.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    owners = {r["arc"]: r["owner"] for r in ring.select("arc", "owner").distinct().collect()}
    owner = [owners[a] for a in sorted(owners)]
    n = sum(counts.values())
    plan = place([counts.get(a, 0) for a in range(len(owner))], owner, [n // shards + (s < n % shards) for s in range(shards)])
    table = spark.createDataFrame(plan, "_arc int, _from long, _to long, _shard int, _first long")
    joined = ranked.join(F.broadcast(table), "_arc").where("_rank >= _from and _rank < _to")
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_from") + F.col("_first")).alias("slot"), F.col("_owner").alias("home_shard"))
