"""Approximate nearest neighbours: a forest of hash-prefix trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offergrid.llm.common import written

BITS = 32
#: Dense cells up to this many are broadcast (16 bytes each).
SMALL_CELLS = 1_000_000


def planes(dim: int, trees: int, sample: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(normals, offsets) of BITS hyperplanes for each tree.

    Normals are drawn like the sample itself (random mixtures of its unit vectors), so they follow the directions in which
    vectors differ; each offset is the median of the sample along its normal, so that either side holds about half.
    """
    draw = np.random.default_rng(seed)
    middle = sample.mean(0)
    mixed = draw.normal(size=(trees * BITS, len(sample))) @ (sample - middle)
    flat = np.linalg.norm(mixed, axis=1) < 1e-9  # one single point: any direction will do
    mixed[flat] = draw.normal(size=(int(flat.sum()), dim))
    offsets = np.median(sample @ mixed.T, axis=0)
    return mixed.reshape(trees, BITS, dim), offsets.reshape(trees, BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def strings(x: np.ndarray, normals: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(vectors, trees): the hash string of each unit vector, the first plane's side as the first of BITS bits."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return np.stack([(x @ n.T > o).astype(np.int64) @ weights for n, o in zip(normals, offsets, strict=True)], 1)


def codes(x: np.ndarray) -> list[bytes]:
    """Each unit vector as two bytes a component, with its step and how far the rounding moved it.

    With one byte the rounding is as large as what tells the members of a dense group apart, and most of a group would
    be handed on for each of its queries.
    """
    step = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30) / 32767
    rounded = np.rint(x / step).astype(np.int16)
    moved = np.linalg.norm(x - rounded * step.astype(np.float32).astype(np.float64), axis=1) * (1 + 1e-6) + 1e-9
    head = np.concatenate([step.astype(np.float32), moved[:, None].astype(np.float32) * np.float32(1.0001)], 1)
    return [a.tobytes() + b.tobytes() for a, b in zip(head, rounded, strict=True)]


def _hashed(shared):
    """(vec_id, hashes): all hash strings of each vector."""

    def run(batches):
        for batch in batches:
            if len(batch):
                h = strings(unit(_matrix(batch.column(1))), *shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["vec_id", "hashes"])

    return run


def _entries(shared):
    """(tree, hash, vec_id, code): one entry of each vector in every tree."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                x = unit(_matrix(part.column(1)))
                h, code = strings(x, *shared.value), pa.array(codes(x), pa.binary())
                for t in range(h.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), pa.array(np.ascontiguousarray(h[:, t])), part.column(0), code], ["tree", "hash", "vec_id", "code"])

    return run


def _nearest(shared, k: int):
    """(query, vec_id, score): the nearest of each batch to each of a few queries, by all vectors."""

    def run(batches):
        qid, q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            ids, near = np.asarray(batch.column(0)), unit(_matrix(batch.column(1))) @ q.T
            top = np.argpartition(-near, min(k, len(ids) - 1), axis=0)[: k + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(qid, len(top))), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(near, top, 0).ravel())], ["query", "vec_id", "score"])

    return run


def _search_cell(k: int):
    """In one cell of one tree: the sorted array of hash strings; each query reads the run that shares its prefix.

    Returns bounds of each cosine that allow for the rounding of the codes, of all vectors that may be among the k best.
    """

    def run(key, points: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out_v, out_low, out_high = [], [], [], []
        if len(points) and len(asked):
            raw = np.frombuffer(b"".join(points.column("code").to_pylist()), np.uint8).reshape(len(points), -1)
            step, moved = np.ascontiguousarray(raw[:, :8]).view(np.float32).astype(np.float64).T
            x = np.ascontiguousarray(raw[:, 8:]).view(np.int16).astype(np.float64) * step[:, None]
            ids, h = np.asarray(points.column("vec_id")), np.asarray(points.column("hash"))
            order = np.argsort(h, kind="stable")
            x, ids, h, moved = x[order], ids[order], h[order], moved[order]
            q, qid = unit(_matrix(asked.column("embedding"))), np.asarray(asked.column("query"))
            qh, below = np.asarray(asked.column("hash")), (BITS - np.asarray(asked.column("level"))).astype(np.int64)
            low = np.searchsorted(h, (qh >> below) << below, "left")
            high = np.searchsorted(h, ((qh >> below) + 1) << below, "left")
            for i in range(len(q)):
                a, b = low[i], high[i]
                if a == b:
                    continue
                near = x[a:b] @ q[i]
                least, most = near - moved[a:b], near + moved[a:b]
                cut = np.partition(least, len(near) - k)[len(near) - k] if len(near) > k else -2.0
                kept = np.flatnonzero(most >= cut)
                out_q.append(np.full(len(kept), qid[i]))
                out_v.append(ids[a:b][kept])
                out_low.append(least[kept])
                out_high.append(most[kept])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query": join(out_q, pa.int64()), "vec_id": join(out_v, pa.int64()), "low": join(out_low, pa.float64()), "high": join(out_high, pa.float64())})

    return run


def _exact(batches):
    """The cosine in double precision on the original vectors, each pair by itself."""
    for batch in batches:
        one, two = _matrix(batch.column(2)) if len(batch) else None, _matrix(batch.column(3)) if len(batch) else None
        scores = [float(np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b)))) for a, b in zip(one, two, strict=True)] if len(batch) else []
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["query", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) without vectors that are null, empty, zero or hold null or non-finite components; each row once."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    whole = named.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", ok) & F.exists("embedding", lambda x: x != 0))
    return whole.dropDuplicates(["vec_id", "embedding"])


def _calibrated(points: DataFrame, trial: DataFrame, found: DataFrame, forest, k: int, recall: float) -> float:
    """How many entries a search has to read, from a few hundred trial queries.

    Their true neighbours come from all vectors; each is found at the longest prefix that any tree shares with the query.
    """
    spark = points.sparkSession
    rows = trial.collect()
    qid, q = np.array([r["vec_id"] for r in rows]), unit(np.array([r["embedding"] for r in rows], np.float64))
    shared = spark.sparkContext.broadcast((qid, q))
    best = points.mapInArrow(_nearest(shared, k), "query long, vec_id long, score double").where("query <> vec_id")
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") <= k)
    true = best.join(points, "vec_id").select("query", "embedding").collect()
    at = {int(i): j for j, i in enumerate(qid)}
    read = np.zeros((len(qid), BITS + 1))
    for r in found.join(trial.select("vec_id"), "vec_id").collect():
        read[at[r["vec_id"]], r["level"]] = r["n"]
    if not true:
        return 0.0
    own, theirs = strings(q, *forest), strings(unit(np.array([r["embedding"] for r in true], np.float64)), *forest)
    rows_of = np.array([at[r["query"]] for r in true])
    differ = (own[rows_of] ^ theirs).min(1)
    shared_bits = np.array([BITS - int(d).bit_length() for d in differ.tolist()])
    # A search stops at the deepest level that holds enough entries, so it reaches a neighbour's level only if the next
    # level holds too few.
    limits = np.sort([read[i, level + 1] + 1 if level < BITS else 1.0 for i, level in zip(rows_of, shared_bits, strict=True)])
    return float(limits[min(len(limits) - 1, math.ceil(recall * len(limits)) - 1)])


def dense_cells(leaves: DataFrame, finer: int, cell: int) -> DataFrame:
    """(tree, cell, salts): the cells of over twice ``cell`` entries, and how many parts of about ``cell`` each is dealt into.

    Vectors that lie close together share all bits of a string, so no longer prefix would part them.
    """
    held = leaves.groupBy("tree", F.expr(f"shiftright(leaf, {finer})").alias("cell")).agg(F.sum("n").alias("held"))
    dense = written(held.where(F.col("held") > 2 * cell).select("tree", "cell", F.expr(f"cast(ceil(held / {cell}) as int)").alias("salts")), "dense")
    return F.broadcast(dense) if dense.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS else dense


def _placed(entries: DataFrame, dense: DataFrame, shallow: int) -> DataFrame:
    """Entries with their cell, and the part of it where it is dense: any part may hold any of its vectors.

    A query of a dense cell goes to all parts, each of which gives its own best, so nothing is lost.
    """
    at = entries.withColumn("cell", F.shiftright("hash", BITS - shallow)).join(dense, ["tree", "cell"], "left")
    return at.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")


def search(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = 12, recall: float = 0.95, leaf: int = 32, cell: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 5000, trials: int = 300) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for every row that ``is_query`` marks.

    Every vector has a string of 32 hyperplane sides in each of ``trees`` trees. A tree is a sorted array of these
    strings, dealt out in cells by their first bits, dense cells in parts. All trees descend to the longest prefix of the query and ascend
    together, one bit at a time, until the runs that share the prefix hold enough entries over all trees. How many is
    measured: about ``trials`` of the queries at most are compared with all vectors, and searches read what these need for
    ``recall``. Clustered vectors need about a hundredth of all; vectors without any clusters need about half.

    Planes are fitted on about ``sample_rows`` vectors at most, chosen by hash; all are indexed. Trees hold two bytes a component, with which
    runs are read; bounds on the rounding decide what is compared on the original vectors, which are fetched once.
    Equal vectors are one point that keeps its k + 1 smallest ids (no query needs more), and equal queries search
    once, so a hot vector costs one search. Scores are cosines in double precision; ties go to the smaller id.
    Unusable vectors, and those of another length than most (of equally frequent ones the smallest), take no part; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    flagged = vectors.withColumn("_q", is_query)
    per_vector = Window.partitionBy("embedding").orderBy("vec_id")
    every = usable(vectors, id_col, vector_col).withColumn("_k", F.row_number().over(per_vector))
    every = written(every.where(F.col("_k") <= k + 1).drop("_k"), "points")
    lengths = every.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    asked = usable(flagged.where("_q"), id_col, vector_col)
    if not lengths or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths[0]["dim"], lengths[0]["n"]
    points, asked = (df.where(F.size("embedding") == dim) for df in (every, asked))
    some = lambda df, rows, most: df.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.ceil(rows / most)))) == 0)
    fitted = some(points, n, sample_rows).select("embedding").collect() or points.select("embedding").limit(1).collect()
    fitted = np.array([r[0] for r in fitted], np.float64)
    forest = planes(dim, trees, unit(fitted))
    shared = spark.sparkContext.broadcast(forest)
    searched = asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding")
    strung = searched.mapInArrow(_hashed(shared), "vec_id long, hashes array<long>")
    sought = written(searched.join(strung, "vec_id").select("vec_id", "embedding", F.posexplode("hashes").alias("tree", "hash")), "sought")
    deep = max(0, min(BITS - 1, math.ceil(math.log2(max(1, n / leaf)))))
    shallow = max(0, min(deep, math.ceil(math.log2(max(1, n / cell)))))
    hashes = points.mapInArrow(_hashed(shared), "vec_id long, hashes array<long>").select(F.posexplode("hashes").alias("tree", "hash"))
    leaves = written(hashes.groupBy("tree", F.shiftright("hash", BITS - deep).alias("leaf")).agg(F.count(F.lit(1)).alias("n")), "leaves")
    levels = F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("level")
    sizes = leaves.select("tree", "leaf", "n", levels).groupBy("tree", "level", F.expr(f"shiftright(leaf, {deep} - level)").alias("prefix")).agg(F.sum("n").alias("n"))
    steps = sought.select("vec_id", "tree", "hash", levels).withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - level)"))
    found = written(steps.join(sizes, ["tree", "level", "prefix"]).groupBy("vec_id", "level").agg(F.sum("n").alias("n")), "reachable")
    ids = sought.where("tree = 0").select("vec_id", "embedding")
    trial = some(ids, ids.count(), trials)
    # With k + 1 entries for each tree, one tree at least holds k + 1 vectors: never fewer than k besides the query.
    need = max(_calibrated(points, trial if not trial.isEmpty() else ids.limit(1), found, forest, k, recall), (k + 1) * trees)
    level = found.groupBy("vec_id").agg(F.coalesce(F.max(F.when(F.col("n") >= need, F.col("level"))), F.lit(0)).alias("level"))
    ready = sought.join(level, "vec_id").select(F.col("vec_id").alias("query"), "embedding", "tree", "hash", "level")
    cells = leaves.select("tree", F.expr(f"shiftright(leaf, {deep - shallow})").alias("cell")).distinct()
    # A query whose prefix is shorter than a cell's reads all cells below it.
    by = F.least(F.col("level"), F.lit(shallow))
    tops = cells.select("tree", "cell", F.explode(F.sequence(F.lit(0), F.lit(shallow))).alias("by")).withColumn("top", F.expr(f"shiftright(cell, {shallow} - by)"))
    routed = ready.withColumn("by", by).withColumn("top", F.expr(f"shiftright(hash, {BITS} - by)")).join(tops, ["tree", "by", "top"]).select("tree", "cell", "query", "embedding", "hash", "level")
    dense = dense_cells(leaves, deep - shallow, cell)
    placed = _placed(points.mapInArrow(_entries(shared), "tree int, hash long, vec_id long, code binary"), dense, shallow)
    routed = routed.join(dense, ["tree", "cell"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    near = placed.groupBy("tree", "cell", "salt").cogroup(routed.groupBy("tree", "cell", "salt")).applyInArrow(_search_cell(k + 1), "query long, vec_id long, low double, high double")
    best = near.groupBy("query", "vec_id").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    ordered = Window.partitionBy("query").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = best.withColumn("_cut", F.nth_value("low", k + 1).over(ordered)).where("_cut is null or high >= _cut").select("query", "vec_id")
    with_q = best.join(searched.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), "query")
    with_v = with_q.join(points.select("vec_id", F.col("embedding").alias("v")), "vec_id").select("query", "vec_id", "q", "v")
    scored = with_v.mapInArrow(_exact, "query long, vec_id long, score double")
    owners = asked.join(searched.select("embedding", F.col("vec_id").alias("query")), "embedding").select(F.col("vec_id").alias("query_id"), "query")
    answers = owners.join(scored, "query").where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
