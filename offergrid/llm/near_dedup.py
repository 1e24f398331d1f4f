"""Near-duplicate documents: min-max hashing, bands, and links confirmed on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import batched, mix, powers, scratch, slices, text_buffer, word_hashes, written
from offergrid.llm.components import connected_components

PERMUTATIONS, BAND_ROWS = 64, 4
BAND = 1.05  # set sizes are dealt into bands of this ratio
#: A node whose offered shingles meet more components than this, counted for each shingle, is crowded: long bands find
#: its partners. Its joins would cost more than its hashes in bands of 8 values (some 116 bands, 464 permutations).
MEETS = 8192
MISS = 1e-5  # how likely long bands may miss a pair that links
_MULT = powers(0x9E3779B97F4A7C15, 2 * PERMUTATIONS + 2)[2:]  # odd multipliers permute the 64-bit hashes
_LONG = 0xD1342543DE82EF95  # powers of this one permute for the long bands
_SIG = "doc long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sig binary"


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, and where each text's begin.

    A text of fewer than ``words`` words has its whole sequence as one shingle; one without words has none.
    """
    h, woffs = word_hashes(data, offs, lower=True)
    n = np.diff(woffs)
    base = powers(0xC2B2AE3D27D4EB4F, words + 1)[1:]
    full = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        full += h[j : len(full) + j] * base[j]
    full = mix(full + np.uint64(words))
    out, count = [], np.zeros(len(n), np.int64)
    for d, k in enumerate(n.tolist()):
        if k >= words:
            own = np.unique(full[woffs[d] : woffs[d] + k - words + 1])
        elif k:
            own = mix((h[woffs[d] : woffs[d] + k] * base[:k]).sum(keepdims=True) + np.uint64(k))
        else:
            continue
        out.append(own)
        count[d] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(count)])


def signatures(sets: np.ndarray, offs: np.ndarray, mult: np.ndarray = _MULT[:PERMUTATIONS]) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima) of each nonempty set under each permutation: two values for one hash evaluation."""
    rows = np.flatnonzero(np.diff(offs))
    low, high = np.zeros((len(rows), len(mult)), np.uint64), np.zeros((len(rows), len(mult)), np.uint64)
    if len(rows):
        at = offs[:-1][rows]
        for p, m in enumerate(mult):
            x = sets * m
            low[:, p] = np.minimum.reduceat(x, at)
            high[:, p] = np.maximum.reduceat(x, at)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int = BAND_ROWS, before: int = 0) -> np.ndarray:
    """Bands of ``rows`` values, each from another permutation: half of them minima, half maxima, and the rest.

    The first band is number ``before``.
    """
    keys, half = [], rows // 2
    for b in range(0, low.shape[1], rows):
        for pair in ((low,) * half + (high,) * half, (high,) * half + (low,) * half):
            key = np.full(len(low), before + len(keys) + 1, np.uint64)
            for j, side in enumerate(pair):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + side[:, b + j])
            keys.append(key)
    return np.stack(keys, 1)


def _signed(words: int):
    def run(batches):
        for batch in batched(batches):
            data, offs = text_buffer(batch.column(2))
            for a, b in slices(offs, 1_000_000):
                sets, soffs = shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                n = np.diff(soffs)
                full = np.flatnonzero(n)
                low, high = signatures(sets, soffs)
                keys = band_keys(low, high)
                at = soffs[:-1][full]
                one = np.add.reduceat(sets * np.uint64(0xFF51AFD7ED558CCD), at) if len(full) else sets
                two = np.add.reduceat(mix(sets), at) if len(full) else sets
                short = np.concatenate([low, high], 1)
                short = (mix(short) & np.uint64(0xFF)).astype(np.uint8)
                set_a, set_b = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                set_a[full], set_b[full] = one, two
                bands, sigs = [[]] * (b - a), [None] * (b - a)
                for i, d in enumerate(full.tolist()):
                    bands[d], sigs[d] = keys[i].view(np.int64), short[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc", "text_key", "n_shingles", "set_a", "set_b", "bands", "sig"],
                )

    return run


def _tokens(words: int):
    """The distinct shingle hashes of each text, as one array a text."""

    def run(batches):
        for batch in batched(batches):
            data, offs = text_buffer(batch.column(1))
            sets, soffs = shingle_hashes(data, offs, words)
            lists = pa.ListArray.from_arrays(pa.array(soffs.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "tokens"])

    return run


def long_bands(nodes: int, percent: int) -> tuple[int, int]:
    """(values a band, bands) for ``nodes`` crowded nodes.

    Bands have as many values as the number of nodes has bits (6 to 16, even), so texts that share about half of their
    shingles meet ever more seldom as there are more of them, and as many bands as keep a link's miss below MISS.
    """
    rows = 2 * min(8, max(3, nodes.bit_length() // 2))
    return rows, 2 * math.ceil(-math.log(MISS) / (percent / 100) ** rows / 2)


def _banded(words: int, rows: int, bands: int):
    """The long band keys of each text: further permutations, ``rows`` for two bands."""

    def run(batches):
        mult = powers(_LONG, bands // 2 * rows + 2)[2:]
        for batch in batched(batches, 500, 1_000_000):
            data, offs = text_buffer(batch.column(1))
            sets, soffs = shingle_hashes(data, offs, words)
            keys = [band_keys(*signatures(sets, soffs, mult[i : i + rows]), rows, 2 * (i // rows)) for i in range(0, len(mult), rows)]
            nodes = batch.column(0).filter(pa.array(np.diff(soffs) > 0))
            flat = np.concatenate(keys, 1)
            at = np.arange(len(flat) + 1, dtype=np.int32) * np.int32(flat.shape[1])
            yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.ravel().view(np.int64)))], ["node", "buckets"])

    return run


def _linked(words: int, percent: int):
    """The pairs that link by their full sets."""

    def run(batches):
        for batch in batched(batches, 500, 2_000_000, "text_b"):
            sides = []
            for c in ("text_a", "text_b"):
                data, offs = text_buffer(batch.column(batch.schema.get_field_index(c)))
                sides.append(shingle_hashes(data, offs, words))
            (sa, oa), (sb, ob) = sides
            linked = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]]
                same = len(np.intersect1d(a, b, assume_unique=True))
                linked[i] = 100 * same >= percent * (len(a) + len(b) - same) and same > 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked))

    return run


def _likely(least: float):
    """The pairs whose one-byte signatures agree in a share of at least ``least``, far below the similarity that links."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            one, two = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((one == two).mean(1) >= least))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc, text_key, n_shingles, component_id, kept) for every row: classes of texts linked at ``percent``/100 Jaccard similarity.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; sets hold distinct runs of ``words`` words.

    1. One pass gives each text's set size, a 128-bit key of the set and 32 bands of four min-max values (64
       permutations give 128). Texts of equal sets become one node, so copies are never paired.
    2. In each band bucket members are paired with one leader only, the one that shares most places in buckets with
       others; likely pairs are confirmed on full sets and join components. A leader is then done with its bucket.
    3. Where a bucket's other members still stand in several components, pairs come from their rarest shingles (see
       ``_crossing``), never from the bucket: a group's common text is no key, so a large group whose members differ too
       much to link makes few pairs, and nothing is capped or sampled. First each node meets one member of each other
       component, then what is still apart meets pair by pair.
    4. Texts made of common parts have no rare shingles. Nodes whose shingles meet too many components (``MEETS``) meet each
       other in long bands of further min-max values instead (see ``_in_long_bands``).

    At similarity 0.75 a pair shares no bucket with probability below 1e-5, and no long band with one below 1e-5. component_id is the smallest id reachable
    (its own for null-text, empty and single rows); kept marks the class's row of the smallest (id, text_key). A node is
    a set of shingles, so rows of one id and different texts are apart and may be in two classes; equal rows are all kept
    or all not. Null ids stay alone with a null component; an empty table gives no rows; other columns are ignored. Ids
    are integers; text_key is xxhash64 of the text.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    signed = written(base.mapInArrow(_signed(words), _SIG), "signatures")
    sets = signed.where("n_shingles > 0 and doc is not null").groupBy("set_a", "set_b", F.col("n_shingles").alias("n"))
    first = sets.agg(F.min(F.struct("doc", "text_key", "bands", "sig")).alias("r"))
    nodes = written(first.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "n", F.col("r.doc").alias("doc"), F.col("r.text_key").alias("text_key"), F.col("r.bands").alias("bands"), F.col("r.sig").alias("sig")), "nodes")
    with scratch(docs.sparkSession):
        comps = _classes(base, nodes, words, percent)
        comps = None if comps is None else written(comps, "classes", keep=True)
    rows = F.struct("doc", "text_key")
    if comps is None:
        classes = nodes.select("set_a", "set_b", "n", rows.alias("least"))
    else:
        least = nodes.join(comps, "node").groupBy("comp").agg(F.min(rows).alias("least"))
        within = nodes.select("node", "set_a", "set_b", "n", rows.alias("own")).join(comps, "node", "left").join(least, "comp", "left")
        classes = within.select("set_a", "set_b", "n", F.coalesce("least", "own").alias("least"))
    whole = signed.withColumnRenamed("n_shingles", "n").where("n > 0 and doc is not null").join(classes, ["set_a", "set_b", "n"])
    grouped = whole.select("doc", "text_key", F.col("n").alias("n_shingles"), F.col("least.doc").alias("component_id"), (rows == F.col("least")).alias("kept"))
    alone = signed.where("n_shingles = 0 or doc is null").select("doc", "text_key", "n_shingles", F.col("doc").alias("component_id"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def _classes(base: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, comp) of every linked node; None where no two nodes share a bucket."""
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    crowds = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    members = written(members.join(crowds, "bucket"), "buckets")
    if members.isEmpty():
        return None
    degree = written(members.groupBy("node").agg(F.sum("crowd").alias("degree")), "degrees")
    texts = base.where("doc is not null").dropDuplicates(["doc", "text_key"])
    mine = nodes.join(degree, "node").select("node", "sig", F.col("doc").alias("d"), F.col("text_key").alias("k"))
    held = written(mine.join(texts, (F.col("d") == texts["doc"]) & (F.col("k") == texts["text_key"])).select("node", "sig", "text"), "candidates")
    members = members.join(degree, "node").select("bucket", "node", "n", "degree")
    best = members.groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("o"), "node", "n")).alias("l"))
    led = written(members.join(best, "bucket").where("node <> l.node").select("bucket", "node", "n", F.col("l.node").alias("leader"), F.col("l.n").alias("n_leader")), "led")
    pairs = led.where(f"100 * least(n, n_leader) >= {percent} * greatest(n, n_leader)").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    comps = _merged(None, _confirmed(pairs, held, words, percent))
    now = led.select("bucket", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    apart = written(now.join(mixed, "bucket").select("node", "n", "comp").distinct(), "apart")
    if apart.isEmpty():
        return comps
    offers = _offers(apart, held, words, percent)
    crowded = _crowded(offers)
    pairs = written(_crossing(offers, crowded, percent), "crossing")
    comps = _merged(comps, _confirmed(pairs.groupBy("a", "comp_b").agg(F.max_by("b", "most").alias("b")).select("a", "b"), held, words, percent))
    comps = _merged(comps, _confirmed(_apart_yet(pairs.select("a", "b"), comps), held, words, percent))
    return comps if crowded is None else _in_long_bands(crowded, comps, held, words, percent)


def _apart_yet(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends stand in two components."""
    to = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    return pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after new links: only the components that they touch are worked out again."""
    if comps is None:
        return written(connected_components(links, "a", "b").select(F.col("id").alias("node"), F.col("component").alias("comp")), "components")
    if links.isEmpty():
        return comps
    to = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    ends = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    moved = written(connected_components(ends, "a", "b"), "moved")
    old = comps.join(moved, comps["comp"] == moved["id"], "left").select("node", F.coalesce("component", "comp").alias("comp"))
    fresh = moved.join(comps.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.col("component").alias("comp"))
    return written(old.unionByName(fresh), "components")


def _offers(apart: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """The shingles by which each node of ``apart`` can meet those of other components that it may link with.

    Sets of n and m shingles that link share at least percent * (n + m) / (100 + percent). With each set in one order,
    rarest first, the first shingle that both hold leaves each set at least that many, itself included. So a set
    offers only its shingles up to there, and for each only the sizes of partners that the rest of the set allows.
    Shingles that no other component holds come first of all and are left out: a set with too few others can't link.
    """
    sizes = apart.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    about = written(apart.join(sizes, "comp").select("node", "n", "comp", "size"), "standing")
    tokens = written(about.select("node").join(held.select("node", "text"), "node").mapInArrow(_tokens(words), "node long, tokens array<long>"), "tokens")
    ranks = tokens.join(about.select("node", F.struct("size", "comp").alias("at")), "node").select("at", F.explode("tokens").alias("token"))
    ranks = ranks.groupBy("token").agg(F.count(F.lit(1)).alias("often"), F.min("at").alias("low"), F.max("at").alias("top"))
    ranks = ranks.where("low.comp <> top.comp").select("token", "often", F.col("top.comp").alias("top"))
    shared = tokens.select("node", F.explode("tokens").alias("token")).join(ranks, "token")
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "token", "top"))).alias("t"))
    lists = lists.join(about, "node").where(f"100 * size(t) >= {percent} * n")
    offers = lists.withColumn("few", F.expr(f"cast(ceil({percent} * n / 100) as int)"))
    return written(offers.select("node", "n", "comp", "size", "few", F.size("t").alias("held"), F.posexplode(F.expr("slice(t, 1, size(t) - few + 1)")).alias("i", "t")).select("node", "n", "comp", "size", "few", (F.col("held") - F.col("i")).alias("left"), "t.token", "t.top"), "offers")


def _crowded(offers: DataFrame) -> DataFrame | None:
    """(node, n, comp) of the nodes whose offers meet more than MEETS components; None without such."""
    meets = offers.select("token", "comp").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("meets"))
    heavy = offers.join(meets, "token").groupBy("node", "n", "comp").agg(F.sum("meets").alias("meets")).where(F.col("meets") > MEETS)
    heavy = written(heavy.select("node", "n", "comp"), "crowded")
    return None if heavy.isEmpty() else heavy


def _crossing(offers: DataFrame, crowded: DataFrame | None, percent: int) -> DataFrame:
    """(a, b, comp_b, most): every pair across components that offers bring together, and the most they may share.

    Of a pair the side of the smaller component asks, so one large component is never paired with itself. Pairs of two
    ``crowded`` nodes are left to the long bands, so a node that isn't crowded bounds the work on each pair.
    """
    band = lambda n: f"cast(floor(ln({n}) / ln({BAND}D)) as int)"
    biggest = f"greatest(few, floor(left * {100 + percent} / {percent}) - n)"
    most = F.least("left", "left_b")

    def met(asking: DataFrame, offering: DataFrame) -> DataFrame:
        offered = offering.select("token", F.expr(band("n")).alias("band"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), F.col("size").alias("size_b"), F.col("left").alias("left_b"))
        asked = asking.where("comp <> top").select("token", F.explode(F.expr(f"sequence({band('few')}, {band(biggest)})")).alias("band"), F.col("node").alias("a"), "n", "comp", "size", "left")
        pairs = asked.join(offered, ["token", "band"]).where(F.expr("size < size_b or (size = size_b and comp < comp_b)") & (most * (100 + percent) >= percent * (F.col("n") + F.col("m"))))
        return pairs.select("a", "b", "comp_b", most.alias("most"))

    if crowded is None:
        pairs = met(offers, offers)
    else:
        sparse = offers.join(crowded.select("node"), "node", "left_anti")
        pairs = met(sparse, offers).unionByName(met(offers.join(crowded.select("node"), "node", "left_semi"), sparse))
    return pairs.groupBy("a", "b", "comp_b").agg(F.max("most").alias("most"))


def _in_long_bands(crowded: DataFrame, comps: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) after the links among ``crowded`` nodes, which long bands of min-max values bring together.

    As with the short bands, a bucket's members meet one of them first; where they still stand in several components,
    members of different ones meet each other.
    """
    rows, bands = long_bands(crowded.count(), percent)
    texts = crowded.select("node", "n").join(held.select("node", "text"), "node")
    keys = texts.select("node", "text").mapInArrow(_banded(words, rows, bands), "node long, buckets array<long>")
    members = keys.join(crowded.select("node", "n"), "node").select("node", "n", F.explode("buckets").alias("bucket"))
    members = written(members, "long_bands")

    def mixed(comps: DataFrame) -> DataFrame:
        now = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        return now.join(now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket"), "bucket")

    sized = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    now = written(mixed(comps), "mixed")
    first = now.groupBy("bucket").agg(F.min(F.struct("node", "n", "comp")).alias("l"))
    led = now.join(first, "bucket").where("comp <> l.comp").select(F.col("l.node").alias("a"), F.col("l.n").alias("m"), F.col("node").alias("b"), "n")
    comps = _merged(comps, _confirmed(written(led.where(sized).select("a", "b").distinct(), "led_long"), held, words, percent))
    now = written(mixed(comps), "mixed")
    other = now.select("bucket", F.col("node").alias("a"), F.col("n").alias("m"), F.col("comp").alias("comp_a"))
    rest = now.withColumnRenamed("node", "b").join(other, "bucket").where("a < b and comp <> comp_a").where(sized)
    return _merged(comps, _confirmed(written(rest.select("a", "b").distinct(), "crossing_long"), held, words, percent))


def _confirmed(pairs: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link: a look at their signatures, then their full sets."""
    sigs = held.select("node", "sig")
    with_a = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    with_ab = with_a.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")
    likely = written(with_ab.mapInArrow(_likely(percent / 100 - 0.25), "a long, b long"), "pairs")
    one = likely.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return written(two.mapInArrow(_linked(words, percent), "a long, b long"), "links")
