"""The work grid: products by locations, what is left to do, and how it is split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offergrid.functions.text import duration_text

SMALL_ROWS = 50_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only where the table is counted to be small; beyond that Spark chooses another join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def work_grid(catalog: DataFrame, locations: DataFrame) -> DataFrame:
    """Every catalog row at every location. The product is the result itself; only the location side is replicated."""
    at = locations.select(F.col("ord").alias("loc_ord"), "pincode", "city")
    return catalog.crossJoin(small(at))


BITS = 64


def location_numbers(locations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Locations with ``number`` from 0: in the order of the list, or after the largest of ``known`` (pincode, number).

    Numbers that were given once stay, so bitmaps made with them stay right when the list grows. A code that is listed
    twice has two numbers. The list is small by nature.
    """
    if known is None:
        return locations.withColumn("number", (F.row_number().over(Window.orderBy("ord", "pincode")) - 1).cast("long"))
    given = known.groupBy("pincode").agg(F.min("number").alias("number"))
    after = known.agg((F.coalesce(F.max("number"), F.lit(-1)) + 1).alias("_after"))
    fresh = locations.join(small(given), "pincode", "left_anti").withColumn("_n", F.row_number().over(Window.orderBy("ord", "pincode")) - 1)
    fresh = fresh.crossJoin(F.broadcast(after)).withColumn("number", (F.col("_n") + F.col("_after")).cast("long"))
    return locations.join(small(given), "pincode").select(*locations.columns, "number").unionByName(fresh.select(*locations.columns, "number"))


def done_bitmaps(done: DataFrame, numbers: DataFrame) -> DataFrame:
    """(asin, words): the numbers of each product's done locations, 64 to a word; words without a bit are left out.

    Repeated pairs meet in one bit before the shuffle. Pairs at locations without a number, and pairs without an id or a
    code, are in no grid and so in no bitmap.
    """
    at = done.select("asin", "pincode").where("asin is not null").join(small(numbers.select("pincode", "number")), "pincode")
    bit = F.expr(f"shiftleft(1L, cast(number % {BITS} as int))")
    return _by_product(at.select("asin", F.expr(f"cast(number div {BITS} as int)").alias("word"), bit.alias("bits")))


def merge_bitmaps(*bitmaps: DataFrame) -> DataFrame:
    """One bitmap a product out of those of several workers or runs that share their numbers: OR of the words."""
    words = [b.select("asin", F.explode("words").alias("word", "bits")) for b in bitmaps]
    union = words[0]
    for more in words[1:]:
        union = union.unionByName(more)
    return _by_product(union)


def _by_product(words: DataFrame) -> DataFrame:
    one = words.groupBy("asin", "word").agg(F.bit_or("bits").alias("bits"))
    return one.groupBy("asin").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def done_pairs(bitmaps: DataFrame, numbers: DataFrame) -> DataFrame:
    """The pairs of bitmaps: one row for each bit."""
    words = bitmaps.select("asin", F.explode("words").alias("_word", "_bits"))
    return _at_bits(words, numbers.select("pincode", "number")).select("asin", "pincode")


def _at_bits(words: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows with a word of bits at each location whose bit is set: a join by word that tests the bit in its condition."""
    at = numbers.select(*[c for c in numbers.columns if c != "number"], F.expr(f"cast(number div {BITS} as int)").alias("_there"), F.expr(f"cast(number % {BITS} as int)").alias("_at"))
    met = words.join(small(at), (F.col("_word") == F.col("_there")) & (F.expr("bit_get(_bits, _at)") == 1))
    return met.drop("_word", "_bits", "_there", "_at")


def todo_grid(catalog: DataFrame, locations: DataFrame, done: DataFrame) -> DataFrame:
    """The grid's rows that are not in ``done``."""
    numbers = location_numbers(locations)
    return todo_of_bitmaps(catalog, numbers, done_bitmaps(done, numbers))


def todo_of_bitmaps(catalog: DataFrame, numbers: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The grid's rows whose bit is not set in ``bitmaps``.

    Done locations are taken from each product's bits before any pair is made; a row is made for a missing pair alone, by
    replicating the list of locations, and no pair is ever shuffled. A product or a location that is not known stays to do.
    """
    last = numbers.agg(F.max("number").alias("m")).first()["m"]
    if last is None:
        return work_grid(catalog, numbers.drop("number"))
    listed = numbers.groupBy(F.expr(f"cast(number div {BITS} as int)").alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(number % {BITS} as int))")).alias("_listed"))
    known = catalog.join(bitmaps.select("asin", F.col("words").alias("_words")), "asin", "left")
    words = known.withColumn("_word", F.explode(F.sequence(F.lit(0), F.lit(int(last) // BITS)))).join(small(listed), "_word")
    missing = words.withColumn("_bits", F.expr("_listed & ~coalesce(_words[_word], 0L)")).where("_bits <> 0").drop("_words", "_listed")
    return _at_bits(missing, numbers.select(F.col("ord").alias("loc_ord"), "pincode", "city", "number"))


def done_set(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Distinct pairs of ``rows`` at the listed locations."""
    numbers = location_numbers(locations.groupBy("pincode").agg(F.min("ord").alias("ord")))
    return done_pairs(done_bitmaps(rows, numbers), numbers)


def location_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary list, or the fallback where that has no row at all."""
    empty = primary.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return primary.unionByName(fallback.crossJoin(F.broadcast(empty)).drop("_n"))


def location_failure_fanout(failed: DataFrame, catalog: DataFrame, done: DataFrame, reason: str = "Pincode Failed") -> DataFrame:
    """A failed location fails each of its products that is not done yet."""
    rest = todo_grid(catalog.select("asin", "item_name"), failed, done)
    return rest.select("asin", "pincode", "city", F.lit("PINCODE_FAILED").alias("status"), F.lit(reason).alias("failure_reason"))


def test_subset(catalog: DataFrame, locations: DataFrame, products: int = 3, places: int = 2) -> DataFrame:
    """The grid of the first products and locations; both limits apply before the product is formed."""
    return work_grid(catalog.orderBy("ord").limit(products), locations.orderBy("ord").limit(places))


def balanced_chunks(locations: DataFrame, workers: int) -> DataFrame:
    """Contiguous chunks of locations, the first ones one longer. The list of locations is small by nature."""
    n = max(1, min(workers, locations.count()))
    return locations.withColumn("chunk", F.ntile(n).over(Window.orderBy("ord")) - 1)


def plan_cost(locations: DataFrame, catalog: DataFrame, workers: int, seconds_each: int = 28) -> DataFrame:
    """Pairs and estimated duration of each chunk."""
    items = catalog.agg(F.count(F.lit(1)).alias("items"))
    per = balanced_chunks(locations, workers).groupBy("chunk").agg(F.count(F.lit(1)).alias("places"))
    combos = per.crossJoin(F.broadcast(items)).select("chunk", (F.col("places") * F.col("items")).alias("combos"))
    return combos.withColumn("estimate", duration_text(F.col("combos"), seconds_each))


def tail_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows of an order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
