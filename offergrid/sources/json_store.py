"""JSON edge: nested results and progress files to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offergrid.operators.grid import small, tail_n
from offergrid.schemas import OFFER_DEFAULTS, OFFER_FIELDS, OFFERS
from offergrid.shared import aside, erase, saved
from offergrid.sources.lines import before_blocks, read_pieces

RECORD = [f.split()[0] for f in OFFER_FIELDS.split(", ")]


def sink_offers_json(offers: DataFrame) -> DataFrame:
    """(asin, body): each product's record object by location. One row a product, so a table of any size is written as lines."""
    record = F.struct("asin", "pincode", *RECORD)
    nested = offers.groupBy("asin").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("pincode", record.alias("record"))))).alias("m"))
    return nested.select("asin", F.to_json(F.create_map("asin", "m"), {"ignoreNullFields": "false"}).alias("body"))


def sink_offers_files(offers: DataFrame, path: str, files: int, most: int = 1 << 16, compression: str = "none") -> None:
    """Offers as nested objects {asin: {pincode: record}}, one a file: products are dealt to ``files`` files by their id.

    A file is written by one task, so there are more files, a multiple of ``files``, where one would hold over ``most``
    products. Products are made once and kept aside until all is written; which of them begin and end a file is told by their
    ids alone. With a ``compression`` (gzip) that can't be split a file is also read by one task, so ``most`` bounds that too.
    """
    kept = aside(offers.sparkSession, "bodies")
    bodies = saved(sink_offers_json(offers), "bodies", kept, "zstd")
    n = files * max(1, -(-bodies.count() // (files * most)))
    dealt = bodies.withColumn("file", F.pmod(F.xxhash64("asin"), F.lit(n)).cast("int"))
    ends = F.broadcast(dealt.groupBy("file").agg(F.min("asin").alias("first"), F.max("asin").alias("last")))  # a row a file
    line = F.concat(F.when(F.col("asin") == F.col("first"), "{").otherwise(","), F.expr("substring(body, 2, char_length(body) - 2)"), F.when(F.col("asin") == F.col("last"), "}").otherwise(""))
    lines = dealt.join(ends, "file").select("file", "asin", line.alias("value")).repartitionById(n, F.col("file"))
    lines.sortWithinPartitions("file", "asin").drop("asin").write.partitionBy("file").text(path, compression=compression)
    erase(offers.sparkSession, kept)


def scan_offers_json(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Offers of nested objects {asin: {pincode: record}}.

    Absent keys take their defaults, present nulls stay null; outer keys stand in for an absent id or location; a
    body that is no such object gives no rows.
    """
    return offers_of(bodies.select(F.from_json(column, "map<string,map<string,string>>").alias("nested")), "nested")


def offers_of(maps: DataFrame, column: str) -> DataFrame:
    """scan_offers_json of maps that were read from their bodies."""
    outer = maps.select(F.explode(column).alias("k_asin", "inner"))
    pairs = outer.select("k_asin", F.explode("inner").alias("k_pincode", "raw"))
    seen = pairs.withColumn("keys", F.coalesce(F.json_object_keys("raw"), F.array())).withColumn("r", F.from_json("raw", OFFERS))
    absent = lambda name: ~F.array_contains("keys", name)
    cols = [F.when(absent("asin"), F.col("k_asin")).otherwise(F.col("r.asin")).alias("asin"), F.when(absent("pincode"), F.col("k_pincode")).otherwise(F.col("r.pincode")).alias("pincode")]
    for f in RECORD:
        value = F.col(f"r.{f}")
        cols.append((F.when(absent(f), F.lit(OFFER_DEFAULTS[f])).otherwise(value) if f in OFFER_DEFAULTS else value).alias(f))
    return seen.select(*cols)


def read_offers_json(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Offers of files that hold one nested object {asin: {pincode: record}} each, a large file read by many tasks.

    A file is cut at every closing brace; ``products`` finds which of them end a product. A file that is no such
    object (cut short, or not JSON) gives no rows; with ``whole`` False its whole products are kept. Of products that
    stand twice in a file the last counts.
    """
    kept = aside(spark, "pieces")
    rows = products(read_pieces(spark, path, "}", piece_marks(), kept))
    erase(spark, kept)  # products are saved
    found = rows.where("key is not null")
    if whole:
        good = rows.groupBy("file").agg(F.min(F.col("key").isNotNull() & F.col("ended")).alias("good")).where("good")
        found = found.join(small(good.select("file")), "file", "left_semi")
    again = found.groupBy("file", "key").agg(F.max("product").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return offers_of(found.join(small(again), ["file", "key"], "left").where("_last is null or product = _last").select("nested"), "nested")


def piece_marks() -> dict[str, Column]:
    """What a piece of a nested file holds: quotes, opening braces outside of strings if it begins outside of one, opening
    braces in all (those inside are outside if it begins inside), and whether it is blank."""
    bare = F.regexp_replace("text", r"(?s)\\.", "")  # a cut can't part an escape: it stands before a brace
    count = lambda text, mark: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))).cast("long")
    code = F.regexp_replace(bare, r'"[^"]*(?:"|$)', "")
    return {"quotes": count(bare, '"'), "opens_out": count(code, "{"), "opens": count(bare, "{"), "blank": F.regexp_like("text", F.lit(r"^\s*$"))}


def products(pieces: DataFrame) -> DataFrame:
    """(file, product, key, nested, ended): the map {key: {...}} of each product of a nested file, from pieces with their marks.

    Braces inside strings don't count, and whether a piece begins inside a string depends on all quotes before it; how
    deep it begins, on all braces before it; its product, on all products that ended before it. Each is a running sum,
    taken within blocks and shifted by the sums of the blocks before, which are of numbers alone: the text is moved once, to
    its block. Products that end in the block in which they begin are read there; the others, two a block, meet after.
    ``key`` is null where a product can't be read or what stands before it is no brace or comma. ``ended``: after the last
    product the file's object is closed and nothing else follows.
    """
    numbers = pieces.drop("text")
    quotes = _starts(numbers, "quotes")
    depths = _starts(_depths(numbers, quotes), "deeper")
    ends = _starts(_ends(_depths(numbers, quotes), depths), "ends")
    rows = running(_ends(_depths(pieces, quotes), depths), "ends", "product", ends)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"])
    facts = [F.max("ends").alias("ends"), F.sum("closes").alias("closes"), F.max("depth").alias("depth"), F.min("plain").alias("plain")]
    own = rows.groupBy("file", "block", "product").agg(F.array_join(texts, "}").alias("raw"), F.min("piece").alias("from"), *facts)
    within = (F.col("ends") == 1) & (F.col("from") > 0)
    own = own.withColumn("within", within).withColumn("nested", F.when(within, _nested())).withColumn("raw", F.when(~within, F.col("raw")))
    own = saved(_keyed(own), "products", compression="zstd")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "raw"))), lambda p: p["raw"])
    met = own.where("not within").groupBy("file", "product").agg(F.array_join(texts, "}").alias("raw"), *facts)
    tail = met.where("ends = 0").select("file", (F.col("plain") & (F.col("closes") == 1) & (F.col("depth") == 1)).alias("ended"))
    parts = [own.where("within"), _keyed(met.where("ends = 1").withColumn("nested", _nested()))]
    found = parts[0].unionByName(parts[1], allowMissingColumns=True).select("file", "product", "key", "nested")
    return found.join(small(tail), "file", "left").withColumn("ended", F.coalesce("ended", F.lit(False)))


def _nested() -> Column:
    """A product's map of its text ``raw``, which lacks its last brace."""
    lead = F.when(F.col("product") == 0, r"^\s*\{").otherwise(r"^\s*,")
    body = F.when(F.regexp_like("raw", lead), F.concat(F.lit("{"), F.regexp_replace("raw", lead, F.lit("")), F.lit("}}")))
    return F.from_json(body, "map<string,map<string,string>>")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.when(F.size("nested") == 1, F.map_keys("nested")[0]))


def _depths(pieces: DataFrame, quotes: DataFrame) -> DataFrame:
    """Pieces with how much deeper they go, given the quotes before each block."""
    rows = running(pieces, "quotes", "quoted", quotes)
    inside = F.col("quoted") % 2 == 1
    rows = rows.withColumn("closes", (F.col("cut") & ((F.col("quoted") + F.col("quotes")) % 2 == 0)).cast("long"))
    opens = F.when(inside, F.col("opens") - F.col("opens_out")).otherwise(F.col("opens_out"))
    return rows.withColumn("deeper", opens - F.col("closes")).withColumn("plain", (F.col("quotes") == 0) & (inside | F.col("blank")))


def _ends(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """Rows of _depths with whether they end a product, given the depth before each block."""
    rows = running(rows, "deeper", "depth", depths)
    return rows.withColumn("ends", F.when(F.col("depth") + F.col("deeper") == 1, F.col("closes")).otherwise(0))


def _starts(rows: DataFrame, what: str) -> DataFrame:
    """The sum of ``what`` over the file's blocks before each block: a row a block."""
    return small(saved(before_blocks(rows.groupBy("file", "block").agg(F.sum(what).alias("_before")), "_before"), "starts"))


def running(rows: DataFrame, what: str, name: str, starts: DataFrame) -> DataFrame:
    """Add ``name``: the sum of ``what`` over all earlier pieces of the file, given those of its earlier blocks."""
    within = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn(name, F.coalesce(F.sum(what).over(within), F.lit(0)))
    return own.join(starts, ["file", "block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def sink_progress(done: DataFrame, order: tuple[str, ...], stamp: str, keep: int = 10_000) -> DataFrame:
    """One JSON row: how many pairs are done, and the last ``keep`` of them (the file's own bound)."""
    last = tail_n(done, keep, *order)
    pairs = last.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "asin", "pincode"))), lambda x: F.array(x["asin"], x["pincode"])).alias("completed_combinations"))
    total = done.agg(F.count(F.lit(1)).cast("int").alias("last_completed_index"))
    return total.crossJoin(F.broadcast(pairs)).select(F.to_json(F.struct("last_completed_index", "completed_combinations", F.lit(stamp).alias("timestamp"))).alias("body"))


def scan_progress_json(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Distinct done pairs; entries that are no pair and bodies that are no such object give none."""
    kind = "last_completed_index int, completed_combinations array<array<string>>, timestamp string"
    pairs = bodies.select(F.explode(F.from_json(column, kind)["completed_combinations"]).alias("p")).where("size(p) = 2")
    return pairs.select(F.col("p")[0].alias("asin"), F.col("p")[1].alias("pincode")).distinct()
