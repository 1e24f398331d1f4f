"""Line sources: catalog and location lists, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offergrid.functions.text import strip, valid_asin, valid_pincode
from offergrid.operators.grid import small
from offergrid.operators.offers import keyed_dict_dedupe
from offergrid.shared import saved


#: Names of files that Spark reads decompressed, as it goes by their names.
COMPRESSED = r"(?i)\.(gz|gzip|bz2|deflate|zst|lz4|snappy)$"


def read_pieces(spark: SparkSession, path: str, end: str | None = None, marks: dict[str, Column] | None = None, at: str | None = None) -> DataFrame:
    """(file, block, piece, text) of text files cut at ``end`` (by default at line ends), each large file by many tasks.

    A block is the part of a file that one task reads, named by where it begins; pieces are numbered from 0 in each. With
    an ``end`` given, ``cut`` tells whether it follows the piece, as it does for all but perhaps the last of a file. What
    was read is saved once (under ``at``), since a second reading may be split otherwise; ``marks``, columns made of ``text``,
    are saved with it, so that they are made once too. A compressed file is a block as a whole unless its format can be split.
    """
    reader = spark.read if end is None else spark.read.option("lineSep", end)
    where = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    # Ids grow within a task, and a block is read by one task from its first piece to its last.
    rows = saved(reader.text(path).select(*where, F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"), F.octet_length("value").alias("length")).withColumns(marks or {}), "pieces", at, "zstd")
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("_first"), F.max("id").alias("_last"), F.max("size").alias("size"), F.sum(F.col("length") + len(end or "")).alias("bytes"))
    of_file = Window.partitionBy("file")
    if end and blocks.where(F.col("file").rlike(COMPRESSED)).limit(1).count():
        # How long a compressed text is, tell two ways of cutting it: one ends with ``end`` if its lines count a byte more.
        lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.octet_length("value").alias("length"))
        lines = lines.where(F.col("file").rlike(COMPRESSED)).groupBy("file").agg(F.sum(F.col("length") + 1).alias("_lines"))
        whole = blocks.groupBy("file").agg(F.sum("bytes").alias("_pieces")).join(lines, "file").select("file", F.when(F.col("_lines") > F.col("_pieces"), F.col("_pieces")).otherwise(F.col("_pieces") - len(end)).alias("_size"))
        blocks = blocks.join(small(saved(whole, "sizes")), "file", "left").withColumn("size", F.coalesce("_size", "size"))
    # The last piece has no end if the file is shorter than its pieces with their ends.
    open_end = (F.col("block") == F.max("block").over(of_file)) & (F.sum("bytes").over(of_file) > F.col("size"))
    known = small(saved(blocks.select("file", "block", "_first", F.when(open_end, F.col("_last")).alias("_open")), "blocks"))
    cut = [~F.coalesce(F.col("id") == F.col("_open"), F.lit(False))] if end else []
    return rows.join(known, ["file", "block"]).select("file", "block", (F.col("id") - F.col("_first")).alias("piece"), "text", *(marks or {}), *[c.alias("cut") for c in cut])


def before_blocks(blocks: DataFrame, *sums: str) -> DataFrame:
    """For one row a block: the sums of the file's earlier blocks, under the same names. A file has few blocks."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files: lines are counted in each block and shifted by the counts of those before."""
    rows = read_pieces(spark, path)
    starts = before_blocks(rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_before")), "_before")
    return rows.join(small(starts), ["file", "block"]).select("file", (F.col("piece") + F.col("_before")).alias("line_no"), F.col("text").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """(file, line_no, line) as text files, one in a folder ``file=...`` for each list."""
    lines.select("file", "line_no", F.col("line").alias("value")).repartition("file").sortWithinPartitions("file", "line_no").drop("line_no").write.partitionBy("file").text(path)


def category_ffill(lines: DataFrame, range_lines: int = 1 << 16) -> DataFrame:
    """Give each line the text of the last header line above it in its file; an empty header resets to empty.

    Files are cut into ranges of line numbers. Each range hands its last header on to the ranges after it (one row a
    range), so a file of any length is worked on by many tasks.
    """
    line = strip(F.col("line"))
    cut = lines.withColumn("_range", F.expr(f"cast(line_no div {range_lines} as bigint)")).withColumn("_header", F.when(line.startswith("#"), strip(F.substring(line, 2, 1 << 30))))
    ends = cut.groupBy(F.col("file").alias("_file"), F.col("_range").alias("_at")).agg(F.max_by("_header", F.when(F.col("_header").isNotNull(), F.col("line_no"))).alias("_last"))
    earlier = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("_file", "_at", F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
    upto = Window.partitionBy("file", "_range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_own", F.last("_header", ignorenulls=True).over(upto))
    met = own.join(handed, own["file"].eqNullSafe(handed["_file"]) & (own["_range"] == handed["_at"]))
    return met.select(*[own[c] for c in lines.columns], F.coalesce("_own", "_handed", F.lit("")).alias("category"))


def strip_comments(lines: DataFrame) -> DataFrame:
    """Lines that hold data, without what follows a ``#``."""
    data = strip(F.split_part(F.col("line"), F.lit("#"), F.lit(1)))
    return lines.withColumn("data", data).where(~strip(F.col("line")).startswith("#") & (F.col("data") != ""))


def catalog_fields(lines: DataFrame) -> DataFrame:
    parts = F.transform(F.split("data", ","), strip)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return strip_comments(category_ffill(lines)).select("file", "line_no", part(0).alias("asin"), part(1).alias("item_name"), part(2).alias("item_code"), "category")


def scan_catalog(lines: DataFrame) -> DataFrame:
    """Catalog rows of valid ids; further fields are dropped."""
    return catalog_fields(lines).where(valid_asin(F.col("asin")))


def rejects(lines: DataFrame) -> DataFrame:
    """The rows that scan_catalog leaves out for their id."""
    return catalog_fields(lines).where(~valid_asin(F.col("asin"))).select("file", "line_no", "asin")


def scan_locations(lines: DataFrame) -> DataFrame:
    """(ord, pincode, city): split at the first comma; the last city of a code wins, at its first place."""
    line = strip(F.col("line"))
    pair = F.split(line, ",", 2)
    rows = lines.where((line != "") & ~line.startswith("#") & line.contains(",")).select("line_no", strip(F.get(pair, F.lit(0))).alias("pincode"), strip(F.get(pair, F.lit(1))).alias("city"))
    valid = rows.where(valid_pincode(F.col("pincode"), F.col("city")))
    return keyed_dict_dedupe(valid, "pincode", "city", "line_no").select(F.col("line_no").cast("bigint").alias("ord"), "pincode", "city")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")
