"""Document fingerprints: a homomorphic multiset hash over paragraphs. Only DataFrame and SQL functions are used."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offergrid.llm.common import buckets_of

#: Each lane of the equality part is a sum modulo 2**60; each lane of the likeness part holds two sums of up to 2**30.
EQUAL_LANES, BITS_EACH, FIELD = 8, 6, 30
LANES = EQUAL_LANES + 4 * BITS_EACH
M60 = (1 << 60) - 1
#: Runs are added up in bytes, eight to a word, CHUNK runs at a time, so that no byte overflows and none is negative.
CHUNK, EACH_BYTE = 127, 0x0101010101010101


def fingerprint(text: Column) -> Column:
    """Struct (n, lanes): the sum of wide vectors hashed from the paragraphs of ``text`` (null: empty).

    Paragraphs are the lines that hold a word. Lanes 0 to 7 add eight seeded 60-bit hashes of each paragraph. Lanes
    8 to 31 add, for each run of three words in a paragraph (two or one at its end), 48 bits of its hash, two sums to a
    lane; a text can't hold the 2**30 runs that a sum has room for. Sums of vectors modulo powers of two don't depend on
    the order of paragraphs, and adding or subtracting a paragraph's vector inserts or deletes it (``combine``).
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.regexp_replace(F.regexp_replace(p, r"[\x20\x09-\x0D]+", " "), "^ | $", "")), lambda p: p != "")
    return paragraphs_vector(paragraphs)


def paragraphs_vector(paragraphs: Column) -> Column:
    runs = F.flatten(F.transform(F.transform(paragraphs, lambda p: F.split(p, " ")), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))
    whole = F.aggregate(
        paragraphs,
        F.struct(*[F.lit(0).cast("long").alias(f"e{i}") for i in range(EQUAL_LANES)]),
        lambda a, p: F.struct(*[(a[f"e{i}"] + F.xxhash64(p, F.lit(i)).bitwiseAND(M60)).bitwiseAND(M60).alias(f"e{i}") for i in range(EQUAL_LANES)]),
        lambda a: F.array(*[a[f"e{i}"] for i in range(EQUAL_LANES)]),
    )
    add = lambda h, k: F.shiftrightunsigned(h, k).bitwiseAND(EACH_BYTE)
    counted = lambda part: F.aggregate(
        part,
        F.struct(*[F.lit(0).cast("long").alias(f"b{k}") for k in range(BITS_EACH)]),
        lambda a, h: F.struct(*[(a[f"b{k}"] + add(h, k)).alias(f"b{k}") for k in range(BITS_EACH)]),
    )
    byte = lambda w, j: F.shiftrightunsigned(w, 8 * j).bitwiseAND(255)
    wide = lambda w, j: byte(w, j) + F.shiftleft(byte(w, j + 4), FIELD)
    names = [(k, j) for k in range(BITS_EACH) for j in range(4)]
    sums = lambda runs: F.aggregate(
        F.transform(F.when(F.size(runs) > 0, F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")), lambda c: counted(F.slice(runs, c * CHUNK + 1, CHUNK))),
        F.struct(*[F.lit(0).cast("long").alias(f"s{k}_{j}") for k, j in names]),
        lambda a, w: F.struct(*[(a[f"s{k}_{j}"] + wide(w[f"b{k}"], j)).bitwiseAND(M60).alias(f"s{k}_{j}") for k, j in names]),
        lambda a: F.array(*[a[f"s{k}_{j}"] for k, j in names]),
    )
    # The runs stand in an array of one, so that they are worked out once for their count and for their sums.
    return F.transform(F.array(F.struct(whole.alias("e"), runs.alias("r"))), lambda x: F.struct(F.size(x["r"]).cast("long").alias("n"), F.concat(x["e"], sums(x["r"])).alias("lanes")))[0]


def combine(one: Column, other: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together (sign 1), or of ``one`` without ``other`` (sign -1)."""
    return F.struct((one["n"] + sign * other["n"]).alias("n"), F.zip_with(one["lanes"], other["lanes"], lambda a, b: (a + sign * b + (M60 + 1)).bitwiseAND(M60)).alias("lanes"))


def as_hex(fp: Column) -> Column:
    """Fixed-width lower-case hex of the run count and all lanes."""
    return F.lower(F.concat(F.lpad(F.hex(fp["n"]), 15, "0"), F.array_join(F.transform(fp["lanes"], lambda x: F.lpad(F.hex(x), 15, "0")), "")))


def _signed(fp: Column) -> Column:
    """The 48 sums as differences from what half of all runs would give."""
    lanes = F.slice(fp["lanes"], EQUAL_LANES + 1, LANES - EQUAL_LANES)
    return F.flatten(F.transform(lanes, lambda w: F.array(*[(2 * F.shiftrightunsigned(w, FIELD * j).bitwiseAND((1 << FIELD) - 1) - fp["n"]).cast("double") for j in range(2)])))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of their sums, not below 0. It estimates the shared runs."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pair = F.array(F.struct(_signed(one).alias("a"), _signed(other).alias("b")))
    cosine = F.transform(pair, lambda p: dot(p["a"], p["b"]) / F.nullif(F.sqrt(dot(p["a"], p["a"])) * F.sqrt(dot(p["b"], p["b"])), F.lit(0.0)))[0]
    return F.when(one["lanes"] == other["lanes"], 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def _last_line(text: Column) -> tuple[Column, Column]:
    """(all lines before the last newline, where the line after it begins)."""
    newlines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    before = F.call_function("substring_index", text, F.lit("\n"), newlines)
    return before, F.when(newlines > 0, F.char_length(before) + 2).otherwise(1)


def _numbers(values: list[int | None]) -> Column:
    """An array of constants as one literal, so that a plan doesn't grow by an expression for each."""
    return F.from_json(F.lit(json.dumps(values)), "array<long>")


def _rank_in(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``value``, by halving."""
    steps = max(1, len(cuts).bit_length())
    padded = _numbers(cuts)
    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(steps - 1, -1, -1)]), F.lit(0), lambda at, step: at + F.when(F.get(padded, at + step - 1) < value, step).otherwise(0))


def neighbour_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000, most_ranges: int | None = None) -> DataFrame:
    """Fingerprint every text and the text edited from its successor's start.

    The successor of a row is the next one by descending id (ties by the text's hash, then the text; after the last row
    the first). The edited text has its last floor(n/2) code points replaced by the successor's first as many. Its
    fingerprint is not made anew: that of the lines before the edit stays, and only the rest is added to it.

    Rows are dealt into ranges of the id (from approximate quantiles) and rows without an id into ranges of their hash, and
    the first rows of a range are copied into the one before it, so that no window spans the table. A range has about
    ``rows`` rows, or more where there would be over ``most_ranges`` of them (by default 8 for each shuffle partition): how
    many there are follows the cluster, not the rows. Of the table only two numbers for each range come to the driver.

    Returns id, text, next_id, edited, fp, edited_fp, next_fp, near_edited, near_next. Null texts count as empty;
    ids are integers, null ids come last; repeated rows succeed each other; a single row succeeds itself; an empty table gives none.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    n, unnamed = base.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    most = most_ranges or 8 * buckets_of(docs.sparkSession)
    ranges, hashed = min(most, max(1, (n - unnamed) // rows)), min(most, max(1, unnamed // rows))
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(base.agg(F.percentile_approx("id", shares, max(10_000, 10 * ranges)).alias("q")).first()["q"] or []))
    # Ranges are numbered so that a row's successor is in its own range or in the next lower one that holds any row.
    ranked = _rank_in([int(c) for c in cuts], F.col("id")) if cuts else F.lit(0)
    nulls = F.lit(-1) - F.shiftright(F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 32) * hashed, 32)
    base = base.withColumn("part", F.when(F.col("id").isNull(), nulls).otherwise(ranked).cast("int"))
    tops = {r["part"]: (r["top"], r["least"]) for r in base.groupBy("part").agg(F.max("id").alias("top"), F.min("key").alias("least")).collect()}
    order = sorted(tops, reverse=True)
    # The first rows of a range also stand after the last of the range before it; those of the first after the very last.
    at = {p: i for i, p in enumerate(order)}
    low, high = (order[-1], order[0]) if order else (0, 0)
    spots = [p in at and (order[at[p] - 1], *tops[p]) for p in range(low, high + 1)]
    pick = lambda i: F.get(_numbers([s[i] if s else None for s in spots]), F.col("part") - low)
    leads = F.when(F.col("id").isNull(), F.col("key") == pick(2)).otherwise(F.col("id") == pick(1))
    half = F.expr("cast(char_length(text) div 2 as int)")
    kept = F.expr("left(text, char_length(text) - cast(char_length(text) div 2 as int))")
    before, start = _last_line(kept)
    split = base.withColumn("guest", F.when(leads, pick(0).cast("int")) if order else F.lit(None).cast("int")).withColumn("before", before).withColumn("start", start)
    fps = split.withColumn("kept_fp", fingerprint(F.col("before"))).withColumn("rest_fp", fingerprint(F.expr("substring(text, start)")))
    fps = fps.withColumn("fp", combine(F.col("kept_fp"), F.col("rest_fp"))).drop("before", "rest_fp")
    dealt = fps.withColumn("at", F.explode(F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("g")), F.when(F.col("guest").isNotNull(), F.struct(F.col("guest").alias("part"), F.lit(1).alias("g")))))))
    window = Window.partitionBy("at.part").orderBy("at.g", F.col("id").desc_nulls_last(), "key", "text")
    follows = dealt.withColumn("next", F.lead(F.struct("id", "text", "fp")).over(window)).where("at.g = 0")
    added = F.left("next.text", half)
    done = follows.select("id", "text", F.col("next.id").alias("next_id"), F.concat(kept, added).alias("edited"), "fp", F.col("next.fp").alias("next_fp"), "kept_fp", F.concat(F.expr("substring(left(text, char_length(text) - cast(char_length(text) div 2 as int)), start)"), added).alias("changed"))
    done = done.withColumn("edited_fp", combine(F.col("kept_fp"), fingerprint(F.col("changed")))).drop("kept_fp", "changed")
    return done.withColumn("near_edited", likeness(F.col("fp"), F.col("edited_fp"))).withColumn("near_next", likeness(F.col("fp"), F.col("next_fp")))
