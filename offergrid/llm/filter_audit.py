"""How filters interact: for every order of a filter chain, what each step removes, and what it would remove alone.

Each document becomes a set of bits, one for each filter it fails. All orders and steps follow from how many documents
have which bits, so the texts are judged once and the 120 chains of five filters are sums over at most 32 numbers a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import scratch, written

#: Repeated text hashes up to this many are broadcast (24 bytes each); beyond, texts are dealt by hash instead.
SMALL_KEYS = 1_000_000
KEYS = ["id", "part", "text_key", "size"]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_SEPARATORS = " \t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    """Maximal runs of other than the six ASCII separators; an empty array where there is none."""
    bare = F.trim(text, F.lit(_SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of whole texts: A short, B repetitive words, C capitals, D symbols."""
    words = word_list(text)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80, "C": capitals * 100 > F.char_length(text) * 10, "D": text.rlike("[#$%&*|]")}


def repeats(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows whose whole text some row of a smaller id has: a semi-join on hash, exact text and smaller id.

    ``rows`` has KEYS and text, ``facts`` the same rows without text. Only texts whose hash occurs twice are moved. The
    witness of a text is its smallest id, found by an aggregation that combines before the shuffle, so a group of copies
    that holds a third of all rows meets one witness row; Spark splits the copies' side where it is skewed.
    """
    twice = facts.groupBy("text_key", "size").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least").select("text_key", "size")
    twice = written(twice, "audit-keys")
    if twice.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS:
        twice = F.broadcast(twice)
    held = written(rows.join(twice, ["text_key", "size"], "left_semi"), "audit-texts")
    first = written(held.groupBy("text_key", "size", "text").agg(F.min("id").alias("first")), "audit-firsts")
    a, b = held.alias("a"), first.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("text_key", "size", "text")]
    return a.join(b, [*same, F.col("b.first") < F.col("a.id")], "left_semi").select(*[F.col(f"a.{c}").alias(c) for c in KEYS])


def failure_counts(docs: DataFrame, labels: DataFrame, filters=text_filters, repeat: str = "E", part: str = "lang") -> DataFrame:
    """(part, bits, n, good, toxic): how many documents of a part fail exactly these filters, and how many are labelled.

    Bit i stands for the i-th letter of ``filters`` and then ``repeat``. Null text and part are empty. Every row counts,
    repeated rows as often as they stand; a row without id repeats nothing and is no witness. Of several labels of an id
    one of quality 1 or toxic 1 is enough.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = given.withColumn("text_key", F.xxhash64("text")).withColumn("size", F.octet_length("text"))
    fails = filters(F.col("text"))
    bits = F.lit(0)
    for i, test in enumerate(fails.values()):
        bits = bits + F.when(test, 1 << i).otherwise(0)
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    with scratch(docs.sparkSession):
        facts = written(rows.select(*KEYS, bits.alias("bits")), "audit-facts")
        again = repeats(rows, facts).select(*KEYS, F.lit(1 << len(fails)).alias("bits"), F.lit(0).alias("n"))
        failed = facts.select(*KEYS, "bits", F.lit(1).alias("n")).unionByName(again).groupBy(*KEYS).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
        known = failed.join(label, "id", "left").select("part", "bits", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
        return written(known.groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "audit-counts", keep=True)


def filter_audit(docs: DataFrame, labels: DataFrame, filters=text_filters, repeat: str = "E", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included; no rows for an empty table.

    kept: what passes this step; removed: what goes here; redundant: what fails here too but went before; unique_fails: what
    fails nothing else; good_lost, toxic_lost: labelled rows among the removed; shapley: the removed of this filter, summed
    over all orders, where a document that fails k filters is removed by each in one k-th of them.
    """
    counts = failure_counts(docs, labels, filters, repeat, part)
    letters = "".join([*filters(F.lit("")), repeat])
    orders = ["".join(p) for p in permutations(letters)]
    at = {c: 1 << i for i, c in enumerate(letters)}
    rows = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    mask = lambda chars: sum((F.when(F.contains(chars, F.lit(c)), b).otherwise(0) for c, b in at.items()), F.lit(0))
    here, before = mask(F.expr("substring(filter_order, step, 1)")), mask(F.expr("substring(filter_order, 1, step - 1)"))
    rows = rows.withColumn("here", here).withColumn("before", before)
    fails, gone = F.col("bits").bitwiseAND(F.col("here")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    count = lambda test, c="n": F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    sums = [
        count(~fails & ~gone), count(fails & ~gone), count(fails & gone), count(F.col("bits") == F.col("here")), count(fails & ~gone, "good"), count(fails & ~gone, "toxic"),
        F.coalesce(F.sum(F.when(fails, F.col("n") * F.lit(len(orders)) / F.bit_count("bits"))), F.lit(0)).cast("long"),
    ]
    return rows.groupBy("part", "filter_order", "step").agg(*[s.alias(n) for s, n in zip(sums, COUNTS, strict=True)])
