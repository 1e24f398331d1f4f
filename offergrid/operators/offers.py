"""From captured pages and attempts to one offer for each product and location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offergrid.functions.text import delivery_display, delivery_minutes, is_free_text
from offergrid.operators.grid import small
from offergrid.schemas import UNKNOWN_STOCK

WRITE_ORDER = ("captured_at", "l_orderkey", "l_linenumber", "l_suppkey")


def upsert_latest(rows: DataFrame, keys: tuple[str, ...] = ("asin", "pincode"), order: tuple[str, ...] = WRITE_ORDER, by: tuple[str, ...] = ()) -> DataFrame:
    """The last write of each key. Spark keeps one row of a key and task before the shuffle (group limit).

    With ``by``, some of the keys, rows are dealt by these alone and before that limit: where keys seldom repeat and what
    follows joins or groups by these columns, this one shuffle serves it all.
    """
    rows = rows.repartition(*by) if by else rows
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def keyed_dict_dedupe(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key's last occurrence at the place of its first."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def attempt_resolution(tries: DataFrame, order: tuple[str, ...], keys: tuple[str, ...] = ("asin", "pincode"), max_attempts: int = 3, final_reason: str = "Failed after retries", challenge: str = "CAPTCHA") -> DataFrame:
    """The first attempt that is OK, among the first ``max_attempts``; else the last of these, as FAILED.

    A try that meets a challenge gives its attempt one more try, whose outcome counts; a second challenge in one attempt
    is its outcome. ``tries`` has status, failure_reason, seller and price; other columns are ignored.
    """
    within = Window.partitionBy(*keys).orderBy(*order)
    met = F.coalesce(F.col("failure_reason") == challenge, F.lit(False))
    rows = tries.select(*keys, *[c for c in order if c not in keys], "status", "seller", "price", met.alias("_met")).withColumn("_n", F.row_number().over(within))
    # In a run of challenges every second try is an extra one, and so is what follows a run of odd length.
    rows = rows.withColumn("_last", F.coalesce(F.max(F.when(~F.col("_met"), F.col("_n"))).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("attempt", F.sum(F.when((F.col("_n") - F.col("_last")) % 2 == 1, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    whole = F.struct("attempt", "status", "seller", "price")
    ended = rows.where(F.col("attempt") <= max_attempts).groupBy(*keys, "attempt").agg(F.max_by(F.struct("status", "seller", "price"), "_n").alias("r"))
    ended = ended.select(*keys, "attempt", "r.*")
    ok = F.min_by(whole, F.when(F.col("status") == "OK", F.col("attempt")))
    out = ended.groupBy(*keys).agg(ok.alias("ok"), F.max_by(whole, "attempt").alias("last"), F.max("attempt").alias("attempts"))
    good = F.col("ok").isNotNull() & (F.col("ok.status") == "OK")
    pick = lambda c: F.when(good, F.col(f"ok.{c}")).otherwise(F.col(f"last.{c}"))
    return out.select(*keys, pick("attempt").alias("attempt"), F.when(good, "OK").otherwise("FAILED").alias("status"), F.when(good, "").otherwise(final_reason).alias("failure_reason"), pick("seller").alias("seller"), pick("price").alias("price"), "attempts")


def with_options(rows: DataFrame, channel: Column, text: Column, as_of: Column) -> DataFrame:
    """Delivery option columns of rows that hold one promise each."""
    free = is_free_text(text)
    return rows.withColumn("channel", channel).withColumn("raw_text", text).withColumn("is_free", free).withColumn("sort_minutes", delivery_minutes(text, as_of)).withColumn("display_text", delivery_display(F.col("channel"), text, free))


def channel_first(options: DataFrame, keys: tuple[str, ...], seq: tuple[str, ...]) -> DataFrame:
    """The first option found for each channel, before any sorting."""
    first = Window.partitionBy(*keys, "channel").orderBy(*seq)
    return options.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def options_sorted(options: DataFrame, keys: tuple[str, ...], seq: tuple[str, ...]) -> DataFrame:
    """The options of each key by minutes, stable, as one array."""
    item = F.struct("sort_minutes", *seq, "display_text")
    return options.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda o: o["display_text"]).alias("all_options"))


def earliest_delivery(options: DataFrame, keys: tuple[str, ...], seq: tuple[str, ...]) -> DataFrame:
    """The earliest of the options that channel_first keeps: display text and whether it is free."""
    first = channel_first(options, keys, seq)
    best = first.groupBy(*keys).agg(F.min_by(F.struct("display_text", "is_free", "sort_minutes"), F.struct("sort_minutes", *seq)).alias("b"))
    return best.select(*keys, F.coalesce("b.display_text", F.lit("Not Available")).alias("delivery_date"), F.coalesce("b.is_free", F.lit(False)).alias("is_free"), "b.sort_minutes")


def running_progress(rows: DataFrame, run: str, order: tuple[str, ...], started: Column, ranges: int = 64) -> DataFrame:
    """Running counters, rate and remaining seconds of each run, in arrival order; the total is the run's rows.

    A run is cut into ranges of its time, counted apart and shifted by the counts of the earlier ranges, so that one run
    with most of the rows is spread over tasks. The table of counts has a row for each run and range.
    """
    at = F.unix_timestamp(F.col(order[0]).cast("timestamp"))
    spans = rows.groupBy(run).agg(F.min(at).alias("_from"), F.max(at).alias("_to"), F.count(F.lit(1)).alias("total"))
    cut = rows.join(small(spans), run).withColumn("_range", ((at - F.col("_from")) * ranges / (F.col("_to") - F.col("_from") + 1)).cast("int"))
    counts = cut.groupBy(run, "_range").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "OK").alias("_ok"))
    before = Window.partitionBy(run).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(run, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_ok")])
    so_far = Window.partitionBy(run, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("_i", F.count(F.lit(1)).over(so_far)).withColumn("_s", F.count_if(F.col("status") == "OK").over(so_far)).join(starts, [run, "_range"])
    out = out.withColumn("done", F.col("_i") + F.col("_n_before")).withColumn("success", F.col("_s") + F.col("_ok_before")).withColumn("failed", F.col("done") - F.col("success"))
    out = out.withColumn("elapsed_s", at - F.unix_timestamp(started.cast("timestamp")))
    eta = F.col("elapsed_s") / F.greatest(F.lit(1), F.col("done")) * F.greatest(F.lit(0), F.col("total") - F.col("done"))
    out = out.withColumn("pct", (F.col("done") * 100 / F.col("total")).cast("int")).withColumn("eta_s", eta.cast("bigint"))
    return out.select(*rows.columns, "done", "success", "failed", "total", "elapsed_s", "pct", "eta_s")


def retention(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], newest: int, cutoff: Column) -> DataFrame:
    """Rows among the ``newest`` of their key that are also not older than ``cutoff``."""
    recent = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(recent)).where((F.col("_rn") <= newest) & (F.col(order[0]) >= cutoff)).drop("_rn")


def classify_page(url: Column, html: Column, asin: Column, captcha: tuple[str, ...] = ("captcha", "robot check"), missing: str = "page not found", ready: tuple[str, ...] = ("add to cart", "out of stock"), sample: int = 3000, low: Column | None = None) -> Column:
    """CAPTCHA, NOT_FOUND, WRONG_PAGE, INCOMPLETE_LOAD or OK, by ordered rules on the start of the page and its url.

    ``low`` is the page in small letters, where the caller has it: of a page that is no longer than the sample this is taken.
    """
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, sample))
    head = head if low is None else F.when(F.octet_length(html) <= sample, low).otherwise(head)
    address = F.coalesce(url, F.lit(""))
    has = lambda words: _any([head.contains(w) for w in words])
    return (
        F.when(has(captcha) | F.lower(address).contains("captcha"), "CAPTCHA")
        .when(head.contains(missing) | address.contains("404"), "NOT_FOUND")
        .when(~head.contains(F.lower(asin)), "WRONG_PAGE")
        .when(~has(ready), "INCOMPLETE_LOAD")
        .otherwise("OK")
    )


def is_challenge(url: Column, title: Column, html: Column, low: Column | None = None) -> Column:
    """A page that asks whether its reader is human; ``low`` is the page in small letters, where the caller has it."""
    page = F.lower(html) if low is None else low
    return F.coalesce(F.lower(url).contains("captcha") | F.lower(title).contains("captcha") | page.contains("enter the characters you see below") | page.contains('id="captchacharacters"'), F.lit(False))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def outcome_of_page(state: Column) -> tuple[Column, Column]:
    """(status, reason): only a challenge and a missing page fail."""
    status = F.when(state.isin("CAPTCHA", "NOT_FOUND"), "FAILED").otherwise("OK")
    reason = F.when(state == "CAPTCHA", "CAPTCHA").when(state == "NOT_FOUND", "Product not found (404)").otherwise("")
    return status, reason


def location_confirmed(line: Column, pincode: Column, city: Column) -> Column:
    """The delivery line names the location expected."""
    return F.coalesce(line.contains(pincode) | F.lower(line).contains(F.lower(city)), F.lit(False))


#: What each field of an offer holds after each kind of failure.
FAILURE_DEFAULTS = {
    "CAPTCHA": {"product_name": "", "discount_percent": "", "in_stock": "", "delivery_date": "", "free_delivery": "", "bsr": ""},
    "NOT_FOUND": {"product_name": "Not Found", "discount_percent": "N/A", "in_stock": "Not Found", "delivery_date": "Not Available", "free_delivery": "N/A", "bsr": "N/A"},
    "ERROR": {"product_name": "Not Found", "discount_percent": "N/A", "in_stock": UNKNOWN_STOCK, "delivery_date": "Not Found", "free_delivery": "N/A", "bsr": "N/A"},
    "PINCODE_FAILED": {"product_name": "Not Found", "discount_percent": "N/A", "in_stock": "Not Found", "delivery_date": "Pincode Failed", "free_delivery": "N/A", "bsr": "N/A"},
}


def failure_defaults(rows: DataFrame, kind: str = "kind", error: str = "error") -> DataFrame:
    """Fill the fields of failed rows by their kind; an error's text is kept up to 120 characters."""
    fields = FAILURE_DEFAULTS["CAPTCHA"]
    filled = [F.coalesce(*[F.when(F.col(kind) == k, F.lit(v[f])) for k, v in FAILURE_DEFAULTS.items()]).alias(f) for f in fields]
    status = F.when(F.col(kind) == "PINCODE_FAILED", "PINCODE_FAILED").otherwise("FAILED").alias("status")
    reason = F.when(F.col(kind) == "CAPTCHA", "CAPTCHA").when(F.col(kind) == "NOT_FOUND", "Product not found (404)").when(F.col(kind) == "PINCODE_FAILED", "Pincode Failed").otherwise(F.substring(F.col(error), 1, 120))
    return rows.select("*", *filled, status, reason.alias("failure_reason"))
