"""Column expressions that normalise captured page text. Each takes and returns columns; none runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offergrid.schemas import UNKNOWN_STOCK

#: Names looked for in delivery texts, in order.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAY, UNKNOWN_MINUTES = 1440, 999999


def number_of(text: Column, pattern: str, kind: str = "double", group: int = 1) -> Column:
    """The group of the first match as a number; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast(kind)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash_ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def parse_money(text: Column) -> Column:
    """The first number of a price text without currency sign and commas; null if there is none."""
    return number_of(F.translate(text, "₹,", ""), r"(\d+(?:\.\d+)?)")


def whole_plus_fraction(whole: Column, fraction: Column) -> Column:
    """A price shown in two elements. A whole part that ends in a dot loses its fraction, as the pages' readers expect."""
    joined = F.concat(whole, F.lit("."), F.coalesce(fraction, F.lit("00")))
    return parse_money(F.regexp_replace(F.translate(joined, ", ", ""), r"^\.+|\.+$", ""))


def normalise_stock(text: Column, can_add: Column | None = None, unknown: str = UNKNOWN_STOCK) -> Column:
    """One of five stock states. The order matters: a text that says "in stock" is in stock whatever else it says."""
    low = F.lower(F.coalesce(text, F.lit("")))
    left = F.regexp_extract(low, r"only\s+(\d+)\s+left", 1)
    state = F.when(low.contains("in stock"), "In Stock").when(low.contains("out of stock"), "Out of Stock").when(left != "", F.concat(F.lit("Low Stock ("), left, F.lit(" left)")))
    return (state.when(can_add, "In Stock") if can_add is not None else state).otherwise(unknown)


def discount_pct(mrp: Column, price: Column) -> Column:
    """Percent off, rounded half to even, as text; N/A where either price is missing or zero."""
    share = F.bround((mrp - price) / mrp * 100).cast("bigint").cast("string")
    return F.when(mrp.isNull() | price.isNull() | (mrp <= 0) | (price == 0), "N/A").otherwise(share)


def title_case(text: Column) -> Column:
    """A capital after anything that is no letter, small letters after letters."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def delivery_minutes(text: Column, as_of: Column) -> Column:
    """Minutes until the promised delivery, for ordering only; 999999 if the text promises nothing known.

    Rules apply in order: minutes, hours, today, tomorrow, days, ranges of days, the first weekday name (from Monday;
    the same day is a week ahead), then the first month name that stands anywhere in the text and makes a date with
    the first number. A date before ``as_of`` counts as 365 days later.
    """
    # The text stands in an array of one, so that it is lowered and stripped once for all rules.
    return F.transform(F.array(strip(F.lower(text))), lambda low: _minutes(low, as_of))[0]


def _minutes(low: Column, as_of: Column) -> Column:
    whole = lambda p: number_of(low, p, "int")
    ahead = F.coalesce(*[F.when(low.contains(d), (F.pmod(F.lit(i) - F.weekday(as_of) - 1, F.lit(7)) + 1) * DAY) for i, d in enumerate(WEEKDAYS)])
    day, year = whole(r"(\d{1,2})"), F.year(as_of)
    february = F.dayofmonth(F.last_day(F.make_date(year, F.lit(2), F.lit(1))))
    lengths = [F.lit(31), february, *[F.lit(n) for n in (31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]]
    # One lookup for the month, so that only one date is made: a day that a month doesn't have leaves it to the next.
    month = F.coalesce(*[F.when(low.contains(name) & (day >= 1) & (day <= length), F.lit(i + 1)) for i, (name, length) in enumerate(zip(MONTHS, lengths, strict=True))])
    days = F.date_diff(F.make_date(year, month, F.when(month.isNotNull(), day)), as_of)
    return F.coalesce(
        whole(r"in\s+(\d+)\s+minute"),
        whole(r"in\s+(\d+)\s+hour") * 60,
        F.when(low.contains("today"), F.lit(DAY)),
        F.when(low.contains("tomorrow"), F.lit(2 * DAY)),
        whole(r"in\s+(\d+)\s+day") * DAY,
        whole(r"(\d+)-\d+\s+day") * DAY,
        ahead,
        F.when(days < 0, days + 365).otherwise(days) * DAY,
        F.lit(UNKNOWN_MINUTES),
    ).cast("int")


def delivery_display(channel: Column, text: Column, is_free: Column) -> Column:
    """Channel and promise as a report shows them, without one leading phrase and order conditions."""
    bare = strip(F.regexp_replace(strip(text), r"(?i)^(free\s+delivery\s+in\s+|get\s+it\s+(by\s+)?|delivery\s+by\s+)", ""))
    bare = strip(F.regexp_replace(bare, r"(?i)\s+on orders over.*$", ""))
    return F.concat(channel, F.lit(" – "), title_case(bare), F.when(is_free, " (Free)").otherwise(""))


def delivery_days(text: Column, as_of: Column) -> Column:
    """Whole days until delivery, not below 0; null if the text names no day or one that doesn't exist.

    A date more than a day before ``as_of`` is taken in the next year.
    """
    # As for minutes, what several rules need stands in an array of one: the text, then its day and month.
    return F.transform(F.array(strip(F.coalesce(text, F.lit("")))), lambda bare: _days(bare, as_of))[0]


def _days(bare: Column, as_of: Column) -> Column:
    pattern = r"(\d{1,2})(?:\s*[-–]\s*\d{1,2})?\s+([A-Za-z]{3,})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(F.regexp_extract(bare, pattern, 2), 1, 3))).cast("int")
    parts = F.array(F.struct(F.lower(bare).alias("low"), number_of(bare, pattern, "int").alias("day"), month.alias("month")))
    return F.transform(parts, lambda p: _days_to(p["low"], p["day"], p["month"], as_of))[0]


def _days_to(low: Column, day: Column, month: Column, as_of: Column) -> Column:
    # Days that a month doesn't have are told by its length: no text that is no date is ever parsed.
    first = lambda year: F.make_date(year, month, F.lit(1))
    dated = lambda year: F.when(day <= F.dayofmonth(F.last_day(first(year))), F.date_add(first(year), day - 1))
    near = lambda this: F.when(this < F.date_sub(as_of, 1), dated(F.year(as_of) + 1)).when(this.isNotNull(), F.greatest(this, as_of))
    target = F.transform(F.array(F.when((month > 0) & (day >= 1), dated(F.year(as_of)))), near)[0]
    return F.when(low.contains("today"), 0).when(low.contains("tomorrow"), 1).otherwise(F.date_diff(target, as_of)).cast("int")


def delivery_band(status: Column, stock: Column, delivery: Column, as_of: Column) -> Column:
    """grey: failed, red: out of stock, green, yellow, orange: days to delivery up to 1, 3, more; null: none."""
    low, days = F.lower(F.coalesce(stock, F.lit(""))), delivery_days(delivery, as_of)
    timed = F.when(days <= 1, "green").when(days <= 3, "yellow").when(days.isNotNull(), "orange")
    return F.when(status.isin("FAILED", "PINCODE_FAILED"), "grey").when(low.startswith("out of stock"), "red").when(low.startswith("in stock") | low.startswith("low stock"), timed)


def pivot_cell(status: Column, stock: Column, delivery: Column, unknown: str = UNKNOWN_STOCK) -> Column:
    """What a report's cell says of one product at one location."""
    shown = F.coalesce(F.nullif(stock, F.lit("")), F.lit(unknown))
    told = F.when((F.coalesce(delivery, F.lit("")) != "") & ~delivery.isin("Not Found", "Set pincode manually"), delivery)
    return F.when(status == "PINCODE_FAILED", "Pincode Failed").when(status == "FAILED", "Scrape Failed").otherwise(F.concat_ws(" | ", shown, told))


def is_free_text(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("free") | low.contains("₹0") | low.contains("no charge")


def free_flag(is_free: Column) -> Column:
    return F.when(is_free, "Yes").otherwise("No")


def valid_asin(asin: Column) -> Column:
    """Ten letters or digits that begin with a capital B."""
    bare = strip(asin)
    return F.coalesce((F.char_length(bare) == 10) & bare.startswith("B") & bare.rlike(r"^[\p{L}\p{N}]+$"), F.lit(False))


def valid_pincode(pincode: Column, city: Column) -> Column:
    """Six digits and a city."""
    return F.coalesce(pincode.rlike("^[0-9]{6}$") & (F.char_length(city) > 0), F.lit(False))


def product_url(asin: Column, base: str = "https://www.example.com/dp/") -> Column:
    return F.concat(F.lit(base), asin)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy, hh:mm a")


def elapsed(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s.cast("bigint"))).otherwise(F.format_string("%02d:%02d", m, s.cast("bigint")))


def duration_text(combos: Column, seconds_each: int = 28) -> Column:
    total = combos.cast("bigint") * seconds_each
    hours, minutes = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60)
    return F.when(hours <= 0, F.format_string("~%d minutes", minutes)).otherwise(F.format_string("~%d hours %d minutes", hours, minutes))


