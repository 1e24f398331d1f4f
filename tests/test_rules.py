"""Rules that are easy to get wrong, one case each; invariants by hypothesis."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offergrid.functions import text as X
from offergrid.operators import grid, offers, report
from offergrid.sources import json_store, lines
from offergrid.sources.sinks import sink_versioned


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_money(spark):
    assert values(spark, ["₹1,299.50", "M.R.P.: ₹ 99", "free", "", None], X.parse_money) == [1299.5, 99.0, None, None, None]


def test_fraction_is_lost_after_a_dot(spark):
    assert values(spark, ["1,299.", "1,299"], lambda t: X.whole_plus_fraction(t, F.lit("50"))) == [1299.0, 1299.5]


def test_stock_order(spark):
    assert values(spark, ["Only 2 left in stock", "only 3 left", "Currently out of stock", "", None], X.normalise_stock) == ["In Stock", "Low Stock (3 left)", "Out of Stock", "Check on site", "Check on site"]


def test_discount_rounds_half_to_even(spark):
    df = spark.createDataFrame([(200.0, 199.0), (200.0, 197.0), (100.0, 110.0), (0.0, 1.0), (None, 1.0), (10.0, 0.0)], "m double, p double")
    assert [r[0] for r in df.select(X.discount_pct(F.col("m"), F.col("p"))).collect()] == ["0", "2", "-10", "N/A", "N/A", "N/A"]


def test_title_case(spark):
    assert values(spark, ["2-day 10am o'clock"], X.title_case) == ["2-Day 10Am O'Clock"]


@pytest.mark.parametrize(
    ("as_of", "text", "minutes"),
    [("2000-01-15", "in 12 minutes", 12), ("2000-01-15", "in 2 hours", 120), ("2000-01-15", "Friday, 15 May", 6 * 1440), ("2000-01-15", "Saturday", 7 * 1440), ("2000-01-15", "may arrive 20", 126 * 1440), ("2000-12-31", "1 Jan", (-365 + 365) * 1440), ("2001-02-10", "29 feb", 999999), ("2000-02-10", "29 feb", 19 * 1440), ("2000-01-15", "soon", 999999), ("2000-01-15", "2-4 days", 2880)],
)
def test_minutes(spark, as_of, text, minutes):
    assert values(spark, [text], lambda t: X.delivery_minutes(t, F.lit(as_of).cast("date"))) == [minutes]


@pytest.mark.parametrize(("as_of", "text", "days"), [("2000-12-31", "1 - 3 Jan", 1), ("2001-02-10", "29 Feb", None), ("2000-01-15", "Today", 0), ("2000-01-15", "14 January", 0), ("2000-01-15", "13 Jan", 364), ("2000-01-15", None, None), ("2000-01-15", "5 Foo", None)])
def test_days(spark, as_of, text, days):
    assert values(spark, [text], lambda t: X.delivery_days(t, F.lit(as_of).cast("date"))) == [days]


def test_display(spark):
    assert values(spark, ["FREE delivery in 10 min", "Get it by Tomorrow on orders over 499"], lambda t: X.delivery_display(F.lit("C"), t, X.is_free_text(t))) == ["C – 10 Min (Free)", "C – Tomorrow"]


def test_catalog_lines(spark):
    body = ["# Webcams", "B09W9FND7M , Webcam 720p , WC-720, rest", "", "B0DSKNKCYX # note", "bad", "#", "B0DSKNKCYY"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(body)], "file string, line_no int, line string")
    found = [tuple(r)[2:] for r in lines.scan_catalog(df).orderBy("line_no").collect()]
    assert found == [("B09W9FND7M", "Webcam 720p", "WC-720", "Webcams"), ("B0DSKNKCYX", "", "", "Webcams"), ("B0DSKNKCYY", "", "", "")]
    assert [r["asin"] for r in lines.rejects(df).collect()] == ["bad"]


def test_location_lines_last_city_wins_at_first_place(spark):
    body = ["# x", "400001, Mumbai", "110001,Delhi, New", "400001,Bombay", "1234,No", "nocomma"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(body)], "file string, line_no int, line string")
    assert [tuple(r) for r in lines.scan_locations(df).orderBy("ord").collect()] == [(1, "400001", "Bombay"), (2, "110001", "Delhi, New")]


def test_json_defaults_and_nulls(spark):
    bodies = [('{"B1": {"110001": {"price": 5, "city": null}}}',), ("not json",), (None,)]
    rows = json_store.scan_offers_json(spark.createDataFrame(bodies, "body string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["asin"], r["pincode"], r["price"], r["city"], r["status"], r["discount_percent"]) == ("B1", "110001", 5.0, None, "FAILED", "N/A")


def test_versions_are_never_overwritten(spark, tmp_path):
    df, now = spark.range(3), dt.datetime(2024, 1, 2, 3, 4, 5)
    assert sink_versioned(df, str(tmp_path), now).endswith("run_id=02Jan2024_030405")
    with pytest.raises(Exception, match="(?i)exists"):
        sink_versioned(df, str(tmp_path), now)


def test_fallback_only_if_empty(spark):
    a, b = spark.createDataFrame([(1, "110001", "Delhi")], "ord long, pincode string, city string"), spark.createDataFrame([(1, "400001", "Mumbai")], "ord long, pincode string, city string")
    assert [r["city"] for r in grid.location_fallback(a, b).collect()] == ["Delhi"]
    assert [r["city"] for r in grid.location_fallback(a.where("false"), b).collect()] == ["Mumbai"]


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 30), st.integers(1, 9))
def test_chunks_are_balanced_and_ordered(spark, n, workers):
    rows = grid.balanced_chunks(spark.range(n).select(F.col("id").alias("ord")), workers).orderBy("ord").collect()
    chunks = [r["chunk"] for r in rows]
    sizes = [chunks.count(c) for c in sorted(set(chunks))]
    assert chunks == sorted(chunks)
    assert max(sizes) - min(sizes) <= 1
    assert len(sizes) == min(n, workers)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xy"), st.integers(0, 5)), min_size=1, max_size=12))
def test_upsert_is_idempotent(spark, rows):
    df = spark.createDataFrame([(a, p, n, i) for i, (a, p, n) in enumerate(rows)], "asin string, pincode string, n int, i int")
    once = offers.upsert_latest(df, order=("n", "i"))
    assert sorted(once.collect()) == sorted(offers.upsert_latest(once, order=("n", "i")).collect())


def test_report_marks_pending(spark):
    catalog = spark.createDataFrame([(1, "B1", "one", "c", "k"), (2, "B2", "", "c", "k"), (3, "B3", "no offer", "c", "k")], "ord long, asin string, item_name string, item_code string, category string")
    places = spark.createDataFrame([(1, "110001", "Delhi"), (2, "400001", "Mumbai")], "ord long, pincode string, city string")
    cols = "asin string, pincode string, loc_ord long, product_name string, mrp double, price double, discount_percent string, in_stock string, delivery_date string, seller string, rating string, reviews string, bsr string, scraped_at string, status string"
    rows = [("B1", "110001", 1, "p", 2.0, 1.0, "50", "In Stock", "X", "s", "4", "5", "#1", "t", "OK"), ("B2", "400001", 2, "q", None, None, "N/A", "", "", "", "", "", "", "t2", "FAILED")]
    out = {r["asin"]: r for r in report.pivot_report(catalog, places, spark.createDataFrame(rows, cols)).collect()}
    assert set(out) == {"B1", "B2"}
    assert (out["B1"]["110001 - Delhi"], out["B1"]["400001 - Mumbai"]) == ("In Stock | X", "Pending")
    assert (out["B2"]["400001 - Mumbai"], out["B2"]["item_name"], out["B2"]["seller"]) == ("Scrape Failed", "q", "Not Found")


def test_days_parse_no_text_as_a_date():
    """What is no date costs no exception a row: the expression builds dates from numbers alone."""
    plan = X.delivery_days(F.col("t"), F.lit("2000-01-15").cast("date"))._jc.toString()
    assert "make_date" in plan and "to_date" not in plan and "to_timestamp" not in plan and "format_string" not in plan


def test_days_of_every_month_end(spark):
    ends = {"jan": 31, "feb": 29, "mar": 31, "apr": 30, "may": 31, "jun": 30, "jul": 31, "aug": 31, "sep": 30, "oct": 31, "nov": 30, "dec": 31}
    at = dt.date(2000, 1, 1)
    texts = [f"{d} {m}" for m, n in ends.items() for d in (0, 1, n, n + 1)]
    want = [(dt.date(2000, i + 1, d) - at).days if 1 <= d <= n else None for i, n in enumerate(ends.values()) for d in (0, 1, n, n + 1)]
    assert values(spark, texts, lambda t: X.delivery_days(t, F.lit("2000-01-01").cast("date"))) == want
    assert values(spark, ["29 Feb", "28 Feb"], lambda t: X.delivery_days(t, F.lit("2000-03-10").cast("date"))) == [None, 355]
