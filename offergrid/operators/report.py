"""Reports: the pivoted availability table, failures, summaries and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.functions.text import delivery_band, pivot_cell

FIXED = ("category", "item_name", "item_code", "asin", "price", "mrp", "discount_percent", "bsr", "rating", "reviews", "seller", "scraped_at")


def first_ok(offers: DataFrame, order: str = "loc_ord") -> DataFrame:
    """One row for each product: prices, rank, rating and seller of its first OK offer by ``order``, else sentinels.

    Name and stamp come from the first OK offer or else the first offer of any status.
    """
    return offers.groupBy("asin").agg(*_first_aggs(order)).select("asin", *_first_columns())


def _first_aggs(order: str, of: Column | None = None) -> list[Column]:
    """With ``of``, of those offers alone."""
    of = F.lit(True) if of is None else of
    ok = (F.col("status") == "OK") & of
    money = F.struct("price", "mrp", "discount_percent", "bsr", "rating", "reviews", "seller")
    named = F.struct("product_name", "scraped_at")
    return [
        F.min_by(F.when(ok, money), F.when(ok, F.col(order))).alias("m"),
        F.min_by(F.when(ok, named), F.when(ok, F.col(order))).alias("n"),
        F.min_by(named, F.when(of, F.col(order))).alias("any"),
        F.count_if(ok).alias("n_ok"),
    ]


def _first_columns() -> list[Column]:
    has = F.col("n_ok") > 0
    text = lambda c, missing: F.when(has, F.col(f"m.{c}")).otherwise(missing).alias(c)
    pick = lambda c: F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"any.{c}")).alias(c)
    return [pick("product_name"), pick("scraped_at"), F.col("m.price").alias("price"), F.col("m.mrp").alias("mrp"), text("discount_percent", "N/A"), text("bsr", "N/A"), text("rating", "Not Found"), text("reviews", "Not Found"), text("seller", "Not Found")]


def catalog_with_results(catalog: DataFrame, offers: DataFrame) -> DataFrame:
    """Catalog rows that have an offer; repeated catalog rows stay repeated."""
    return catalog.join(offers.select("asin"), "asin", "left_semi")


def catalog_without_results(catalog: DataFrame, offers: DataFrame) -> DataFrame:
    return catalog.join(offers.select("asin"), "asin", "left_anti")


def overlay_catalog(catalog: DataFrame, firsts: DataFrame) -> DataFrame:
    """Report rows: the catalog's name where it has one, else the captured name, else a sentinel."""
    captured = firsts.withColumnRenamed("product_name", "captured_name")
    name = F.coalesce(F.nullif("item_name", F.lit("")), F.nullif("captured_name", F.lit("")), F.lit("Not Found"))
    return catalog.join(captured, "asin").withColumn("item_name", name).drop("captured_name")


def cells(offers: DataFrame) -> DataFrame:
    return offers.select("asin", "pincode", pivot_cell(F.col("status"), F.col("in_stock"), F.col("delivery_date")).alias("cell"))


def grid_status(grid: DataFrame, offers: DataFrame, pending: str = "Pending") -> DataFrame:
    """Each pair of the grid with its cell, or ``pending``."""
    return grid.select("asin", "pincode").join(cells(offers), ["asin", "pincode"], "left").withColumn("cell", F.coalesce("cell", F.lit(pending)))


def product_rows(offers: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """(asin, the fixed columns of first_ok, cells): one row for each product, ``cells`` a map of location to cell.

    Offers are keyed by product and location; of repeated ones the first cell in order counts. ``more`` are further
    aggregates of all offers of a product, those without a location too: a product of such offers alone has no cell.
    """
    placed = F.col("pincode").isNotNull()
    cell = F.struct("pincode", pivot_cell(F.col("status"), F.col("in_stock"), F.col("delivery_date")).alias("cell"))
    one = (offers if more else offers.where(placed)).groupBy("asin").agg(*_first_aggs("loc_ord", placed), F.sort_array(F.collect_list(F.when(placed, cell))).alias("cells"), *[m.alias(f"more{i}") for i, m in enumerate(more)])
    apart = F.filter("cells", lambda c, i: (i == 0) | (c["pincode"] != F.get("cells", i - 1)["pincode"]))
    return one.select("asin", *_first_columns(), F.map_from_entries(apart).alias("cells"), *[f"more{i}" for i in range(len(more))])


def pivot_report(catalog: DataFrame, locations: DataFrame, offers: DataFrame, pending: str = "Pending") -> DataFrame:
    """One row for each catalog row with an offer: the fixed columns and one for each location, ``pending`` if empty.

    Offers are read once: one aggregation by product gives the fixed columns and the cells.
    """
    return pivot_of_products(catalog, locations, product_rows(offers), pending)


def pivot_of_products(catalog: DataFrame, locations: DataFrame, products: DataFrame, pending: str = "Pending") -> DataFrame:
    """The report of ``product_rows``. The list of locations makes the columns, so it is read first and its length is checked."""
    listed = locations.orderBy("ord").select("pincode", "city").limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("more than 10000 locations: a report can't have so many columns")
    names = {r["pincode"]: f"{r['pincode']} - {r['city']}" for r in listed}
    rows = overlay_catalog(catalog, products)
    return rows.select("ord", *FIXED, *[F.coalesce(F.col("cells")[p], F.lit(pending)).alias(n) for p, n in names.items()])


def failed_rows(offers: DataFrame) -> DataFrame:
    """Offers that are not OK, with a reason."""
    return offers.where("status <> 'OK'").select("asin", "pincode", "city", F.coalesce(F.nullif("failure_reason", F.lit("")), F.lit("Failed")).alias("failure_reason"), "scraped_at")


def summary(offers: DataFrame, ok_only: bool) -> DataFrame:
    """One row of totals, over OK offers alone or over all. Sums are of decimals, so they don't depend on order."""
    return offers.agg(*summary_sums(ok_only)).select(*summary_columns())


SUMS = ("total", "success", "failed", "out_of_stock", "price_sum", "price_count", "rating_sum", "rating_count")


def summary_sums(ok_only: bool, weight: Column | None = None) -> list[Column]:
    """The totals as sums of ``weight`` (1): with -1 for rows that are taken back, a change of the totals."""
    weight = F.lit(1) if weight is None else weight
    ok = F.col("status") == "OK"
    counted = ok if ok_only else F.lit(True)
    rating = F.when(counted, F.col("rating").try_cast("decimal(18,4)"))
    price = F.when(counted, F.col("price").cast("decimal(18,4)"))
    n = lambda test: F.coalesce(F.sum(F.when(test, weight)), F.lit(0)).cast("long")
    stock = counted & F.lower(F.coalesce("in_stock", F.lit(""))).startswith("out of stock")
    sums = [n(F.lit(True)), n(ok), n(~ok), n(stock), F.sum(price * weight), n(price.isNotNull()), F.sum(rating * weight), n(rating.isNotNull())]
    return [s.alias(name) for name, s in zip(SUMS, sums, strict=True)]


def summary_columns() -> list[Column]:
    """The totals as shown: sums as doubles, null where nothing was summed."""
    whole = ["total", "success", "failed", "out_of_stock", "price_count", "rating_count"]
    return [F.col(c) for c in whole] + [F.when(F.col(f"{c}_count") > 0, F.col(f"{c}_sum").cast("double")).alias(f"{c}_sum") for c in ("price", "rating")]


def summary_metrics(totals: DataFrame, catalog: DataFrame, finished: Column, taken: Column) -> DataFrame:
    """The summary as metric and value rows."""
    rows = totals.crossJoin(F.broadcast(catalog.agg(F.count(F.lit(1)).alias("items"))))
    shown = lambda total, n: F.when(F.col(n) > 0, F.format_string("%.2f", F.col(total) / F.col(n))).otherwise("N/A")
    rate = F.format_string("%.2f", F.when(F.col("total") > 0, F.col("success") / F.col("total") * 100).otherwise(0.0))
    text = rows.select(
        F.col("items").cast("string").alias("a"), F.col("total").cast("string").alias("b"), rate.alias("c"), F.col("out_of_stock").cast("string").alias("d"),
        shown("price_sum", "price_count").alias("e"), shown("rating_sum", "rating_count").alias("f"), finished.alias("g"), taken.alias("h"),
    )
    return text.selectExpr("stack(8, 'Total ASINs scraped', a, 'Total combinations attempted', b, 'Success rate %', c, 'Out of stock count', d, 'Average price', e, 'Average rating', f, 'Scrape date and time', g, 'Time taken', h) as (metric, value)")


def status_counts(rows: DataFrame) -> DataFrame:
    """OK and failed counters; any other status counts toward done alone."""
    return rows.agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("status") == "OK").alias("success"), F.count_if(F.col("status").isin("FAILED", "PINCODE_FAILED")).alias("failed"))


def stock_band_counts(offers: DataFrame, as_of: Column) -> DataFrame:
    band = delivery_band(F.col("status"), F.col("in_stock"), F.col("delivery_date"), as_of)
    return offers.select(F.coalesce(band, F.lit("none")).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Display width of each column: the longest text plus two, at most 60, at least 10, header included."""
    wide = df.agg(*[F.greatest(F.lit(10), F.lit(min(60, len(c) + 2)), F.coalesce(F.max(F.least(F.lit(60), F.char_length(F.col(c).cast("string")) + 2)), F.lit(0))).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "width")


def nest_by_asin(offers: DataFrame, fields: list[str]) -> DataFrame:
    """asin and a map of location to record."""
    return offers.groupBy("asin").agg(F.map_from_entries(F.collect_list(F.struct("pincode", F.struct(*fields)))).alias("by_pincode"))
