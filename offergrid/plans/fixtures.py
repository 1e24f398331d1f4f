"""Views that give the operators something to run on, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offergrid.functions import text as X
from offergrid.schemas import STANDARD_CHANNEL
from offergrid.shared import listed


def as_of() -> Column:
    """The fixed clock of the views."""
    return F.lit("2000-01-15").cast("date")


ATTEMPTS_A_FILE = 1 << 17
CATALOG = "SELECT p_partkey AS ord, 'B' || lpad(CAST(p_partkey AS VARCHAR(20)), 9, '0') AS asin, p_name AS item_name, p_brand AS item_code, p_type AS category FROM {part}"
LOCATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS ord, CAST(110001 + n_nationkey AS VARCHAR(20)) AS pincode, n_name AS city FROM {nation}"
ATTEMPTS = """SELECT 'B' || lpad(CAST(l_partkey AS VARCHAR(20)), 9, '0') AS asin,
  CAST(110001 + s_nationkey AS VARCHAR(20)) AS pincode, s_name AS seller, l_shipdate AS captured_at, l_orderkey, l_suppkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'FAILED' WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'PINCODE_FAILED' ELSE 'OK' END AS status,
  l_extendedprice AS mrp, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS price,
  CASE WHEN l_quantity <= 5 THEN 'Only ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || ' left' WHEN l_quantity <= 10 THEN 'Out of Stock' WHEN l_quantity <= 12 THEN 'Not Found' ELSE 'In stock.' END AS availability_text,
  CASE l_linenumber WHEN 1 THEN 'FREE delivery in ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) || ' minutes' WHEN 2 THEN 'Get it by Tomorrow' WHEN 3 THEN 'in 3 days' WHEN 4 THEN '2-4 days' WHEN 5 THEN 'Friday' WHEN 6 THEN '15 - 18 May' ELSE 'Ships soon' END AS delivery_text
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey"""
CAPTURE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asin, pincode ORDER BY captured_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM {attempts}) t WHERE rn = 1"""


class Tables:
    """The driver's tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def catalog(self) -> DataFrame:
        return self.spark.sql(CATALOG, part=self.read("part"))

    @cached_property
    def locations(self) -> DataFrame:
        return self.spark.sql(LOCATIONS, nation=self.read("nation"))

    @cached_property
    def attempts(self) -> DataFrame:
        return self.spark.sql(ATTEMPTS, lineitem=self.read("lineitem"), supplier=self.read("supplier"))

    @cached_property
    def capture(self) -> DataFrame:
        from offergrid.operators.offers import upsert_latest

        return upsert_latest(self.attempts, by=("asin",))

    @cached_property
    def offers(self) -> DataFrame:
        """The capture as offers."""
        return self.as_offers(self.capture).drop("captured_at", "l_orderkey", "l_linenumber", "l_suppkey")

    def as_offers(self, rows: DataFrame) -> DataFrame:
        """Attempts as offers, with names of the catalog, cities of the locations and their place in the order of writes."""
        from offergrid.operators.grid import small

        c = rows.join(self.catalog.select("asin", F.col("item_name").alias("product_name")), "asin")
        c = c.join(small(self.locations.select("pincode", "city", F.col("ord").alias("loc_ord"))), "pincode")
        free = X.is_free_text(F.col("delivery_text"))
        return c.select(
            "asin", "pincode", "city", "loc_ord", "product_name", "mrp", "price", X.discount_pct(F.col("mrp"), F.col("price")).alias("discount_percent"),
            X.normalise_stock(F.col("availability_text")).alias("in_stock"), X.delivery_display(F.lit(STANDARD_CHANNEL), F.col("delivery_text"), free).alias("delivery_date"), X.free_flag(free).alias("free_delivery"),
            "seller", F.when(F.col("l_linenumber") == 7, "Not Found").otherwise(F.col("l_linenumber").cast("string")).alias("rating"), F.lit("Not Found").alias("reviews"), F.lit("N/A").alias("bsr"),
            X.product_url(F.col("asin")).alias("product_url"), X.stamp(F.col("captured_at")).alias("scraped_at"), "status", F.when(F.col("status") == "PINCODE_FAILED", "Pincode Failed").otherwise("").alias("failure_reason"),
            "captured_at", "l_orderkey", "l_linenumber", "l_suppkey",
        )

    def attempt_stream(self, root: str, files: int = 4) -> DataFrame:
        """The attempts as a stream of ``files`` batches: written as files under ``root`` by the tasks that make them, unshuffled.

        A file is written and read by one task, so it has at most ``ATTEMPTS_A_FILE`` rows; there are some files a batch at
        least, so that their number comes out even.
        """
        rows = min(ATTEMPTS_A_FILE, max(1, -(-self.read("lineitem").count() // (4 * files))))
        self.attempts.write.option("maxRecordsPerFile", rows).parquet(root)
        each = -(-sum(name.endswith(".parquet") for name in listed(self.spark, root)) // files)
        return self.spark.readStream.schema(self.attempts.schema).option("maxFilesPerTrigger", max(1, each)).parquet(root)

    @cached_property
    def product_pages(self) -> DataFrame:
        """Product pages made of the capture by a template that varies by row, so that each selector finds something."""
        from offergrid.operators.grid import small
        from offergrid.operators.offers import upsert_latest

        # Rows are dealt by product once, to as many tasks as are set: the work begins after it, and rows look too few to Spark.
        dealt = self.attempts.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "asin")
        c = upsert_latest(dealt).join(small(self.locations.select("pincode", "city")), "pincode").join(self.catalog.select("asin", "item_name"), "asin")
        money = c.withColumn("p", F.format_number("price", 4)).withColumn("m", F.format_number("mrp", 4)).withColumn("w", F.format_number(F.floor("price"), 0)).withColumn("n", F.format_number("l_suppkey", 0)).withColumn("r", F.format_number("l_orderkey", 0)).withColumn("dot", F.when(F.col("l_linenumber") % 2 == 0, ".").otherwise(""))
        key = F.expr("cast(substr(asin, 2) as bigint)") * 1000 + F.col("pincode").cast("bigint") - 110001
        money = money.withColumn("page_id", key)
        part = lambda choice: F.coalesce(*[F.when(F.expr(choice) == i, filled(text)) for i, text in enumerate(PARTS[choice])])
        held = lambda i, x: F.coalesce(F.col(x).cast("string"), F.lit("null")) if i % 2 else F.lit(x)
        filled = lambda text: F.concat(*[held(i, x) for i, x in enumerate(re.split(r"\{(\w+)\}", text)) if x])
        frame = ["<html><head><title>", F.when(F.expr("l_orderkey % 97 = 0"), "Robot Check").otherwise(F.col("item_name")), "</title></head><body>", *[part(c) for c in PARTS], '<input id="asin" value="', F.col("asin"), '"><button>Add to Cart</button></body></html>']
        html = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in frame])
        return money.select("page_id", X.product_url(F.col("asin")).alias("url"), html.alias("html"), "asin", "pincode", "city", "captured_at")


#: The template: for each choice of a row, what its page holds. Some parts are there to be passed over.
PARTS = {
    "l_orderkey % 3": ['<span id="productTitle">  {item_name}\n</span>', '<div class="product-title">{item_name}</div>', '<h1>Shop</h1><h1 class="x a-size-large">{item_name}</h1>'],
    "l_orderkey % 6": [
        '<div id="corePrice_feature_div"><span class="a-price priceToPay"><span class="a-offscreen">₹{p}</span></span><span class="a-price a-text-price"><span class="a-offscreen">₹{m}</span></span></div>',
        '<span class="a-price-whole">7</span><div id="corePriceDisplay_desktop_feature_div"><span class="apexPriceToPay"><span class="a-offscreen">₹0</span></span><span class="priceToPay"><span class="a-offscreen">₹{p}</span></span><span class="basisPrice">MRP <span class="a-offscreen">₹{m}</span></span></div>',
        '<span class="a-price-whole">7</span><div id="corePrice_feature_div"><span class="a-price-whole">{w}<i>{dot}</i></span><span class="a-price-fraction">0{l_linenumber}</span></div><span class="a-price"><b class="a-text-price"><span class="a-offscreen">₹1</span></b></span><span class="a-text-price"><span class="a-offscreen">₹{m}</span></span>',
        '<span id="priceblock_ourprice">₹{p}</span>',
        '<div class="priceToPay"><div id="corePrice_feature_div"><span class="a-offscreen">₹{p}</span></div></div><div class="basis"><span class="a-offscreen">₹3</span></div><div class="a-text-price a-price"><i><span class="a-offscreen">₹{m}</span></i></div>',
        '<div id="corePrice_feature_div"></div>',
    ],
    "l_suppkey % 4": ['<div id="availability"><span> {availability_text} </span></div>', '<div id="availability"><span></span></div><p class="availGreen">{availability_text}', '<div id="outOfStock">{availability_text}</div>', '<button id="add-to-cart-button">Add</button>'],
    "(l_orderkey + l_suppkey) % 5": [
        '<div id="mir-layout-DELIVERY_BLOCK-slot-PRIMARY_DELIVERY_MESSAGE_LARGE"><span>x</span><span data-csa-c-slot-id="x">{delivery_text}</span></div>',
        '<span data-csa-c-delivery-time="12"></span><span data-csa-c-delivery-time=" {delivery_text} "></span><span data-csa-c-delivery-time="Today"></span>',
        '<div id="alm-delivery-message"><span class="a-size-base">in {l_linenumber} hours</span></div>',
        '<div id="almLogoAndDeliveryMessage_feature_div"><b class="a-size-base">instant: in  3 hours</b></div><span id="ddmDeliveryMessage">{delivery_text}</span>',
        '<div class="delivery-message"><p><span>{delivery_text}</span></div>',
    ],
    "l_suppkey % 3": ['<div id="merchant-info">Sold by <a href="#">{seller}</a></div>', '<a id="sellerProfileTriggerId">{seller}</a>', "<p>Sold here"],
    "l_orderkey % 2": ['<span data-hook="rating-out-of-text">{l_linenumber}.0 out of 7</span>', '<span id="acrPopover"><i><span class="a-icon-alt">{l_linenumber}.5 out of 7</span></i></span>'],
    "l_suppkey % 2": ['<span id="acrCustomerReviewText">{r} ratings</span>', '<span data-hook="total-review-count">{r} global ratings</span>'],
    "l_suppkey % 6": [
        '<div id="SalesRank">Best Sellers Rank: #{n} in Parts (See Top 100)</div>',
        '<table id="productDetails_detailBullets_sections1"><tr><td>Best Sellers Rank<td> #{n} in  Parts.\n</table>',
        '<ul id="detailBulletsWrapper_feature_div"><li>Best-seller<li>#{n}</ul>',
        '<div id="SalesRank">none yet</div><div id="productDetails_db_sections">Rank: # {n} in Parts</div>',
        '<div class="a-section a-padding-small">#1 in Decoys</div><div class="a-padding-small a-section a-spacing-small">#{n} in Parts</div>',
        '<i title="#{n} in Parts&"></i>',
    ],
}


def duck_page() -> dict[str, str]:
    """What the pages of the template hold, in SQL on the capture."""
    k, d = "l_orderkey % 6", "(l_orderkey + l_suppkey) % 5"
    told = "l_linenumber BETWEEN 2 AND 6"  # what the standard channel's words know
    price = f"CASE {k} WHEN 2 THEN floor(price) + CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE l_linenumber / 100 END WHEN 5 THEN NULL ELSE price END"
    mrp = f"CASE {k} WHEN 3 THEN price WHEN 5 THEN NULL ELSE mrp END"
    state = "CASE WHEN l_orderkey % 97 = 0 THEN 'CAPTCHA' WHEN contains(asin, '404') THEN 'NOT_FOUND' ELSE 'OK' END"
    shown = f"CASE WHEN {d} = 2 THEN 'in ' || l_linenumber || ' hours' WHEN {d} = 3 THEN 'instant: in 3 hours' WHEN {d} = 1 OR l_linenumber < 7 THEN delivery_text END"
    channel = f"CASE WHEN {d} IN (2, 3) OR ({d} <> 1 AND l_linenumber = 1) THEN 'Express' ELSE 'Standard' END"
    return {
        "price": price, "mrp": mrp, "state": state, "promise": shown, "channel": channel, "told": told, "d": d,
        "stock": f"CASE WHEN l_suppkey % 4 = 3 THEN 'In Stock' ELSE {duck_stock('availability_text')} END",
        "seller": "CASE WHEN l_suppkey % 3 = 2 THEN 'Marketplace' ELSE seller END",
        "rating": "l_linenumber || CASE WHEN l_orderkey % 2 = 0 THEN '.0' ELSE '.5' END",
        "bsr": "'#' || l_suppkey || CASE WHEN l_suppkey % 6 = 2 THEN '' ELSE ' in Parts' END",
    }


def duck(sql: str) -> str:
    """The same views as common table expressions before ``sql``."""
    plain = lambda s: s.replace("{", "").replace("}", "")
    offers = f"""SELECT c.asin, c.pincode, l.city, l.ord AS loc_ord, k.item_name AS product_name, c.mrp, c.price, {duck_discount('c.mrp', 'c.price')} AS discount_percent,
  {duck_stock('availability_text')} AS in_stock, {duck_display("'Standard'", 'delivery_text', duck_free('delivery_text'))} AS delivery_date, CASE WHEN {duck_free('delivery_text')} THEN 'Yes' ELSE 'No' END AS free_delivery,
  c.seller, CASE WHEN l_linenumber = 7 THEN 'Not Found' ELSE CAST(l_linenumber AS VARCHAR) END AS rating, 'Not Found' AS reviews, 'N/A' AS bsr,
  'https://www.example.com/dp/' || c.asin AS product_url, strftime(captured_at, '%d %b %Y, %I:%M %p') AS scraped_at, c.status, CASE WHEN c.status = 'PINCODE_FAILED' THEN 'Pincode Failed' ELSE '' END AS failure_reason
FROM capture c JOIN catalog k ON c.asin = k.asin JOIN locations l ON c.pincode = l.pincode"""
    return f"WITH catalog AS ({plain(CATALOG)}), locations AS ({plain(LOCATIONS)}), attempts AS ({plain(ATTEMPTS)}), capture AS ({plain(CAPTURE)}), offers AS ({offers})\n{sql}"


def duck_free(c: str) -> str:
    return f"(contains(lower({c}), 'free') OR contains(lower({c}), '₹0') OR contains(lower({c}), 'no charge'))"


def duck_discount(mrp: str, price: str) -> str:
    return f"CASE WHEN {mrp} IS NULL OR {price} IS NULL OR {mrp} <= 0 OR {price} = 0 THEN 'N/A' ELSE CAST(CAST(round_even(({mrp} - {price}) / {mrp} * 100, 0) AS BIGINT) AS VARCHAR) END"


def duck_stock(c: str) -> str:
    return f"CASE WHEN contains(lower({c}), 'in stock') THEN 'In Stock' WHEN contains(lower({c}), 'out of stock') THEN 'Out of Stock' WHEN regexp_matches(lower({c}), 'only\\s+(\\d+)\\s+left') THEN 'Low Stock (' || regexp_extract(lower({c}), 'only\\s+(\\d+)\\s+left', 1) || ' left)' ELSE 'Check on site' END"


def duck_title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: upper(x[1:1]) || x[2:]), '')"


def duck_display(channel: str, c: str, free: str) -> str:
    bare = f"trim(regexp_replace(trim({c}), '^(?i)(free\\s+delivery\\s+in\\s+|get\\s+it\\s+(by\\s+)?|delivery\\s+by\\s+)', ''))"
    bare = f"trim(regexp_replace({bare}, '(?i)\\s+on orders over.*$', ''))"
    return f"{channel} || ' – ' || {duck_title(bare)} || CASE WHEN {free} THEN ' (Free)' ELSE '' END"


def duck_minutes(c: str, as_of: str = "DATE '2000-01-15'") -> str:
    low = f"trim(lower({c}))"
    num = lambda p: f"TRY_CAST(nullif(regexp_extract({low}, '{p}', 1), '') AS INT)"
    ahead = " ".join(f"WHEN contains({low}, '{d}') THEN (({i} - (isodow({as_of}) - 1) + 6) % 7 + 1) * 1440" for i, d in enumerate(X.WEEKDAYS))
    months = ", ".join(f"CASE WHEN contains({low}, '{m}') THEN (CASE WHEN date_diff('day', {as_of}, d{i}) < 0 THEN date_diff('day', {as_of}, d{i}) + 365 ELSE date_diff('day', {as_of}, d{i}) END) * 1440 END".replace(f"d{i}", f"TRY_CAST(year({as_of}) || '-{i + 1:02d}-' || lpad({num('(\\d{1,2})')}::VARCHAR, 2, '0') AS DATE)") for i, m in enumerate(X.MONTHS))
    return f"CAST(coalesce({num('in\\s+(\\d+)\\s+minute')}, {num('in\\s+(\\d+)\\s+hour')} * 60, CASE WHEN contains({low}, 'today') THEN 1440 END, CASE WHEN contains({low}, 'tomorrow') THEN 2880 END, {num('in\\s+(\\d+)\\s+day')} * 1440, {num('(\\d+)-\\d+\\s+day')} * 1440, CASE {ahead} END, {months}, 999999) AS INT)"


def duck_days(c: str, as_of: str = "DATE '2000-01-15'") -> str:
    pattern = "(\\d{1,2})(?:\\s*[-–]\\s*\\d{1,2})?\\s+([A-Za-z]{3,})"
    month = f"list_position({list(X.MONTHS)!r}, lower(substr(regexp_extract({c}, '{pattern}', 2), 1, 3)))"
    day = lambda y: f"TRY_CAST({y} || '-' || lpad({month}::VARCHAR, 2, '0') || '-' || lpad(regexp_extract({c}, '{pattern}', 1), 2, '0') AS DATE)"
    this, following = day(f"year({as_of})"), day(f"(year({as_of}) + 1)")
    target = f"CASE WHEN {this} < {as_of} - INTERVAL 1 DAY THEN {following} ELSE {this} END"
    return f"CAST(CASE WHEN contains(lower({c}), 'today') THEN 0 WHEN contains(lower({c}), 'tomorrow') THEN 1 WHEN ({target}) IS NOT NULL THEN greatest(0, date_diff('day', {as_of}, {target})) END AS INT)"


def duck_band(status: str, stock: str, delivery: str) -> str:
    days = duck_days(delivery)
    return f"CASE WHEN {status} IN ('FAILED', 'PINCODE_FAILED') THEN 'grey' WHEN starts_with(lower({stock}), 'out of stock') THEN 'red' WHEN starts_with(lower({stock}), 'in stock') OR starts_with(lower({stock}), 'low stock') THEN CASE WHEN {days} <= 1 THEN 'green' WHEN {days} <= 3 THEN 'yellow' WHEN {days} IS NOT NULL THEN 'orange' END END"


def duck_cell(status: str = "status", stock: str = "in_stock", delivery: str = "delivery_date") -> str:
    return f"CASE WHEN {status} = 'PINCODE_FAILED' THEN 'Pincode Failed' WHEN {status} = 'FAILED' THEN 'Scrape Failed' ELSE coalesce(nullif({stock}, ''), 'Check on site') || CASE WHEN coalesce({delivery}, '') <> '' AND {delivery} NOT IN ('Not Found', 'Set pincode manually') THEN ' | ' || {delivery} ELSE '' END END"
