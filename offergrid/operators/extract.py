"""Product fields of captured pages, and whole offers. Each page is parsed once; all its fields come from that one row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import zip_longest
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offergrid.functions.text import delivery_display, delivery_minutes, discount_pct, free_flag, is_free_text, normalise_stock, parse_money, product_url, squash_ws, stamp, whole_plus_fraction
from offergrid.operators.dom import Channel, first_text, parts_of, read_texts
from offergrid.operators.offers import classify_page, is_challenge, outcome_of_page
from offergrid.schemas import DEFAULT_SELLER, FAST_CHANNEL, STANDARD_CHANNEL

#: The selectors of the page format, by field, in the order in which they are tried.
SELECTORS = {
    "name": ["#productTitle", ".product-title", "h1.a-size-large"],
    "seller": ["#merchant-info a", "#sellerProfileTriggerId", ".offer-display-feature-text"],
    "rating": ["#acrPopover span.a-icon-alt", "[data-hook='rating-out-of-text']"],
    "reviews": ["#acrCustomerReviewText", "[data-hook='total-review-count']"],
    "stock": ["#availability span", "#outOfStock", ".availRed", ".availGreen"],
    "price": [
        "#corePriceDisplay_desktop_feature_div .apexPriceToPay span.a-offscreen",
        "#corePriceDisplay_desktop_feature_div .priceToPay span.a-offscreen",
        "#corePrice_feature_div .apexPriceToPay span.a-offscreen",
        "#corePrice_feature_div .priceToPay span.a-offscreen",
        ".apexPriceToPay span.a-offscreen",
        ".priceToPay span.a-offscreen",
    ],
    "whole": ["#corePriceDisplay_desktop_feature_div .a-price-whole", "#corePrice_feature_div .a-price-whole", ".apexPriceToPay .a-price-whole", ".priceToPay .a-price-whole", ".a-price-whole"],
    "fraction": ["#corePriceDisplay_desktop_feature_div .a-price-fraction", "#corePrice_feature_div .a-price-fraction", ".apexPriceToPay .a-price-fraction", ".priceToPay .a-price-fraction", ".a-price-fraction"],
    "old_price": ["#priceblock_dealprice", "#priceblock_ourprice", "#price_inside_buybox", "#tp_price_block_total_price_ww span.a-offscreen"],
    "mrp": [
        "#corePriceDisplay_desktop_feature_div .basisPrice span.a-offscreen",
        "#corePrice_feature_div .basisPrice span.a-offscreen",
        "#corePriceDisplay_desktop_feature_div .a-price.a-text-price span.a-offscreen",
        "#corePrice_feature_div .a-price.a-text-price span.a-offscreen",
    ],
    "old_mrp": [".basisPrice span.a-offscreen", ".a-price.a-text-price span.a-offscreen", "span.a-text-price > span.a-offscreen", "#priceblock_ourprice"],
    "rank": ["#SalesRank", "#productDetails_detailBullets_sections1", "#detailBulletsWrapper_feature_div", "#productDetails_db_sections", ".a-section.a-spacing-small.a-padding-small"],
    "fast": ["#alm-delivery-message span.a-size-base", "#alm-delivery-message span", "#almLogoAndDeliveryMessage_feature_div .a-size-base"],
    "standard": [
        "#mir-layout-DELIVERY_BLOCK-slot-PRIMARY_DELIVERY_MESSAGE_LARGE span[data-csa-c-slot-id]",
        "#mir-layout-DELIVERY_BLOCK-slot-PRIMARY_DELIVERY_MESSAGE_LARGE span",
        "#deliveryMessageMirWidget span",
        "#ddmDeliveryMessage",
        ".delivery-message span",
        "[data-feature-name='delivery-message'] span",
    ],
    "title": ["title"],
    "can_add": ["#add-to-cart-button"],
}
PROMISE, PROMISE_ATTR = "span[data-csa-c-delivery-time]", "data-csa-c-delivery-time"
#: The words by which a delivery text is known, by channel.
KEYWORDS = {
    "fast": ("minutes", "hours", "now", "instant"),
    "standard": ("tomorrow", "today", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "day", "days"),
}
NAMES = {"fast": FAST_CHANNEL, "standard": STANDARD_CHANNEL}
FIELDS = tuple(f for f in SELECTORS if f not in NAMES)


@dataclass(frozen=True)
class Rules:
    """What is read from a page: selectors by field, delivery channels, and attributes that hold a promise.

    ``promises`` are (channel, selector, attribute). Fields without selectors find nothing.
    """

    fields: tuple[tuple[str, tuple[str, ...]], ...]
    channels: tuple[Channel, ...]
    promises: tuple[tuple[str, str, str], ...] = ()

    def selectors(self) -> tuple[str, ...]:
        return tuple(s for _, own in self.fields for s in own)

    def only(self, *fields: str) -> Rules:
        """The rules of some fields, without channels and promises."""
        return Rules(tuple((f, own) for f, own in self.fields if f in fields), ())

    def delivery(self) -> Rules:
        """The rules of channels and promises alone."""
        return Rules((), self.channels, self.promises)

    def names(self) -> list[str]:
        return list(dict.fromkeys([*[c for c, *_ in self.promises], *[c.name for c in self.channels]]))


RULES = Rules(tuple((f, tuple(SELECTORS[f])) for f in FIELDS), tuple(Channel(n, tuple(SELECTORS[c]), KEYWORDS[c]) for c, n in NAMES.items()), ((STANDARD_CHANNEL, PROMISE, PROMISE_ATTR),))
#: Rules as rows: kind is field, channel (a selector of it), word or promise; name the field or channel; seq their order.
RULE_ROW = "kind string, name string, seq int, value string, attribute string"
MOST_RULES = 10_000


def rules_table(spark: SparkSession, rules: Rules = RULES) -> DataFrame:
    rows = [("field", f, s, None) for f, own in rules.fields for s in own]
    rows += [("channel", c.name, s, None) for c in rules.channels for s in c.selectors] + [("word", c.name, w, None) for c in rules.channels for w in c.words]
    rows += [("promise", *p) for p in rules.promises]
    return spark.createDataFrame([(kind, name, i, value, attribute) for i, (kind, name, value, attribute) in enumerate(rows)], RULE_ROW)


def rules_of(table: DataFrame) -> Rules:
    """The rules of a table, checked: known kinds and fields, selectors that are understood, words in lower case.

    They go to every task, so there may be at most MOST_RULES; of fields and channels the first seq gives the order.
    """
    rows = table.orderBy("seq", "kind", "name", "value").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by: dict[str, dict[str, list]] = {"field": {}, "channel": {}, "word": {}, "promise": {}}
    for r in rows:
        if r["kind"] not in by or not r["value"] or not r["name"]:
            raise ValueError(f"not a rule: {r}")
        if r["kind"] == "word":
            if r["value"] != r["value"].lower():
                raise ValueError(f"a word in lower case is needed: {r}")
        else:
            parts_of(r["value"])
        if r["kind"] == "field" and r["name"] not in FIELDS:
            raise ValueError(f"no such field: {r}")
        if r["kind"] == "promise" and not r["attribute"]:
            raise ValueError(f"a promise needs an attribute: {r}")
        by[r["kind"]].setdefault(r["name"], []).append((r["value"], r["attribute"]) if r["kind"] == "promise" else r["value"])
    if lost := set(by["word"]) - set(by["channel"]):
        raise ValueError(f"words of channels without selectors: {sorted(lost)}")
    channels = tuple(Channel(n, tuple(own), tuple(by["word"].get(n, ()))) for n, own in by["channel"].items())
    return Rules(tuple((f, tuple(own)) for f, own in by["field"].items()), channels, tuple((n, s, a) for n, own in by["promise"].items() for s, a in own))


def found(pages: DataFrame, rules: Rules = RULES, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Pages with, for each field, the first text of each of its selectors (as an array, and each for itself by its number) and the
    first of these that has any; what channels tell; what attributes promise.

    ``carry`` are the columns of pages that are kept, by default all.
    """
    read = read_texts(pages, rules.selectors(), tuple((s, a) for _, s, a in rules.promises), rules.channels, carry)
    texts, at, own = [], 0, dict(rules.fields)
    for field in own:
        each = [F.get("found", F.lit(at + i)) for i in range(len(own[field]))]
        texts += [F.slice("found", at + 1, len(each)).alias(f"{field}_texts"), *[t.alias(f"{field}_{i}") for i, t in enumerate(each)], first_text(each).alias(f"{field}_text")]
        at += len(each)
    texts += [c for f in FIELDS if f not in own for c in (F.array().cast("array<string>").alias(f"{f}_texts"), F.lit(None).cast("string").alias(f"{f}_text"))]
    told = [F.struct(F.lit(c.name).alias("channel"), squash_ws(F.get("told", F.lit(i))).alias("text")) for i, c in enumerate(rules.channels)]
    promise = lambda c: lambda p: F.struct(F.lit(c).alias("channel"), F.trim(p).alias("text"))
    promised = [F.transform(F.get("every", F.lit(i)), promise(c)) for i, (c, _, _) in enumerate(rules.promises)]
    none = F.array().cast("array<struct<channel: string, text: string>>")
    return read.select(*(pages.columns if carry is None else carry), *texts, (F.array(*told) if told else none).alias("told"), (F.filter(F.concat(*promised), lambda p: p["text"].rlike(r"\p{L}")) if promised else none).alias("promised"))


def text_of(field: str) -> Column:
    return F.col(f"{field}_text")


def _texts(field: str, rules: Rules) -> list[Column]:
    """The texts of a field's selectors. As columns they are tried one by one, without an array made for each row."""
    return [F.col(f"{field}_{i}") for i in range(len(dict(rules.fields).get(field, ())))]


def _first(values: list[Column], kind: str) -> Column:
    return F.coalesce(*values, F.lit(None).cast(kind))


def _paid(money: list[Column]) -> Column:
    """The first amount that is above zero."""
    return _first([F.when(m > 0, m) for m in money], "double")


def price_of(rules: Rules = RULES) -> Column:
    """Three tiers; a price of zero counts only in the last."""
    given = lambda t: F.when(F.trim(t) != "", F.trim(t))
    none = F.lit(None).cast("string")
    parts = [whole_plus_fraction(given(w), given(f)) for w, f in zip_longest(_texts("whole", rules), _texts("fraction", rules), fillvalue=none)]
    return F.coalesce(_paid([parse_money(t) for t in _texts("price", rules)]), _paid(parts), parse_money(text_of("old_price")))


def mrp_of(rules: Rules = RULES) -> Column:
    """Two tiers; the last selector of the second is one of a selling price, as the pages' readers have it."""
    return F.coalesce(_paid([parse_money(t) for t in _texts("mrp", rules)]), parse_money(text_of("old_mrp")))


def rank_of(rules: Rules = RULES) -> Column:
    """Rank and category of the first block that has a rank, else from the page's source, else N/A."""
    pattern = r"#\s*([\d,]+)\s+in\s+([^\n(]{3,60})"
    tidy = lambda c: F.regexp_replace(squash_ws(c), r"\.+$", "")
    both = lambda c, p: F.when(F.regexp_extract(c, p, 1) != "", F.concat(F.lit("#"), F.replace(F.regexp_extract(c, p, 1), F.lit(","), F.lit("")), F.lit(" in "), tidy(F.regexp_extract(c, p, 2))))
    alone = lambda c: F.nullif(F.regexp_extract(c, r"#\s*([\d,]+)", 1), F.lit(""))
    block = lambda c: F.when(F.lower(c).rlike("best seller|best-seller|#"), F.coalesce(both(c, pattern), F.concat(F.lit("#"), F.replace(alone(c), F.lit(","), F.lit("")))))
    ranked = _first([block(t) for t in _texts("rank", rules)], "string")
    return F.coalesce(ranked, both(F.col("html"), r"#\s*([\d,]+)\s+in\s+([^<\n]{3,60}?)(?:<|\n|&)"), F.lit("N/A"))


#: What a promise in a page's source begins with.
SAID = ("tomorrow", "today", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def options_of() -> Column:
    """All promises of a page, in order: from attributes, from the channels' selectors, and from the source where these give none.

    ``low``, the page in small letters, tells first whether the source has any word that a pattern begins with.
    """
    item = lambda channel, text, free: F.struct(channel.alias("channel"), text.alias("raw_text"), free.alias("is_free"))
    some = lambda items: F.filter(F.array(*items), lambda o: o["raw_text"] != "")
    attrs = F.transform("promised", lambda p: item(p["channel"], p["text"], F.lower(p["text"]).contains("free")))
    told = F.transform(F.filter("told", lambda t: t["text"].isNotNull()), lambda t: item(t["channel"], t["text"], is_free_text(t["text"])))
    said = lambda words, pattern: F.when(reduce(or_, [F.col("low").contains(w) for w in words]), F.trim(F.regexp_extract("html", pattern, 1)))
    fast = said(["free delivery in "], r'(?i)(FREE delivery in \d+ minutes[^"<]{0,60})')
    slow = said(SAID, rf'(?i)((?:{"|".join(SAID)})[^"<\n]{{0,50}})')
    source = some([item(F.lit(FAST_CHANNEL), fast, F.lit(True)), item(F.lit(STANDARD_CHANNEL), slow, F.lower(slow).contains("free"))])
    return F.transform(F.array(F.concat(attrs, told)), lambda b: F.when(F.size(b) > 0, b).otherwise(source))[0]


def rule_match(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(page_id, channel, raw_text): for each channel the first selector whose first element holds one of its words."""
    told = Rules((), rules.channels)
    return found(pages.select("page_id", "html"), told, ("page_id",)).select("page_id", F.inline("told").alias("channel", "raw_text")).where("raw_text is not null")


def delivery_options(pages: DataFrame, as_of: Column, rules: Rules = RULES) -> DataFrame:
    """(page_id, seq, channel, raw_text, is_free, sort_minutes, display_text): all promises of each page, as found."""
    rows = found(pages.select("page_id", "html"), rules.delivery()).withColumn("low", F.lower("html")).select("page_id", F.posexplode(options_of()).alias("seq", "o")).select("page_id", "seq", "o.*")
    return rows.withColumn("sort_minutes", delivery_minutes(F.col("raw_text"), as_of)).withColumn("display_text", delivery_display(F.col("channel"), F.col("raw_text"), F.col("is_free")))


def with_earliest(rows: DataFrame, as_of: Column, rules: Rules = RULES) -> DataFrame:
    """``rows`` of ``found`` with ``best``, a page's earliest promise; only the first promise of a channel counts."""
    return _with_best(rows.withColumn("low", F.lower("html")).withColumn("options", options_of()), as_of, rules).drop("options", "low")


def _with_best(rows: DataFrame, as_of: Column, rules: Rules) -> DataFrame:
    """``with_earliest`` of rows with their ``options``."""
    out, bests = rows, []
    of = lambda name: lambda x: x["channel"] == name
    for i, name in enumerate(dict.fromkeys([*rules.names(), STANDARD_CHANNEL, FAST_CHANNEL])):
        at = F.array_position(F.transform("options", lambda x: x["channel"]), F.lit(name))
        out = out.withColumn(f"first_{i}", F.get(F.filter("options", of(name)), F.lit(0))).withColumn(f"at_{i}", at)
        o = F.col(f"first_{i}")
        item = F.struct(delivery_minutes(o["raw_text"], as_of).alias("sort_minutes"), F.col(f"at_{i}").alias("seq"), delivery_display(o["channel"], o["raw_text"], o["is_free"]).alias("display_text"), o["is_free"].alias("is_free"))
        bests.append(F.when(o.isNotNull(), item))
    return out.select(*rows.columns, F.array_min(F.array_compact(F.array(*bests))).alias("best"))


def rating_of(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")), F.lit("Not Found"))


def reviews_of(text: Column) -> Column:
    run = F.regexp_extract(text, r"([\d,]+)", 1)
    return F.when(F.coalesce(run, F.lit("")) == "", "Not Found").otherwise(F.replace(run, F.lit(","), F.lit("")))


def build_offer(pages: DataFrame, as_of: Column, rules: Rules = RULES) -> DataFrame:
    """One offer for each page (page_id, url, html, asin, pincode, city, captured_at); no join and no shuffle."""
    rows = found(pages, rules).withColumn("low", F.lower("html"))  # once, for all that looks for words in it
    state = F.when(is_challenge(F.col("url"), F.coalesce(text_of("title"), F.lit("")), F.col("html"), F.col("low")), "CAPTCHA").otherwise(classify_page(F.col("url"), F.col("html"), F.col("asin"), low=F.col("low")))
    # What needs the page comes first, so that the rows after it are without it.
    texts = [text_of(f) for f in ("name", "stock", "seller", "rating", "reviews")]
    can_add = _first(_texts("can_add", rules)[:1], "string").isNotNull()
    wide = rows.select("page_id", "asin", "pincode", "city", "captured_at", *texts, options_of().alias("options"), state.alias("state"), price_of(rules).alias("price"), mrp_of(rules).alias("mrp"), rank_of(rules).alias("bsr"), can_add.alias("can_add"))
    status, reason = outcome_of_page(F.col("state"))
    wide = _with_best(wide, as_of, rules).withColumn("status", status).withColumn("failure_reason", reason)
    good, can_add = F.col("status") == "OK", F.col("can_add")
    lost = lambda value, captcha, missing: F.when(good, value).when(F.col("state") == "CAPTCHA", captcha).otherwise(missing)
    return wide.select(
        "page_id", "asin", "pincode", "city",
        lost(F.coalesce(squash_ws(text_of("name")), F.lit("Not Found")), "", "Not Found").alias("product_name"),
        F.when(good, F.col("mrp")).alias("mrp"), F.when(good, F.col("price")).alias("price"),
        lost(discount_pct(F.col("mrp"), F.col("price")), "", "N/A").alias("discount_percent"),
        lost(normalise_stock(text_of("stock"), can_add), "", "Not Found").alias("in_stock"),
        lost(F.coalesce("best.display_text", F.lit("Not Available")), "", "Not Available").alias("delivery_date"),
        lost(free_flag(F.coalesce("best.is_free", F.lit(False))), "", "N/A").alias("free_delivery"),
        lost(F.coalesce(squash_ws(text_of("seller")), F.lit(DEFAULT_SELLER)), "", "").alias("seller"),
        lost(rating_of(text_of("rating")), "", "").alias("rating"), lost(reviews_of(text_of("reviews")), "", "").alias("reviews"),
        lost(F.col("bsr"), "", "N/A").alias("bsr"), product_url(F.col("asin")).alias("product_url"), stamp(F.col("captured_at")).alias("scraped_at"), "status", "failure_reason",
    )
