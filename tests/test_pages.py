"""Element tables, selectors and the fields read by them, on small pages."""

import random

import pytest
from pyspark.sql import functions as F

from offergrid.operators import dom, extract


def plain_date():
    return F.lit("2000-01-15").cast("date")



def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string")


def chosen(spark, selector, body):
    reader, text = dom._page(body, dom.Selectors([selector]))
    assert dom.read_texts(pages(spark, body), (selector,)).first()["found"] == [next((text[a : a + n] for a, n, _ in reader.hits.get(0, ())), None)]
    return [text[a : a + n] for a, n, _ in reader.hits.get(0, ())]


def test_elements(spark):
    rows = dom.dom_explode(pages(spark, "<ul id=u><li>a<li>b <b>c</b><p>d<p>e</ul><br><p>f &amp; g</i><div>h", None, "", "plain")).where("page_id = 0").orderBy("seq").collect()
    assert [(r["tag"], r["parent"], r["last"], r["text"]) for r in rows] == [
        ("ul", None, 5, "ab cde"), ("li", 0, 1, "a"), ("li", 0, 5, "b cde"), ("b", 2, 3, "c"), ("p", 2, 4, "d"), ("p", 2, 5, "e"), ("br", None, 6, ""), ("p", None, 7, "f & g"), ("div", None, 8, "h"),
    ]
    assert [r["path"] for r in rows] == [0, 1, 1, 2, 3, 3, 4, 5, 6]
    paths = dom.read_elements(pages(spark, "<ul><li><b><li><p>")).first()["paths"]
    assert [tuple(p) for p in paths] == [(None, "ul"), (0, "li"), (1, "b"), (1, "p")]
    assert rows[0]["attrs"] == {"id": "u"} and rows[0]["id"] == "u"


def test_open_tags_do_not_nest_without_end(spark):
    deepest = dom.dom_explode(pages(spark, "<p>x" * 2000)).agg(F.max(F.col("last") - F.col("seq")), F.count("parent"), F.count("*")).first()
    assert tuple(deepest) == (0, 0, 2000)


def test_deep_pages_in_proportion_to_their_length():
    import time
    import tracemalloc

    page = "<div class=a>" * 4000 + "x"
    tracemalloc.start()
    reader, _ = dom._page(page, dom.Selectors([".a .a .a b", "#x .a", ".a > .a"]), keep=True)
    dom._elements([reader.rows])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(reader.rows) == 4000 and reader.rows[0]["last"] == 3999 and peak < 20e6
    began = time.time()
    dom._page("<b>" * 40_000 + "</i>" * 40_000 + "<p>", dom.Selectors(["b b u", "b > b"]))
    assert time.time() - began < 10


@pytest.mark.parametrize(
    ("selector", "body", "found"),
    [
        (".a.b span", '<i class="a"><i class="b"><span>no</span></i></i><i class="x b a"><span>yes</span></i>', ["yes"]),
        ("#x .y b", '<p class="y"><i id="x"><b>no</b></i></p><div id="x"><i><i class="y"><u><b>yes</b></u></i></i></div>', ["yes"]),
        ("i.k > b", '<i class="k"><u><b>no</b></u><b>yes</b></i><u class="k"><b>no</b></u>', ["yes"]),
        ("[data-f='a-b'] span", '<p data-f="a"><span>no</span></p><p data-f="a-b"><span>yes</span></p>', ["yes"]),
        ("span[data-t]", '<span data-t>yes</span><span data-tt="">no</span><i data-t="1">no</i>', ["yes"]),
        (".x", '<i class="xx x-y">no</i><i class="z x">yes</i>', ["yes"]),
        (".x .x", '<i class="x">no<b class="x">yes</b></i>', ["yes"]),
        (".x .x .x", '<i class="x"><b class="x">no<u class="x">yes</u></b></i>', ["yes"]),
        ("#a .x > i b".replace("> i b", "b > i"), '<p id="a"><u class="x"><b><i>yes</i><u><i>no</i></u></b></u></p><b><i>no</i></b>', ["yes"]),
        ("i>b", '<i><b>one</b><u><b>no</b></u></i><i><b>two</b></i>', ["one", "two"]),
        ("[data-f='a > b'] span", '<p data-f="a > b"><span>yes</span></p>', ["yes"]),
        ("b, i".replace(", ", " "), "<b><b><i>yes</i></b></b><i>no</i>", ["yes"]),
    ],
)
def test_selectors(spark, selector, body, found):
    assert chosen(spark, selector, body) == found


def test_selectors_that_are_not_understood():
    for css in ("a:hover", "a > b c", "a + b", ""):
        with pytest.raises(ValueError, match="selector|last part"):
            dom.Selectors([css])


def test_first_element_counts_even_if_empty(spark):
    rows = dom.cascade_text(pages(spark, "<h1> </h1><h1>x</h1><h2> y </h2>", "<h1>z", "none", None), ["h1", "h2"]).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == ["y", "z", None, None]


def fields(spark, bodies, **columns):
    rows = extract.found(pages(spark, *bodies)).select("page_id", *[c.alias(n) for n, c in columns.items()]).orderBy("page_id").collect()
    return [tuple(r)[1:] for r in rows]


def test_price_tiers(spark):
    off = '<span class="a-offscreen">%s</span>'
    bodies = [
        f'<div class="priceToPay">{off % "₹9"}</div><div id="corePrice_feature_div"><b class="apexPriceToPay">{off % "₹1,234.50"}</b></div>',
        f'<div class="priceToPay">{off % "none"}</div><span class="a-price-whole">1,299.</span><span class="a-price-fraction">50</span>',
        '<div class="priceToPay"><i class="a-price-whole">2,000</i></div>',
        '<div class="apexPriceToPay"><i class="a-price-whole">7</i><i class="a-price-fraction">05</i></div>',
        '<i class="a-price-whole">0</i><b id="price_inside_buybox">₹0</b>',
        f'<p id="priceblock_dealprice"> </p><b id="tp_price_block_total_price_ww">{off % "₹77"}</b>',
        "",
    ]
    assert [r[0] for r in fields(spark, bodies, v=extract.price_of())] == [1234.5, 1299.0, 2000.0, 7.05, 0.0, 77.0, None]


def test_list_price_tiers(spark):
    off = '<span class="a-offscreen">%s</span>'
    bodies = [
        f'<div id="corePrice_feature_div"><i class="basisPrice">{off % "₹10"}</i><i class="a-price a-text-price">{off % "₹11"}</i></div>',
        f'<div id="corePriceDisplay_desktop_feature_div"><i class="a-price"><i class="a-text-price">{off % "₹1"}</i></i><i class="a-price a-text-price">{off % "₹12"}</i></div>',
        f'<span class="a-text-price"><i>{off % "₹2"}</i>{off % "₹13"}</span>',
        f'<i class="basisPrice">{off % "no money"}</i><b id="priceblock_ourprice">₹14</b>',
        '<b id="priceblock_ourprice">₹15</b>',
    ]
    assert [r[0] for r in fields(spark, bodies, v=extract.mrp_of())] == [10.0, 12.0, 13.0, None, 15.0]


def test_rank_blocks(spark):
    bodies = ['<p id="SalesRank">soon</p><p id="productDetails_db_sections">Best-Seller rank #1,234 in Toys &amp; Games (x)</p>', '<p id="detailBulletsWrapper_feature_div">Best Seller: # 12</p>', '<p class="a-section a-spacing-small a-padding-small"># 7 in  Home\tand.. </p>', "<p>#5 in Shoes</p>", "<p>five</p>"]
    assert [r[0] for r in fields(spark, bodies, v=extract.rank_of())] == ["#1234 in Toys & Games", "#12", "#7 in Home and", "#5 in Shoes", "N/A"]


def test_delivery_options(spark):
    bodies = [
        '<span data-csa-c-delivery-time="12"></span><span data-csa-c-delivery-time=" FREE Tomorrow "></span><div id="alm-delivery-message"><span>soon</span><span class="a-size-base">in 20\n minutes, ₹0</span></div>',
        "<p>FREE delivery in 15 minutes to you<p>or Friday, 21 January",
        '<div data-feature-name="delivery-message"><span>Monday</span></div><p>Free delivery in 5 minutes',
        "nothing",
    ]
    rows = extract.delivery_options(pages(spark, *bodies), plain_date()).orderBy("page_id", "seq").collect()
    assert [(r["page_id"], r["channel"], r["raw_text"], r["is_free"], r["sort_minutes"]) for r in rows] == [
        (0, "Standard", "FREE Tomorrow", True, 2880),
        (0, "Express", "in 20 minutes, ₹0", True, 20),
        (1, "Express", "FREE delivery in 15 minutes to you", True, 15),
        (1, "Standard", "Friday, 21 January", False, 6 * 1440),
        (2, "Standard", "Monday", False, 2 * 1440),
    ]
    best = extract.with_earliest(extract.found(pages(spark, *bodies)), plain_date()).select("page_id", F.col("best").alias("b")).orderBy("page_id").collect()
    assert [r["b"] and r["b"]["display_text"] for r in best] == ["Express – In 20 Minutes, ₹0 (Free)", "Express – 15 Minutes To You (Free)", "Standard – Monday", None]


def test_selectors_against_plain_walks():
    """Random pages: what the index finds is what a walk over all ancestors finds."""
    import random

    rng = random.Random(1)
    names = ["#a", ".x", ".y", "i", "b", "[k]", "i.x", "b.x.y"]

    def fits(part, e):
        return part.fits(e[0], e[1], e[1].get("class", "").split())

    for _ in range(150):
        css = [" ".join(rng.choice(names) for _ in range(rng.randint(1, 3))) for _ in range(6)] + [rng.choice(names) + " " + rng.choice(names) + " > " + rng.choice(names), rng.choice(names) + " > " + rng.choice(names)]
        page, stack, want = [], [], {i: [] for i in range(len(css))}
        for n in range(40):
            if stack and rng.random() < 0.4:
                page.append(f"</{stack.pop()[0]}>")
                continue
            attrs = {k: v for k, v in (("id", "a"), ("class", rng.choice(["x", "y", "y x", "z"])), ("k", "1")) if rng.random() < 0.4}
            e = (rng.choice("ib"), attrs, n)
            page.append(f"<{e[0]}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">")
            for i, s in enumerate(css):
                parts, child = dom.parts_of(s)
                above, need = stack[:], parts[:-1]
                ok = fits(parts[-1], e)
                if child:
                    ok, above, need = ok and bool(stack) and fits(need[-1], stack[-1]), stack[:-1], need[:-1]
                for part in reversed(need):
                    while above and not fits(part, above[-1]):
                        above.pop()
                    ok = ok and bool(above)
                    above = above[:-1]
                if ok:
                    want[i].append(attrs)
            stack.append(e)
        reader, _ = dom._page("".join(page), dom.Selectors(css))
        assert {i: [h[2] for h in reader.hits.get(i, [])] for i in want} == want, css


def test_rules_as_a_table(spark):
    table = extract.rules_table(spark)
    assert extract.rules_of(table) == extract.RULES
    own = spark.createDataFrame(
        [("channel", "Drone", 0, ".air p", None), ("channel", "Drone", 1, "#sky", None), ("word", "Drone", 2, "wings", None), ("channel", "Boat", 3, "p", None), ("word", "Boat", 4, "sea", None), ("word", "Boat", 5, "wings", None), ("promise", "Post", 6, "i[data-when]", "data-when"), ("field", "name", 7, "h2", None)], extract.RULE_ROW,
    )
    rules = extract.rules_of(own)
    df = pages(spark, '<h2>N</h2><p>by Sea</p><div class="air"><p>no</p><p>wings</p></div><b id="sky">on WINGS</b><i data-when=" in 2 days "></i>', "<p>nothing", None)
    assert sorted(map(tuple, extract.rule_match(df, rules).collect())) == [(0, "Boat", "by Sea"), (0, "Drone", "on WINGS")]
    assert sorted((r["channel"], r["raw_text"]) for r in extract.delivery_options(df, plain_date(), rules).collect()) == [("Boat", "by Sea"), ("Drone", "on WINGS"), ("Post", "in 2 days")]
    best = extract.with_earliest(extract.found(df, rules), plain_date(), rules).select("page_id", "best.display_text", extract.text_of("name").alias("n"), extract.text_of("seller").alias("s")).orderBy("page_id").first()
    assert tuple(best) == (0, "Post – In 2 Days", "N", None)


@pytest.mark.parametrize("row", [("other", "x", 0, "p", None), ("field", "nothing", 0, "p", None), ("field", "name", 0, "p:hover", None), ("word", "x", 0, "w", None), ("promise", "x", 0, "p", None), ("channel", "x", 0, None, None)])
def test_rules_are_checked(spark, row):
    with pytest.raises(ValueError, match="rule|field|selector|words|attribute"):
        extract.rules_of(spark.createDataFrame([row], extract.RULE_ROW))


def _read_by(monkeypatch, plain, html, selectors):
    with monkeypatch.context() as m:
        if not plain:
            m.setattr(dom._Reader, "plain", lambda self, html: False)
        reader, text = dom._page(html, dom.Selectors(selectors), keep=True)
    return text, reader.hits, reader.rows, reader.paths


def test_plain_pages_are_read_by_their_tags_alone(spark, monkeypatch):
    page = """<!DOCTYPE html><html><head><title>a &amp b</title><script>if (a<b) c("</p>&amp;")</script></head><!-- <b>x</b> --><body><br/><p class='x y' data-n=1 hidden>1<p id="i&amp;j">2 &lt; 3</P ></body></html>"""
    want = _read_by(monkeypatch, False, page, ["title", "p.x", "[hidden]"])
    monkeypatch.setattr(dom._Reader, "feed", lambda self, html: pytest.fail("left to the general parser"))
    assert _read_by(monkeypatch, True, page, ["title", "p.x", "[hidden]"]) == want


def test_tags_read_alone_equal_the_general_parser(monkeypatch):
    rng = random.Random(7)
    bits = ["<p>", "<p", ">", "</p>", "</p >", "<b class='x y'>", '<b id="x" id=y>', "<a href=/q/>", '<a href="/q"/>', "<a href=x/>", "<br/>", "<br />", "<i\xa0b>", "<i b=a\xa0c>", "<i\x0bb>", "<I X=Y>", "</I>", "<script>", "</script>", "</SCRIPT >", "</ script>", "<script/>", "<style>", "</style>",
            "<!-- ", " -->", "-", "--", "<!--->", "<!-->", "<!doctype html>", "<!x>", "<?x>", "</>", "</1>", "<1>", "< b", "&amp", "&amp;", "&lt;b&gt;", "a", " b ", '"', "'", "=", "/", "<b a='>'>", '<b a="<">', "<b a=\"&lt;&amp\">", "<b a='x'c='y'>", "<b =a>", "<b a==c>", "<b a = c>", "<b\na\n>", "<td>", "<tr>", "<li>", "<table>", "</table>"]
    plain = 0
    for n in range(6000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(1, 3 if n % 2 else 12)))
        css = ["b", "p .x", "p > b", "[a]", "#x", "script"]
        assert _read_by(monkeypatch, True, html, css) == _read_by(monkeypatch, False, html, css), html
        plain += dom._Reader(dom.Selectors(css), False).plain(html)
    assert plain > 600


def test_references_without_semicolon_as_text(spark):
    df = pages(spark, "<h1>a&amp;&amp</h1>", "<h1>b&lt c&#60;&#x3c;&#60 &copy;&</h1>", None)
    got = lambda d: [r["text"] for r in dom.cascade_text(d, ["h1"]).orderBy("page_id").collect()]
    assert got(df) == ["a&&", "b< c<<< \u00a9&", None]
    assert got(df.withColumn("html", dom.finished_references(F.col("html")))) == ["a&&amp", "b&lt c<<&#60 \u00a9&", None]


@pytest.mark.parametrize("name", ["cascade_text", "rule_table"])
def test_headings_cut_within_a_reference_equal_sql(spark, tmp_path, name):
    import duckdb

    from offergrid.plans import catalogue

    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1></article></body></html>"
    spark.createDataFrame([(1, "u", page.format("then &amp;&amp")), (2, "u", page.format("quen &quot;&quot"))], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    df, con = catalogue.queries()[name](spark, str(tmp_path)), duckdb.connect()
    for t in ("part", "nation", "supplier", "lineitem"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.sql(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall())


def test_fields_alone_come_without_their_pages(spark):
    """A query for one field matches that field's selectors and gets no page back; its texts are those of all rules."""
    from offergrid.operators import extract
    from offergrid.plans.fixtures import Tables

    pages = Tables(spark, "/root/testdata/sf0.001").product_pages.select("page_id", "html")
    few = extract.found(pages, extract.RULES.only("mrp", "old_mrp"), ("page_id",))
    assert "html" not in few.columns and "mrp_texts" in few.columns
    whole = extract.found(pages).select("page_id", "mrp_texts", "old_mrp_texts")
    assert few.select(*whole.columns).exceptAll(whole).count() == 0 and few.count() == whole.count() > 0


def test_pages_of_one_shape_are_read_once(monkeypatch):
    """Pages that differ in texts and in values that no selector names: one page's tags are read for all of them."""
    import pyarrow as pa

    begun, start = [], dom._Reader.start
    monkeypatch.setattr(dom._Reader, "start", lambda self, t: (begun.append(t), start(self, t))[1])
    html = [f'<div id="a"><b title="t{i}">n &amp; {i}</b><i value="{i}">x</i></div><script>if (a&amp;{i}) b()</script><!-- {i} --><p data-at="{i}">z' for i in range(500)]
    texts_of, given = dom.Shapes(["#a b", "#a", "script", "p[data-at]", "u"], range(3, 4)).read(pa.array(html))
    assert texts_of(0, 5).to_pylist() == [t for i in range(500) for t in (f"n & {i}", f"n & {i}x", f"if (a&amp;{i}) b()", "z", None)]
    assert [[[g["data-at"] for g in own] for own in page] for page in given] == [[[str(i)]] for i in range(500)]
    assert len(begun) < 10


def test_shapes_equal_pages_read_one_by_one(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dom, "MOST_HELD", 400)
    monkeypatch.setattr(dom, "MOST_TAGS", 30)
    rng, css = random.Random(11), ["b", "p .x", "p > b", "[a]", "#x", "script", "i[c='y']", "td"]
    bits = ["<p>", "<p", ">", "</p>", "</p >", "<b class='x y'>", '<b id="x" id=y>', '<b id="z" a="x">', '<b c="x">', '<i c="y">', '<i c="z" q="1">', '<i C="y">', '<i @="p q=" id="x">', '<i @="p q=" r="x">', '<a href="/q"/>', "<br/>", "<I X=Y>", "</I>", "<script>", "</script>", "</SCRIPT >", "<style>", "</style>",
            "<!-- ", " -->", "<!-- a -->", "<!--->", "<!doctype html>", "<?x>", "&amp", "&amp;", "&lt;b&gt;", "a", " b ", '"', "<b a=\"&lt;&amp\">", "<td>", "<tr>", "<table>", "</table>", "</b>", "</i>", "é"]
    pages = [None if n % 50 == 0 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 3 if n % 2 else 12))) for n in range(6000)]
    shapes, whole, alike = dom.Shapes(css, range(3, 5)), dom.Selectors(css), 0
    for at in range(0, len(pages), 100):
        part = pages[at : at + 100]
        texts_of, given = shapes.read(pa.array([*part, *part], pa.string()).slice(100))
        found = texts_of(0, len(css)).to_pylist()
        for n, html in enumerate(part):
            reader, text = dom._page(html, whole)
            want = [text[h[0][0] : h[0][0] + h[0][1]] if (h := reader.hits.get(i)) else None for i in range(len(css))]
            assert found[n * len(css) : (n + 1) * len(css)] == want, html
            assert given[n] == [[h[2] for h in reader.hits.get(i, ())] for i in range(3, 5)], html
        alike += sum(s is not None for s in shapes.shapes.values())
    assert alike > 600


def test_delivery_matches_its_own_selectors(spark, monkeypatch):
    """Options and channels are read without the selectors of other fields."""
    seen = []
    monkeypatch.setattr(extract, "read_texts", lambda pages, selectors, *more: seen.append(selectors) or dom.read_texts(pages, selectors, *more))
    df = pages(spark, '<div id="ddmDeliveryMessage">Monday</div>')
    assert [r["raw_text"] for r in extract.rule_match(df).collect()] == [r["raw_text"] for r in extract.delivery_options(df, plain_date()).collect()] == ["Monday"]
    assert seen == [(), ()]


def test_pages_are_made_after_one_shuffle(spark):
    from offergrid.plans.fixtures import Tables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Tables(spark, "/root/testdata/sf0.001").product_pages._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" in line]
    assert len(rows) == 1 and "hashpartitioning(asin" in rows[0]


def test_source_is_searched_only_where_it_has_a_word(spark):
    """Promises from the source, in any case and script of the page; a page without their words isn't searched by patterns."""
    source = ["<p>FREE DELIVERY IN 20 minutes, now<b>", "<i>İ On TODAY", "<p>free delivery in minutes", "<p>Frday", None]
    got = extract.delivery_options(pages(spark, *source), plain_date()).select("page_id", "channel", "raw_text").collect()
    assert sorted(map(tuple, got)) == [(0, "Express", "FREE DELIVERY IN 20 minutes, now"), (1, "Standard", "TODAY")]
    plan = extract.delivery_options(pages(spark, *source), plain_date())._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan or "contains(" in plan.lower()


def test_offers_need_one_small_copy_of_a_page(spark):
    """A page's small letters are made once for all rules, and after that no step holds the page."""
    df = pages(spark, "<title>x</title>").selectExpr("*", "'u' url", "'B1' asin", "'1' pincode", "'c' city", "timestamp_ntz'2000-01-01 00:00:00' captured_at")
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    try:
        steps = [line for line in extract.build_offer(df, plain_date())._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project [" in line]
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert sum(line.count("lower(html#") for line in steps) == 1
    assert not any("html#" in line for line in steps[:3])
    long = "<p>" + "x" * 3100 + "captcha</p>"
    df = pages(spark, long, "<p>B1 İ ADD TO cart", "<p>ROBOT check").selectExpr("*", "'u' url", "'B1' asin", "'1' pincode", "'c' city", "timestamp_ntz'2000-01-01 00:00:00' captured_at")
    assert [r["failure_reason"] for r in extract.build_offer(df, plain_date()).orderBy("page_id").collect()] == ["", "", "CAPTCHA"]
