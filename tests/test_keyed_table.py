"""The keyed table: versions, merges, crashes, writers at one time; the report kept up to date from it."""

import random
import shutil
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from offergrid.operators import report
from offergrid.sources import keyed_table, sinks
from offergrid.sources.keyed_table import KeyedTable
from offergrid.streaming.live_report import LiveReport

KIND = "k string, p int, n int, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, root, **more):
    return KeyedTable(spark, str(root), ("k", "p"), ("n",), **more)


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


@pytest.mark.parametrize(("fanout", "part_rows"), [(3, 1 << 17), (2, 8), (4, 20)])
def test_versions_equal_a_dictionary(spark, tmp_path, fanout, part_rows):
    rng, t, model, versions = random.Random(fanout), table(spark, tmp_path / "t", fanout=fanout, part_rows=part_rows), {}, {}
    for batch_id in range(9):
        rows = [(rng.choice([*map(str, range(20)), None]), rng.randint(0, 2), rng.randint(0, 99) * 10 + batch_id, f"{batch_id}-{i}") for i in range(rng.choice([0, 1, 15, 15, 40]))]
        rows = list({(k, p, n): (k, p, n, v) for k, p, n, v in rows}.values())  # an order without ties
        v = t.commit(spark.createDataFrame(rows, KIND), "w", batch_id)
        for k, p, n, text in rows:
            if (k, p) not in model or model[k, p][2] < n:
                model[k, p] = k, p, n, text
        versions[v] = sorted(model.values(), key=str)
        assert t.commit(spark.createDataFrame([("0", 0, 10**6, "again")], KIND), "w", batch_id) >= v  # a batch that comes again
    now = t.snapshot()
    assert len(now["runs"]) < 9 and (max(r["bits"] for r in now["runs"]) > 0) == (part_rows < 100)
    schema = t.read().schema
    for v, want in versions.items():
        assert rows_of(t.read(schema, version=v)) == want
    only = spark.createDataFrame([("3",), ("7",), ("none",)], "k string")
    assert rows_of(t.read(only=only)) == sorted((r for r in model.values() if r[0] in ("3", "7")), key=str)
    mid = sorted(versions)[4]
    assert set(rows_of(t.changed(mid))) >= {r[:2] for r in set(model.values()) - set(versions[mid])}
    t.compact(whole=True)
    assert len(t.snapshot()["runs"]) == 1 and rows_of(t.read()) == sorted(model.values(), key=str)
    t.vacuum(t.snapshot()["version"], older_than_s=-60)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1 and len(t.versions()) == 1
    assert rows_of(t.read()) == sorted(model.values(), key=str)
    assert t.commit(spark.createDataFrame([("0", 0, 10**6, "other writer")], KIND), "w2", 0) and ("0", 0, 10**6, "other writer") in rows_of(t.read())


def test_no_commit_and_empty_batches(spark, tmp_path):
    t, empty = table(spark, tmp_path / "t"), spark.createDataFrame([], KIND)
    assert t.read(empty.schema).count() == 0 and t.versions() == [] and t.snapshot()["results"] == 0
    t.commit(empty, "w", 0)
    assert t.read().columns == ["k", "p", "n", "v"] and t.read().count() == 0 and t.changed(0).count() == 0
    t.compact(whole=True)
    t.commit(spark.createDataFrame([("x", "a", 1, 1)], "v string, k string, p int, n int"), "w", 1)  # columns by name
    assert rows_of(t.read()) == [("a", 1, 1, "x")]


def test_later_commits_win_ties(spark, tmp_path):
    t = table(spark, tmp_path / "t", fanout=3)
    for i in range(7):
        t.commit(spark.createDataFrame([("a", 1, 5, f"v{i}")], KIND))
        assert rows_of(t.read()) == [("a", 1, 5, f"v{i}")]


def test_a_crash_between_the_two_writes(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.commit(spark.createDataFrame([("a", 1, 1, "x")], KIND), "w", 0)
    before = rows_of(t.read())

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed_table, "publish", crash)
        with pytest.raises(RuntimeError):
            t.commit(spark.createDataFrame([("a", 1, 2, "y"), ("b", 1, 1, "z")], KIND), "w", 1)
    again = table(spark, tmp_path / "t")
    assert rows_of(again.read()) == before and again.snapshot()["results"] == 1
    again.commit(spark.createDataFrame([("a", 1, 2, "y"), ("b", 1, 1, "z")], KIND), "w", 1)
    assert rows_of(again.read()) == [("a", 1, 2, "y"), ("b", 1, 1, "z")] and again.snapshot()["results"] == 3
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3
    again.vacuum(0)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3  # too young to be sure
    again.vacuum(0, older_than_s=-60)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_a_reader_sees_one_version(spark, tmp_path):
    t = table(spark, tmp_path / "t", fanout=2)
    t.commit(spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x")], KIND))
    held = t.read()
    t.commit(spark.createDataFrame([("a", 1, 2, "y"), ("b", 1, 2, "y")], KIND))  # merges, too
    assert {v for *_, v in rows_of(held)} == {"x"} and {v for *_, v in rows_of(t.read())} == {"y"}


def test_writers_at_one_time(spark, tmp_path):
    lost = []

    def work(i):
        try:
            t = table(spark, tmp_path / "t", fanout=3)
            for b in range(3):
                t.commit(spark.createDataFrame([(f"{i}", b, 1, "x"), ("all", 0, i * 10 + b, "y")], KIND), f"w{i}", b)
        except Exception as e:
            lost.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    t = table(spark, tmp_path / "t")
    assert not lost and rows_of(t.read()) == sorted([(f"{i}", b, 1, "x") for i in range(3) for b in range(3)] + [("all", 0, 22, "y")], key=str)
    assert t.snapshot()["results"] == 18


def test_what_is_written_follows_the_batches(spark, tmp_path):
    root, t = tmp_path / "t", table(spark, tmp_path / "t", fanout=4, part_rows=1000)
    t.commit(spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit(1).alias("p"), F.lit(1).alias("n"), F.sha2((F.col("id") + 7).cast("string"), 512).alias("v")))
    whole, written = size(root), 0
    for b in range(12):
        at = size(root)
        t.commit(spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit(1).alias("p"), F.lit(2 + b).alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("v")))
        written += size(root) - at
    assert written < 0.3 * whole  # 12 batches of a 400th of the table each, and their merges
    assert t.read().count() == 40_000 and t.read().where("n > 1").count() == 100


def test_cadence_by_results(spark, tmp_path):
    calls, rows = [], lambda n, at: spark.createDataFrame([(f"{at + i}", 0, 1, "x") for i in range(n)], KIND)
    note = lambda what: lambda t: calls.append((what, t.snapshot()["results"]))
    new = lambda flush=note("flush"): sinks.IncrementalSink(str(tmp_path / "t"), ("k", "p"), ("n",), cadence={10: flush, 50: note("report")})
    for i, n in enumerate([4, 5, 1, 25, 14, 1, 9]):
        new()(rows(n, 100 * i), i)  # each time a new process
    assert calls == [("flush", 10), ("flush", 35), ("flush", 49), ("flush", 50), ("report", 50)]

    def crash(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        new(crash)(rows(3, 900), 7)
    calls.clear()
    new()(rows(3, 900), 7)  # the batch comes again: nothing is added, but the flush is made up for
    assert calls == [("flush", 62)]


OFFER = "asin string, pincode string, city string, loc_ord long, product_name string, mrp double, price double, discount_percent string, in_stock string, delivery_date string, seller string, rating string, reviews string, bsr string, scraped_at string, status string, failure_reason string, n int"


def offer(rng, asin, place, n):
    ok = rng.random() < 0.7
    price = rng.choice([None, round(rng.random() * 100, 2)])
    return (asin, f"{110001 + place}", f"c{place}", place, f"name {asin}", 9.5, price, "5%", rng.choice(["In Stock", "Out of Stock", None]), rng.choice(["Tomorrow", "Today"]), f"s{n}", rng.choice(["4.5", "x", None]), "3", "N/A", f"t{n}", "OK" if ok else "FAILED", "", n)


def test_report_after_each_batch(spark, tmp_path):
    rng = random.Random(8)
    catalog = spark.createDataFrame([(i, f"B{i}", "" if i % 3 else f"listed {i}", "c", "cat") for i in range(12)], "ord long, asin string, item_name string, item_code string, category string")
    places = spark.createDataFrame([(i, f"{110001 + i}", f"c{i}") for i in range(4)], "ord long, pincode string, city string")
    offers = KeyedTable(spark, str(tmp_path / "offers"), order=("n",), fanout=3, part_rows=6)
    live = LiveReport(spark, offers, str(tmp_path / "view"))
    assert rows_of(live.summary(True)) == [(0, 0, 0, 0, 0, 0, None, None)] and live.refresh() == 0
    for b in range(4):
        batch = [offer(rng, f"B{rng.randint(0, 11)}", rng.randint(0, 3), 100 * b + i) for i in range(rng.choice([1, 5, 12]))]
        offers.commit(spark.createDataFrame(batch, OFFER), "w", b)
        if b == 1:
            continue  # the view may be behind by some batches
        live.refresh()
        whole = offers.read()
        assert rows_of(live.report(catalog, places)) == rows_of(report.pivot_report(catalog, places, whole))
        for ok_only in (True, False):
            assert rows_of(live.summary(ok_only)) == rows_of(report.summary(whole, ok_only))
        at = live.products.versions()
        assert live.refresh() and live.products.versions() == at  # nothing new: nothing written


def test_only_changed_products_are_read(spark, tmp_path):
    rng = random.Random(9)
    offers = KeyedTable(spark, str(tmp_path / "offers"), order=("n",), fanout=99, part_rows=4)
    offers.commit(spark.createDataFrame([offer(rng, f"B{i}", j, i) for i in range(40) for j in range(2)], OFFER))
    offers.compact(whole=True)
    live = LiveReport(spark, offers, str(tmp_path / "view"))
    live.refresh()
    (run,) = offers.snapshot()["runs"]
    part = spark.createDataFrame([("B7",)], "asin string").select(offers._part(run["bits"])).first()[0]
    for folder in (tmp_path / "offers" / "data" / run["path"].rpartition("/")[2]).glob("_part=*"):
        if folder.name != f"_part={part}":
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"not to be read")
    first = offers.snapshot()["runs"][0]["rows"]
    offers.commit(spark.createDataFrame([offer(rng, "B7", 0, 999)], OFFER))
    live.refresh()
    assert live.summary(False).first()["total"] == first and live.products.read().where("asin = 'B7'").count() == 1
    shutil.rmtree(tmp_path / "offers")
    assert Decimal(live.products.snapshot()["meta"]["all"]["price_sum"]) is not None


def test_large_batch_is_written_once(spark, tmp_path):
    """A batch of more than part_rows goes to its folders at once: one run, one version, nothing rewritten."""
    rows = spark.range(400).selectExpr("concat('B', id % 100) asin", "cast(id % 2 as string) pincode", "id v")
    for cluster, versions in (((), 1), (("v",), 2)):
        table = KeyedTable(spark, str(tmp_path / f"t{versions}"), ("asin", "pincode"), ("v",), cluster, part_rows=50)
        table.commit(rows)
        now = table.snapshot()
        assert table.versions() == list(range(1, versions + 1)) and len(now["runs"]) == 1 and now["runs"][0]["bits"] > 0 and now["results"] == 400
        assert sorted(r["v"] for r in table.read().collect()) == list(range(300, 400))


def test_refresh_reads_offers_once(spark, tmp_path):
    """Totals change by what the view's own rows held, offers without a location included; these have no cell."""
    rng = random.Random(10)
    offers = KeyedTable(spark, str(tmp_path / "offers"), order=("n",))
    live, calls = LiveReport(spark, offers, str(tmp_path / "view")), []
    read = offers.read
    offers.read = lambda *a, **k: calls.append(1) or read(*a, **k)
    for b in range(2):
        rows = [offer(rng, f"B{i % 4}", i % 3, 100 * b + i) for i in range(8)]
        offers.commit(spark.createDataFrame([*rows, ("B9", None, *offer(rng, "B9", 0, 100 * b + 9)[2:])], OFFER))
        calls.clear()
        live.refresh()
        assert len(calls) == 1
    for ok_only in (True, False):
        assert rows_of(live.summary(ok_only)) == rows_of(report.summary(read(), ok_only))
    catalog = spark.createDataFrame([(i, f"B{i}", "", "c", "cat") for i in range(10)], "ord long, asin string, item_name string, item_code string, category string")
    places = spark.createDataFrame([(i, f"{110001 + i}", f"c{i}") for i in range(3)], "ord long, pincode string, city string")
    assert rows_of(live.report(catalog, places)) == rows_of(report.pivot_report(catalog, places, read()))


def test_large_stream_batch_is_of_several_files(spark, tmp_path, monkeypatch):
    from offergrid.plans import fixtures

    monkeypatch.setattr(fixtures, "ATTEMPTS_A_FILE", 500)
    t, seen = fixtures.Tables(spark, "/root/testdata/sf0.001"), []
    stream = t.attempt_stream(str(tmp_path / "in"), files=3)
    query = stream.writeStream.foreachBatch(lambda df, i: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == 3 and sum(seen) == t.attempts.count() and len(list((tmp_path / "in").glob("*.parquet"))) > 10


def test_stream_moves_narrow_rows(spark, tmp_path):
    """The report's table holds attempts, its offers are made when it is refreshed; the stream's files are written unshuffled."""
    from offergrid.plans import catalogue, fixtures

    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def moved():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = moved()
    assert t.attempt_stream(str(tmp_path / "in"), files=3).isStreaming and moved() - before < 2000
    live = catalogue._live(t)
    assert "delivery_text" in live.offers.read().columns and "product_url" not in live.offers.read().columns
    assert len(live.offers.snapshot()["runs"]) == 3
    assert rows_of(live.summary(False)) == rows_of(report.summary(t.offers, False))
