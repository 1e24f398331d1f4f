"""Attempts, running counters, text files, and streams of several batches with restarts."""

import random

import pytest
from pyspark.sql import functions as F

from offergrid.operators import offers
from offergrid.shared import shared_dir
from offergrid.sources import lines
from offergrid.streaming import attempts, entry_log, progress


@pytest.mark.parametrize(
    ("tries", "attempt", "seller", "attempts"),
    [
        ("O", 1, 1, 1),
        ("FO", 2, 2, 2),
        ("FFFO", None, 3, 3),
        ("CO", 1, 2, 1),  # the extra try after a challenge
        ("CCO", 2, 3, 2),  # two challenges are one attempt
        ("CFCFCO", 3, 6, 3),
        ("CCCCCCO", None, 6, 3),
        ("CCCCCO", 3, 6, 3),
        ("FCO", 2, 3, 2),
        ("CFO", 2, 3, 2),
        ("FFCF", None, 4, 3),
        ("C", None, 1, 1),
    ],
)
def test_attempts(spark, tries, attempt, seller, attempts):
    status = {"O": ("OK", ""), "F": ("FAILED", "x"), "C": ("FAILED", "CAPTCHA")}
    rows = [("a", "p", i + 1, *status[t], str(i + 1), float(i)) for i, t in enumerate(tries)]
    df = spark.createDataFrame(rows, "asin string, pincode string, i int, status string, failure_reason string, seller string, price double")
    r = offers.attempt_resolution(df, ("i",)).first()
    assert (r["status"], r["failure_reason"]) == (("OK", "") if attempt else ("FAILED", "Failed after retries"))
    assert (r["attempt"], r["seller"], r["attempts"]) == (attempt or attempts, str(seller), attempts)


def test_running_counters_over_ranges(spark):
    rows = [("hot" if i % 10 else "cold", i // 3, i, "OK" if i % 4 else "FAILED") for i in range(300)] + [("one", 5, 999, "OK")]
    df = spark.createDataFrame(rows, "run string, s int, i int, status string").withColumn("at", F.timestamp_seconds("s"))
    out = offers.running_progress(df, "run", ("at", "i"), F.timestamp_seconds(F.lit(0)), ranges=7).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r["run"], r["at"], r["i"])):
        done, ok = seen.get(r["run"], (0, 0))
        seen[r["run"]] = done + 1, ok + (r["status"] == "OK")
        total = sum(x[0] == r["run"] for x in rows)
        assert (r["done"], r["success"], r["total"]) == (*seen[r["run"]], total)
        assert (r["failed"], r["pct"]) == (r["done"] - r["success"], r["done"] * 100 // total)
    assert len(out) == len(rows)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"# Tools\r\nB09W9FND7M , Saw , S1\rB0DSKNKCYX # note\n\nbad\n")
    (tmp_path / "b.txt").write_bytes(b"B0DSKNKCYY,x\n#\nB0DSKNKCYZ")
    read = lines.read_lines(spark, str(tmp_path))
    found = sorted((r["file"][-5:], r["line_no"], r["asin"], r["item_name"], r["category"]) for r in lines.scan_catalog(read).collect())
    assert found == [("a.txt", 1, "B09W9FND7M", "Saw", "Tools"), ("a.txt", 2, "B0DSKNKCYX", "", "Tools"), ("b.txt", 0, "B0DSKNKCYY", "x", ""), ("b.txt", 2, "B0DSKNKCYZ", "", "")]


@pytest.fixture
def source(spark, tmp_path):
    """A folder of message files, and a function that adds one."""
    kind = "k int, n int, v string"
    folder = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)

    add([(1, 1, "a"), (2, 1, "b")])
    read = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    return add, read


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_keyed_table_over_batches_and_restarts(spark, tmp_path, source):
    add, read = source
    add([(1, 3, "c"), (3, 1, "d")])
    add([(1, 2, "late"), (4, 1, None)])
    seen = []
    run = lambda: progress.upsert_stream(read(), str(tmp_path / "table"), str(tmp_path / "cursor"), ("k",), ("n",), cadence={5: lambda t: seen.append((t.snapshot()["results"], t.read().count()))})
    want = [(1, 3, "c"), (2, 1, "b"), (3, 1, "d"), (4, 1, None)]
    assert sorted(run().read().collect(), key=str) == sorted(want, key=str)
    assert seen == [(6, 4)]  # two results a batch: the fifth came with the third batch
    assert sorted(run().read().collect(), key=str) == sorted(want, key=str)  # nothing new: the table as it stands
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    add([(2, 5, "e")])
    assert (2, 5, "e") in rows_of(run().read().where("v is not null"))
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())  # what was written stays as it was
    add([(5, 1, "f"), (6, 1, "g"), (7, 1, "h")])
    assert run().read().count() == 7 and seen == [(6, 4), (10, 7)]


def test_state_over_restarts(spark, tmp_path, source):
    add, read = source
    run = lambda: progress.run_complete(read().groupBy("k").agg(F.count("*").alias("c")), str(tmp_path / "agg"))
    assert rows_of(run()) == [(1, 1), (2, 1)]
    assert rows_of(run()) == [(1, 1), (2, 1)]
    add([(1, 7, "x")])
    assert rows_of(run()) == [(1, 2), (2, 1)]


def test_log_goes_on_from_any_entry(spark, tmp_path, source):
    add, read = source
    run = lambda **more: entry_log.log_stream(read(), str(tmp_path / "log"), str(tmp_path / "at"), ("k",), **more)
    assert [r["entry"] for r in run().read().orderBy("k").collect()] == [0, 1] and run().entries() == 2
    add([(9, 9, "z"), (8, 9, "y")])
    add([(7, 9, "x")])
    log = run()
    seen = [tuple(r) for r in log.read().orderBy("entry").collect()]
    assert [r[-1] for r in seen] == [0, 1, 2, 3, 4] and {r[0] for r in seen[2:]} == {7, 8, 9}
    for k in range(7):
        assert [tuple(r) for r in log.read(k).orderBy("entry").collect()] == seen[k:]
    again = entry_log.EntryLog(spark, str(tmp_path / "log"), ("k",))  # another process
    assert again.read(3).count() == 2 and not again.ended()
    assert run(last=True).ended() and again.ended()
    with pytest.raises(ValueError, match="ended"):
        again.append(read_all(spark))
    assert entry_log.EntryLog(spark, str(tmp_path / "none"), ("k",)).read(0, read_all(spark).schema).count() == 0


def read_all(spark):
    return spark.createDataFrame([(1, 1, "q")], "k int, n int, v string")


def test_numbers_over_many_tasks(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("x"))
    assert sorted(tuple(r) for r in entry_log.numbered(df, ("x",), 10).collect()) == [(i, i + 10) for i in range(5000)]


TRIES = "asin string, pincode string, s int, i int, status string, failure_reason string, seller string, price double"


@pytest.mark.parametrize("shuffled", [False, True])
def test_attempts_of_a_stream(spark, tmp_path, shuffled):
    rng = random.Random(5)
    kinds = {"O": ("OK", ""), "F": ("FAILED", "x"), "C": ("FAILED", "CAPTCHA"), "N": (None, None)}
    rows = [(f"a{k}", "p", i, i, *kinds[rng.choice("OFFCCN")], rng.choice([None, f"s{i}"]), rng.choice([None, float(i)])) for k in range(40) for i in range(rng.randint(1, 9))]
    if shuffled:
        rng.shuffle(rows)
    folder, at = str(tmp_path / "in"), F.timestamp_seconds(F.col("s") + 10**9)
    write = lambda part: spark.createDataFrame(part, TRIES).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: attempts.resolved_table(spark.readStream.schema(TRIES).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", at), str(tmp_path / "t"), str(tmp_path / "c"), order=("at", "i"))
    third = len(rows) // 3
    want = lambda n: offers.attempt_resolution(spark.createDataFrame(rows[:n], TRIES), ("i",))
    write(rows[:third])
    write(rows[third : 2 * third])
    assert sorted(map(str, run().read().drop("rev").collect())) == sorted(map(str, want(2 * third).collect()))
    write(rows[2 * third :])  # after a restart
    assert sorted(map(str, run().read().drop("rev").collect())) == sorted(map(str, want(len(rows)).collect()))


def test_state_of_idle_pairs_is_dropped(spark, tmp_path):
    folder, at = str(tmp_path / "in"), F.timestamp_seconds(F.col("s") + 10**9)
    for rows in ([("a", "p", 0, 0, "FAILED", "x", "s", 1.0)], [("b", "p", 10_000, 1, "OK", "", "s", 1.0)], [("c", "p", 10_001, 2, "OK", "", "s", 1.0)]):
        spark.createDataFrame(rows, TRIES).coalesce(1).write.mode("append").parquet(folder)
    kept = []
    out = attempts.attempt_stream(spark.readStream.schema(TRIES).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", at), ("at", "i"), late="1 second", idle_s=60)
    query = out.writeStream.foreachBatch(lambda df, i: kept.append(df.count())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(kept) == 3
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1] == 2


def test_no_temporary_folder_off_local_masters():
    class Stub:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Stub)


def test_resolutions_are_made_without_a_step_a_pair(spark, tmp_path, monkeypatch):
    """Tries in any order over batches, the first of which comes last; a batch whose second commit was lost is resolved again."""
    monkeypatch.setattr(attempts, "_step", lambda *_, **__: pytest.fail("a pair by itself"))
    monkeypatch.setattr(attempts, "attempt_stream", lambda *_, **__: pytest.fail("a pair by itself"))
    rows = [("a", "p", 10 - n, n, "FAILED", "CAPTCHA" if n % 3 else "x", f"s{n}", 1.0) for n in range(9)] + [("a", "p", 0, 9, "OK", "", "first", 2.0)]
    folder, at = str(tmp_path / "in"), F.timestamp_seconds(F.col("s") * 10**8)
    run = lambda c="c": attempts.resolved_table(spark.readStream.schema(TRIES).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", at), str(tmp_path / "t"), str(tmp_path / c), order=("at", "i"))
    for n in range(1, 11):
        spark.createDataFrame(rows[n - 1 : n], TRIES).coalesce(1).write.mode("append").parquet(folder)
        if n in (4, 9, 10):
            want = offers.attempt_resolution(spark.createDataFrame(rows[:n], TRIES), ("s", "i"))
            assert run().read().drop("rev").collect() == want.collect()
    lost, commit = [], attempts.KeyedTable.commit

    def failing(self, *args):
        if not self.root.endswith("held") and not lost:
            lost.append(1)
            raise RuntimeError("lost")
        return commit(self, *args)

    monkeypatch.setattr(attempts.KeyedTable, "commit", failing)
    spark.createDataFrame([("b", "p", 1, 1, "OK", "", "s", 1.0)], TRIES).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="lost"):
        run()
    assert [(r["asin"], r["seller"]) for r in run().read().orderBy("asin").collect()] == [("a", "first"), ("b", "s")]


def test_products_need_one_shuffle(spark):
    """The capture is dealt by product, so what is grouped or joined by product after it moves no row again."""
    from offergrid.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.capture.groupBy("asin").agg({"price": "max"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asin") == 1


def test_report_makes_its_offers_once(spark, tmp_path):
    import datetime as dt
    import os

    from offergrid.plans.fixtures import Tables
    from offergrid.sources import sinks

    t, made = Tables(spark, "/root/testdata/sf0.001"), spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    n = t.offers.count()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.offers.schema)
    paths = sinks.sink_report(t.catalog, t.locations, t.offers.mapInArrow(told, kinds), str(tmp_path), dt.datetime(2000, 1, 15))
    assert made.value == n and spark.read.parquet(paths["summary"]).first()["success"] == t.offers.where("status = 'OK'").count()
    assert sorted(os.listdir(tmp_path)) == ["failed", "results", "summary"]
