"""The grid of what is left, by bitmaps of location numbers."""

import random
import re

import pytest

from offergrid.operators import grid

CATALOG = "ord long, asin string, item_name string, word int, bits string"
LOCATIONS = "ord long, pincode string, city string"
PAIRS = "asin string, pincode string, status string"


def pairs(df):
    return sorted(((r["asin"], r["pincode"]) for r in df.collect()), key=str)


@pytest.fixture
def tables(spark):
    def make(products, places, share, seed=1):
        rng = random.Random(seed)
        catalog = [(i, f"B{i:09d}", f"name {i}", 7, "x") for i in range(products)] + [(products, None, "no id", 7, "x"), (products + 1, "B000000001", "again", 7, "x")]
        locations = [(i * 10, f"{110001 + i}", f"city {i}") for i in range(places)]
        done = [(a, p, "OK") for _, a, *_ in catalog[:products] for _, p, _ in locations if rng.random() < share]
        done += done[:50] + [("B000000002", "999999", "OK"), ("other", "110001", "OK"), (None, "110001", "OK"), ("B000000003", None, "OK")]
        return catalog, locations, done

    return make


def frames(spark, catalog, locations, done):
    return spark.createDataFrame(catalog, CATALOG), spark.createDataFrame(locations, LOCATIONS), spark.createDataFrame(done, PAIRS)


@pytest.mark.parametrize(("products", "places", "share"), [(30, 1, 0.5), (20, 63, 0.9), (20, 64, 0.5), (20, 65, 1.0), (12, 200, 0.3), (12, 130, 0.0)])
def test_todo(spark, tables, products, places, share):
    catalog, locations, done = tables(products, places, share)
    out = grid.todo_grid(*frames(spark, catalog, locations, done))
    gone = {(a, p) for a, p, _ in done if a and p}
    want = [(o, a, n, w, b, lo, p, c) for o, a, n, w, b in catalog for lo, p, c in locations if (a, p) not in gone]
    got = [(r["ord"], r["asin"], r["item_name"], r["word"], r["bits"], r["loc_ord"], r["pincode"], r["city"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pairs(grid.done_set(spark.createDataFrame(done, PAIRS), spark.createDataFrame(locations, LOCATIONS))) == sorted({(a, p) for a, p in gone if a and p in {x[1] for x in locations}})


def test_todo_of_nothing(spark, tables):
    catalog, locations, done = tables(5, 3, 0.5)
    c, lo, d = frames(spark, catalog, locations, done)
    assert grid.todo_grid(c.limit(0), lo, d).count() == 0
    assert grid.todo_grid(c, lo.limit(0), d).count() == 0
    assert grid.todo_grid(c, lo, d.limit(0)).count() == len(catalog) * 3
    assert grid.todo_grid(c, spark.createDataFrame([*locations, (99, "110001", "twice"), (100, None, "none")], LOCATIONS), d).count() == len(pairs(grid.todo_grid(c, lo, d))) + len(catalog) + sum((a, "110001") not in {(x, y) for x, y, _ in done if x and y} for _, a, *_ in catalog)


def test_no_pair_is_shuffled(spark, tables):
    """All exchanges stand below the join that makes pairs; above it the plan has rows of missing pairs alone."""
    c, lo, d = frames(spark, *tables(20, 70, 0.5))
    plan = grid.todo_grid(c, lo, d)._jdf.queryExecution().sparkPlan().toString()
    physical = grid.todo_grid(c, lo, d)._jdf.queryExecution().executedPlan().toString()
    made = plan.splitlines().index(next(x for x in plan.splitlines() if "bit_get" in x and "Join" in x))
    assert made <= 2 and "BroadcastHashJoin" in plan.splitlines()[made]
    above = physical[: physical.index("bit_get")]
    assert not re.search(r"(?<!Broadcast)Exchange (hash|range|Round)", above)
    assert "CartesianProduct" not in physical


def test_bitmaps_of_runs_and_a_growing_list(spark, tables):
    catalog, locations, done = tables(10, 90, 0.4)
    c, lo, d = frames(spark, catalog, locations[:70], done)
    first = grid.location_numbers(lo)
    one = grid.done_bitmaps(d.where("asin < 'B000000005'"), first)
    two = grid.done_bitmaps(d.where("asin >= 'B000000003'"), first)
    assert pairs(grid.done_pairs(grid.merge_bitmaps(one, two), first)) == pairs(grid.done_pairs(grid.done_bitmaps(d, first), first))
    # A new list: some locations gone, others in front; numbers that were given stay.
    later = spark.createDataFrame([(-5 - i, *x[1:]) for i, x in enumerate(locations[60:])], LOCATIONS)
    numbers = grid.location_numbers(later, first.select("pincode", "number"))
    held = {r["pincode"]: r["number"] for r in numbers.collect()}
    assert len(set(held.values())) == len(held) == 30 and all(held[p] == i for i, (_, p, _) in enumerate(locations[:70]) if p in held) and min(held[p] for _, p, _ in locations[70:]) == 70
    kept = grid.done_bitmaps(d, first)
    gone = {(a, p) for a, p, _ in done if a and p}
    want = [(a, p) for _, a, *_ in catalog for _, p, _ in locations[60:] if (a, p) not in gone or p not in {x[1] for x in locations[:70]}]
    assert pairs(grid.todo_of_bitmaps(c, numbers, kept)) == sorted(want, key=str)
