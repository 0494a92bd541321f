import random

import pytest
from pyspark.sql import functions as F

from lexstrata.operators import seen
from lexstrata.storage import shared_dir

DDL = "key string, url string, place int, batch string"


def keep_first(parts):
    out = {}
    for n, rows in enumerate(parts):
        for key, url, place, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[1])):
            out.setdefault(key, (n, url, place))
    return out


@pytest.fixture(scope="module")
def parts():
    rng = random.Random(3)
    made = [[(f"k{int(rng.paretovariate(0.4)) % 900}", f"u{i}", i, "b") for i in range(1500)] for _ in range(3)]
    return [rows + [(None, "none", 0, "b"), ("", "empty", 1, "b"), rows[0]] for rows in made]


@pytest.mark.parametrize("bits, broadcast", ((64, 500_000), (256, 10), (seen.BITS, 500_000)))
def test_increments_equal_one_pass(spark, parts, monkeypatch, bits, broadcast):
    """No row is lost or kept twice, with a filter that is full (all is looked up), by either join, or by a wide one."""
    monkeypatch.setattr(seen, "BROADCAST_ROWS", broadcast)
    store, got = shared_dir(spark), {}
    for n, rows in enumerate(parts):
        for r in seen.add(spark.createDataFrame(rows, DDL).drop("batch").repartition(3), n, store, ("place", "url"), bits).collect():
            assert r.key not in got
            got[r.key] = (n, r.url, r.place)
    assert got == keep_first(parts)


def test_an_increment_that_runs_again(spark, parts):
    store = shared_dir(spark)
    frames = [spark.createDataFrame(rows, DDL).drop("batch") for rows in parts]
    for n in (0, 1, 1):
        last = seen.add(frames[n], n, store, ("place", "url"))
    assert {r.key for r in last.collect()} == {k for k, v in keep_first(parts).items() if v[0] == 1}
    assert seen.add(frames[0], 2, store, ("place", "url")).count() == 0
    assert seen.add(frames[0].limit(0), 3, store, ("place", "url")).count() == 0


def test_the_filter_has_no_false_negatives_and_sifts(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    maybe = seen.maybe_seen(seen.filter_words(keys.where("key IS NOT NULL"), 1 << 15), 1 << 15)
    rows = spark.range(4000).select("id", maybe(seen.positions(F.concat(F.lit("k"), "id"), 1 << 15)).alias("m")).collect()
    assert all(r.m for r in rows if r.id < 2000) and sum(r.m for r in rows if r.id >= 2000) < 60


def test_odd_sizes_are_refused(spark):
    with pytest.raises(ValueError, match="multiple of 64"):
        seen.add(spark.createDataFrame([], DDL), 0, shared_dir(spark), ("place",), 100)
