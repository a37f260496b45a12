"""Parts of the price history: appends, compaction along the curve, look-ups by statistics, racing writers."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.sources.history import History, curve
from shelfwise.sources.store import Conflict

SCHEMA = "sku_id string, competitor_id long, scraped_at timestamp_ntz, price double, `odd name` string"


def _rows(spark, n, seed, hot=False):
    rnd = random.Random(seed)
    sku = lambda: "HOT" if hot and rnd.random() < 0.4 else f"S{rnd.randrange(200)}"
    found = spark.createDataFrame([(sku(), rnd.randrange(40), rnd.randrange(10**6), rnd.random(), f"x{i}") for i in range(n)], "sku_id string, competitor_id long, s long, price double, `odd name` string")
    return found.select("sku_id", "competitor_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz").alias("scraped_at"), "price", "odd name")


def _set(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_curve_alternates_the_bits_of_both(spark):
    row = spark.range(1).select(
        F.shiftrightunsigned(F.xxhash64(F.lit("a")), 48).alias("x"), F.shiftrightunsigned(F.xxhash64(F.lit(7)), 48).alias("y"), curve(F.lit("a"), F.lit(7)).alias("z")
    ).first()
    assert row.z == sum(((row.x >> i & 1) << 2 * i) | ((row.y >> i & 1) << 2 * i + 1) for i in range(16))


def test_fewer_files_for_a_look_up(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), per_file=250)
    first = _rows(spark, 250, 0)
    h.create(first.schema)
    whole = first
    h.append(first)
    for i in range(1, 16):
        rows = _rows(spark, 250, i, hot=i % 2 == 0)
        whole = whole.unionByName(rows)
        h.append(rows.select(*reversed(rows.columns)))
    whole = whole.cache()
    before = {"pair": h.files_of("S7", 3), "sku": h.files_of("S7"), "shop": h.files_of(None, 3)}
    assert h.compact(fan=16) == 16
    (part,) = h.version()["parts"]
    assert (part["level"], part["rows"]) == (1, 4000) and part["files"] >= 16
    after = {"pair": h.files_of("S7", 3), "sku": h.files_of("S7"), "shop": h.files_of(None, 3)}
    # Before, every part holds some of a SKU or of a shop
    assert len(before["sku"]) >= 16 and len(before["shop"]) >= 16
    assert len(after["pair"]) <= 1 and len(after["sku"]) <= 8 and len(after["shop"]) <= 8
    assert _set(h.read()) == _set(whole)
    for sku, shop in (("S7", 3), ("S7", None), (None, 3), ("HOT", None), ("HOT", 5), ("none", 1), (None, None)):
        want = whole.where((F.lit(sku is None) | (F.col("sku_id") == sku)) & (F.lit(shop is None) | (F.col("competitor_id") == shop)))
        assert _set(h.of(sku, shop)) == _set(want)
        since = "2023-11-20 00:00:00"
        assert _set(h.of(sku, shop, since)) == _set(want.where(F.col("scraped_at") >= F.lit(since).cast("timestamp_ntz")))
    # A SKU of a third of all rows lies in several files
    assert len(h.files_of("HOT")) > 2


def test_levels_versions_and_tidy(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    h.create(_rows(spark, 1, 0).schema)
    assert h.read().count() == 0 and h.files_of("S1") == [] and h.compact() == 0
    for i in range(8):
        h.append(_rows(spark, 20, i).coalesce(1))
        h.compact(fan=2)
    assert [(p["level"], p["rows"]) for p in h.version()["parts"]] == [(3, 160)]
    eighth = h.append(_rows(spark, 20, 9))
    assert h.read().count() == 180 and h.read(eighth - 1).count() == 160
    assert h.tidy(keep=1, seconds=3600) == 0
    assert h.tidy(keep=1, seconds=0) > 10
    assert h.read().count() == 180 and h.store.numbers() == [eighth]


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    rows = spark.createDataFrame([(None, None, None, None, None), ("A", None, None, 1.0, "t"), (None, 2, None, 1.0, "t"), ("A", 2, None, 1.0, "t"), ("A", 2, None, 1.0, "t")], SCHEMA)
    h.create(rows.schema)
    assert h.append(rows.limit(0)) == 0
    for _ in range(2):
        h.append(rows)
    h.compact(fan=2)
    assert _set(h.read()) == _set(rows.unionByName(rows))
    assert h.of("A").count() == 6 and h.of("A", 2).count() == 4 and h.of(None, 2).count() == 6 and h.of("A", 2, "2000-01-01").count() == 0
    with pytest.raises(ValueError, match="columns"):
        h.append(rows.drop("price"))
    with pytest.raises(Conflict, match="already"):
        h.create(rows.schema)
    with pytest.raises(ValueError, match="needs the columns"):
        History(spark, str(tmp_path / "other")).create(rows.drop("sku_id").schema)


def test_racing_writers(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    h.create(_rows(spark, 1, 0).schema)
    for i in range(3):
        h.append(_rows(spark, 30, i))
    version = h.version()
    gathered = h._gathered(version, version["parts"], 1)
    h.append(_rows(spark, 30, 7))  # comes between: it stays
    h._replace(version["parts"], gathered)
    assert h.read().count() == 120 and sorted(p["level"] for p in h.version()["parts"]) == [0, 1]
    with pytest.raises(Conflict):
        h._replace(version["parts"], gathered)
    assert h.read().count() == 120


def test_a_batch_counts_once(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    h.create(_rows(spark, 1, 0).schema)
    for batch in (0, 1, 1, 0):
        h.append(_rows(spark, 10, batch), batch=batch)
    h.append(_rows(spark, 5, 3))
    h.append(_rows(spark, 10, 1), batch=1)
    assert h.read().count() == 25
