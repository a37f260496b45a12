"""Versions of keyed tables, racing writers, and counters kept up to date."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import aggregates as A
from shelfwise.operators import merge as G
from shelfwise.operators.snapshots import latest_per_pair
from shelfwise.sources import store as store_module
from shelfwise.sources.store import Conflict, Store
from shelfwise.streaming import counters as C

MATCH = "sku_id string, competitor_id long, match_status string, human_reviewed boolean, confidence int, competitor_url string, match_source string, updated_at string"


def _matches(spark, n=300, stamp="a"):
    return spark.createDataFrame([(f"S{i}", i % 7, "review", False, i % 100, f"u{i}", stamp, f"2024-01-{i % 28 + 1:02d}") for i in range(n)], MATCH)


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    base = _matches(spark)
    assert store.create(match=(base, ["sku_id", "competitor_id"], 8)) == 0
    assert sorted(map(tuple, store.read("match").collect())) == sorted(map(tuple, base.collect()))
    few = base.where("confidence in (3, 4)").withColumn("confidence", F.lit(90)).withColumn("updated_at", F.lit("2025"))
    assert store.merge("match", few, G.merge_scrape_matches, {"run": 7}) == 1
    want = G.merge_scrape_matches(base, few)
    assert sorted(map(tuple, store.read("match").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, store.read("match", 0).collect())) == sorted(map(tuple, base.collect()))
    v0, v1 = store.version(0), store.version()
    same = [b for b, p in v0["tables"]["match"]["state"].items() if v1["tables"]["match"]["state"][b] == p]
    assert v1["marks"] == {"run": 7} and 0 < len(same) == 8 - len(v1["touched"]["match"])
    # Rows can go, and buckets with them; nothing to change is a version too
    store.merge("match", base.select("sku_id", "competitor_id"), lambda rows, _: rows.where("false"))
    assert store.read("match").count() == 0 and store.version()["tables"]["match"]["state"] == {}
    assert store.merge("match", few.limit(0), G.merge_scrape_matches) == 3
    with pytest.raises(ValueError, match="other buckets"):
        store.merge("match", few.limit(1), lambda rows, _: base)
    with pytest.raises(ValueError, match="already"):
        store.create(match=(base, ["sku_id", "competitor_id"], 8))


def test_tidy_keeps_what_is_named(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create(match=(_matches(spark), ["sku_id", "competitor_id"], 4))
    for i in range(4):
        store.merge("match", _matches(spark, 5, f"m{i}"), lambda rows, c: G.merge_by_key(rows, c, ["sku_id", "competitor_id"]))
    want = sorted(map(tuple, store.read("match").collect()))
    assert store.tidy(keep=2) == 0 and store.numbers() == [3, 4]  # young folders stay
    assert store.tidy(keep=1, seconds=0) > 0 and store.numbers() == [4]
    assert sorted(map(tuple, store.read("match").collect())) == want


@pytest.mark.parametrize("local", [True, False])
def test_racing_writers(spark, tmp_path, local):
    """All begin on one version; one publishes it as the next, those on other buckets go on from there, the rest conflict."""
    store = Store(spark, str(tmp_path / "s"))
    store.local = local
    base = _matches(spark)
    store.create(match=(base, ["sku_id", "competitor_id"], 8))
    bucket = F.pmod(F.xxhash64("sku_id", "competitor_id"), F.lit(8))
    first, second = base.where(bucket < 4), base.where(bucket >= 4)
    change = [(store.begin(), rows.withColumn("match_source", F.lit(name))) for name, rows in (("one", first), ("two", second), ("late", first.limit(1)))]
    for c, rows in change:
        c.merge("match", rows, lambda old, new: G.merge_by_key(old, new, ["sku_id", "competitor_id"]))
    assert [change[0][0].commit(), change[1][0].commit()] == [1, 2]
    with pytest.raises(Conflict, match="version 1"):
        change[2][0].commit()
    assert Counter(r.match_source for r in store.read("match").collect()) == {"one": first.count(), "two": second.count()}


def test_threads_lose_nothing_and_readers_see_whole_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.range(60).selectExpr("id", "cast(0 as long) as a", "cast(0 as long) as b")
    store.create(t=(rows, ["id"], 4))
    stop, wrong = threading.Event(), []

    def add(old, new):  # reads what it changes: a lost update would show
        return old.join(new, "id", "left").select("id", (F.col("a") + F.coalesce("n", F.lit(0))).alias("a"), (F.col("b") - F.coalesce("n", F.lit(0))).alias("b"))

    def write(start):
        for k in range(3):
            Store(spark, store.root).merge("t", spark.range(start, start + 40).selectExpr("id", f"cast({k + 1} as long) as n"), add, attempts=50)

    def look():
        while not stop.is_set():
            got = store.read("t").agg(F.count("*"), F.sum("a"), F.sum("b")).first()
            if got[0] != 60 or got[1] != -got[2] or got[1] % 40:
                wrong.append(tuple(got))

    writers = [threading.Thread(target=write, args=(s,)) for s in (0, 20)]
    reader = threading.Thread(target=look)
    for t in (*writers, reader):
        t.start()
    for t in writers:
        t.join()
    stop.set(), reader.join()
    assert not wrong and store.numbers()[-1] == 6
    assert {r.id: r.a for r in store.read("t").collect()} == {i: 6 * ((i < 40) + (i >= 20)) for i in range(60)}


SNAP = "run_id long, seq int, sku_id string, competitor_id long, scraped_at string, availability string, diff_pct double, diff_pct_normalised double"


def _snap(rng, run):
    norm = rng.choice([None, 0.0, -10.0, -5.0, 2.0, *(round(rng.uniform(-20, 20), 1) for _ in range(6))])
    return (run, rng.randint(1, 3), f"S{rng.randint(0, 25)}", rng.randint(0, 3) or None, f"2024-01-{rng.randint(1, 28):02d}", rng.choice(["in_stock", "out_of_stock", None]), rng.choice([None, norm, -7.0]), norm)


def test_counters_equal_a_recount(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "s")
    batch, so_far = C.counted_batches(spark, root, 6), []
    matches = _matches(spark, 9)
    for i in range(20):
        rows = [_snap(rng, i * 100 + k) for k in range(rng.choice([0, 1, 12, 30]))]
        rows += rng.sample(so_far, min(len(so_far), rng.randint(0, 6)))  # deliveries that come again
        so_far += rows
        df = spark.createDataFrame(rows, SNAP)
        batch(df, i)
        if rng.random() < 0.3:
            batch(df, i)  # the batch again
        if i % 4 < 3:
            continue
        kept = C.read_counters(spark, root)
        whole = latest_per_pair(spark.createDataFrame(so_far, SNAP))
        for got, want in (
            (C.dashboard_of(kept, matches), A.dashboard_metrics(whole, matches)),
            (C.stats_of(kept), A.competitor_stats(whole)),
            (C.histogram_of(kept), A.diff_histogram(whole)),
        ):
            assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert sorted(map(str, map(tuple, Store(spark, root).read("latest").collect()))) == sorted(map(str, map(tuple, whole.collect())))


def test_merge_in_groups_of_buckets(spark, tmp_path, monkeypatch):
    """A merge that works on a bucket at a time gives what a merge at once gives, and leaves nothing beside the versions."""
    base = _matches(spark)
    found = base.where("confidence % 3 = 0").withColumn("confidence", F.col("confidence") + 5)
    tables = {}
    for name, together in (("whole", store_module.TOGETHER), ("groups", 1)):
        monkeypatch.setattr(store_module, "TOGETHER", together)
        store = Store(spark, str(tmp_path / name))
        store.create(match=(base, ["sku_id", "competitor_id"], 4))
        change = store.begin()
        assert len(change._groups("match", ["0", "1", "2", "3"])) == (1 if name == "whole" else 4)
        store.merge("match", found, G.merge_scrape_matches)
        tables[name] = sorted(map(str, store.read("match").collect()))
        assert len(store.folders("data")) == (2 if name == "whole" else 5)  # of the first version, and of each group
    assert tables["whole"] == tables["groups"] and len(tables["whole"]) == 300
    merged = G.merge_scrape_matches(base, found)
    assert merged._jdf.queryExecution().executedPlan().toString().count("max_by") == 0


def test_a_batch_of_counters_leaves_nothing_beside_its_version(spark, tmp_path, monkeypatch):
    """What a batch counts in and out comes from the buckets before and after it: no table is written on the way."""
    from shelfwise.sources import staging

    written = []
    monkeypatch.setattr(staging, "new_path", lambda spark, name: written.append(name) or str(tmp_path / f"staged-{len(written)}"))
    monkeypatch.setattr(store_module, "TOGETHER", 1)
    row = lambda sku, shop, at, run, d: (sku, shop, at, run, 1, "in_stock", d, d)
    rows = lambda *r: spark.createDataFrame(list(r), "sku_id string, competitor_id long, scraped_at string, run_id long, seq int, availability string, diff_pct double, diff_pct_normalised double")
    batch = C.counted_batches(spark, str(tmp_path / "s"), 4)
    batch(rows(row("a", 1, "2024-01-02", 1, -20.0), row("b", 1, "2024-01-02", 1, 3.0), row("b", 2, "2024-01-02", 1, 0.0)), 0)
    batch(rows(row("a", 1, "2024-01-01", 2, 9.0), row("b", 1, "2024-01-03", 2, -20.0), row("b", 2, "2024-01-02", 1, -20.0)), 1)
    got = {r.competitor_id: (r.matched, r.dash_critical, r.dash_cheapest) for r in C.read_counters(spark, str(tmp_path / "s")).collect()}
    assert got == {1: (2, 2, 0), 2: (1, 0, 0)} and not written
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
