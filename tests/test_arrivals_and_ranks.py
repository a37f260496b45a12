"""Streams that arrive out of order, and ranks by ranges."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.operators.ranks import Ranked, ranked_within
from shelfwise.operators.snapshots import price_changes
from shelfwise.plans import kept
from shelfwise.sources import io
from shelfwise.streaming import changes, intake, streams
from shelfwise.streaming.changes import _events, _pruned, net_changes, stream_price_changes

SNAP = "sku_id string, competitor_id long, scraped_at timestamp, run_id long, seq int, competitor_price double"


def _history(spark, n=700, seed=6):
    rng = random.Random(seed)
    rows = [(f"S{rng.randint(0, 30)}", rng.randint(0, 3), i, rng.randint(1, 3), f"2024-01-{rng.randint(1, 28):02d} 0{rng.randint(0, 9)}:00:00", rng.choice([None, 1.0, 1.0, 2.5, 3.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "sku_id string, competitor_id long, run_id long, seq int, at string, competitor_price double")
    return df.select("sku_id", "competitor_id", F.col("at").cast("timestamp").alias("scraped_at"), "run_id", "seq", "competitor_price")


@pytest.mark.parametrize("delay, files", [("3650 days", 5), ("3650 days", 1)])
def test_changes_of_shuffled_arrivals(spark, tmp_path, delay, files):
    history = _history(spark)
    for i, part in enumerate(history.randomSplit([1.0] * files, 3)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        if i == 1:
            part.coalesce(1).write.parquet(str(tmp_path / "in" / "again"))  # delivered twice
    stream = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    log = stream_price_changes(stream, delay)
    q = log.writeStream.format("parquet").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "log"))
    want = price_changes(history)
    assert Counter(map(tuple, net_changes(got).select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    assert (got.where("op < 0").count() > 0) == (files > 1)


def test_old_observations_are_let_go(spark, tmp_path):
    """Days that come in order, a watermark of two days: state keeps what may still change, events stay right."""
    history = _history(spark)
    days = [r.d for r in history.select(F.to_date("scraped_at").alias("d")).distinct().orderBy("d").collect()]
    stream = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = None
    for i in range(0, len(days), 7):  # a query that is started anew goes on from its checkpoint
        history.where(F.to_date("scraped_at").isin(days[i : i + 7])).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
        stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in" / "*"))
        q = stream_price_changes(stream, "2 days").writeStream.format("parquet").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    want = price_changes(history)
    assert Counter(map(tuple, net_changes(spark.read.parquet(str(tmp_path / "log"))).select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    seen = [(t, t, 1, float(t % 3)) for t in range(10)]
    assert _pruned(seen, 4) == seen[4:] and _pruned(seen, -1) == seen and _pruned(seen, 99) == seen[-1:] and len(_events(seen)) == 9


def test_pairs_of_a_slot_are_worked_out_together(spark, tmp_path):
    """What a slot says and keeps is what its pairs say and keep one by one, whatever comes late, twice or without a price."""
    rng = random.Random(9)
    state, seen = None, {}
    for watermark in (-1, 20, 35, 60):
        rows = [(f"S{rng.randint(0, 9)}", rng.choice([None, 1, 2**53 + 1]), rng.randint(max(0, watermark + 1), 90), rng.randint(0, 10**6), rng.randint(1, 3), rng.choice([np.nan, 1.0, 1.0, 2.5, 3.0])) for _ in range(300)]
        frame = pd.DataFrame(rows + rows[:40], columns=["sku_id", "competitor_id", "at", "run_id", "seq", "competitor_price"])
        frame["competitor_id"] = pd.Series([r[1] for r in rows + rows[:40]], dtype=object)
        log, left, _ = changes._slot(state, [frame[:100], frame[100:]], watermark)
        want = Counter()
        for pair in {r[:2] for r in rows} | set(seen):
            before = seen.get(pair, [])
            after = sorted(set(before) | {r[2:] for r in rows if r[:2] == pair and r[5] == r[5]})
            said, now = _events(before), _events(after)
            want.update((-1, *at, *pair, *e) for at, e in said.items() if now.get(at) != e)
            want.update((1, *at, *pair, *e) for at, e in now.items() if said.get(at) != e)
            seen[pair] = _pruned(after, watermark)
        assert Counter(log.itertuples(index=False, name=None)) == want
        assert Counter(left.itertuples(index=False, name=None)) == Counter((*pair, *x) for pair, kept in seen.items() for x in kept)
        state = changes._packed(left)
    # Many pairs are a bounded number of states
    prices = spark.range(20_000).select(F.concat(F.lit("S"), "id").alias("sku_id"), F.lit(7).cast("long").alias("competitor_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "id")
    history = prices.select(*changes.PAIR, F.timestamp_seconds(F.col("n") * 100).alias("scraped_at"), F.col("id").alias("run_id"), F.col("n").cast("int").alias("seq"), F.col("n").cast("double").alias("competitor_price"))
    history.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    q = stream_price_changes(stream, "3650 days").writeStream.format("parquet").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= changes.SLOTS
    assert net_changes(spark.read.parquet(str(tmp_path / "log"))).where("price_before = 1 and competitor_price = 2").count() == 20_000


def test_pages_read_their_range(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(0, 40) or None) for i in range(2000)], "id long, v int")
    order = [F.asc_nulls_last("v"), F.desc("id")]
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    ranked = Ranked(df, order, parts=9, path=str(tmp_path / "r"))
    assert ranked.count == 2000 and [tuple(r)[:2] for r in ranked.all().orderBy("rank").collect()] == want
    for page in (1, 2, 7, 20, 21, 500):
        assert [tuple(r) for r in ranked.page(page, 100).collect()] == [(*r, (page - 1) * 100 + i + 1) for i, r in enumerate(want[(page - 1) * 100 : page * 100])]
    assert ranked.page(3, 1000).count() == 200  # the cap
    plan = ranked.page(9, 100)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part_#\d+ IN \(\d+,\d+\)", plan) and "SinglePartition" not in plan
    empty = Ranked(df.where("id < 0"), order, path=str(tmp_path / "e"))
    assert empty.count == 0 and empty.page(1).count() == 0 and empty.all().count() == 0


def test_ranks_within_a_group(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 500), ("b", 3), (None, 4)) for i in range(n)], "g string, i int")
    got = ranked_within(df, "g", [F.desc("i")], "n", parts=5).collect()
    assert Counter((r.g, r.n) for r in got) == Counter((g, k + 1) for g, n in (("a", 500), ("b", 3), (None, 4)) for k in range(n))
    assert all(r.n == {"a": 500, "b": 3, None: 4}[r.g] - r.i for r in got)


def test_sitemaps_of_any_depth(spark):
    deep = [(1, f"i{k}", f"<sitemapindex><sitemap><loc>i{k + 1}</loc></sitemap><loc>i0</loc></sitemapindex>", k == 0) for k in range(6)] + [(1, "i6", "<urlset><loc> u1 </loc><loc>u2</loc></urlset>", False), (2, "x", None, True), (2, "y", "<loc>never</loc>", None)]
    maps = spark.createDataFrame(deep, "competitor_id int, sitemap_url string, xml string, is_root boolean")
    assert sorted(map(tuple, io.sitemap_urls(maps).collect())) == [(1, "u1", 1), (1, "u2", 2)]
    assert [r.url for r in io.sitemap_urls(maps, cap=1).collect()] == ["u1"]


def test_no_repeat_is_stored_however_late(spark, tmp_path):
    root, told = str(tmp_path / "in"), []
    batch = intake.intake_batches(spark, root, told=told)
    rows = _history(spark, 3000).dropDuplicates(list(intake.KEYS)).cache()
    parts = rows.randomSplit([1.0] * 4, 5)
    for i, part in enumerate(parts):
        again = [p.limit(40) for p in parts[:i]]  # months later, and twice in a batch
        df = part
        for p in again:
            df = df.unionByName(p).unionByName(p)
        batch(df, i)
        if i == 1:
            batch(df, i)  # the batch again
            intake.compact(spark, root)
    got = intake.read_history(spark, root)
    assert Counter(map(tuple, got.select(*rows.columns).collect())) == Counter(map(tuple, rows.collect()))
    assert sum(t["repeats"] for t in told) > 100 and all(t["repeats"] <= t["seeming"] for t in told)
    assert sum(t["seeming"] - t["repeats"] for t in told) <= 0.02 * sum(t["rows"] for t in told)


def test_filters_know_what_they_were_told():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 60_000)
    table = lambda k: pa.table({"day_": pa.array([None] * len(k), pa.date32()), "part_": pa.array([0] * len(k), pa.int32()), "key_": pa.array(k)})
    built = [intake._build(table(keys[a : a + 10_000])) for a in (0, 10_000, 20_000)]
    both = intake._merge(pa.concat_tables(built))
    assert intake._ask(table(keys[:30_000]), both).column("seems_").to_numpy().all()
    false = intake._ask(table(keys[30_000:]), both).column("seems_").to_numpy().mean()
    assert 0 < false < 0.02


def _run(spark, stream, tmp_path, mode="append"):
    """The query, ended, and the rows of each batch."""
    batches = []
    keep = lambda df, i: batches.append(df.collect())
    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q, batches


def test_state_of_streams_lies_on_disk(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("run_id"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("scraped_at"), F.lit("in_stock").alias("availability"), F.lit(1.0).alias("raw_price"), *(F.col("id").cast("string").alias(c) for c in changes.PAIR))
    rows.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("stats", streams.stream_run_stats(read()), "update"), ("once", streams.dedupe_stream(read()), "append")):
        q, batches = _run(spark, stream, tmp_path / name, mode)
        assert sum(map(len, batches)) == 500
        assert any(k.startswith("rocksdb") for k in q.recentProgress[0]["stateOperators"][0]["customMetrics"])


def test_all_tasks_write_what_arrives(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("run_id")).repartition(4)
    half = {i: set(r.run_id for r in rows.where(F.pmod(F.xxhash64("run_id"), F.lit(2)) == i).collect()) for i in range(2)}
    for twice in (False, True):
        stream = kept.arrivals(SimpleNamespace(spark=spark), rows, twice)
        files = stream.select(F.input_file_name().alias("f"), "run_id")
        _, batches = _run(spark, files, tmp_path / str(twice))
        assert len({r.f for r in batches[0]}) >= 4
        assert Counter(r.run_id for r in batches[0]) == {k: 1 + twice for k in half[0]}
        assert Counter(r.run_id for b in batches[1:] for r in b) == {k: 1 + twice for k in half[1]}
