"""Counters kept up to date: of each pair whose latest row changes, the old row is counted out and the new one in.

A store (``shelfwise.sources.store``) holds two tables: ``latest``, the newest enriched snapshot of each pair, and
``counters``, one row a competitor. A batch is merged with the buckets of ``latest`` that it touches; what those count for
afterwards, less what they counted for before, summed by competitor, is added to the counters.
Both tables change in one version, which also keeps the number of the batch: a batch that runs again, or half a batch whose
driver died, changes nothing. The work of a batch follows the buckets that it touches, never the number of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.scalars import tier
from shelfwise.operators.aggregates import shown_diff
from shelfwise.operators.snapshots import PAIR, latest_per_pair
from shelfwise.sources.store import Conflict, Store

BUCKETS = 64


def counted(red: float = 10, amb: float = 5, par: float = 2) -> dict[str, Column]:
    """What a latest row counts for: the dashboard, the tiers of a competitor, the histogram of differences."""
    d, t = shown_diff(), tier(F.col("diff_pct_normalised"), red, amb, par)
    return {
        "matched": F.lit(True),
        "dash_critical": d <= -10,
        "dash_warning": (d > -10) & (d <= -5),
        "dash_cheapest": d > 0,
        "oos": F.col("availability") == "out_of_stock",
        "tier_critical": t == "r",
        "tier_warning": t == "a",
        "tier_cheaper": t == "g",
        "tier_parity": t.isin("p", "par"),
        "hist_parity": F.abs(d) < par,
        "hist_amber": (d <= -amb) & (d > -red),
        "hist_red": d <= -red,
    }


def count_rows(rows: DataFrame, sign: Column | None = None) -> DataFrame:
    """competitor_id and the counters of rows, each times its sign."""
    one = F.lit(1) if sign is None else sign
    return rows.groupBy("competitor_id").agg(*(F.sum(F.when(c, one).otherwise(0)).cast("long").alias(name) for name, c in counted().items()))


def _create(spark: SparkSession, root: str, rows: DataFrame, buckets: int) -> None:
    empty = rows.limit(0)
    Store(spark, root).create(latest=(empty, PAIR, buckets), counters=(count_rows(empty), ["competitor_id"], max(1, buckets // 8)), marks={"batch": -1})


def counted_batches(spark: SparkSession, root: str, buckets: int = BUCKETS, attempts: int = 5):
    """A foreachBatch function over enriched snapshots (sku_id, competitor_id, scraped_at, run_id, seq, availability and the
    differences). Late rows never win, so the order of arrival does not matter."""

    def once(rows: DataFrame, batch_id: int) -> None:
        store = Store(spark, root)
        change = store.begin()
        if change.marks["batch"] >= batch_id:
            return
        if touched := change.merge("latest", rows, _newest):
            # What the touched buckets count for now, less what they counted for before
            now, before = change.rows("latest", touched), store.rows(change.base, "latest", touched)
            delta = count_rows(now.withColumn("sign_", F.lit(1)).unionByName(before.withColumn("sign_", F.lit(-1))), F.col("sign_"))
            change.merge("counters", delta, _added)
        change.commit({"batch": batch_id})

    def batch(rows: DataFrame, batch_id: int) -> None:
        if not Store(spark, root).numbers():
            _create(spark, root, rows, buckets)
        for left in reversed(range(attempts)):
            try:
                return once(rows, batch_id)
            except Conflict:
                if not left:
                    raise

    return batch


def _newest(kept: DataFrame, came: DataFrame) -> DataFrame:
    """The newest row of each pair; one that is kept stays when another of its time comes."""
    both = kept.withColumn("kept_", F.lit(1)).unionByName(came.select(*kept.columns).withColumn("kept_", F.lit(0)))
    return latest_per_pair(both, tie=("run_id", "seq", "kept_")).drop("kept_")


def _added(rows: DataFrame, delta: DataFrame) -> DataFrame:
    both = rows.unionByName(delta)
    return both.groupBy("competitor_id").agg(*(F.sum(c).alias(c) for c in counted()))


def read_counters(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    return Store(spark, root).read("counters", number).where("matched > 0")


def dashboard_of(counters: DataFrame, matches: DataFrame) -> DataFrame:
    """``aggregates.dashboard_metrics`` from counters: one row a competitor is read instead of one a pair."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = counters.agg(zero("dash_critical").alias("critical"), zero("dash_warning").alias("warning"), zero("dash_cheapest").alias("cheapest"), zero("oos").alias("oos"))
    queue = matches.agg(F.count_if(F.col("match_status") == "review").alias("review_queue"))
    return counts.crossJoin(F.broadcast(queue))  # one row by one row


def stats_of(counters: DataFrame) -> DataFrame:
    """``aggregates.competitor_stats`` from counters."""
    return counters.select("competitor_id", "matched", *(F.col(f"tier_{c}").alias(c) for c in ("critical", "warning", "cheaper", "parity")))


def histogram_of(counters: DataFrame) -> DataFrame:
    """``aggregates.diff_histogram`` from counters."""
    names = {"cheaper": "dash_cheapest", "parity": "hist_parity", "amber": "hist_amber", "red": "hist_red", "oos": "oos"}
    return counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in names.items()))
