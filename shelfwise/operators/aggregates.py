"""Counters and summaries; all by partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import coalesce_falsy, tier
from shelfwise.operators.filters import active_alerts, match_tab, worst_differentials
from shelfwise.operators.windows import worst_n


def shown_diff() -> Column:
    """Normalised, else raw difference, zero counting as missing; 0 where there is none."""
    return F.coalesce(coalesce_falsy(F.col("diff_pct_normalised"), F.col("diff_pct")), F.lit(0.0))


def dashboard_metrics(latest: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: critical, warning, cheapest, oos, review_queue."""
    d = shown_diff()
    counts = latest.agg(
        F.count_if(d <= -10).alias("critical"),
        F.count_if((d > -10) & (d <= -5)).alias("warning"),
        F.count_if(d > 0).alias("cheapest"),
        F.count_if(F.col("availability") == "out_of_stock").alias("oos"),
    )
    queue = matches.agg(F.count_if(F.col("match_status") == "review").alias("review_queue"))
    return counts.crossJoin(F.broadcast(queue))  # one row by one row


def dashboard(latest: DataFrame, matches: DataFrame, runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """The desk's first screen as one table: section (metric, last_run, alert, worst), place in it, and sku_id,
    competitor_id, amount; a metric's name, or the last run's status and id, stand in their places. ``alerts`` has
    created_at, id and dismissed."""
    none = lambda kind: F.lit(None).cast(kind)
    metrics = dashboard_metrics(latest, matches)
    named = F.posexplode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("n")) for c in metrics.columns))).alias("place", "m")
    parts = [metrics.select(named).select(F.lit("metric").alias("section"), (F.col("place") + 1).cast("long").alias("place"), F.col("m.name").alias("sku_id"), none("long").alias("competitor_id"), F.col("m.n").alias("amount"))]
    last = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1)
    parts.append(last.select(F.lit("last_run").alias("section"), F.lit(1).cast("long").alias("place"), F.col("status").alias("sku_id"), F.col("id").cast("long").alias("competitor_id"), none("double").alias("amount")))
    # The two lists are short by their nature: 50 and 10 rows
    for section, rows, amount, order in (("alert", active_alerts(alerts), "diff_pct", [F.desc("created_at"), F.desc("id")]), ("worst", worst_n(worst_differentials(latest)), "diff_pct", [F.asc("diff_pct"), F.asc("sku_id"), F.asc("competitor_id")])):
        place = F.row_number().over(Window.orderBy(*order)).cast("long")
        parts.append(rows.select(F.lit(section).alias("section"), place.alias("place"), "sku_id", F.col("competitor_id").cast("long").alias("competitor_id"), F.col(amount).cast("double").alias("amount")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def competitor_stats(latest: DataFrame, red: float = 10, amb: float = 5, par: float = 2) -> DataFrame:
    """Tier counts of each competitor; no difference counts as parity."""
    t = tier(F.col("diff_pct_normalised"), red, amb, par)
    return latest.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(t == "r").alias("critical"),
        F.count_if(t == "a").alias("warning"),
        F.count_if(t == "g").alias("cheaper"),
        F.count_if(t.isin("p", "par")).alias("parity"),
    )


def competitor_totals(stats: DataFrame) -> DataFrame:
    """stats with a grand-total row (is_total = 1)."""
    names = ["matched", "critical", "warning", "cheaper", "parity"]
    return stats.rollup("competitor_id").agg(*(F.sum(c).alias(c) for c in names), F.grouping("competitor_id").cast("int").alias("is_total"))


def tier_counts(latest: DataFrame, competitor_id: int) -> DataFrame:
    return competitor_stats(latest.where(F.col("competitor_id") == competitor_id))


def match_summary(matches: DataFrame) -> DataFrame:
    """Per SKU: rejected, human, auto and review matches (the first rule that fits), newest change, and a sorting score."""
    status, reviewed = F.col("match_status"), F.coalesce("human_reviewed", F.lit(False))
    kind = (
        F.when(status == "rejected", "rejected")
        .when((F.col("match_source") == "human") | reviewed, "human")
        .when((F.col("match_source") == "scraper_auto") | (status == "matched"), "auto")
        .when(status == "review", "review")
    )
    n = {k: F.count_if(kind == k) for k in ("rejected", "human", "auto", "review")}
    df = matches.groupBy("sku_id").agg(*(c.alias(f"n_{k}") for k, c in n.items()), F.max("updated_at").alias("last_change"))
    return df.withColumn("score", F.col("n_human") * 3 + F.col("n_auto") * 2 + F.col("n_review"))


def match_tab_counts(queue: DataFrame) -> DataFrame:
    tab = match_tab(F.col("match_status"), F.col("human_reviewed"))
    return queue.select(tab.alias("tab")).where("tab is not null").groupBy("tab").agg(F.count(F.lit(1)).alias("n"))


def category_counts(skus: DataFrame) -> DataFrame:
    """SKUs by cat_l4 and by cat_l5 within it ((other) for none); the row of a whole cat_l4 has is_total = 1 and says how
    many named cat_l5 there are."""
    df = skus.where("cat_l4 is not null").withColumn("l5", F.coalesce("cat_l5", F.lit("(other)")))
    counts = df.rollup("cat_l4", "l5").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cat_l5").alias("named"), F.grouping("l5").cast("int").alias("is_total"), F.grouping("cat_l4").cast("int").alias("is_all")
    )
    return counts.where("is_all = 0").drop("is_all")


def run_stats(snapshots: DataFrame) -> DataFrame:
    a = F.col("availability")
    return snapshots.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(a != "error").alias("succeeded"),
        F.count_if(a == "error").alias("failed"),
        F.count_if(a == "out_of_stock").alias("oos"),
        F.count("competitor_price").alias("prices_found"),
    )


def flush_stats(matches: DataFrame, mode: str = "discovery") -> DataFrame:
    """Confirmed and review counts of found matches; a price run counts priced pairs as confirmed instead."""
    found = F.col("competitor_url").isNotNull()
    if mode == "matched":
        return matches.agg(F.count("competitor_price").alias("confirmed"), F.lit(0).cast("long").alias("review"))
    return matches.agg(F.count_if(found & (F.col("confidence") >= 80)).alias("confirmed"), F.count_if(found & (F.col("confidence") < 80)).alias("review"))


def sku_progress(matches: DataFrame, batch_id: str) -> DataFrame:
    c = F.col("confidence")
    return matches.groupBy(F.lit(batch_id).alias("batch_id"), "sku_id").agg(
        F.count("competitor_url").alias("pairs_found"), F.count_if(c >= 80).alias("pairs_confirmed"), F.count_if((c > 0) & (c < 80)).alias("pairs_review")
    )


def batch_progress(progress: DataFrame, total: int = 2634, per_day: int = 570) -> DataFrame:
    """Done, percent, remaining and days to go of each batch."""
    done = progress.groupBy("batch_id").agg(F.count(F.lit(1)).alias("done"))
    left = F.greatest(F.lit(0), F.lit(total) - F.col("done"))
    return done.withColumns({"pct": F.floor(F.col("done") / total * 100 + 0.5).cast("long"), "remaining": left.cast("long"), "days_left": F.ceil(left / per_day).cast("long")})


def run_report(runs: DataFrame) -> DataFrame:
    """Duration in minutes, pairs and hit rate of each run."""
    pairs = F.coalesce(coalesce_falsy(F.col("pairs_attempted"), F.col("skus_attempted")), F.lit(0))
    rate = F.floor(F.try_divide(F.col("prices_found") * 100.0, pairs) + 0.5).cast("long")
    minutes = F.floor((F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")) / 60 + 0.5).cast("long")
    return runs.select("id", "status", minutes.alias("minutes"), pairs.cast("long").alias("pairs"), rate.alias("hit_rate"))


def diff_histogram(latest: DataFrame, red: float = 10, amb: float = 5, par: float = 2) -> DataFrame:
    """One row: cheaper, parity (|d| < par), amber, red, oos."""
    d = shown_diff()
    return latest.agg(
        F.count_if(d > 0).alias("cheaper"),
        F.count_if(F.abs(d) < par).alias("parity"),
        F.count_if((d <= -amb) & (d > -red)).alias("amber"),
        F.count_if(d <= -red).alias("red"),
        F.count_if(F.col("availability") == "out_of_stock").alias("oos"),
    )


def competitor_settings(competitors: DataFrame) -> DataFrame:
    return competitors.agg(F.count_if("active").alias("active"), F.count_if(F.col("vat_status") == "unknown").alias("unknown_vat"))


def discovery_stats(pages: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per competitor: pages harvested, fetched, empty, without a match, and decisions written."""
    p = pages.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("harvested"), F.count("html").alias("fetched"), F.count_if(F.coalesce(F.length("html"), F.lit(0)) == 0).alias("empty")
    )
    c = candidates.select("competitor_id", "url").distinct().groupBy("competitor_id").agg(F.count(F.lit(1)).alias("with_candidates"))
    d = decisions.groupBy("competitor_id").agg(F.count(F.lit(1)).alias("written"))
    df = p.join(c, "competitor_id", "left").join(d, "competitor_id", "left").fillna(0, ["with_candidates", "written"])
    return df.withColumn("no_match", F.col("fetched") - F.col("empty") - F.col("with_candidates"))


def validate(df: DataFrame, rules: dict[str, Column], parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One row: how many rows break each rule (a condition that must hold; null does not break it) and how many have a
    key, other than null, that its parent table lacks."""
    counts = df.agg(*(F.count_if(~c).alias(name) for name, c in rules.items()))
    for name, (parent, key) in (parents or {}).items():
        orphans = df.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias(name))
        counts = counts.crossJoin(F.broadcast(orphans))  # one row by one row
    return counts
