"""Lists, tabs and work selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = {
    "crit": lambda d: d <= -10,
    "warn": lambda d: (d > -10) & (d <= -5),
    "par": lambda d: d.between(-2, 2),
    "cheap": lambda d: d > 0,
}
STOCK = {"oos": "out_of_stock", "unavail": "unavailable", "in": "in_stock"}


def list_snapshots(latest: DataFrame, q: str | None = None, diff: str | None = None, vat: str | None = None, stock: str | None = None) -> DataFrame:
    """The latest snapshots that a search, a difference band (normalised only), a VAT basis and a stock state leave."""
    df = latest
    if q:
        hit = lambda c: F.contains(F.lower(c), F.lit(q.lower()))
        df = df.where(F.coalesce(hit("short_title"), F.lit(False)) | F.coalesce(hit("sku_id"), F.lit(False)) | F.coalesce(hit("competitor_name"), F.lit(False)))
    if diff:
        df = df.where(BANDS[diff](F.col("diff_pct_normalised")))
    if vat:
        df = df.where(F.col("competitor_vat") == vat)
    if stock:
        df = df.where(F.col("availability") == STOCK[stock])
    return df


def worst_differentials(latest: DataFrame) -> DataFrame:
    """Latest rows with a difference and a usable page, in the order of raw difference when sorted by the caller."""
    return latest.where(~F.col("availability").isin("unavailable", "error") & F.col("diff_pct").isNotNull())


def priced_for_competitor(latest: DataFrame, competitor_id: int | None = None) -> DataFrame:
    df = latest.where("competitor_price is not null")
    return df.where(F.col("competitor_id") == competitor_id) if competitor_id is not None else df


def alerts_tab(alerts: DataFrame, tab: str) -> DataFrame:
    kinds = {"crit": ["critical"], "warn": ["warning"], "oos": ["oos_us", "oos_competitor", "unavailable"]}
    return alerts if tab == "all" else alerts.where(F.col("alert_type").isin(kinds[tab]))


def active_alerts(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Newest undismissed alerts."""
    return alerts.where(~F.coalesce("dismissed", F.lit(False))).orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n)


def match_tab(status: Column, reviewed: Column) -> Column:
    """The tab of the match desk that a match is shown in; null for none."""
    return (
        F.when((status == "review") & ~reviewed, "review")
        .when((status == "matched") & ~reviewed, "auto")
        .when((status == "matched") & reviewed, "human")
        .when(status == "amended", "amended")
        .when(status == "rejected", "rejected")
    )


def matches_tab(queue: DataFrame, tab: str, q: str | None = None, competitor_id: int | None = None) -> DataFrame:
    df = queue.where(match_tab(F.col("match_status"), F.col("human_reviewed")) == tab)
    if q:
        df = df.where(F.exists(F.array("sku_id", "short_title", "competitor_name", "competitor_url"), lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))))
    return df.where(F.col("competitor_id") == competitor_id) if competitor_id is not None else df


def scrape_work(matches: DataFrame, skus: DataFrame, competitors: DataFrame, sku_ids: list[str] | None = None, competitor_ids: list[int] | None = None) -> DataFrame:
    """Matches whose price is to be read: confirmed or amended, with a URL, SKU known, competitor active."""
    df = matches.where(F.col("match_status").isin("matched", "amended") & F.col("competitor_url").isNotNull())
    if sku_ids:
        df = df.where(F.col("sku_id").isin(sku_ids))
    if competitor_ids:
        df = df.where(F.col("competitor_id").isin(competitor_ids))
    return df.join(skus.select("sku_id"), "sku_id", "left_semi").join(competitors.where("active").select("competitor_id"), "competitor_id", "left_semi")


def needs_refresh(df: DataFrame, url_col: str, ts_col: str, now: Column, days: int = 90) -> DataFrame:
    """Rows without a URL, without a readable time, or older than so many whole days."""
    at = F.try_to_timestamp(F.col(ts_col).cast("string"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86_400)
    return df.where(F.col(url_col).isNull() | (F.col(url_col) == "") | at.isNull() | (age >= days))


def active_rows(df: DataFrame, order_col: str) -> DataFrame:
    return df.where("active").orderBy(F.asc_nulls_last(order_col))


def usable_pages(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.coalesce(F.length("html"), F.lit(0)) > 0).where(F.coalesce(F.col("profile"), F.lit("")) != "")


def page_counts(profiles: DataFrame) -> DataFrame:
    """Per competitor what ``usable_pages`` drops: harvested, no_html, no_profile."""
    empty = F.coalesce(F.length("html"), F.lit(0)) == 0
    return profiles.groupBy("competitor_id").agg(
        F.count(F.lit(1)).alias("harvested"), F.count_if(empty).alias("no_html"), F.count_if(~empty & (F.coalesce(F.col("profile"), F.lit("")) == "")).alias("no_profile")
    )


def filter_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (competitor_id, url) that their competitor's rule lets pass. A rule has accept_all, allow_paths, min_depth,
    deny_paths and product_only; a competitor without a rule takes product URLs."""
    from shelfwise.functions.text import _parts, _path, is_product_url

    path = _path(F.col("url"))
    holds = lambda a: F.exists(F.coalesce(a, F.array().cast("array<string>")), lambda s: F.contains(path, F.lower(s)))
    df = urls.join(rules.withColumnRenamed("competitor_id", "rule_for"), F.col("competitor_id") == F.col("rule_for"), "left")
    allowed = (F.size(F.coalesce("allow_paths", F.array().cast("array<string>"))) == 0) | holds(F.col("allow_paths"))
    passes = allowed & (_parts(path) >= F.coalesce("min_depth", F.lit(0))) & ~holds(F.col("deny_paths")) & (~F.coalesce("product_only", F.lit(True)) | is_product_url(F.col("url")))
    return df.where(F.coalesce("accept_all", F.lit(False)) | passes).select(*urls.columns)
