"""Feeds, sitemaps, category pages; snapshot and report sinks."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import feed_price, feed_unit_qty, url_slug
from shelfwise.operators.filters import alerts_tab
from shelfwise.operators.ranks import ranked_within
from shelfwise.sources.staging import staged

FEED_TAGS = ["id", "mpn", "title", "short_title", "link", "price", "availability", "google_product_category", "material", "color", "image_link"]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Own product feed (XML items) as SKU rows."""
    schema = ", ".join(f"`g:{t}` string" for t in FEED_TAGS)
    return feed_rows(spark.read.format("xml").option("rowTag", "item").schema(schema).load(path))


def feed_rows(raw: DataFrame) -> DataFrame:
    """Items, a column of text a tag, as SKU rows."""
    g = lambda t: F.trim(F.coalesce(F.col(f"`g:{t}`"), F.lit("")))
    or_null = lambda t: F.nullif(g(t), F.lit(""))
    return raw.select(
        g("id").alias("sku_id"), or_null("mpn").alias("mpn"), F.coalesce(or_null("short_title"), F.substring(g("title"), 1, 80)).alias("short_title"),
        g("title").alias("full_title"), url_slug(g("link")).alias("slug"), feed_price(g("price")).alias("price_ex_vat"),
        F.coalesce(or_null("availability"), F.lit("in stock")).alias("availability"), or_null("google_product_category").alias("category"),
        or_null("material").alias("material"), or_null("color").alias("color"), feed_unit_qty(g("title")).alias("unit_qty"),
        or_null("image_link").alias("image_url"), g("link").alias("product_url"),
    )


def split_valid_feed(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be used, and those without SKU, price (zero is none) or URL."""
    ok = (F.coalesce("sku_id", F.lit("")) != "") & (F.coalesce("price_ex_vat", F.lit(0.0)) != 0) & (F.coalesce("product_url", F.lit("")) != "")
    return feed.where(ok), feed.where(~ok)


def sitemap_urls(sitemaps: DataFrame, cap: int | None = None) -> DataFrame:
    """sitemaps (competitor_id, sitemap_url, xml, is_root) to (competitor_id, url, harvest_idx). Index files lead to the
    sitemaps that they name, level by level until none is left (a file that leads back to itself is not opened again);
    duplicates stay; ``cap`` keeps the first URLs of each competitor."""
    locs = F.transform(F.regexp_extract_all(F.coalesce("xml", F.lit("")), F.lit(r"(?s)<(?:\w+:)?loc[^>]*>\s*(.*?)\s*</(?:\w+:)?loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    is_index = F.coalesce(F.col("xml").rlike(r"<(?:\w+:)?sitemapindex"), F.lit(False))
    all_maps = staged(sitemaps.select("competitor_id", "sitemap_url", is_index.alias("is_index"), locs.alias("locs"), F.coalesce("is_root", F.lit(False)).alias("is_root")), "sitemaps")
    roots = all_maps.where("is_root").select("competitor_id", "sitemap_url").distinct()
    level = all_maps.drop("is_root").join(roots, ["competitor_id", "sitemap_url"], "left_semi").withColumn("trail", F.array(F.col("sitemap_url")))
    found = None
    while True:
        level = staged(level, "sitemap-level")
        urls = level.where(~F.col("is_index")).select("competitor_id", "sitemap_url", F.posexplode("locs").alias("pos", "url"))
        found = urls if found is None else found.unionByName(urls)
        children = level.where("is_index").select("competitor_id", "trail", F.explode("locs").alias("sitemap_url")).where(~F.array_contains("trail", F.col("sitemap_url")))
        if children.isEmpty():
            break
        level = children.join(all_maps.drop("is_root"), ["competitor_id", "sitemap_url"]).withColumn("trail", F.array_append("trail", F.col("sitemap_url")))
    out = ranked_within(found, "competitor_id", [F.asc("sitemap_url"), F.asc("pos"), F.asc("url")], "harvest_idx")
    return (out.where(F.col("harvest_idx") <= cap) if cap else out).select("competitor_id", "url", "harvest_idx")


def _absolute(batches):
    for b in batches:
        urls = [urljoin(base or "", href or "") for base, href in zip(b.column("url").to_pylist(), b.column("href").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("competitor_id"), b.column("page_no"), pa.array(urls, pa.string())], names=["competitor_id", "page_no", "link"])


def category_links(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (competitor_id, page_no, url, html) and rules (competitor_id, pattern) to the distinct product links, up to
    the first page after the first that adds nothing new. Relative links are joined by a vectorised helper: Spark has no
    function for it."""
    hrefs = pages.select("competitor_id", F.col("page_no").cast("int").alias("page_no"), "url", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href=["']([^"'#]+)"""), 1)).alias("href"))
    kind = dict(pages.dtypes)["competitor_id"]
    links = hrefs.mapInArrow(_absolute, f"competitor_id {kind}, page_no int, link string")
    by = rules.select(F.col("competitor_id").alias("rule_for"), "pattern")
    kept = links.join(by, F.col("competitor_id") == F.col("rule_for")).where(F.regexp_like("link", F.col("pattern")))
    first = kept.groupBy("competitor_id", F.col("link").alias("url")).agg(F.min("page_no").alias("page_no"))
    fresh = first.groupBy("competitor_id", "page_no").agg(F.count(F.lit(1)).alias("new"))
    every = pages.select("competitor_id", F.col("page_no").cast("int").alias("page_no")).distinct().join(fresh, ["competitor_id", "page_no"], "left")
    stop = every.where("page_no > 1 and new is null").groupBy(F.col("competitor_id").alias("c")).agg(F.min("page_no").alias("stop"))
    return first.join(stop, F.col("competitor_id") == F.col("c"), "left").where("stop is null or page_no < stop").select("competitor_id", "url")


def append_snapshots(snapshots: DataFrame, path: str, per_file: int = 2_000_000, by: str = "day") -> None:
    """Appends to the price history, one folder a day (snapshot_date), or with ``by="month"`` a folder a month
    (snapshot_month) where days are small. Rows are dealt out by ranges of day and pair, so a folder with many rows is written
    by many tasks, and one with few by one."""
    dated = snapshots.withColumn("snapshot_date", F.to_date("scraped_at"))
    folder = "snapshot_date"
    if by == "month":
        folder = "snapshot_month"
        dated = dated.withColumn(folder, F.date_format("snapshot_date", "yyyy-MM"))
    dealt = dated.repartitionByRange(folder, F.xxhash64("sku_id", "competitor_id"))
    dealt.write.mode("append").option("maxRecordsPerFile", per_file).partitionBy(folder).parquet(path)


def alert_fields(alerts: DataFrame, tab: str) -> DataFrame:
    """The eight columns of the alert file as text; null and zero become empty."""
    blank = lambda c: F.when(F.col(c).isNull() | (F.col(c) == 0), "").otherwise(F.col(c).cast("string")).alias(c)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return alerts_tab(alerts, tab).select(
        text("alert_type"), text("sku_id"), text("short_title"), text("competitor_name"), blank("our_price"), blank("their_price"), blank("diff_pct"), text("message")
    )


def export_alerts_csv(alerts: DataFrame, tab: str, path: str) -> None:
    """Eight quoted columns; null and zero become empty."""
    rows = alert_fields(alerts, tab)
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def export_variant_report(changes: DataFrame, path: str) -> None:
    """The changes of a variant repair; maps as JSON."""
    plain = [F.to_json(F.col(c)).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in changes.dtypes]
    changes.select(*plain).write.option("header", True).csv(path)


def read_table(spark: SparkSession, source: str, table: str | None = None, column: str | None = None, bounds: tuple | None = None, parts: int | None = None, **options: str) -> DataFrame:
    """A Parquet path, or with ``table`` a table of a JDBC source. With ``column``, ``bounds`` and ``parts`` a JDBC table is
    read in so many ranges at once; rows outside the bounds are in the first and last range."""
    if not table:
        return spark.read.parquet(source)
    if column is None:
        return spark.read.jdbc(source, table, properties=options)
    lower, upper = bounds
    return spark.read.jdbc(source, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)


def write_table(df: DataFrame, target: str, mode: str = "errorifexists", table: str | None = None, parts: int | None = None, **options: str) -> None:
    """To a Parquet path, or with ``table`` to a table of a JDBC target over at most ``parts`` connections."""
    if not table:
        df.write.mode(mode).parquet(target)
        return
    rows = df.coalesce(parts) if parts else df
    rows.write.jdbc(target, table, mode=mode, properties=options)
