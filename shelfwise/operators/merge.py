"""Merges: a keyed table and changes to it give the new table.

Plain Parquet has no MERGE, so a merge is a join by key; the result is written to a new path. Of several changes to a key
the one with the highest order wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.snapshots import PAIR


def merge_by_key(
    base: DataFrame,
    changes: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    insert: bool = True,
    protect: Column | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """``columns`` (default: all that both have) are replaced where a key has a change, whatever the change's value, null
    included; rows of base for which ``protect`` holds stay as they are; unknown keys are added if ``insert``. Of several
    changes to a key the one with the highest ``order`` wins, and among equals the one with the highest values."""
    columns = columns or [c for c in changes.columns if c in base.columns and c not in keys]
    ranked = [*dict.fromkeys([*(order or []), *columns])]  # one struct says both what wins and what it holds
    change = changes.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("row"))
    change = change.withColumn("changed", F.lit(True))
    locked = F.coalesce(protect, F.lit(False)) if protect is not None else F.lit(False)
    kept = base.withColumn("locked", locked).withColumn("there", F.lit(True))
    df = kept.join(change, keys, "full" if insert else "left")
    take = F.col("changed").isNotNull() & ~F.coalesce("locked", F.lit(False))
    return df.select(*(F.when(take, F.col(f"row.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def merge_feed(skus: DataFrame, feed: DataFrame) -> DataFrame:
    """Own feed into the catalogue; the last feed row of a SKU (feed_idx) wins."""
    return merge_by_key(skus, feed, ["sku_id"], order=["feed_idx"])


def merge_scrape_matches(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Results of a search run: confident ones are matched, others go to review; any status is overwritten."""
    sure = F.col("confidence") >= 80
    changes = found.withColumns({"match_status": F.when(sure, "matched").otherwise("review"), "match_source": F.when(sure, "scraper_auto").otherwise("scraper_search")})
    return merge_by_key(matches, changes, PAIR, ["match_status", "match_source", "confidence", "competitor_url", "updated_at"], order=["updated_at", "confidence"])


def merge_search_matches(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Search discovery puts pairs to review, but leaves those that are matched or in review."""
    changes = found.withColumn("match_status", F.lit("review"))
    return merge_by_key(matches, changes, PAIR, ["match_status", "confidence", "competitor_url", "updated_at"], protect=F.col("match_status").isin("matched", "review"), order=["updated_at", "confidence"])


def merge_sitemap_matches(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sitemap decisions put pairs to review; only matched pairs are protected."""
    changes = decisions.withColumns({"match_status": F.lit("review"), "human_reviewed": F.lit(False)})
    return merge_by_key(matches, changes, PAIR, ["match_status", "human_reviewed", "confidence", "competitor_url", "updated_at"], protect=F.col("match_status") == "matched", order=["updated_at", "confidence"])


def apply_run_results(matches: DataFrame, results: DataFrame) -> DataFrame:
    """After a price run: an amended pair whose page answered is matched again; a variant's URL replaces the old one. Of
    several answers to a pair the newest (scraped_at, where results have it) counts, among equals the highest values."""
    answer = F.struct("availability", F.coalesce("configurable_url", "variation_url", "storefront_url").alias("variant_url_"))
    at = [F.col("scraped_at")] if "scraped_at" in results.columns else []
    newest = results.groupBy(*PAIR).agg(F.max_by(answer, F.struct(*at, answer)).alias("a")).select(*PAIR, "a.*")
    df = matches.join(newest, PAIR, "left")
    promoted = (F.col("match_status") == "amended") & ~F.col("availability").isin("error", "unavailable")
    return df.withColumns(
        {"match_status": F.when(promoted, "matched").otherwise(F.col("match_status")), "competitor_url": F.coalesce("variant_url_", "competitor_url")}
    ).select(*matches.columns)


def apply_reviews(matches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review decisions (action approve or anything else, at updated_at): matched or rejected by a human."""
    changes = reviews.withColumns(
        {"match_status": F.when(F.col("action") == "approve", "matched").otherwise("rejected"), "human_reviewed": F.lit(True), "match_source": F.lit("human")}
    )
    return merge_by_key(matches, changes, PAIR, ["match_status", "human_reviewed", "match_source", "updated_at"], insert=False, order=["updated_at"])


def apply_corrections(matches: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected URLs: amended, the old URL kept, waiting for a price; a pair that is not there is added as matched."""
    old = matches.select(*PAIR, F.col("competitor_url").alias("previous_url"), F.lit(True).alias("there_"))
    changes = corrections.join(old, PAIR, "left").withColumns(
        {"match_status": F.when(F.col("there_"), "amended").otherwise("matched"), "match_source": F.lit("human"), "human_reviewed": F.lit(True), "awaiting_scrape": F.lit(True)}
    )
    base = matches
    for name, kind in (("previous_url", "string"), ("awaiting_scrape", "boolean")):
        base = base if name in base.columns else base.withColumn(name, F.lit(None).cast(kind))
    return merge_by_key(base, changes, PAIR, ["competitor_url", "previous_url", "match_status", "match_source", "human_reviewed", "awaiting_scrape", "updated_at"], order=["updated_at"])


def patch_competitors(competitors: DataFrame, patches: DataFrame) -> DataFrame:
    """Only the values that a patch gives are replaced. Of several patches that give a value the newest (patched_at, where
    patches have it) counts, among equals the highest value."""
    names = [c for c in patches.columns if c in competitors.columns and c != "competitor_id"]
    at = [F.col("patched_at")] if "patched_at" in patches.columns else []
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*at, F.col(c)))).alias(f"new_{c}") for c in names]
    p = patches.groupBy("competitor_id").agg(*newest)
    df = competitors.join(p, "competitor_id", "left")
    return df.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in names else F.col(c) for c in competitors.columns))


def apply_image_sync(skus: DataFrame, images: DataFrame) -> DataFrame:
    return merge_by_key(skus, images, ["sku_id"], ["image_url", "image_synced_at"], insert=False, order=["image_synced_at"])
