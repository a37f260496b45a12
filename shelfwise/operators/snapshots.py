"""Price snapshots: enrichment, the latest of each pair, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions import text as T

PAIR = ["sku_id", "competitor_id"]


def enrich_snapshots(observations: DataFrame, skus: DataFrame, competitors: DataFrame, rule: str = "current") -> DataFrame:
    """Adds price differences to observations (run_id, seq, sku_id, competitor_id, scraped_at, raw_price, availability,
    comp_title, and page_vat for the legacy rule).

    current: VAT is the competitor's default; quantities come from the titles, ours else from unit_qty.
    legacy: the page's VAT, unless unknown, wins; our quantity is unit_qty alone; there is no pack remark.
    discovery: the price is kept without VAT, both differences are per unit and equal, and the row is marked provisional.
    Rows without a price keep null differences. Competitors are few and small next to observations; Spark broadcasts
    them where their size allows.
    """
    # What depends on the SKU alone is worked out before the join, once a SKU
    stored = F.coalesce(S.coalesce_falsy(F.col("unit_qty")), F.lit(1))
    our_qty = stored if rule != "current" else F.coalesce(T.pack_qty(F.col("short_title")), stored)
    own = skus.select("sku_id", F.col("price_ex_vat").alias("our_price"), "short_title", F.col("unit_qty").alias("our_unit_qty"), our_qty.cast("int").alias("our_qty"))
    shops = competitors.select("competitor_id", F.col("name").alias("competitor_name"), F.col("vat_status").alias("competitor_vat"))
    df = observations.join(own, "sku_id").join(shops, "competitor_id")
    if rule == "legacy" and "page_vat" in df.columns:
        known = F.col("page_vat").isNotNull() & (F.col("page_vat") != "unknown")
        df = df.withColumn("competitor_vat", F.when(known, F.col("page_vat")).otherwise(F.col("competitor_vat")))
    titled = T.pack_qty_legacy if rule == "legacy" else T.pack_qty
    # Plain columns: a job that needs none of them reads none, and the optimiser keeps a costly one that is named more than
    # once in a projection of its own
    df = df.withColumns(
        {
            "comp_qty": F.coalesce(titled(F.col("comp_title")), F.lit(1)).cast("int"),
            "their_ex": S.normalise_price(F.col("raw_price"), F.col("competitor_vat")),
        }
    )
    our, theirs = F.col("our_price"), F.col("their_ex")
    per_unit = S.diff_pct(S.per_unit_price(our, F.col("our_qty")), S.per_unit_price(theirs, F.col("comp_qty")))
    price = theirs if rule == "discovery" else F.col("raw_price")
    priced = price.isNotNull() & (price != 0)
    if rule == "discovery":
        raw, normalised, flag = per_unit, per_unit, F.lit("discovery_provisional")
    else:
        raw = S.diff_pct(our, price)
        normalised = F.when(F.col("our_qty") == F.col("comp_qty"), S.diff_pct(our, theirs)).otherwise(per_unit)
        flag = S.pack_flag(our, theirs, F.col("our_qty"), F.col("comp_qty")) if rule == "current" else F.lit(None).cast("string")
    kept = [
        "run_id", "seq", "sku_id", "competitor_id", "scraped_at", "availability", "comp_title", "competitor_vat", "competitor_name",
        "short_title", "our_price", "our_unit_qty",
    ]
    df = df.withColumns(
        {
            "competitor_price": price,
            "competitor_unit_qty": F.when(priced, F.col("comp_qty")),
            "diff_pct": F.when(priced, raw),
            "diff_pct_normalised": F.when(priced, normalised),
            "pack_qty_flag": F.when(priced, flag),
        }
    )
    return df.select(*kept, "competitor_price", "competitor_unit_qty", "diff_pct", "diff_pct_normalised", "pack_qty_flag")


def latest_per_pair(snapshots: DataFrame, keys: list[str] = PAIR, ts: str = "scraped_at", tie: tuple[str, ...] = ("run_id", "seq")) -> DataFrame:
    """The newest row of each key. An aggregate rather than a window: each task keeps one row a key before the shuffle. Keys
    come from the grouping, so a join by them needs no other shuffle."""
    rest = [c for c in snapshots.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(ts, *tie))
    found = snapshots.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(newest.alias("r"))
    return found.select(*(F.col(f"_{c}").alias(c) if c in keys else F.col(f"r.{c}").alias(c) for c in snapshots.columns))


def latest_enriched(observations: DataFrame, skus: DataFrame, competitors: DataFrame, rule: str = "current") -> DataFrame:
    """The newest observation of each pair, enriched: the price history is reduced before any title is looked at."""
    return enrich_snapshots(latest_per_pair(observations), skus, competitors, rule)


def report_prices(latest: DataFrame, competitors: DataFrame) -> DataFrame:
    """Prices as the desk shows them: sku_id, competitor_id, vat (the snapshot's, else the competitor's default, else unknown),
    our_price_inc_vat, their_ex (unrounded, no VAT), and our_per_unit and their_per_unit where we sell packs; both are
    divided by our quantity. A price of 0 counts as missing. ``competitors`` has competitor_id and default_vat."""
    rows = latest.join(competitors.select("competitor_id", "default_vat"), "competitor_id")
    vat = S.report_vat(F.col("competitor_vat"), F.col("default_vat"))
    ours, raw = S.coalesce_falsy(F.col("our_price")), S.coalesce_falsy(F.col("competitor_price"))
    pack = F.when(F.col("our_unit_qty") > 1, F.col("our_unit_qty"))
    theirs = F.when(vat == "inc", raw / 1.2).otherwise(raw)
    return rows.select(
        *PAIR, vat.alias("vat"), S.rounded(F.col("our_price") * 1.2).alias("our_price_inc_vat"), theirs.alias("their_ex"), (ours / pack).alias("our_per_unit"), (theirs / pack).alias("their_per_unit")
    )


def price_alerts(snapshots: DataFrame, crit: float = -10, warn: float = -5, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alerts from enriched snapshots; ``keep`` names columns of theirs to carry along. A normalised difference of zero
    falls back to the raw one unless ``strict``."""
    norm, raw = F.col("diff_pct_normalised"), F.col("diff_pct")
    diff = F.coalesce(norm, raw) if strict else S.coalesce_falsy(norm, raw)
    kind = F.when(F.col("availability") == "out_of_stock", "oos_competitor").when(diff <= crit, "critical").when(diff <= warn, "warning")
    df = S.once(snapshots.drop("alert_type"), alert_type=kind, alert_diff=diff).where("alert_type is not null")
    message = S.alert_message(F.col("alert_type"), F.col("competitor_name"), F.col("short_title"), F.col("alert_diff"), F.col("competitor_price"), F.col("our_price"))
    return df.select(
        "run_id", "seq", "sku_id", "competitor_id", "alert_type", message.alias("message"), F.col("alert_diff").alias("diff_pct"), "our_price",
        F.col("competitor_price").alias("their_price"), *keep,
    )


def price_changes(snapshots: DataFrame) -> DataFrame:
    """Price drops and rises against the priced observation before, per pair (an extension)."""
    w = Window.partitionBy(*PAIR).orderBy("scraped_at", "run_id", "seq")
    before = F.lag("competitor_price").over(w)
    df = snapshots.where("competitor_price is not null").withColumn("price_before", before)
    kind = F.when(F.col("competitor_price") < F.col("price_before"), "price_drop_them").when(F.col("competitor_price") > F.col("price_before"), "price_rise_them")
    return df.withColumn("alert_type", kind).where("alert_type is not null").select("run_id", "seq", *PAIR, "alert_type", "price_before", "competitor_price")
