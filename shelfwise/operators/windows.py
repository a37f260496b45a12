"""Boards and choices that need the order of rows within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import normalise_price


def latest_discovery(runs: DataFrame) -> DataFrame:
    """The newest discovery run of each competitor."""
    return runs.groupBy(F.col("competitor_id").alias("_c")).agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "id")).alias("r")).select("r.*")


def with_own_price(latest: DataFrame) -> DataFrame:
    """Competitors' prices without VAT and, once a SKU, our own."""
    theirs = latest.select("sku_id", F.col("competitor_name").alias("seller"), F.lit(False).alias("is_us"), normalise_price(F.col("competitor_price"), F.col("competitor_vat")).alias("ex_price"))
    ours = latest.groupBy("sku_id").agg(F.max("our_price").alias("ex_price")).select("sku_id", F.lit("us").alias("seller"), F.lit(True).alias("is_us"), "ex_price")
    return theirs.unionByName(ours)


def price_board(latest: DataFrame) -> DataFrame:
    """Rank of every seller of a SKU by price; no price or zero comes last. A SKU has as many rows as competitors."""
    key = F.coalesce(F.when(F.col("ex_price") != 0, F.col("ex_price")), F.lit(999999.0))
    w = Window.partitionBy("sku_id").orderBy(key, F.desc("is_us"), "seller")
    return with_own_price(latest).withColumn("position", F.row_number().over(w).cast("long"))


def top_candidates(scored: DataFrame, n: int = 20) -> DataFrame:
    """The n best SKUs of each competitor product; equal scores by sku_id."""
    w = Window.partitionBy("competitor_id", "url").orderBy(F.desc("score"), "sku_id")
    return scored.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def contenders(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the rows that ``best_variant`` may choose: the best, and the best in stock. With the columns by which the rows
    are dealt already among the keys nothing is moved, so of all rows one or two a key are moved later."""
    so_far = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("in_stock"), "variant_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = scored.withColumns({"nth_": F.count(F.lit(1)).over(so_far), "nth_there_": F.count_if("in_stock").over(so_far)})
    return df.where((F.col("nth_") == 1) | (F.col("in_stock") & (F.col("nth_there_") == 1))).drop("nth_", "nth_there_")


def best_variant(scored: DataFrame, keys: list[str], margin: int | Column = 10) -> DataFrame:
    """The variant with the highest score, in stock first among equals; if it is out of stock, the first in stock that
    lies within ``margin`` of it (a number, or a column of ``best_score_``)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("in_stock"), "variant_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = scored.withColumns({"place_": F.row_number().over(w), "best_score_": F.first("score").over(whole), "best_stock_": F.first("in_stock").over(whole)})
    near = df.where((F.col("place_") == 1) | (~F.col("best_stock_") & F.col("in_stock") & (F.col("best_score_") - F.col("score") <= margin)))
    pick = Window.partitionBy(*keys).orderBy(F.desc("in_stock"), "place_")
    return near.withColumn("pick_", F.row_number().over(pick)).where("pick_ = 1").drop("place_", "best_score_", "best_stock_", "pick_")


def accept_decisions(decisions: DataFrame, min_conf: int = 40, margin: int = 10) -> DataFrame:
    """Decisions of each page in their order, up to the first that is too weak or too far below the first."""
    w = Window.partitionBy("competitor_id", "url").orderBy("decision_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("confidence").over(so_far)
    fails = (F.col("confidence") < min_conf) | ((F.row_number().over(w) > 1) & (F.col("confidence") < first - margin))
    df = decisions.withColumn("fails_", F.coalesce(fails, F.lit(True)).cast("int"))
    return df.withColumn("failed_", F.sum("fails_").over(so_far)).where("failed_ = 0").drop("fails_", "failed_")


def first_claim(decisions: DataFrame) -> DataFrame:
    """A (sku, competitor) pair belongs to the earliest page that claims it."""
    w = Window.partitionBy("sku_id", "competitor_id").orderBy("harvest_idx", "decision_idx")
    return decisions.withColumn("claim_", F.row_number().over(w)).where("claim_ = 1").drop("claim_")


def last_complete_run(runs: DataFrame, n: int = 20) -> DataFrame:
    """Of the newest n runs the latest complete one, else the newest."""
    newest = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(n)
    return newest.orderBy(F.desc(F.col("status") == "complete"), F.desc("started_at"), F.desc("id")).limit(1)


def worst_n(worst: DataFrame, n: int = 10) -> DataFrame:
    return worst.orderBy(F.asc("diff_pct"), "sku_id", "competitor_id").limit(n)


def page_of(df: DataFrame, page: int, order: list[Column], limit: int = 50, cap: int = 200) -> DataFrame:
    """A page of a list in a total order. Deep pages sort what comes before; ``after`` below and ``ranks.Ranked`` do not."""
    limit = min(limit, cap)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def after(df: DataFrame, last: tuple, columns: list[str], limit: int = 50) -> DataFrame:
    """The rows that follow a known last row, by keyset: no offset to skip."""
    beyond = F.lit(False)
    for c, v in reversed(list(zip(columns, last, strict=True))):
        beyond = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & beyond)
    return df.where(beyond).orderBy(*columns).limit(limit)


def newest_runs(runs: DataFrame, limit: int = 20, cap: int = 100) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(min(limit, cap))


def review_by_confidence(matches: DataFrame, skus: DataFrame, competitors: DataFrame) -> DataFrame:
    df = matches.where("match_status = 'review'")
    return (
        df.join(skus.select("sku_id", "short_title"), "sku_id")
        .join(competitors.select("competitor_id", F.col("name").alias("competitor_name")), "competitor_id")
        .orderBy("confidence", "sku_id", "competitor_id")
    )


def sort_by(df: DataFrame, column: str, descending: bool = False, kind: str = "text", ties: tuple[str, ...] = ("sku_id", "competitor_id", "id")) -> DataFrame:
    """Sorted as the tables of the desk are: text by lower case, no price last, no difference or date as zero. Equal ones by
    ``ties``, as far as df has them."""
    c = F.col(column)
    key = {
        "text": F.coalesce(F.lower(c), F.lit("")),
        "price": F.coalesce(c, F.lit(999999.0)) if kind == "price" else c,
        "diff": F.coalesce(c, F.lit(0.0)) if kind == "diff" else c,
        "date": F.coalesce(F.unix_timestamp(c), F.lit(0)) if kind == "date" else c,
    }[kind]
    return df.orderBy(key.desc() if descending else key.asc(), *(x for x in ties if x in df.columns))
