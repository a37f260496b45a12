"""Prices, differences and labels: columns in, columns out. Null in, null out unless said otherwise.

Rounding is ``rint(x * 100) / 100``: half to even on the product, the same in Spark and in the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added, each evaluated once a row. A later filter or projection would otherwise copy their
    expressions to every place that names them; a generator of one row stands in the way of that."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def rounded(x: Column, places: int = 2) -> Column:
    return F.rint(x * F.lit(10.0**places)) / F.lit(10.0**places)


def coalesce_falsy(*columns: Column) -> Column:
    """The first column that is neither null nor zero, else null."""
    return F.coalesce(*(F.when(c != 0, c) for c in columns))


def diff_pct(our: Column, their: Column) -> Column:
    """Their price against ours in percent; 0 where ours is 0."""
    return F.when(our == 0, F.lit(0.0)).otherwise(rounded(F.try_divide(their - our, our) * 100))


def normalise_price(price: Column, vat: Column) -> Column:
    """Price without VAT; an unknown basis counts as without."""
    return F.when(vat == "inc", rounded(price / 1.2)).otherwise(price)


def per_unit_price(price: Column, quantity: Column) -> Column:
    return F.when(quantity > 1, rounded(price / quantity, 6)).otherwise(price)


def tier(diff: Column, red: float = 10, amb: float = 5, par: float = 2) -> Column:
    """r, a, g, p; par for null."""
    return (
        F.when(diff.isNull(), "par").when(diff <= -red, "r").when(diff <= -amb, "a").when(diff >= par, "g").otherwise("p")
    )


def pack_flag(our: Column, their_ex: Column, our_qty: Column, comp_qty: Column) -> Column:
    """A remark where quantities agree but prices lie 1.5 times apart or more."""
    ratio = F.try_divide(F.greatest(our, their_ex), F.least(our, their_ex))
    says = F.format_string("raw price gap %.1f× with no pack signal — verify pack sizes", ratio)
    return F.when((our_qty == comp_qty) & (our != 0) & (their_ex != 0) & (ratio >= 1.5), says)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 80, "high").when(c >= 60, "medium").when(c > 0, "low")


def shown_unit_price(price: Column, quantity: Column, norm: Column, raw: Column) -> Column:
    """Own price per unit where the unit price drives the difference."""
    return F.when((quantity > 1) & (F.abs(norm - raw) > 0.5), price / quantity).otherwise(price)


def bar_width(diff: Column) -> Column:
    return F.least(F.lit(100.0), F.abs(diff) * 4)


def age_label(ts: Column, now: Column) -> Column:
    """just now, minutes or hours today, yesterday, else the date."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(ts)
    days = F.datediff(now, ts)
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(days == 0, "today")
        .when(days == 1, "yesterday")
        .otherwise(F.date_format(ts, "d MMM"))
    )


def price_score(comp: Column, own: Column, quantity: Column) -> Column:
    """0, 5, 10 or 20 by how near the prices lie, with and without VAT, a piece or a pack."""

    def points(candidate: Column) -> Column:
        ratio = F.try_divide(candidate, own)
        return (
            F.when(ratio.between(0.7, 1.3), 20).when(ratio.between(0.5, 2.0), 10).when(ratio.between(0.3, 3.0), 5).otherwise(0)
        )

    single = F.greatest(points(comp), points(comp / 1.2))
    packed = F.when(quantity > 1, F.greatest(points(comp / quantity), points(comp / 1.2 / quantity))).otherwise(0)
    usable = comp.isNotNull() & own.isNotNull() & (comp != 0) & (own != 0)
    return F.when(usable, F.greatest(single, packed)).otherwise(0).cast("int")


def alert_message(kind: Column, competitor: Column, title: Column, diff: Column, their: Column, our: Column) -> Column:
    """Text of an alert; ``diff`` is brought to one decimal first."""
    gone = F.concat(competitor, F.lit(" is out of stock for "), title, F.lit(" — last known £"), F.coalesce(their.cast("string"), F.lit("?")))
    lower = F.format_string("%s is %.1f%% cheaper — £%.2f vs your £%.2f", competitor, rounded(F.abs(diff), 1), their, our)
    return F.when(kind == "oos_competitor", gone).otherwise(lower)


def report_vat(snapshot_vat: Column, default_vat: Column) -> Column:
    return F.coalesce(snapshot_vat, default_vat, F.lit("unknown"))


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted array; null if empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
