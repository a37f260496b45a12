"""Ranks over a whole table, and pages of it, without one task that sorts everything.

A table in rank order is written by ranges of the order, a folder each; how many rows each range has is known, so the rank
of a row is the rows in the ranges before plus its place in its own. Page 10,000 then reads the one or two ranges that it
lies in.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.staging import new_path


class Ranked:
    """``df`` in a total order (ties of equal rows aside). ``parts``: number of ranges; default the session's number of
    shuffle partitions. Columns must not be named rank, part_ or at_."""

    def __init__(self, df: DataFrame, order: list[Column], parts: int | None = None, path: str | None = None):
        self.spark = df.sparkSession
        self.path = path or new_path(self.spark, "ranked")
        parts = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Of an id that counts a partition's rows the lower 33 bits are the place in it
        sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
        placed = sorted_.withColumns({"part_": F.shiftright("at_", 33).cast("int"), "at_": F.col("at_").bitwiseAND((1 << 33) - 1)})
        placed.write.partitionBy("part_").parquet(self.path)
        self.schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, at_ long, part_ int"
        sizes = dict(self._table().groupBy("part_").count().collect())  # a row a range
        self.firsts = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)), initial=0))
        self.count = self.firsts[-1]

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _ranked(self, table: DataFrame, parts: range) -> DataFrame:
        """``rank`` from 1; the first ranks of the ranges stand in the plan as a small map."""
        first = F.element_at(F.array(*(F.lit(self.firsts[p]) for p in parts)), F.col("part_") - parts.start + 1)
        return table.select("*", (first + F.col("at_") + 1).alias("rank")).drop("part_", "at_")

    def all(self) -> DataFrame:
        return self._ranked(self._table(), range(max(1, len(self.firsts) - 1)))

    def between(self, first: int, last: int) -> DataFrame:
        """Rows of rank first to last, in order; reads the ranges that hold them."""
        first, last = max(1, first), min(last, self.count)
        if first > last:
            return self.all().limit(0)
        parts = range(bisect_right(self.firsts, first - 1) - 1, bisect_right(self.firsts, last - 1))
        inside = self._table().where(F.col("part_").isin(*parts))
        return self._ranked(inside, parts).where(F.col("rank").between(first, last)).orderBy("rank")

    def page(self, page: int, limit: int = 50, cap: int = 200) -> DataFrame:
        limit = min(limit, cap)
        return self.between((page - 1) * limit + 1, page * limit)


def ranked_within(df: DataFrame, group: str, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """df with ``name``: 1, 2, ... within each ``group`` in the order. A group with very many rows is spread over ranges."""
    ranked = Ranked(df, [F.col(group).asc_nulls_first(), *order], parts).all()
    firsts = ranked.groupBy(F.col(group).alias("group_")).agg(F.min("rank").alias("first_"))
    joined = ranked.join(firsts, F.col(group).eqNullSafe(F.col("group_")))
    return joined.select(*df.columns, (F.col("rank") - F.col("first_") + 1).alias(name))
