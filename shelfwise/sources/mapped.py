"""The driver's star-schema tables as price-monitoring tables (FIXTURES.md §2), and the same as SQL for the oracles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A setting of the session: partitions that the price history is dealt out to.
SCAN = "spark.shelfwise.scanPartitions"


@dataclass
class Mapped:
    """Tables are made when first asked for; each scan reads only the columns that a job uses."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """A file of one row group is one scan task, however many cores there are. Where the session sets ``SCAN`` the rows
        are dealt out to so many partitions; by default the scan stays as it is."""
        n = self.spark.conf.get(SCAN, None)
        return df.repartition(int(n)) if n else df

    @cached_property
    def part(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        tail = (
            F.when(key % 4 == 0, F.concat(F.lit(" pack of "), size.cast("string")))
            .when(key % 4 == 1, F.concat(F.lit(" x"), size.cast("string")))
            .when(key % 4 == 2, F.concat(F.lit(" "), (size * 10).cast("string"), F.lit("mm x "), (size * 5).cast("string"), F.lit("mm")))
            .otherwise("")
        )
        title = F.concat(F.when(key % 17 == 0, "Custom Printed ").otherwise(""), F.col("p_name"), F.lit(" A"), (size % 8).cast("string"), tail)
        return self.raw("part").select(
            key.alias("p_partkey"),
            F.concat(F.lit("SKU-"), key.cast("string"), F.when(key % 17 == 0, "-PRINTED").otherwise("")).alias("sku_id"),
            title.alias("short_title"),
            F.col("p_retailprice").alias("price_ex_vat"),
            F.when(key % 5 == 0, size).alias("unit_qty"),
            F.col("p_brand").alias("cat_l4"),
            F.when(key % 6 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("cat_l5"),
            (key % 20 != 0).alias("active"),
            F.col("p_name"),
            F.col("p_size"),
        )

    @cached_property
    def sku(self) -> DataFrame:
        return self.part.drop("p_name", "p_size", "p_partkey")

    @cached_property
    def competitor(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("competitor_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("www."), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example")).alias("domain"),
            F.when(key % 3 == 0, "ex").when(key % 3 == 1, "inc").otherwise("unknown").alias("vat_status"),
            (key % 10 != 9).alias("active"),
        )

    @cached_property
    def observation(self) -> DataFrame:
        """One row a price observation, before enrichment."""
        line = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
        line = self.spread(line)
        own = self.part.select("p_partkey", "sku_id", "price_ex_vat", "p_name", "p_size")
        q, n = F.col("l_quantity"), F.col("l_linenumber")
        raw = F.floor(F.col("price_ex_vat") * (F.lit(0.8) + 4 * F.col("l_discount")) * (F.lit(1) + F.col("l_tax") / 10) * 100) / 100
        title = F.concat(
            F.col("p_name"), F.lit(" A"), ((F.col("p_size") + n % 2) % 8).cast("string"),
            F.when(n % 3 == 0, F.concat(F.lit(" pack of "), q.cast("int").cast("string"))).when(n % 3 == 1, "").otherwise(F.concat(F.lit(" x"), F.col("p_size").cast("string"))),
        )
        return (
            line.join(own, F.col("l_partkey") == F.col("p_partkey"))
            .join(self.competitor.select(F.col("competitor_id").alias("c_id")), F.col("l_suppkey") == F.col("c_id"))
            .select(
                F.col("l_orderkey").alias("run_id"),
                n.alias("seq"),
                "sku_id",
                F.col("l_suppkey").alias("competitor_id"),
                F.col("l_shipdate").alias("scraped_at"),
                F.when(q % 10 != 0, raw.cast("double")).alias("raw_price"),
                F.when(q == 50, "error").when(q % 10 == 0, "unavailable").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "out_of_stock").otherwise("in_stock").alias("availability"),
                title.alias("comp_title"),
            )
        )

    @cached_property
    def match(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        code = (p * 7 + s * 13) % 6
        status = F.when(code == 0, "matched").when(code == 1, "review").when(code == 2, "rejected").when(code == 3, "amended").when(code == 4, "matched").otherwise("pending")
        return (
            self.raw("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("updated_at")).select(
                F.concat(F.lit("SKU-"), p.cast("string"), F.when(p % 17 == 0, "-PRINTED").otherwise("")).alias("sku_id"),
                s.alias("competitor_id"),
                status.alias("match_status"),
                ((p + s) % 2 == 0).alias("human_reviewed"),
                ((p * 31 + s * 17) % 101).cast("int").alias("confidence"),
                F.when(p % 9 != 0, F.concat(F.lit("https://shop.example/p/"), p.cast("string"), F.lit("-"), s.cast("string"))).alias("competitor_url"),
                F.when((p + s) % 3 == 0, "human").when((p + s) % 3 == 1, "scraper_auto").otherwise("scraper_search").alias("match_source"),
                "updated_at",
            )
        )

    @cached_property
    def run(self) -> DataFrame:
        k = F.col("o_orderkey")
        s = F.col("o_orderstatus")
        return self.raw("orders").select(
            k.alias("id"),
            F.when(s == "F", "complete").when(s == "O", "running").otherwise("partial").alias("status"),
            F.col("o_orderdate").alias("started_at"),
            (F.col("o_orderdate") + F.make_dt_interval(mins=(k % 180).cast("int"))).alias("completed_at"),
            (k % 40).alias("pairs_attempted"),
            (k % 25).alias("skus_attempted"),
            (k % 20).alias("prices_found"),
            (k % 97).alias("competitor_id"),
        )


SQL = """
WITH sku AS (
  SELECT p_partkey, p_name, p_size,
         concat('SKU-', p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '-PRINTED' ELSE '' END) AS sku_id,
         concat(CASE WHEN p_partkey % 17 = 0 THEN 'Custom Printed ' ELSE '' END, p_name, ' A', p_size % 8,
                CASE p_partkey % 4 WHEN 0 THEN concat(' pack of ', p_size)
                                   WHEN 1 THEN concat(' x', p_size)
                                   WHEN 2 THEN concat(' ', p_size * 10, 'mm x ', p_size * 5, 'mm')
                                   ELSE '' END) AS short_title,
         CASE WHEN p_partkey % 4 IN (0, 1) AND p_size BETWEEN 2 AND 500 THEN p_size END AS title_qty,
         p_retailprice AS price_ex_vat,
         CASE WHEN p_partkey % 5 = 0 THEN p_size END AS unit_qty,
         p_brand AS cat_l4,
         CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS cat_l5,
         p_partkey % 20 <> 0 AS active
  FROM part),
competitor AS (
  SELECT s_suppkey AS competitor_id, s_name AS name,
         concat('www.', lower(replace(s_name, '#', '-')), '.example') AS domain,
         CASE s_suppkey % 3 WHEN 0 THEN 'ex' WHEN 1 THEN 'inc' ELSE 'unknown' END AS vat_status,
         s_suppkey % 10 <> 9 AS active
  FROM supplier),
observation AS (
  SELECT l_orderkey AS run_id, l_linenumber AS seq, k.sku_id, c.competitor_id, l_shipdate AS scraped_at,
         CASE WHEN l_quantity % 10 = 0 THEN NULL
              ELSE floor(k.price_ex_vat * (0.8 + 4 * l_discount) * (1 + l_tax / 10) * 100) / 100 END AS raw_price,
         CASE WHEN l_quantity = 50 THEN 'error' WHEN l_quantity % 10 = 0 THEN 'unavailable'
              WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'out_of_stock' ELSE 'in_stock' END AS availability,
         concat(p_name, ' A', (p_size + l_linenumber % 2) % 8,
                CASE l_linenumber % 3 WHEN 0 THEN concat(' pack of ', CAST(l_quantity AS INT))
                                      WHEN 1 THEN '' ELSE concat(' x', p_size) END) AS comp_title,
         CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_quantity BETWEEN 2 AND 500 THEN CAST(l_quantity AS INT) END
                               WHEN 1 THEN NULL ELSE CASE WHEN p_size BETWEEN 2 AND 500 THEN p_size END END AS comp_title_qty
  FROM lineitem JOIN sku k ON k.p_partkey = l_partkey JOIN competitor c ON c.competitor_id = l_suppkey),
match AS (
  SELECT concat('SKU-', l_partkey, CASE WHEN l_partkey % 17 = 0 THEN '-PRINTED' ELSE '' END) AS sku_id,
         l_suppkey AS competitor_id,
         CASE (l_partkey * 7 + l_suppkey * 13) % 6 WHEN 0 THEN 'matched' WHEN 1 THEN 'review' WHEN 2 THEN 'rejected'
              WHEN 3 THEN 'amended' WHEN 4 THEN 'matched' ELSE 'pending' END AS match_status,
         (l_partkey + l_suppkey) % 2 = 0 AS human_reviewed,
         CAST((l_partkey * 31 + l_suppkey * 17) % 101 AS INT) AS confidence,
         CASE WHEN l_partkey % 9 <> 0 THEN concat('https://shop.example/p/', l_partkey, '-', l_suppkey) END AS competitor_url,
         CASE (l_partkey + l_suppkey) % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'scraper_auto' ELSE 'scraper_search' END AS match_source,
         max(l_shipdate) AS updated_at
  FROM lineitem GROUP BY l_partkey, l_suppkey),
run AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'partial' END AS status,
         o_orderdate AS started_at, o_orderdate + to_minutes(CAST(o_orderkey % 180 AS INT)) AS completed_at,
         o_orderkey % 40 AS pairs_attempted, o_orderkey % 25 AS skus_attempted, o_orderkey % 20 AS prices_found,
         o_orderkey % 97 AS competitor_id
  FROM orders),
prepared AS (
  SELECT o.*, s.price_ex_vat AS our_price, s.short_title, s.unit_qty AS our_unit_qty, c.name AS competitor_name,
         c.vat_status AS competitor_vat,
         CASE WHEN c.vat_status = 'inc' THEN round_even(o.raw_price / 1.2 * 100, 0) / 100 ELSE o.raw_price END AS their_ex,
         CAST(CASE WHEN s.title_qty > 1 THEN s.title_qty ELSE coalesce(nullif(s.unit_qty, 0), 1) END AS INT) AS our_qty,
         CAST(coalesce(o.comp_title_qty, 1) AS INT) AS comp_qty
  FROM observation o JOIN sku s USING (sku_id) JOIN competitor c USING (competitor_id)),
enriched AS (
  SELECT *,
         CASE WHEN raw_price IS NOT NULL THEN comp_qty END AS competitor_unit_qty,
         CASE WHEN our_price = 0 THEN 0.0 ELSE round_even((raw_price - our_price) / our_price * 100 * 100, 0) / 100 END AS diff_pct,
         CASE WHEN our_qty = comp_qty THEN round_even((their_ex - our_price) / our_price * 100 * 100, 0) / 100
              ELSE round_even((their_unit - our_unit) / our_unit * 100 * 100, 0) / 100 END AS diff_pct_normalised,
         raw_price IS NOT NULL AND our_qty = comp_qty AND greatest(our_price, their_ex) / least(our_price, their_ex) >= 1.5 AS is_suspect
  FROM (SELECT *, CASE WHEN comp_qty > 1 THEN round_even(their_ex / comp_qty * 1000000, 0) / 1000000 ELSE their_ex END AS their_unit,
               CASE WHEN our_qty > 1 THEN round_even(our_price / our_qty * 1000000, 0) / 1000000 ELSE our_price END AS our_unit
        FROM prepared)),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY sku_id, competitor_id ORDER BY scraped_at DESC, run_id DESC, seq DESC) AS rn
    FROM enriched) WHERE rn = 1)
"""
