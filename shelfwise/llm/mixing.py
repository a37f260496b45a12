"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions alone.

1. A source's target is its weight's part of the mix, at most ``most`` times its own size; what the capped sources leave
   is shared again by weight. The fill level solves sum(min(cap, level * weight)) = mix size, and follows in closed form
   from running sums over sources ordered by cap / weight.
2. Documents are dealt to shards of a source by a hash of doc_id; a shard's documents, in hash order, form one run of
   words that is cut into blocks of ``block`` words.
3. All (source, shard) cells compete for the blocks of the mix: each next block goes to the cell with the highest
   quotient weight / (2 * seats + 1). The first seats come from a divisor that cannot give too many; only the rest,
   fewer than there are cells, are ranked by quotient.
4. A cell with n blocks and q seats takes each block q div n times, and q mod n of them once more; those are chosen by a
   seeded permutation of block numbers. A document takes the words of its part in each block.

Defined cases: null text has size 0 and takes nothing; a very long text is counted whole and spans many blocks; a null
source is a source of its own, the last in order; sources or tables without words have target 0; repeated rows are
separate rows, and rows that tie in doc_id and size are alike, so their order changes nothing; null doc_ids hash as the
word null. Only doc_id, text and source are read, so other columns may have any name. Shards hold about ``shard`` words; for very large inputs they grow, so that there are never
more than 4096 of them plus one a source, and what is broadcast (one row a source or a cell) is counted first: beyond
10,000 rows it is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD, read, settle, staged

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK, SHARD, CELLS = 128, 65_536, 4096
SEED, STEP = "mix-1", 1_000_003
SMALL = 10_000
#: Multiples of this, modulo 1, are spread evenly.
GOLDEN = 0.6180339887498949


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hex(value: Column) -> Column:
    """A number from the first 32 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long")


def _within(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def source_targets(sized: DataFrame) -> DataFrame:
    """mix_source, source_size, target, n_shards; one row a source."""
    sources = sized.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    filled = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = sources.withColumn("weight", weight.cast("double")).withColumns(
        {
            "cap": (F.lit(MOST) * F.col("source_size")).cast("double"),
            "words": F.sum("source_size").over(every),
        }
    )
    df = df.withColumns({"ratio": F.col("cap") / F.col("weight"), "mix": F.lit(SHARE) * F.col("words")})
    df = df.withColumns(
        {"cap_below": F.sum("cap").over(filled), "weight_left": F.sum("weight").over(every) - F.sum("weight").over(filled)}
    )
    df = df.withColumn("full", F.col("cap_below") + F.col("ratio") * F.col("weight_left") <= F.col("mix"))
    caps = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    df = df.withColumn(
        "target", F.when(F.col("full"), F.col("cap")).otherwise((F.col("mix") - caps) / open_weight * F.col("weight"))
    )
    per_shard = F.greatest(F.lit(float(SHARD)), F.col("words") / F.lit(float(CELLS)))
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)).cast("long")
    return df.select("mix_source", "source_size", "target", n_shards.alias("n_shards"))


def dealt(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with source_size, target, deal_key and shard."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.md5(F.concat(F.lit(f"{SEED}-"), name).cast("binary"))
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
        .drop("mix_source")
        .withColumn("deal_key", key)
        .withColumn("shard", F.conv(F.substring("deal_key", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
        .drop("n_shards")
    )


def cell_quotas(rows: DataFrame) -> DataFrame:
    """cell_source, cell_shard, n_blocks, quota; one row a (source, shard)."""
    cells = rows.groupBy(F.col("source").alias("cell_source"), F.col("shard").alias("cell_shard")).agg(
        F.sum("size").alias("cell_size"), F.max("target").alias("t"), F.max("source_size").alias("s")
    )
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.where("cell_size > 0").withColumn("w", F.col("t") * F.col("cell_size") / F.col("s"))
    cells = cells.withColumn("all_w", F.round(F.sum(F.round("w", 6).cast("decimal(30,6)")).over(every), 3).cast("double"))
    cells = cells.withColumns({"n": F.count(F.lit(1)).over(every), "house": F.floor(F.col("all_w") / BLOCK + 0.5)})
    sure = F.floor(F.col("w") / F.col("all_w") * (F.col("house") - F.col("n") / 2) + 0.5)
    cells = cells.withColumns(
        {
            "first": F.greatest(F.lit(0), F.when(F.col("all_w") > 0, sure).otherwise(0)).cast("long"),
            "upto": F.when(F.col("all_w") > 0, F.ceil(F.col("w") / F.col("all_w") * (F.col("house") + F.col("n") / 2)) + 1)
            .otherwise(0)
            .cast("long"),
        }
    )
    cells = cells.withColumn("left", (F.col("house") - F.sum("first").over(every)).cast("long"))
    tries = cells.select("cell_source", "cell_shard", "w", "left", F.explode(F.sequence("first", F.greatest("first", "upto"))).alias("seat"))
    highest = Window.orderBy(F.desc(F.col("w") / (2 * F.col("seat") + 1)), F.asc_nulls_last("cell_source"), "cell_shard", "seat")
    more = (
        tries.withColumn("place", F.row_number().over(highest))
        .where("place <= left")
        .groupBy(F.col("cell_source").alias("more_source"), F.col("cell_shard").alias("more_shard"))
        .agg(F.count(F.lit(1)).alias("more"))
    )
    n_blocks = F.ceil(F.col("cell_size") / BLOCK).cast("long")
    return cells.join(
        more, F.col("cell_source").eqNullSafe(F.col("more_source")) & (F.col("cell_shard") == F.col("more_shard")), "left"
    ).select(
        "cell_source",
        "cell_shard",
        n_blocks.alias("n_blocks"),
        F.least(MOST * n_blocks, F.col("first") + F.coalesce("more", F.lit(0))).alias("quota"),
    )


def words_taken(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """rows with taken: words that the mix takes from each document, repeats counted."""
    run = (
        Window.partitionBy("source", "shard")
        .orderBy("deal_key", F.asc_nulls_last("doc_id"), "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    df = rows.withColumn("end", F.sum("size").over(run)).withColumn("start", F.col("end") - F.col("size"))
    df = df.join(quotas, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("shard") == F.col("cell_shard")), "left")
    start_at = _hex(F.concat(F.lit(f"{SEED}-"), F.coalesce("source", F.lit("null")), F.lit("-"), F.col("shard").cast("string")))
    df = df.withColumns(
        {
            "once": F.floor(F.col("quota") / F.col("n_blocks")).cast("long"),
            "extra": F.col("quota") % F.col("n_blocks"),
            "stride": F.when(F.col("n_blocks") % STEP == 0, F.lit(1)).otherwise(F.lit(STEP)).cast("long"),
            "seeded": start_at % F.col("n_blocks"),
        }
    )

    def part(total: Column, k: Column) -> Column:
        overlap = F.least("end", (k + 1) * BLOCK) - F.greatest("start", k * BLOCK)
        chosen = (k * F.col("stride") + F.col("seeded")) % F.col("n_blocks") < F.col("extra")
        return total + overlap * (F.col("once") + chosen.cast("long"))

    blocks = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    taken = F.when((F.col("size") > 0) & F.col("quota").isNotNull(), F.aggregate(blocks, F.lit(0).cast("long"), part)).otherwise(
        F.lit(0).cast("long")
    )
    return df.withColumn("taken", taken)


def mixed(sized: DataFrame) -> DataFrame:
    """``sized`` has doc_id, source, size, and may carry more; gives it source_size, target and taken."""
    rows = dealt(sized, _within(source_targets(sized)))
    return words_taken(rows, _within(cell_quotas(rows)))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    docs = read(spark, sf_dir, "documents")
    sized = staged(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in(F.col("text")).alias("size")), "op9-sizes")
    return mixed(sized).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, in whole copies. Along a cell's documents, longest
    first, the copies so far are the running sum of taken / size plus the cell's offset, rounded down; so a cell's words
    differ from those taken by less than its longest document, and offsets that are spread evenly over the cells let
    these differences cancel."""
    settle(spark)
    columns = docs.columns
    slim = staged(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes")
    targets = _within(source_targets(slim))
    quotas = _within(cell_quotas(dealt(slim, targets)))
    rows = dealt(docs.withColumn("size", words_in(F.col("text"))), targets)
    longest = Window.partitionBy("source", "shard").orderBy(F.desc("size"), "deal_key", F.asc_nulls_last("doc_id"), "taken")
    so_far = F.sum(F.col("taken") / F.col("size")).over(longest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offset = (F.lit(0.5) + F.col("shard") * GOLDEN) % 1
    # Sums of fractions that make up a whole number may end just below it
    upto = F.floor(F.col("so_far") + offset + 1e-9)
    before = F.floor(F.col("so_far") - F.col("taken") / F.col("size") + offset + 1e-9)
    return (
        words_taken(rows, quotas)
        .where("size > 0")
        .withColumn("so_far", so_far)
        .withColumn("copies", (upto - before).cast("int"))
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select(*columns)
    )


#: The same in DuckDB's SQL.
OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
         CAST(2 * source_size AS DOUBLE) AS cap, sum(source_size) OVER () AS words FROM src),
ratios AS (SELECT *, cap / weight AS ratio, 1.5 * CAST(words AS DOUBLE) AS mix FROM weighted),
levels AS (
  SELECT *, sum(cap) OVER f AS cap_below, sum(weight) OVER () - sum(weight) OVER f AS weight_left
  FROM ratios WINDOW f AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (SELECT *, cap_below + ratio * weight_left <= mix AS is_full FROM levels),
target AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE (mix - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
              / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target,
         CAST(greatest(1, ceil(source_size / greatest(65536.0, CAST(words AS DOUBLE) / 4096.0))) AS BIGINT) AS n_shards
  FROM filled),
dealt AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         md5(concat('{SEED}-', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))) AS deal_key,
         CAST(concat('0x', substr(md5(concat('{SEED}-', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), 1, 8)) AS BIGINT) % n_shards AS shard
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
cell AS (
  SELECT source, shard, sum(size) AS cell_size, max(target) * sum(size) / max(source_size) AS w
  FROM dealt GROUP BY source, shard HAVING sum(size) > 0),
house AS (
  SELECT *, CAST(round(sum(CAST(round(w, 6) AS DECIMAL(30, 6))) OVER (), 3) AS DOUBLE) AS all_w, count(*) OVER () AS n FROM cell),
sure AS (
  SELECT *, floor(all_w / {BLOCK} + 0.5) AS seats,
         CAST(greatest(0, floor(w / all_w * (floor(all_w / {BLOCK} + 0.5) - n / 2) + 0.5)) AS BIGINT) AS first_seats,
         CAST(ceil(w / all_w * (floor(all_w / {BLOCK} + 0.5) + n / 2)) + 1 AS BIGINT) AS upto
  FROM house),
ranked AS (
  SELECT source, shard, row_number() OVER (ORDER BY w / (2 * seat + 1) DESC, source ASC NULLS LAST, shard, seat) AS place, l
  FROM (SELECT *, seats - sum(first_seats) OVER () AS l FROM sure), unnest(range(first_seats, greatest(first_seats, upto) + 1)) AS s(seat)),
more AS (SELECT source, shard, count(*) AS more FROM ranked WHERE place <= l GROUP BY source, shard),
quota AS (
  SELECT c.source, c.shard, CAST(ceil(cell_size / {BLOCK}) AS BIGINT) AS nb,
         CAST(least(2 * ceil(cell_size / {BLOCK}), first_seats + coalesce(more, 0)) AS BIGINT) AS q,
         CAST(concat('0x', substr(md5(concat('{SEED}-', coalesce(c.source, 'null'), '-', CAST(c.shard AS VARCHAR))), 1, 8)) AS BIGINT) AS h
  FROM sure c LEFT JOIN more m ON c.source IS NOT DISTINCT FROM m.source AND c.shard = m.shard),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY deal_key, doc_id NULLS LAST, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM dealt)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(coalesce(CASE WHEN p.size > 0 THEN (
         SELECT sum((least(p.done, (k + 1) * {BLOCK}) - greatest(p.done - p.size, k * {BLOCK}))
                    * (q.q // q.nb + CASE WHEN (k * CASE WHEN q.nb % {STEP} = 0 THEN 1 ELSE {STEP} END + q.h % q.nb) % q.nb < q.q % q.nb THEN 1 ELSE 0 END))
         FROM unnest(range(CAST(p.done - p.size AS BIGINT) // {BLOCK}, (CAST(p.done AS BIGINT) - 1) // {BLOCK} + 1)) AS b(k)) END, 0) AS BIGINT) AS taken,
       p.source
FROM placed p LEFT JOIN quota q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
"""
