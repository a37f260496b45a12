"""Registered queries whose rows pass through files, versioned tables and streams before they are read back.

Feeds, sitemaps and pages are written from the given tables into the shared folder; a stream reads its input there, too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import extract as X
from shelfwise.operators import merge as G
from shelfwise.operators import ranks as R
from shelfwise.operators.snapshots import PAIR, latest_per_pair, price_alerts
from shelfwise.plans.catalogue import ALERTS, DIFF, enriched, latest, query, whole
from shelfwise.sources import elements as E
from shelfwise.sources import io
from shelfwise.sources.buckets import write_bucketed
from shelfwise.sources.history import History
from shelfwise.sources.staging import new_path, shared_dir, staged
from shelfwise.sources.store import Store
from shelfwise.streaming import changes as H
from shelfwise.streaming import counters as C
from shelfwise.streaming import streams as T

# ── feeds, sitemaps, category pages, search results ──


def _xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


FEED = """
SELECT sku_id, short_title, concat('frame-', p_partkey) AS slug, CASE WHEN p_partkey % 8 <> 1 THEN round_even(price_ex_vat * 100, 0) / 100 ELSE 0.0 END AS price_ex_vat,
       TRY_CAST(nullif(regexp_extract(concat('The ', short_title), '(?i)(?:x\\s*|pack\\s+of\\s+)(\\d+)', 1), '') AS INT) AS unit_qty,
       CASE WHEN p_partkey % 5 = 0 THEN 'in stock' ELSE 'out of stock' END AS availability, p_partkey % 8 <> 1 AS usable
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN substring(concat('The ', short_title), 1, 80) ELSE short_title END AS shown FROM sku)
""".replace("SELECT sku_id, short_title,", "SELECT sku_id, shown AS short_title,")


def feed_files(m) -> str:
    """The catalogue as feed files of up to 2,000 items."""
    k, title = F.col("p_partkey"), F.concat(F.lit("The "), F.col("short_title"))
    tag = lambda name, c: F.concat(F.lit(f"<g:{name}>"), _xml(c), F.lit(f"</g:{name}>"))
    price = F.when(k % 8 != 1, F.concat(F.format_string("%.2f", "price_ex_vat"), F.lit(" GBP"))).otherwise("0.00 GBP")
    item = F.concat(
        F.lit("<item>"), tag("id", F.col("sku_id")), tag("title", title), F.when(k % 3 != 0, tag("short_title", F.col("short_title"))).otherwise(""),
        tag("link", F.concat(F.lit("https://own.example/p/frame-"), k.cast("string"), F.lit("?v=1&w=2"))), tag("price", price),
        F.when(k % 5 != 0, tag("availability", F.lit("out of stock"))).otherwise(""), F.lit("</item>"),
    )
    path = new_path(m.spark, "feed")
    files = m.part.select(F.floor(k / 2000).alias("file"), item.alias("item")).groupBy("file").agg(F.array_join(F.collect_list("item"), "\n").alias("items"))
    head, foot = F.lit('<rss xmlns:g="http://base.google.com/ns/1.0"><channel>\n'), F.lit("\n</channel></rss>")
    files.select("file", F.concat(head, "items", foot)).write.partitionBy("file").text(path)
    return path


def sorted_out(feed: DataFrame) -> DataFrame:
    good, bad = io.split_valid_feed(feed)
    columns = ["sku_id", "short_title", "slug", "price_ex_vat", F.col("unit_qty").cast("int").alias("unit_qty"), "availability"]
    return good.select(*columns, F.lit(True).alias("usable")).unionByName(bad.select(*columns, F.lit(False).alias("usable")))


@query(FEED)
def src1_feed(m):
    return sorted_out(io.read_feed(m.spark, feed_files(m)))


@query(FEED)
def src1_feed_elements(m):
    """The feed files in splits of bytes, many a file, from the data source."""
    elements = E.registered(m.spark).read.format("elements").option("splitBytes", 100_000).load(feed_files(m))
    return sorted_out(E.feed_elements(elements))


@query(FEED)
def src1_feed_stream(m):
    """The feed files as they come, from the same data source as a stream."""
    stream = E.registered(m.spark).readStream.format("elements").option("splitBytes", 100_000).load(feed_files(m))
    return sorted_out(told(m, E.feed_elements(stream)))


@query("SELECT concat('https://shop.example/p?id=', p_partkey, '&v=1') AS url, p_partkey % 97 AS competitor_id FROM sku")
def src3_sitemap_elements(m):
    """A sitemap file a shop, with a prefix, line breaks and escapes; its URLs from the data source."""
    loc = F.concat(F.lit("\n<sm:url><sm:loc>\n"), _xml(F.concat(F.lit("https://shop.example/p?id="), F.col("p_partkey").cast("string"), F.lit("&v=1"))), F.lit("</sm:loc></sm:url>"))
    files = m.part.select((F.col("p_partkey") % 97).alias("shop"), loc.alias("loc")).groupBy("shop").agg(F.array_join(F.collect_list("loc"), "").alias("urls"))
    path = new_path(m.spark, "sitemap-files")
    files.select("shop", F.concat(F.lit("<sm:urlset>"), "urls", F.lit("</sm:urlset>"))).write.partitionBy("shop").text(path)
    urls = E.sitemap_elements(E.registered(m.spark).read.format("elements").option("rowTag", "url").load(path))
    return urls.select("url", F.regexp_extract("file", "shop=([0-9]+)/", 1).cast("long").alias("competitor_id"))


#: A shop's URLs lie in sitemaps that its root leads to over so many index files: 0 to 5.
_DEPTH = "c % 6"


@query(f"""
, page AS (SELECT p_partkey % 97 AS c, p_partkey AS k FROM sku), leaf AS (
  SELECT DISTINCT c, k % 3 AS part FROM page)
SELECT c AS competitor_id, concat('https://shop.example/p?id=', k, '&v=1') AS url,
       row_number() OVER (PARTITION BY c ORDER BY k % 3, k) AS harvest_idx
FROM page
""")
def src3_sitemaps(m):
    page = m.part.select((F.col("p_partkey") % 97).alias("c"), F.col("p_partkey").alias("k"))
    loc = lambda u: F.concat(F.lit("<sm:loc>\n"), _xml(u), F.lit("</sm:loc>"))
    leaf_url = F.concat_ws("-", F.lit("leaf"), "c", "part")
    lists = page.groupBy("c", (F.col("k") % 3).alias("part")).agg(F.sort_array(F.collect_list("k")).alias("ks"))
    url = lambda k: F.concat(F.lit("https://shop.example/p?id="), k.cast("string"), F.lit("&v=1"))
    leaves = lists.select("c", leaf_url.alias("u"), F.concat(F.lit("<sm:urlset>"), F.array_join(F.transform("ks", lambda k: loc(url(k))), ""), F.lit("</sm:urlset>")).alias("xml"))
    named = lists.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: loc(F.concat_ws("-", F.lit("leaf"), "c", p))), "").alias("below"))
    depth = F.expr(_DEPTH)
    at = named.select("c", "below", F.explode(F.sequence(F.lit(0), depth)).alias("d"))
    inside = F.when(F.col("d") == depth, F.col("below")).otherwise(F.concat(loc(F.concat_ws("-", F.lit("index"), "c", F.col("d") + 1)), loc(F.concat_ws("-", F.lit("index"), "c", F.lit(0)))))
    indexes = at.select("c", F.concat_ws("-", F.lit("index"), "c", "d").alias("u"), F.concat(F.lit("<?xml?><sitemapindex>"), inside, F.lit("</sitemapindex>")).alias("xml"), (F.col("d") == 0).alias("is_root"))
    maps = indexes.unionByName(leaves.withColumn("is_root", F.lit(False)))
    return io.sitemap_urls(maps.select(F.col("c").alias("competitor_id"), F.col("u").alias("sitemap_url"), "xml", "is_root"))


@query("""
, page AS (SELECT p_partkey % 97 AS c, p_partkey AS k, p_partkey // 97 % 7 + 1 AS page_no FROM sku)
SELECT DISTINCT c AS competitor_id, concat('https://shop-', c, '.example/c/p/', k) AS url FROM page WHERE page_no < 5
""")
def src4_category_links(m):
    """Seven pages a shop; the fifth has nothing new, so the two after it are not looked at."""
    page = m.part.select((F.col("p_partkey") % 97).alias("c"), F.col("p_partkey").alias("k")).withColumn("page_no", (F.floor(F.col("k") / 97) % 7 + 1).cast("int"))
    html = F.concat(F.lit('<a href="../about">us</a>'), F.array_join(F.collect_list(F.concat(F.when(F.col("k") % 2 == 0, '<A HREF="p/').otherwise("<a href='/c/p/"), F.col("k").cast("string"), F.when(F.col("k") % 2 == 0, '#top">x</a>').otherwise("'>x</a>"))), ""))
    shop = F.concat(F.lit("https://shop-"), F.col("c").cast("string"), F.lit(".example/c/"))
    pages = page.where("page_no <> 5").groupBy("c", "page_no").agg(html.alias("html"))
    pages = pages.unionByName(page.select("c").distinct().select("c", F.lit(5).alias("page_no"), F.lit('<a href="/help">help</a>').alias("html")))
    rules = page.select("c").distinct().select(F.col("c").alias("competitor_id"), F.lit("/c/p/[0-9]+$").alias("pattern"))
    return io.category_links(pages.select(F.col("c").alias("competitor_id"), "page_no", shop.alias("url"), "html"), rules)


@query("""
SELECT p_partkey % 97 AS competitor_id, sku_id, concat('https://shop.example/p/', p_partkey, '/item') AS url, short_title AS link_text FROM sku WHERE p_partkey % 4 <> 3
""")
def ex11_search_hits(m):
    """Result pages with a category page of the shop, a page of another shop, and the product's own page, which one in four lacks."""
    k = F.col("p_partkey")
    a = lambda url, text: F.concat(F.lit('<div><a class="r" href="'), url, F.lit('">'), text, F.lit("</a></div>"))
    own = a(F.concat(F.lit("https://shop.example/p/"), k.cast("string"), F.lit("/item")), F.concat(F.lit("<b>"), F.col("short_title"), F.lit("</b>")))
    html = F.concat(a(F.lit("https://other.example/p/1/item"), F.col("short_title")), a(F.lit("https://shop.example/p/0/gnome"), F.lit("Garden gnome, painted")), F.when(k % 4 != 3, own).otherwise(""))
    pages = m.part.select((k % 97).alias("competitor_id"), "sku_id", F.lit("shop.example").alias("domain"), html.alias("html"))
    return X.search_hits(pages, m.sku).drop("confidence")


# ── sinks ──


@query("SELECT run_id, seq, sku_id, competitor_id, CAST(scraped_at AS DATE) AS snapshot_date, raw_price FROM observation")
def src5_appended_snapshots(m):
    path = new_path(m.spark, "history")
    for half in ("run_id % 2 = 0", "run_id % 2 = 1"):
        io.append_snapshots(m.observation.where(half), path, by="month")
    return m.spark.read.parquet(path).select("run_id", "seq", *PAIR, "snapshot_date", "raw_price")


def clustered(m) -> History:
    """The observations in eight appends by their run, and then in one part along the curve."""
    history = History(m.spark, new_path(m.spark, "clustered"), per_file=500_000)
    history.create(m.observation.schema)
    rows = staged(m.observation.withColumn("turn", F.pmod(F.xxhash64("run_id"), F.lit(8))), "turns")
    for turn in range(8):
        history.append(rows.where(F.col("turn") == turn).drop("turn"))
    history.compact(fan=8)
    return history


@query("SELECT run_id, seq, sku_id, competitor_id, scraped_at, raw_price, availability FROM observation")
def src5_clustered_history(m):
    return clustered(m).read().select("run_id", "seq", *PAIR, "scraped_at", "raw_price", "availability")


@query("""
SELECT run_id, seq, sku_id, competitor_id, scraped_at, raw_price FROM observation
WHERE sku_id = (SELECT sku_id FROM observation GROUP BY sku_id ORDER BY count(*) DESC, sku_id LIMIT 1)
""")
def src5_busiest_sku(m):
    """The history of the SKU that was looked at most, from the files that its statistics name."""
    history = clustered(m)
    busiest = history.read().groupBy("sku_id").count().orderBy(F.desc("count"), F.asc("sku_id")).first()
    return history.of(busiest.sku_id if busiest else "").select("run_id", "seq", *PAIR, "scraped_at", "raw_price")


CRITICAL = """
SELECT run_id * 10 + seq AS id, alert_type, sku_id, short_title, competitor_name, nullif(our_price, 0) AS our_price, nullif(raw_price, 0) AS their_price, nullif(d, 0) AS diff_pct
FROM alert WHERE alert_type = 'critical'
"""


def numbered_alerts(m) -> DataFrame:
    """The message column carries an id here, to compare row by row."""
    return price_alerts(enriched(m), keep=("short_title", "competitor_name")).withColumn("message", (F.col("run_id") * 10 + F.col("seq")).cast("string"))


def from_csv(m, path: str) -> DataFrame:
    back = m.spark.read.option("header", True).option("escape", '"').csv(path)
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("double").alias(c)
    return back.select(F.col("message").cast("long").alias("id"), "alert_type", "sku_id", "short_title", "competitor_name", number("our_price"), number("their_price"), number("diff_pct"))


@query(ALERTS + CRITICAL)
def src6_alerts_csv(m):
    path = new_path(m.spark, "alerts")
    io.export_alerts_csv(numbered_alerts(m), "crit", path)
    return from_csv(m, path)


@query(ALERTS + CRITICAL)
def src6_alerts_whole(m):
    """The alert file through the sink that shows all of a job or nothing."""
    path = new_path(m.spark, "alerts-whole")
    E.registered(m.spark)
    io.alert_fields(numbered_alerts(m), "crit").write.format("whole_csv").mode("append").save(path)
    return from_csv(m, f"{path}/job-*")


@query("""
SELECT sku_id, competitor_id, concat('{"page":"', coalesce(competitor_url, 'none'), '","status":"', match_status, '"}') AS labels, confidence AS score FROM match
""")
def src7_variant_report(m):
    path = new_path(m.spark, "report")
    labels = F.create_map(F.lit("page"), F.coalesce("competitor_url", F.lit("none")), F.lit("status"), F.col("match_status"))
    io.export_variant_report(m.match.select(*PAIR, labels.alias("labels"), F.col("confidence").alias("score")), path)
    return m.spark.read.option("header", True).option("escape", "\\").csv(path).select("sku_id", F.col("competitor_id").cast("long"), "labels", F.col("score").cast("int"))


@query("SELECT sku_id, competitor_id, match_status, confidence, updated_at FROM match")
def src8_tables(m):
    path = new_path(m.spark, "match")
    io.write_table(m.match, path)
    return io.read_table(m.spark, path).select(*PAIR, "match_status", "confidence", "updated_at")


# ── versions and counters ──


@query("""
, c AS (SELECT sku_id, competitor_id, confidence + 10 AS nc FROM match UNION ALL SELECT sku_id, -1 - competitor_id, confidence + 10 FROM match),
first AS (
  SELECT sku_id, competitor_id, confidence + 5 AS confidence, CASE WHEN confidence + 5 >= 80 THEN 'matched' ELSE 'review' END AS match_status FROM match WHERE confidence % 3 = 0
  UNION ALL SELECT sku_id, competitor_id, confidence, match_status FROM match WHERE confidence % 3 <> 0)
SELECT sku_id, competitor_id, CASE WHEN f.match_status = 'matched' THEN f.confidence ELSE coalesce(c.nc, f.confidence) END AS confidence,
       CASE WHEN f.match_status = 'matched' THEN 'matched' WHEN c.nc IS NOT NULL THEN 'review' ELSE f.match_status END AS match_status
FROM first f FULL JOIN c USING (sku_id, competitor_id)
""")
def mrg_versions(m):
    """A search run and then sitemap decisions merged into a versioned table of matches."""
    store = Store(m.spark, new_path(m.spark, "matches"))
    store.create(match=(m.match, PAIR, 16))
    found = m.match.where("confidence % 3 = 0").withColumn("confidence", F.col("confidence") + 5)
    store.merge("match", found, G.merge_scrape_matches)
    store.tidy(keep=1, seconds=0)  # no one else writes to this store
    store.merge("match", whole(m)[1], G.merge_sitemap_matches)
    store.tidy(keep=1, seconds=0)
    return store.read("match").select(*PAIR, "confidence", "match_status")


@query(f"""
SELECT competitor_id, count(*) AS matched, count(*) FILTER (d <= -10) AS dash_critical, count(*) FILTER (d > -10 AND d <= -5) AS dash_warning, count(*) FILTER (d > 0) AS dash_cheapest,
       count(*) FILTER (availability = 'out_of_stock') AS oos, count(*) FILTER (n <= -10) AS tier_critical, count(*) FILTER (n > -10 AND n <= -5) AS tier_warning,
       count(*) FILTER (n >= 2) AS tier_cheaper, count(*) FILTER (n IS NULL OR (n > -5 AND n < 2)) AS tier_parity,
       count(*) FILTER (abs(d) < 2) AS hist_parity, count(*) FILTER (d <= -5 AND d > -10) AS hist_amber, count(*) FILTER (d <= -10) AS hist_red
FROM (SELECT competitor_id, availability, CASE WHEN raw_price IS NOT NULL THEN diff_pct_normalised END AS n, {DIFF} AS d FROM latest) GROUP BY competitor_id
""")
def agg_counters_kept(m):
    """All observations in three batches, none of them in the order of time."""
    snaps = staged(enriched(m).select("run_id", "seq", *PAIR, "scraped_at", "availability", "diff_pct", "diff_pct_normalised"), "snapshots")
    root = new_path(m.spark, "counters")
    batch = C.counted_batches(m.spark, root, 16)
    for i in range(3):
        batch(snaps.where(F.pmod(F.xxhash64("run_id"), F.lit(3)) == i), i)
        Store(m.spark, root).tidy(keep=1, seconds=0)  # no one else writes to this store
    return C.read_counters(m.spark, root)


@query("""
SELECT m.sku_id, m.competitor_id, s.short_title, c.name AS competitor_name, m.match_status, l.raw_price AS last_price, l.run_id AS last_run
FROM match m JOIN sku s USING (sku_id) JOIN competitor c USING (competitor_id)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sku_id, competitor_id ORDER BY scraped_at DESC, run_id DESC, seq DESC) AS rn FROM observation) l
  ON l.rn = 1 AND l.sku_id = m.sku_id AND l.competitor_id = m.competitor_id
""")
def jn2_by_buckets(m):
    """History, in two appends, and matches lie in the same buckets."""
    id = uuid.uuid4().hex
    history, matches = (f"{name}_{id}" for name in ("history", "matches"))
    rows = m.observation.select("run_id", "seq", *PAIR, "scraped_at", "raw_price")
    try:
        for half, mode in (("run_id % 2 = 0", "errorifexists"), ("run_id % 2 = 1", "append")):
            write_bucketed(rows.where(half), history, f"{shared_dir(m.spark)}/{history}", 8, mode=mode)
        write_bucketed(m.match, matches, f"{shared_dir(m.spark)}/{matches}", 8)
        newest = latest_per_pair(m.spark.table(history)).select(*PAIR, F.col("raw_price").alias("last_price"), F.col("run_id").alias("last_run"))
        queue = m.spark.table(matches).join(newest, PAIR, "left")
        queue = queue.join(m.sku.select("sku_id", "short_title"), "sku_id").join(m.competitor.select("competitor_id", F.col("name").alias("competitor_name")), "competitor_id")
        return staged(queue.select(*PAIR, "short_title", "competitor_name", "match_status", "last_price", "last_run"), "queue")
    finally:
        for name in (history, matches):
            m.spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("""
SELECT sku_id, competitor_id, diff_pct_normalised, row_number() OVER (ORDER BY diff_pct_normalised NULLS LAST, sku_id, competitor_id) AS rank FROM latest WHERE raw_price IS NOT NULL
""")
def srt2_ranks(m):
    rows = latest(m).where("competitor_price is not null").select(*PAIR, "diff_pct_normalised")
    return R.Ranked(rows, [F.asc_nulls_last("diff_pct_normalised"), F.asc("sku_id"), F.asc("competitor_id")]).all()


# ── streams ──


def arrivals(m, rows: DataFrame, twice: bool = False) -> DataFrame:
    """The rows as a stream of two batches, dealt by a hash of the run, not by time. All tasks write; the first batch takes as
    many files, the oldest, as there are of the first half, and so does each that follows, of what is left."""
    path, read = new_path(m.spark, "arrivals"), m.spark.read.schema(rows.schema)
    late = F.pmod(F.xxhash64("run_id"), F.lit(2))
    for i in range(2):
        rows.where(late == i).write.parquet(f"{path}/{i}-once")
        if twice:
            read.parquet(f"{path}/{i}-once").write.parquet(f"{path}/{i}-again")
    files = len(read.parquet(f"{path}/0-*").inputFiles())
    return m.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{path}/*")


def told(m, stream: DataFrame) -> DataFrame:
    """All that a stream has to say, through a file sink."""
    path = new_path(m.spark, "told")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(m.spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(path)


@query(ALERTS + "SELECT run_id, seq, sku_id, competitor_id, alert_type, d AS diff_pct, our_price, raw_price AS their_price FROM alert")
def str1_stream_alerts(m):
    return told(m, T.stream_alerts(arrivals(m, m.observation), m.sku, m.competitor)).drop("message")


@query("SELECT sku_id, competitor_id, run_id, seq, scraped_at, raw_price FROM latest")
def str2_stream_latest(m):
    root, stream = new_path(m.spark, "latest"), arrivals(m, m.observation)
    batch = T.maintain_latest(m.spark, root, 16)
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", new_path(m.spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return T.read_latest(m.spark, root).select(*PAIR, "run_id", "seq", "scraped_at", "raw_price")


#: Longer than the given history, so that no row is late.
EVER = "36500 days"


@query("""
SELECT date_trunc('hour', scraped_at) AS window_start, run_id, count(*) AS attempted, count(*) FILTER (availability <> 'error') AS succeeded, count(raw_price) AS prices_found
FROM observation GROUP BY 1, 2
""")
def str3_stream_run_stats(m):
    """What a window's counters say after the last batch that touched it."""
    path = new_path(m.spark, "run-stats")
    stream = T.stream_run_stats(arrivals(m, m.observation), EVER)
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(path)
    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(m.spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return latest_per_pair(m.spark.read.parquet(path), ["window_start", "run_id"], "batch", ()).drop("batch")


@query("SELECT DISTINCT sku_id, competitor_id, scraped_at FROM observation")
def str4_stream_once(m):
    return told(m, T.dedupe_stream(arrivals(m, m.observation, twice=True), EVER)).select(*PAIR, "scraped_at")


@query("""
SELECT run_id, seq, sku_id, competitor_id, CASE WHEN raw_price < b THEN 'price_drop_them' ELSE 'price_rise_them' END AS alert_type, b AS price_before, raw_price AS competitor_price
FROM (SELECT *, lag(raw_price) OVER (PARTITION BY sku_id, competitor_id ORDER BY scraped_at, run_id, seq) AS b FROM enriched WHERE raw_price IS NOT NULL)
WHERE b IS NOT NULL AND raw_price <> b
""")
def win9_stream_price_changes(m):
    seen = m.observation.select(*PAIR, "scraped_at", "run_id", "seq", F.col("raw_price").alias("competitor_price"))
    return H.net_changes(told(m, H.stream_price_changes(arrivals(m, seen), EVER)))
