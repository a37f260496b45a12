"""More registered queries: composed reports, page rules, scorers and merges that the first catalogue does not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions import text as T
from shelfwise.operators import aggregates as A
from shelfwise.operators import extract as X
from shelfwise.operators import filters as L
from shelfwise.operators import joins as J
from shelfwise.operators import merge as G
from shelfwise.operators import variants as V
from shelfwise.operators import windows as W
from shelfwise.operators.snapshots import PAIR, enrich_snapshots, latest_enriched, price_alerts, report_prices
from shelfwise.plans.catalogue import ALERTS, DIFF, FAMILY, ORACLE_SQL, _page_url, configured_pages, latest, query, shop_pages


# ── reports ──

@query(ALERTS + f"""
, part_of AS (
  SELECT 'metric' AS section, k AS place, name AS sku_id, CAST(NULL AS BIGINT) AS competitor_id, CAST(n AS DOUBLE) AS amount
  FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest(['critical', 'warning', 'cheapest', 'oos', 'review_queue']) AS name,
               unnest([critical, warning, cheapest, oos, review_queue]) AS n
        FROM (SELECT count(*) FILTER (d <= -10) AS critical, count(*) FILTER (d > -10 AND d <= -5) AS warning, count(*) FILTER (d > 0) AS cheapest,
                     count(*) FILTER (availability = 'out_of_stock') AS oos, (SELECT count(*) FROM match WHERE match_status = 'review') AS review_queue
              FROM (SELECT availability, {DIFF} AS d FROM latest)))
  UNION ALL
  SELECT 'last_run', 1, (SELECT status FROM run ORDER BY started_at DESC, id DESC LIMIT 1), (SELECT id FROM run ORDER BY started_at DESC, id DESC LIMIT 1), NULL
  UNION ALL
  SELECT 'alert', row_number() OVER (ORDER BY scraped_at DESC, run_id * 10 + seq DESC), sku_id, competitor_id, d
  FROM (SELECT * FROM alert ORDER BY scraped_at DESC, run_id * 10 + seq DESC LIMIT 50)
  UNION ALL
  SELECT 'worst', row_number() OVER (ORDER BY diff_pct, sku_id, competitor_id), sku_id, competitor_id, diff_pct
  FROM (SELECT * FROM latest WHERE availability NOT IN ('unavailable', 'error') AND diff_pct IS NOT NULL ORDER BY diff_pct, sku_id, competitor_id LIMIT 10))
SELECT section, CAST(place AS BIGINT) AS place, sku_id, competitor_id, amount FROM part_of
""")
def cmp4_dashboard(m):
    alerts = price_alerts(enrich_snapshots(m.observation, m.sku, m.competitor), keep=("scraped_at",))
    alerts = alerts.withColumnRenamed("scraped_at", "created_at").withColumns({"id": F.col("run_id") * 10 + F.col("seq"), "dismissed": F.lit(False)})
    return A.dashboard(latest(m), m.match, m.run, alerts)


@query("""
SELECT competitor_id, count(*) AS harvested, count(html) AS fetched, count(*) FILTER (coalesce(length(html), 0) = 0) AS empty,
       count(DISTINCT CASE WHEN page_id % 3 = 0 THEN url END) AS with_candidates, count(*) FILTER (page_id % 5 = 0) AS written,
       count(html) - count(*) FILTER (coalesce(length(html), 0) = 0) - count(DISTINCT CASE WHEN page_id % 3 = 0 THEN url END) AS no_match
FROM (SELECT page_id, url, page_id % 7 AS competitor_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN '' ELSE html END AS html FROM pages) GROUP BY competitor_id
""".replace("\nSELECT", "\nWITH x AS (SELECT 1)\nSELECT", 1))
def agg15_discovery_stats(m):
    p = fetched(m)
    return A.discovery_stats(p, p.where("page_id % 3 = 0"), p.where("page_id % 5 = 0"))


def fetched(m) -> DataFrame:
    """The given pages as what a harvest fetched: some not at all, some empty."""
    k = F.col("page_id")
    html = F.when(k % 11 == 0, None).when(k % 13 == 0, "").otherwise(F.col("html"))
    return m.raw("pages").select("page_id", (k % 7).alias("competitor_id"), "url", html.alias("html"))


@query("""
SELECT kind, id, status FROM (
  SELECT 'date' AS kind, row_number() OVER (ORDER BY coalesce(happened, 0) DESC, id) AS n, id, status FROM (SELECT *, CASE WHEN id % 7 <> 0 THEN epoch(started_at) END AS happened FROM run)
  UNION ALL SELECT 'price', row_number() OVER (ORDER BY coalesce(p, 999999.0), id), id, status FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN CAST(prices_found AS DOUBLE) END AS p FROM run)
  UNION ALL SELECT 'diff', row_number() OVER (ORDER BY coalesce(d, 0.0) DESC, id), id, status FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN CAST(prices_found - 10 AS DOUBLE) END AS d FROM run)
  UNION ALL SELECT 'text', row_number() OVER (ORDER BY lower(coalesce(t, '')), id), id, status FROM (SELECT *, CASE WHEN id % 9 <> 0 THEN upper(status) END AS t FROM run))
WHERE n <= 40
""")
def srt5_sort_by(m):
    k = F.col("id")
    runs = m.run.withColumns(
        {"at": F.when(k % 7 != 0, F.col("started_at")), "p": F.when(k % 3 != 0, F.col("prices_found").cast("double")), "d": F.when(k % 3 != 0, (F.col("prices_found") - 10).cast("double")), "t": F.when(k % 9 != 0, F.upper("status"))}
    )
    parts = [W.sort_by(runs, c, descending, kind, ("id",)).limit(40).select(F.lit(kind).alias("kind"), "id", "status") for kind, c, descending in (("date", "at", True), ("price", "p", False), ("diff", "d", True), ("text", "t", False))]
    return J.union_all(*parts)


@query("""
SELECT DISTINCT competitor_id, competitor_url AS url FROM match WHERE competitor_url IS NOT NULL
UNION SELECT competitor_id % 5, competitor_url FROM match WHERE competitor_url IS NOT NULL
""")
def set3_union_distinct(m):
    urls = m.match.where("competitor_url is not null").select("competitor_id", F.col("competitor_url").alias("url"))
    return J.union_distinct(urls, urls.withColumn("competitor_id", F.col("competitor_id") % 5))


@query("""
SELECT run_id, seq, len(list_intersect(a, b)) AS shared, len(list_intersect(a, b)) = len(a) AND len(a) = len(b) AS is_equal
FROM (SELECT run_id, seq, list_distinct(str_split(lower(short_title), ' ')) AS a, list_distinct(str_split(lower(comp_title), ' ')) AS b FROM enriched)
""")
def set4_title_tokens(m):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    o = m.observation.join(m.sku.select("sku_id", "short_title"), "sku_id").select("run_id", "seq", words("short_title").alias("a"), words("comp_title").alias("b"))
    a, b = F.col("a"), F.col("b")
    return o.select("run_id", "seq", F.size(T.token_overlap(a, b)).cast("long").alias("shared"), T.token_equal(a, b).alias("is_equal"))


@query("""
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' ELSE strftime(happened, '%-d %b') END AS age
FROM (SELECT id, started_at + to_minutes(CAST(id % 180 AS INT)) AS happened, CAST(epoch(TIMESTAMP '1995-06-17 02:30:30') - epoch(started_at + to_minutes(CAST(id % 180 AS INT))) AS BIGINT) AS s,
             date_diff('day', CAST(started_at + to_minutes(CAST(id % 180 AS INT)) AS DATE), DATE '1995-06-17') AS d FROM run)
""")
def sc18_age_label(m):
    return m.run.select("id", S.age_label(F.col("completed_at"), F.lit("1995-06-17 02:30:30").cast("timestamp")).alias("age"))


@query("""
SELECT sku_id, competitor_id, regexp_replace(sku_id, '[A-Z]\\d*$', '') AS looked_up,
       replace(regexp_extract(competitor_url, '([^/]*)$', 1), '-', ' ') AS title FROM match WHERE competitor_url IS NOT NULL
""")
def sc22_sc23_search_words(m):
    return m.match.where("competitor_url is not null").select(*PAIR, T.strip_sku_suffix(F.col("sku_id")).alias("looked_up"), T.title_from_slug(F.col("competitor_url")).alias("title"))


@query("""
SELECT sku_id, competitor_id, vat, round_even(our_price * 1.2 * 100, 0) / 100 AS our_price_inc_vat, shown AS their_ex, nullif(our_price, 0) / pack AS our_per_unit, shown / pack AS their_per_unit
FROM (SELECT *, CASE WHEN vat = 'inc' THEN nullif(raw_price, 0) / 1.2 ELSE nullif(raw_price, 0) END AS shown, CASE WHEN our_unit_qty > 1 THEN our_unit_qty END AS pack
      FROM (SELECT l.*, coalesce(CASE WHEN l.seq % 2 = 0 THEN l.competitor_vat END, CASE WHEN l.competitor_id % 5 <> 0 THEN c.vat_status END, 'unknown') AS vat
            FROM latest l JOIN competitor c USING (competitor_id)))
""")
def sc27_report_prices(m):
    shops = m.competitor.select("competitor_id", F.when(F.col("competitor_id") % 5 != 0, F.col("vat_status")).alias("default_vat"))
    said = F.when(F.col("seq") % 2 == 0, F.col("competitor_vat"))
    return report_prices(latest(m).withColumn("competitor_vat", said), shops)


@query(ORACLE_SQL["cmp1b_enrich_legacy"].replace("FROM prepared", """FROM (
  SELECT * REPLACE (CASE vat WHEN 'inc' THEN round_even(raw_price / 1.2 * 100, 0) / 100 ELSE raw_price END AS their_ex)
  FROM (SELECT *, CASE seq % 4 WHEN 0 THEN 'inc' WHEN 1 THEN 'ex' ELSE competitor_vat END AS vat FROM prepared))"""))
def cmp1b_page_vat(m):
    """The page says inc or ex, unknown, or nothing; a VAT basis that it says wins."""
    said = F.when(F.col("seq") % 4 == 0, "inc").when(F.col("seq") % 4 == 1, "ex").when(F.col("seq") % 4 == 2, "unknown")
    return enrich_snapshots(m.observation.withColumn("page_vat", said), m.sku, m.competitor, "legacy").select("run_id", "seq", *PAIR, "competitor_price", "diff_pct", "diff_pct_normalised")


@query("""
SELECT run_id, seq, CASE WHEN ours <> 0 AND theirs <> 0 AND greatest(ours, theirs) / least(ours, theirs) >= 1.5
       THEN concat('raw price gap ', printf('%.1f', greatest(ours, theirs) / least(ours, theirs)), '× with no pack signal — verify pack sizes') END AS remark
FROM (SELECT run_id, seq, our_price AS ours, round_even(raw_price * (seq + 1) * 100, 0) / 100 AS theirs FROM prepared)
""")
def sc13_pack_remark(m):
    """One to eight times the price that was seen, as if of one quantity."""
    o = m.observation.join(m.sku.select("sku_id", "price_ex_vat"), "sku_id").join(m.competitor.select("competitor_id"), "competitor_id")
    theirs = S.rounded(F.col("raw_price") * (F.col("seq") + 1))
    return o.select("run_id", "seq", S.pack_flag(F.col("price_ex_vat"), theirs, F.lit(1), F.lit(1)).alias("remark"))


_VARIANT_URLS = """, named AS (
  SELECT sku_id, competitor_id, k % 4 AS kind, concat('https://shop.example/p/', k, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN concat('?super_attribute[9]=', k, '#top') WHEN 2 THEN concat('?a=1&variation_id=', k)
         ELSE concat('?variant=', k, '&b=2') END) AS url, concat('https://shop.example/p/', k) AS parent, k
  FROM (SELECT sku_id, competitor_id, confidence AS k FROM match))
"""


@query(_VARIANT_URLS + """
SELECT sku_id, competitor_id, parent, kind = 1 AS configurable, kind = 2 AS variation, kind = 3 AS storefront, CASE WHEN kind = 2 THEN CAST(k AS VARCHAR) END AS variation_id, CASE WHEN kind = 3 THEN CAST(k AS VARCHAR) END AS variant,
       CASE WHEN kind = 2 THEN concat(parent, '?variation_id=', k, '&attribute_dimension=A3+%28L%29') WHEN kind = 3 THEN concat(parent, '?variant=', k) ELSE concat(parent, '?super_attribute[1]=x&super_attribute[9]=', k) END AS rebuilt
FROM named
""")
def sc25_variant_urls(m):
    k = F.col("confidence")
    s = k.cast("string")
    base = F.concat(F.lit("https://shop.example/p/"), s)
    url = F.when(k % 4 == 0, base).when(k % 4 == 1, F.concat(base, F.lit("?super_attribute[9]="), s, F.lit("#top"))).when(k % 4 == 2, F.concat(base, F.lit("?a=1&variation_id="), s)).otherwise(F.concat(base, F.lit("?variant="), s, F.lit("&b=2")))
    rows = m.match.select(*PAIR, k, url.alias("url"))
    u = F.col("url")
    built = lambda site, labels: T.variant_url(u, site, s, labels)
    rebuilt = F.when(k % 4 == 2, built("variation", F.create_map(F.lit("d"), F.lit("A3 (L)")))).when(k % 4 == 3, built("storefront", None)).otherwise(built("configurable", F.create_map(F.lit("9"), s, F.lit("1"), F.lit("x"))))
    return rows.select(*PAIR, T.parent_url(u).alias("parent"), *(T.has_variant(u, site).alias(site) for site in ("configurable", "variation", "storefront")), T.url_param(u, "variation_id").alias("variation_id"), T.url_param(u, "variant").alias("variant"), rebuilt.alias("rebuilt"))


# ── page and URL rules ──

def _any_of(text: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p.lower()}')" for p in parts) + ")"


_PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_SIZE_OF = "len(list_filter(str_split({0}, '/'), lambda x: x <> ''))"
_KINDS = f""", kinds AS (
  SELECT *, {_any_of("u", T.CATEGORY_SIGNALS)} OR {_SIZE_OF.format("u")} <= 2 AS is_category, {_any_of("path", T.CONTENT_SIGNALS)} AS is_content
  FROM (SELECT *, split_part(lower(url), '?', 1) AS u, {_PATH} AS path FROM harvest))
"""
#: URLs of all kinds by key arithmetic, as the given ones have few.
_TAILS = ["/category/a", "/blog/post-1", "/p/item-7/x", "", "/help/faq", "/Shop/One/two", "/a/b/c/d"]
_HARVEST = f"WITH harvest AS (SELECT page_id, page_id % 6 AS competitor_id, concat(split_part(url, '?', 1), {_TAILS}[1 + page_id % 7], '?q=1') AS url, html FROM pages)"


def harvest(m) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("page_id") % 7 + 1).cast("int"))
    return m.raw("pages").select("page_id", (F.col("page_id") % 6).alias("competitor_id"), F.concat(F.substring_index("url", "?", 1), tail, F.lit("?q=1")).alias("url"), "html")


@query(_HARVEST + _KINDS + "SELECT page_id, is_category, is_content, NOT is_category AND NOT is_content AS is_product, contains(lower(url), 'therwh.example.org/') OR regexp_matches(url, '://[a-z]+\\.therwh\\.example\\.org/') AS by_proxy FROM kinds")
def flt10_url_kinds(m):
    u = F.col("url")
    return harvest(m).select("page_id", T.is_category_url(u).alias("is_category"), T.is_content_url(u).alias("is_content"), T.is_product_url(u).alias("is_product"), T.needs_proxy(u, ["therwh.example.org"]).alias("by_proxy"))


#: Rules of competitors 0 to 4; 5 has none.
RULES = [
    (0, True, None, None, None, None), (1, False, ["/es", "/de"], 2, None, False), (2, False, None, None, ["/blog", "/Help"], False),
    (3, False, None, 4, None, True), (4, None, [], None, None, None),
]


@query(_HARVEST + _KINDS + """
SELECT page_id FROM kinds WHERE CASE competitor_id WHEN 0 THEN true WHEN 1 THEN (contains(path, '/es') OR contains(path, '/de')) AND len(list_filter(str_split(path, '/'), lambda x: x <> '')) >= 2
  WHEN 2 THEN NOT (contains(path, '/blog') OR contains(path, '/help')) WHEN 3 THEN len(list_filter(str_split(path, '/'), lambda x: x <> '')) >= 4 AND NOT is_category AND NOT is_content
  ELSE NOT is_category AND NOT is_content END
""")
def flt11_filter_urls(m):
    rules = m.spark.createDataFrame(RULES, "competitor_id long, accept_all boolean, allow_paths array<string>, min_depth int, deny_paths array<string>, product_only boolean")
    return L.filter_urls(harvest(m), rules).select("page_id")


@query("""
SELECT competitor_id, count(*) AS harvested, count(*) FILTER (coalesce(length(html), 0) = 0) AS no_html, count(*) FILTER (length(html) > 0 AND page_id % 17 = 0) AS no_profile,
       count(*) FILTER (length(html) > 0 AND page_id % 17 <> 0) AS usable
FROM (SELECT page_id, page_id % 7 AS competitor_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN '' ELSE html END AS html FROM pages) GROUP BY competitor_id
""".replace("\nSELECT", "\nWITH x AS (SELECT 1)\nSELECT", 1))
def flt12_page_guard(m):
    k = F.col("page_id")
    profiles = fetched(m).withColumn("profile", F.when(k % 34 == 0, None).when(k % 17 == 0, "").otherwise("some title"))
    counts = L.page_counts(profiles)
    kept = L.usable_pages(profiles).groupBy(F.col("competitor_id").alias("c")).agg(F.count(F.lit(1)).alias("usable"))
    return counts.join(kept, F.col("competitor_id") == F.col("c"), "left").select("competitor_id", "harvested", "no_html", "no_profile", F.coalesce("usable", F.lit(0)).alias("usable"))


# ── pages ──

@query("""
SELECT page_id % 7 AS competitor_id, url, trim(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\\s+', ' ', 'g')) AS title FROM pages
""".replace("\nSELECT", "\nWITH x AS (SELECT 1)\nSELECT", 1))
def ex4_titles_of_pages(m):
    p = m.raw("pages").select((F.col("page_id") % 7).alias("competitor_id"), "url", "html")
    return X.page_facts(p).select("competitor_id", "url", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"))


def _tagged(m) -> DataFrame:
    """The given pages with an image tag, by key arithmetic, before their own head."""
    k, p = F.col("page_id"), F.col("page_id").cast("string")
    tag = (
        F.when(k % 4 == 0, F.concat(F.lit('<meta property="og:image" content=" https://img.example/'), p, F.lit('.png ">')))
        .when(k % 4 == 1, F.concat(F.lit('<meta name="twitter:image" content="http://img.example/t'), p, F.lit('">')))
        .when(k % 4 == 2, F.lit('<meta property="og:image" content="/relative.png">'))
        .otherwise("")
    )
    return m.raw("pages").select((k % 7).alias("competitor_id"), "url", F.concat(tag, F.lit('<span id="ContentPlaceHolder1_lblexVAT">£'), (k % 900 + 10).cast("string"), F.lit('.25</span><ul class="list-unstyled"><h2>£ '), (k % 50 + 1).cast("string"), F.lit(".50</h2></ul>"), F.col("html")).alias("html"))


@query("""
SELECT page_id % 7 AS competitor_id, url, CASE page_id % 4 WHEN 0 THEN concat('https://img.example/', page_id, '.png') WHEN 1 THEN concat('http://img.example/t', page_id) END AS image FROM pages
""".replace("\nSELECT", "\nWITH x AS (SELECT 1)\nSELECT", 1))
def ex10_preview_images(m):
    return X.preview_images(_tagged(m))


@query("""
SELECT page_id % 7 AS competitor_id, url, CAST(CASE page_id % 7 WHEN 1 THEN page_id % 900 + 10.25 ELSE page_id % 50 + 1.5 END AS DOUBLE) AS price FROM pages WHERE page_id % 7 IN (1, 2)
""".replace("\nSELECT", "\nWITH x AS (SELECT 1)\nSELECT", 1))
def ex9_site_prices(m):
    rules = [(1, r'(?s)id="ContentPlaceHolder1_lblexVAT"[^>]*>(.*?)</'), (2, r'(?s)<ul class="list-unstyled">.*?<h2>(.*?)</h2>')]
    return X.site_prices(_tagged(m), m.spark.createDataFrame(rules, "competitor_id long, pattern string"))


@query("""
SELECT p_partkey % 97 AS competitor_id, concat('https://shop.example/products/', p_partkey) AS url,
       CAST(CASE p_partkey % 3 WHEN 0 THEN coalesce(nullif(p_partkey * 7, 0), 1) / 100.0 WHEN 1 THEN p_partkey * 3 / 100.0 END AS DOUBLE) AS price FROM sku
""")
def ex8_shopify_js_price(m):
    k = F.col("p_partkey")
    doc = (
        F.when(k % 3 == 0, F.concat(F.lit('{"title":"x","price":1,"variants":[{"id":1,"price":'), (k * 7).cast("string"), F.lit('},{"id":2,"price":5}]}')))
        .when(k % 3 == 1, F.concat(F.lit('{"title":"x","variants":[{"id":1,"price":0}],"price":'), (k * 3).cast("string"), F.lit("}")))
        .otherwise("{broken")
    )
    return X.shopify_js_price(m.part.select((k % 97).alias("competitor_id"), F.concat(F.lit("https://shop.example/products/"), k.cast("string")).alias("url"), doc.alias("json")))


# ── variants ──

_OPTION_SIZES = r"list_distinct(list_transform(regexp_extract_all({0}, '" + V.SIZE + r"'), lambda z: replace(lower(z), ' ', '')))"
_COLOURS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({{0}}, '{'|'.join(w)}') THEN '{name}' END" for name, w in V.COLOURS.items()) + "], lambda x: x IS NOT NULL)"
_LONG_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '\b[a-z]{{3,}}\b'))"


@query(f"""
, offer AS (
  SELECT sku_id, v, concat(short_title, CASE p_partkey % 3 WHEN 0 THEN ' in dark oak' WHEN 1 THEN ' white, wall mounted' ELSE '' END) AS title,
         CASE v WHEN 3 THEN 'none' ELSE concat('A', (p_size + v) % 8) END AS z, ['Dark Oak', 'White wash', 'Slate', 'plain'][1 + v] AS c, ['wall mounted', 'free standing', 'wall', 'mounted in dark'][1 + v] AS f FROM sku, (SELECT unnest([0, 1, 2, 3]) AS v)),
told AS (
  SELECT *, {_OPTION_SIZES.format("title")} AS tz, {_OPTION_SIZES.format("z")} AS oz, {_COLOURS_SQL.format("lower(title)")} AS tc, {_COLOURS_SQL.format("lower(c)")} AS oc, {_LONG_WORDS.format("title")} AS tw, {_LONG_WORDS.format("f")} AS fw FROM offer)
SELECT sku_id, v AS variant_no, CAST(greatest(0, least(100,
       CASE WHEN len(tz) > 0 AND len(oz) > 0 THEN CASE WHEN len(list_intersect(tz, oz)) > 0 THEN 50 ELSE -20 END WHEN len(tz) = 0 THEN 5 ELSE -5 END
       + CASE WHEN len(tc) > 0 AND len(oc) > 0 THEN CASE WHEN len(list_intersect(tc, oc)) > 0 THEN 30 ELSE -10 END WHEN len(tc) = 0 THEN 3 ELSE 0 END
       + least(15, 5 * len(list_intersect(tw, fw))))) AS INT) AS score
FROM told
""")
def ex12_configurable_scores(m):
    """Children with a size, a colour and a mount, which fit more or less; SKU titles say more or less of theirs."""
    k, v = F.col("p_partkey"), F.col("variant_no")
    of = lambda *x: F.element_at(F.array(*map(F.lit, x)), v + 1)
    title = F.concat("short_title", F.when(k % 3 == 0, " in dark oak").when(k % 3 == 1, " white, wall mounted").otherwise(""))
    size = F.when(v == 3, "none").otherwise(F.concat(F.lit("A"), ((F.col("p_size") + v) % 8).cast("string")))
    labels = F.create_map(F.lit("Paper Size"), size, F.lit("Frame Colour"), of("Dark Oak", "White wash", "Slate", "plain"), F.lit("Mount"), of("wall mounted", "free standing", "wall", "mounted in dark"))
    pairs = m.part.withColumn("variant_no", F.explode(F.array(*map(F.lit, range(4))))).select("sku_id", "variant_no", title.alias("short_title"), labels.alias("labels"))
    return V.score_variants(pairs, "configurable").select("sku_id", "variant_no", "score")


#: The variant of the highest score, in stock first; if it is not in stock, the first that is, within ten points.
_BEST = """, ranked AS (
  SELECT *, row_number() OVER w AS n, first_value(score) OVER w AS top, first_value(in_stock) OVER w AS top_stock FROM scored
  WINDOW w AS (PARTITION BY sku_id ORDER BY score DESC, in_stock DESC, variant_id))
SELECT {0} FROM ranked WHERE n = 1 OR (NOT top_stock AND in_stock AND top - score <= 10) QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY in_stock DESC, n) = 1
"""


@query(", scored AS (SELECT sku_id, concat('v', v) AS variant_id, CAST((p_partkey * 7 + v * 13) % 40 AS INT) AS score, (p_partkey + v) % 3 = 0 AS in_stock FROM sku, (SELECT unnest([0, 1, 2, 3, 4]) AS v))" + _BEST.format("sku_id, variant_id, score, in_stock"))
def win5_stock_swap(m):
    k, v = F.col("p_partkey"), F.col("v")
    scored = m.part.withColumn("v", F.explode(F.array(*map(F.lit, range(5))))).select("sku_id", F.concat(F.lit("v"), v.cast("string")).alias("variant_id"), ((k * 7 + v * 13) % 40).cast("int").alias("score"), ((k + v) % 3 == 0).alias("in_stock"))
    return W.best_variant(scored, ["sku_id"])


@query("""
SELECT sku_id, variant_id, CAST(greatest(0, least(100, CASE WHEN z = p_size % 8 THEN 60 ELSE -30 END + CASE WHEN z = p_size % 8 THEN 20 ELSE CASE WHEN contains(regexp_replace(lower(short_title), '[- ]', '', 'g'), concat('a', z)) THEN 20 ELSE 0 END END)) AS INT) AS score
FROM (SELECT *, (p_size + k) % 8 AS z, concat(p_partkey, '-', k) AS variant_id FROM sku, (SELECT unnest([0, 1, 3]) AS k))
""")
def ex12_variation_scores(m):
    sized = m.part.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3)))).withColumn("z", ((F.col("p_size") + F.col("k")) % 8).cast("string"))
    pairs = sized.select(
        "sku_id", "short_title", F.concat(F.col("p_partkey").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("variant_id"), F.concat(F.lit("A"), "z").alias("variant_title"), F.concat(F.lit("A-"), "z").alias("variant_sku")
    )
    return V.score_variants(pairs, "variation").select("sku_id", "variant_id", "score")


_TOKENS_SQL = r"list_distinct(list_transform(regexp_extract_all(lower({0}), '\b\d+\s*mm\b|\ba[0-7]\b|\b\d+(?:\.\d+)?\s*cm\b|\b\d+\b'), lambda t: regexp_replace(t, '\s*(?:mm|cm)$', '')))"


@query(f"""
SELECT sku_id, k AS variant_no, CAST(CASE WHEN upper(variant_sku) = upper(sku_id) THEN 100 ELSE greatest(0, least(100,
         CASE WHEN regexp_matches(suffix, '^[0-9]+$') THEN CASE WHEN contains(squeezed, suffix) THEN 70 ELSE -20 END ELSE CASE WHEN contains(squeezed, suffix) THEN 50 ELSE 0 END END
         + CASE WHEN len(a) > 0 AND len(b) > 0 THEN CASE WHEN len(list_intersect(a, b)) > 0 THEN 20 ELSE -10 END ELSE 0 END + CASE WHEN in_stock THEN 5 ELSE 0 END)) END AS INT) AS score
FROM (SELECT *, lower(split_part(upper(sku_id), '-', -1)) AS suffix, replace(lower(variant_title), ' ', '') AS squeezed, {_TOKENS_SQL.format("short_title")} AS a, {_TOKENS_SQL.format("variant_title")} AS b
      FROM (SELECT *, CASE k WHEN 0 THEN concat('Size A', p_size % 8, ' printed') WHEN 1 THEN concat('No ', p_partkey) ELSE concat(p_size * 10, 'mm wide') END AS variant_title,
                   CASE WHEN k = 2 AND p_partkey % 5 = 0 THEN lower(sku_id) ELSE 'other' END AS variant_sku, (p_partkey + k) % 2 = 0 AS in_stock
            FROM sku, (SELECT unnest([0, 1, 2]) AS k)))
""")
def ex12_storefront_scores(m):
    k, p = F.col("variant_no"), F.col("p_partkey")
    pairs = m.part.withColumn("variant_no", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "sku_id", "variant_no", "short_title",
        F.when(k == 0, F.concat(F.lit("Size A"), (F.col("p_size") % 8).cast("string"), F.lit(" printed"))).when(k == 1, F.concat(F.lit("No "), p.cast("string"))).otherwise(F.concat((F.col("p_size") * 10).cast("string"), F.lit("mm wide"))).alias("variant_title"),
        F.when((k == 2) & (p % 5 == 0), F.lower("sku_id")).otherwise("other").alias("variant_sku"), ((p + k) % 2 == 0).alias("in_stock"),
    )
    return V.score_variants(pairs, "storefront").select("sku_id", "variant_no", "score")


def woo_pages(m) -> DataFrame:
    """A page a family of parts with its variations; the price is given with VAT, without, or in the markup alone."""
    k = F.col("p_partkey")
    price = F.when(k % 3 == 0, F.concat(F.lit('"price_ex_vat":'), F.format_string("%.2f", "price_ex_vat"))).when(k % 3 == 1, F.concat(F.lit('"display_price":'), F.format_string("%.2f", F.col("price_ex_vat") * 1.2))).otherwise(F.concat(F.lit('"price_html":"<b>'), F.format_string("%.2f", "price_ex_vat"), F.lit('</b> 99999.00"')))
    item = F.concat(F.lit('{"variation_id":'), k.cast("string"), F.lit(',"attributes":{"attribute_dimension":"A'), (F.col("p_size") % 8).cast("string"), F.lit('"},"is_in_stock":'), (k % 3 != 0).cast("string"), F.lit(',"sku":"S'), k.cast("string"), F.lit('",'), price, F.lit("}"))
    by = m.part.groupBy(F.floor(k / FAMILY).alias("family")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items"))
    return by.select(F.concat(F.lit("https://woo.example/p/"), F.col("family").cast("string")).alias("url"), F.concat(F.lit('<form data-product_variations="'), F.replace(F.concat(F.lit("["), "items", F.lit("]")), F.lit('"'), F.lit("&quot;")), F.lit('"></form>')).alias("html"))


@query(f"""
SELECT concat('https://woo.example/p/', p_partkey // {FAMILY}) AS parent_url, CAST(p_partkey AS VARCHAR) AS variant_id, concat('A', p_size % 8) AS variant_title, concat('S', p_partkey) AS variant_sku,
       CASE p_partkey % 3 WHEN 1 THEN round_even(CAST(printf('%.2f', price_ex_vat * 1.2) AS DOUBLE) / 1.2 * 10000, 0) / 10000 ELSE CAST(printf('%.2f', price_ex_vat) AS DOUBLE) END AS price_ex_vat, p_partkey % 3 <> 0 AS in_stock FROM sku
""")
def ex6_woo_variations(m):
    return X.woo_variations(woo_pages(m)).select("parent_url", "variant_id", "variant_title", "variant_sku", "price_ex_vat", "in_stock")


def store_pages(m) -> DataFrame:
    """A product's JSON a family of parts, wrapped, bare or as storefront data."""
    k = F.col("p_partkey")
    item = F.concat(F.lit('{"id":"gid://x/'), k.cast("string"), F.lit('","title":"T'), k.cast("string"), F.lit('","available":'), (k % 3 != 0).cast("string"), F.lit(',"price":"'), F.format_string("%.2f", "price_ex_vat"), F.lit('","sku":"S'), k.cast("string"), F.lit('"}'))
    by = m.part.groupBy(F.floor(k / FAMILY).alias("family")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items"))
    body = F.concat(F.lit('{"variants":['), "items", F.lit("]}"))
    f = F.col("family")
    json = F.when(f % 3 == 0, F.concat(F.lit('{"product":'), body, F.lit("}"))).when(f % 3 == 1, body).otherwise(F.concat(F.lit('{"result":{"data":{"shopifyProduct":'), body, F.lit("}}}")))
    return by.select(F.concat(F.lit("https://store.example/p/"), f.cast("string"), F.lit("?a=1")).alias("url"), json.alias("json"))


@query(f"""
SELECT concat('https://store.example/p/', p_partkey // {FAMILY}) AS parent_url, CAST(p_partkey AS VARCHAR) AS variant_id, concat('T', p_partkey) AS variant_title, concat('S', p_partkey) AS variant_sku,
       CAST(printf('%.2f', price_ex_vat) AS DOUBLE) AS price_ex_vat, p_partkey % 3 <> 0 AS in_stock FROM sku
""")
def ex7_shopify_variants(m):
    return X.shopify_variants(store_pages(m)).select("parent_url", "variant_id", "variant_title", "variant_sku", "price_ex_vat", "in_stock")


@query(f"""
SELECT sku_id, CAST(p_partkey % 97 AS BIGINT) AS competitor_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE first_same END AS variant_id FROM (
  SELECT *, first_value(CAST(p_partkey AS VARCHAR)) OVER (PARTITION BY p_partkey // {FAMILY}, p_size % 8 ORDER BY p_partkey % 3 <> 0 DESC, CAST(p_partkey AS VARCHAR)) AS first_same FROM sku)
""")
def ex13_resolve_variant(m):
    k = F.col("p_partkey")
    page = F.concat(F.lit("https://woo.example/p/"), F.floor(k / FAMILY).cast("string"))
    named = F.when(k % 2 == 0, F.concat(F.lit("?variation_id="), k.cast("string"))).otherwise(F.concat(F.lit("?attribute_dimension=a"), (F.col("p_size") % 8).cast("string")))
    matches = m.part.select("sku_id", (k % 97).alias("competitor_id"), F.concat(page, named).alias("competitor_url"))
    return V.resolve_variant(matches, X.woo_variations(woo_pages(m)), m.sku, "variation").select(*PAIR, "variant_id")


@query(f"""
, child AS (SELECT *, concat(replace(cat_l4, '#', '-'), '/', p_partkey // {FAMILY}) AS page, CAST(p_partkey AS VARCHAR) AS variant_id, p_partkey % 3 <> 0 AS in_stock, p_size % 8 AS z FROM sku),
wanted AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 1) % 8 END AS named FROM child),
scored AS (
  SELECT w.sku_id, w.p_partkey, c.variant_id, c.in_stock, CASE WHEN c.z = w.named THEN 1000 WHEN c.z = w.z THEN 50 ELSE 0 END AS score
  FROM wanted w JOIN child c ON c.page = w.page)
SELECT sku_id, p_partkey % 97 AS competitor_id, variant_id FROM scored
QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY score DESC, in_stock DESC, variant_id) = 1 AND score >= 50
""")
def ex13_by_attributes(m):
    """Half of the URLs name a size by its attribute, if not their own; where the page has no such child, and for the other
    half, scores decide."""
    k = F.col("p_partkey")
    url = F.concat(_page_url("/"), F.when(k % 2 == 0, F.concat(F.lit("?super_attribute[9]="), ((F.col("p_size") + 1) % 8).cast("string"))).otherwise(""))
    matches = m.part.select("sku_id", (k % 97).alias("competitor_id"), url.alias("competitor_url"))
    return V.resolve_variant(matches, X.configurable_variants(configured_pages(m)), m.sku, "configurable").select(*PAIR, "variant_id")


@query(f"""
, child AS (SELECT sku_id, p_partkey, p_partkey // {FAMILY} AS page, CAST(p_partkey AS VARCHAR) AS variant_id, p_partkey % 3 <> 0 AS in_stock, concat('t', p_partkey) AS text FROM sku),
wanted AS (SELECT *, lower(split_part(upper(sku_id), '-', -1)) AS suffix, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) END AS named FROM child),
pairs AS (
  SELECT w.sku_id, w.p_partkey, c.variant_id, c.in_stock, c.variant_id = w.named AS by_url, CAST(greatest(0, least(100,
         CASE WHEN regexp_matches(suffix, '^[0-9]+$') THEN CASE WHEN contains(c.text, suffix) THEN 70 ELSE -20 END ELSE CASE WHEN contains(c.text, suffix) THEN 50 ELSE 0 END END + CASE WHEN c.in_stock THEN 5 ELSE 0 END)) AS INT) AS points
  FROM wanted w JOIN child c ON c.page = w.page),
found AS (SELECT sku_id FROM pairs WHERE by_url),
scored AS (SELECT sku_id, p_partkey, variant_id, in_stock, points AS score FROM pairs WHERE sku_id NOT IN (SELECT sku_id FROM found) UNION ALL SELECT sku_id, p_partkey, variant_id, true, 1000 FROM pairs WHERE by_url)
""" + _BEST.format("sku_id, p_partkey % 97 AS competitor_id, variant_id"))
def ex13_by_variant_id(m):
    """A third of the URLs name the next variant by its id (the last of a family names one that its page lacks)."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://store.example/p/"), F.floor(k / FAMILY).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("?variant="), (k + 1).cast("string"))).otherwise(""))
    matches = m.part.select("sku_id", (k % 97).alias("competitor_id"), url.alias("competitor_url"))
    return V.resolve_variant(matches, X.shopify_variants(store_pages(m)), m.sku, "storefront").select(*PAIR, "variant_id")


# ── merges ──

@query("""
SELECT sku_id, competitor_id, CASE WHEN match_status = 'amended' AND confidence % 2 = 0 AND confidence % 3 <> 0 THEN 'matched' ELSE match_status END AS match_status,
       CASE WHEN confidence % 2 = 0 AND confidence % 5 = 0 THEN concat('https://v.example/', sku_id) ELSE competitor_url END AS competitor_url FROM match
""")
def mrg5_run_results(m):
    c, none = F.col("confidence"), F.lit(None).cast("string")
    newest = m.match.where(c % 2 == 0).select(
        *PAIR, F.when(c % 3 == 0, "error").otherwise("in_stock").alias("availability"), none.alias("configurable_url"),
        F.when(c % 5 == 0, F.concat(F.lit("https://v.example/"), "sku_id")).alias("variation_url"), F.lit("https://late.example").alias("late"), none.alias("storefront_url"), F.lit(2).alias("scraped_at"),
    ).drop("late")
    # An older answer to the same pairs says otherwise and does not count
    older = newest.withColumns({"availability": F.lit("unavailable"), "variation_url": F.lit("https://old.example"), "scraped_at": F.lit(1)})
    return G.apply_run_results(m.match, older.unionByName(newest)).select(*PAIR, "match_status", "competitor_url")


@query("""
SELECT sku_id, CASE WHEN p_partkey % 4 = 0 THEN concat('https://img.example/2/', p_partkey) WHEN p_partkey % 2 = 0 THEN concat('https://img.example/1/', p_partkey) END AS image_url,
       CASE WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 END AS image_synced_at FROM sku
""")
def mrg9_image_sync(m):
    k = F.col("p_partkey")
    skus = m.part.withColumns({"image_url": F.lit(None).cast("string"), "image_synced_at": F.lit(None).cast("int")})
    synced = lambda every, at: m.part.where(k % every == 0).select("sku_id", F.concat(F.lit(f"https://img.example/{at}/"), k.cast("string")).alias("image_url"), F.lit(at).alias("image_synced_at"))
    unknown = m.part.select(F.concat(F.lit("GONE-"), "sku_id").alias("sku_id"), F.lit("x").alias("image_url"), F.lit(9).alias("image_synced_at"))
    return G.apply_image_sync(skus, synced(4, 2).unionByName(synced(2, 1)).unionByName(unknown)).select("sku_id", "image_url", "image_synced_at")
