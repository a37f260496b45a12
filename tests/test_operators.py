"""Properties and small cases that SQL cannot state."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import extract as X
from shelfwise.operators import joins as J
from shelfwise.operators import matching as M
from shelfwise.operators import merge as G
from shelfwise.operators import variants as V
from shelfwise.operators import windows as W
from shelfwise.operators.snapshots import enrich_snapshots, latest_enriched, latest_per_pair, price_alerts
from shelfwise.plans import catalogue
from shelfwise.plans.catalogue import titled
from shelfwise.sources import io
from shelfwise.sources.buckets import known, write_bucketed
from shelfwise.sources.mapped import Mapped
from shelfwise.streaming import streams

SF = "/root/testdata/sf0.001"


def test_candidates_by_blocks_are_all_candidates(spark):
    pages, skus = titled(Mapped(spark, SF))
    pages, skus = pages.where("competitor_id = 3").limit(60).cache(), skus.limit(120).cache()
    got = {tuple(r) for r in M.scored_pairs(pages, skus).collect()}
    p = M.with_tokens(pages.withColumnRenamed("price", "comp_price"), "profile", "p")
    s = M.with_tokens(skus, "short_title", "s")
    score = M.keyword_score(F.col("p_groups"), F.col("p_sizes"), F.col("s_groups"), F.col("s_sizes")) + M.price_score(F.col("comp_price"), F.col("price_ex_vat"), F.col("unit_qty"))
    every = p.crossJoin(s).withColumn("score", score.cast("int")).where("score >= 25").select("competitor_id", "url", "sku_id", "score")
    assert got == {tuple(r) for r in every.collect()} and got


SIGNS = ["snap frame", "a board", "acrylic", "leaflet holder", "noticeboard", "sign holder acrylic", "magnetic snap frame"]


def _shop(seed, products=160, skus=300):
    """Products and SKUs of few words and many prices: near and far, none, zero, negative; packs, codes, confirmed pairs."""
    rng = random.Random(seed)
    price = lambda: rng.choice([None, 0.0, -5.0, float("nan"), 9.99, 9.99, *(round(10 ** rng.uniform(-1, 4), 2) for _ in range(14)), *(round(rng.uniform(8, 16), 2) for _ in range(20))])
    name = lambda: f"{rng.choice(SIGNS)} {rng.choice(['', 'A4', 'A3', 'A4 A3', '60x40'])}"
    own = [(f"S-{i}", name(), price(), rng.choice([None, 1, 2, 10])) for i in range(skus)]
    theirs = [(i % 5, f"u{i}", name(), price(), rng.choice([None, [], [], [f"S-{rng.randint(0, skus + 20)}", f"S-{rng.randint(0, 40)}"]])) for i in range(products)]
    done = [(f"S-{rng.randint(0, skus)}", rng.randint(0, 5), rng.choice(["matched", "matched", "review"])) for _ in range(200)] + [(f"S-{i}", 3, "matched") for i in range(0, skus, 2)]
    return theirs, own, done


@pytest.mark.parametrize("seed, n, spare", [(1, 20, 12), (2, 5, 0), (3, 3, 1)])
def test_threshold_join_gives_the_best_of_all_pairs(spark, seed, n, spare):
    theirs, own, done = _shop(seed)
    pages = spark.createDataFrame(theirs, "competitor_id long, url string, profile string, price double, sku_codes array<string>")
    skus = spark.createDataFrame(own, "sku_id string, short_title string, price_ex_vat double, unit_qty int")
    matches = spark.createDataFrame(done, "sku_id string, competitor_id long, match_status string")
    every = M.scored_pairs(pages, skus).cache()
    for known in (None, matches):
        want = M.top_candidates(J.drop_confirmed(every, known) if known is not None else every, n)
        got = M.match_candidates(pages, skus, known, n=n, spare=spare)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_price_bounds_hold(spark):
    rng = random.Random(9)
    odd = [None, 0.0, -1.0, float("inf"), float("nan")]
    rows = [(rng.choice(odd) if rng.random() < 0.1 else 10 ** rng.uniform(-1, 3), rng.choice(odd) if rng.random() < 0.1 else 10 ** rng.uniform(-1, 3), rng.choice([None, 1, 2, 12])) for _ in range(4000)]
    rows += [(10 * q, 10.0, None) for q in (0.7, 1.3, 1.56, 0.5, 2.0, 2.4, 0.3, 3.0, 3.6)]
    df = spark.createDataFrame(rows, "c double, o double, q int")
    pack = F.when(F.col("q") > 1, F.col("o") * F.col("q"))
    (a, b), (c, d) = (M._bounds(M._band(F.col("c")), M._band(x)) for x in (F.col("o"), pack))
    bounds = df.select(F.greatest(a, c).alias("low"), M.price_score(F.col("c"), F.col("o"), F.col("q")).alias("is"), F.greatest(b, d).alias("high"))
    assert bounds.where("not (low <= is and is <= high)").count() == 0 and bounds.where("low = high").count() > 3000


def test_variants_of_every_match(spark):
    m = Mapped(spark, SF)
    matches = catalogue.variant_matches(m)
    assert sorted(map(tuple, matches.select("sku_id", "competitor_id").collect())) == sorted(map(tuple, m.match.select("sku_id", "competitor_id").collect()))
    pages = catalogue.configured_pages(m)
    brands = m.part.groupBy("cat_l4").count().count()
    assert pages.count() > brands and X.configurable_variants(pages).count() == m.part.count()
    best = catalogue.QUERIES["win5_best_variant"](spark, SF)
    assert best.select("sku_id", "competitor_id").distinct().count() == m.match.count()


def test_a_low_bound_is_refused(spark):
    with pytest.raises(ValueError):
        M.scored_pairs(*titled(Mapped(spark, SF)), min_score=20)


def test_enrich_example(spark):
    o = spark.createDataFrame([(1, 1, "S", 7, "2024-01-01", 120.0, "in_stock", "Sign x 10")], "run_id long, seq int, sku_id string, competitor_id long, scraped_at string, raw_price double, availability string, comp_title string")
    s = spark.createDataFrame([("S", "Sign", 10.0, 1)], "sku_id string, short_title string, price_ex_vat double, unit_qty int")
    c = spark.createDataFrame([(7, "C", "inc")], "competitor_id long, name string, vat_status string")
    e = enrich_snapshots(o, s, c)
    row = e.first()
    assert (row.diff_pct, row.diff_pct_normalised) == (1100.0, 0.0)
    assert price_alerts(e).count() == 0


def test_merge_twice_is_once(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    change = spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int")
    once = G.merge_by_key(base, change, ["k"])
    twice = G.merge_by_key(once, change, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)]
    kept = G.merge_by_key(base, change, ["k"], insert=False, protect=F.col("k") == "b")
    assert sorted(map(tuple, kept.collect())) == [("a", 1, "x"), ("b", 2, "y")]


@pytest.mark.parametrize("scores, winner", [([(80, False), (75, True), (72, True)], 75), ([(80, False), (69, True)], 80)])
def test_best_variant_swap(spark, scores, winner):
    rows = [("k", f"v{i}", s, stock) for i, (s, stock) in enumerate(scores)]
    df = spark.createDataFrame(rows, "k string, variant_id string, score int, in_stock boolean")
    assert W.best_variant(df, ["k"]).first().score == winner


@pytest.mark.parametrize("confs, kept", [([75, 66, 64], 2), ([75, 64, 70], 1), ([39], 0)])
def test_accept(spark, confs, kept):
    df = spark.createDataFrame([(1, "u", i, c) for i, c in enumerate(confs)], "competitor_id int, url string, decision_idx int, confidence int")
    assert W.accept_decisions(df).count() == kept


def test_storefront_suffix(spark):
    df = spark.createDataFrame([("WIRE-C-300", "Wire 300", "300mm", "X", True)], "sku_id string, short_title string, variant_title string, variant_sku string, in_stock boolean")
    assert V.score_variants(df, "storefront").first().score == 95


def test_woo_and_shopify(spark):
    blob = '[{"variation_id":5,"attributes":{"attribute_dimension":"A5 landscape"},"display_price":12,"is_in_stock":true,"sku":"911-A5L"}]'.replace('"', "&quot;")
    page = spark.createDataFrame([("https://a/p?x=1", f'<form data-product_variations="{blob}">'), ("https://b/p", '<form data-product_variations="[broken">')], "url string, html string")
    (row,) = X.woo_variations(page).collect()
    assert (row.parent_url, row.variant_id, row.variant_title, row.price_ex_vat) == ("https://a/p", "5", "A5 landscape", 10.0)
    docs = spark.createDataFrame(
        [
            ("https://a/x", '{"product":{"variants":[{"id":1,"title":"300mm","sku":"W","price":"2.50","available":false}]}}'),
            ("https://a/y", '{"result":{"data":{"shopifyProduct":{"variants":[{"storefrontId":"gid://shopify/ProductVariant/9","priceV2":{"amount":"3.5"},"selectedOptions":[{"name":"Size","value":"A4"},{"name":"C","value":"red"}]}]}}}}'),
        ],
        "url string, json string",
    )
    got = {(r.variant_id, r.variant_title, r.price_ex_vat, r.in_stock) for r in X.shopify_variants(docs).collect()}
    assert got == {("1", "300mm", 2.5, False), ("9", "A4 / red", 3.5, True)}


def test_sitemaps_and_links(spark):
    maps = spark.createDataFrame(
        [(1, "r", "junk<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>", True), (1, "c", "<x:urlset><x:loc> https://a/1?p=1&amp;q=2 </x:loc><x:loc>https://a/2</x:loc></x:urlset>", False)],
        "competitor_id int, sitemap_url string, xml string, is_root boolean",
    )
    assert [r.url for r in io.sitemap_urls(maps).orderBy("harvest_idx").collect()] == ["https://a/1?p=1&q=2", "https://a/2"]
    assert io.sitemap_urls(maps, cap=1).count() == 1
    pages = spark.createDataFrame(
        [(1, 1, "https://a/c/", '<a href="p/1">'), (1, 2, "https://a/c/", '<a href="p/1">'), (1, 3, "https://a/c/", '<a href="/p/3">')], "competitor_id int, page_no int, url string, html string"
    )
    rules = spark.createDataFrame([(1, "/p/")], "competitor_id int, pattern string")
    assert [r.url for r in io.category_links(pages, rules).collect()] == ["https://a/c/p/1"]


def test_feed(spark, tmp_path):
    item = "<item><g:id>{0}</g:id><g:title>Frame x 10</g:title><g:link>https://a/f-{0}?u=1</g:link><g:price>{1}</g:price></item>"
    body = "".join(item.format(*x) for x in [("A", "12.50 GBP"), ("B", "0.00 GBP")])
    (tmp_path / "feed.xml").write_text(f'<rss xmlns:g="http://base.google.com/ns/1.0">{body}</rss>')
    good, bad = io.split_valid_feed(io.read_feed(spark, str(tmp_path / "feed.xml")))
    row = good.first()
    assert (row.sku_id, row.price_ex_vat, row.unit_qty, row.slug, row.availability) == ("A", 12.5, 10, "f-A", "in stock")
    assert bad.count() == 1


def test_append_and_csv(spark, tmp_path):
    e = enrich_snapshots(Mapped(spark, SF).observation, Mapped(spark, SF).sku, Mapped(spark, SF).competitor).limit(50)
    io.append_snapshots(e, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 50
    alerts = spark.createDataFrame([("critical", "S", 'a "b"', "C", 1.0, None, 0.0, "m")], "alert_type string, sku_id string, short_title string, competitor_name string, our_price double, their_price double, diff_pct double, message string")
    io.export_alerts_csv(alerts, "crit", str(tmp_path / "csv"))
    (line,) = [x for part in (tmp_path / "csv").glob("part-*.csv") for x in part.read_text().splitlines()[1:]]
    assert line == '"critical","S","a ""b""","C","1.0","","","m"'


def test_streams_equal_batch(spark, tmp_path):
    m = Mapped(spark, SF)
    o = m.observation.limit(400).cache()
    for i, part in enumerate(o.randomSplit([1.0, 1.0, 1.0], 7)):
        part.coalesce(1).write.parquet(str(tmp_path / "raw" / str(i)))
    src = str(tmp_path / "raw" / "*")
    read = lambda: spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streams.stream_alerts(read(), m.sku, m.competitor).writeStream.format("memory").queryName("stream_alerts_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    batch = price_alerts(enrich_snapshots(spark.read.schema(o.schema).parquet(src), m.sku, m.competitor))
    key = lambda df: sorted((r.run_id, r.seq, r.sku_id, r.competitor_id, r.alert_type) for r in df.collect())
    assert key(spark.table("stream_alerts_out")) == key(batch)
    root = str(tmp_path / "latest")
    q = read().writeStream.foreachBatch(streams.maintain_latest(spark, root)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((r.sku_id, r.competitor_id, r.run_id, r.seq) for r in df.collect())
    assert rows(streams.read_latest(spark, root)) == rows(latest_per_pair(spark.read.schema(o.schema).parquet(src)))
    twice = streams.dedupe_stream(read().unionByName(read()), "3650 days").writeStream.format("memory").queryName("once_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    twice.awaitTermination(120)
    assert spark.table("once_out").count() == o.select("sku_id", "competitor_id", "scraped_at").distinct().count()
    q = streams.stream_run_stats(read()).writeStream.outputMode("update").format("memory").queryName("run_stats_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c4")).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("run_stats_out").collect():  # an update gives a window's counters anew
        key = (r.window_start, r.run_id)
        got[key] = max(got.get(key, (0, 0, 0)), (r.attempted, r.succeeded, r.prices_found))
    want = Counter(), Counter(), Counter()
    for r in o.collect():
        key = (r.scraped_at.replace(minute=0, second=0, microsecond=0), r.run_id)
        for c, hit in zip(want, (True, r.availability != "error", r.raw_price is not None), strict=True):
            c[key] += hit
    # Rows later than the watermark are dropped, so a window may have fewer, never more
    assert got and all(all(n <= c[k] for n, c in zip(v, want, strict=True)) for k, v in got.items())
    assert sum(v == tuple(c[k] for c in want) for k, v in got.items()) >= 0.5 * len(got)


def test_latest_rewrites_only_touched_buckets_and_drops_old_versions(spark, tmp_path):
    row = lambda k, at: (f"s{k}", 1, at, at, 0)
    df = lambda *rows: spark.createDataFrame(rows, "sku_id string, competitor_id long, scraped_at long, run_id long, seq long")
    root = str(tmp_path / "t")
    keep = streams.maintain_latest(spark, root, buckets=4, keep=2)
    keep(df(*(row(k, 1) for k in range(40))), 0)
    first = {p.name for p in (tmp_path / "t" / "version=0").glob("bucket=*")}
    for batch in range(1, 6):
        keep(df(row(0, batch + 1), row(1, 0)), batch)
    keep(df(row(0, 6), row(1, 0)), 5)  # a batch that runs again
    keep(df(), 6)  # nothing arrived
    got = {r.sku_id: r.scraped_at for r in streams.read_latest(spark, root).collect()}
    assert got == {f"s{k}": 6 if k == 0 else 1 for k in range(40)}
    left = {p.name for p in (tmp_path / "t" / "version=0").glob("bucket=*")}
    assert len(first) == 4 and 1 <= 4 - len(left) <= 2  # what was not touched is where it was
    assert not (tmp_path / "t" / "version=2").exists() and len(list((tmp_path / "t" / "pointers").glob("batch=*"))) == 2


def test_several_changes_to_a_key_count_once(spark):
    shops = spark.createDataFrame([(1, "inc", True), (2, "ex", True)], "competitor_id long, vat_status string, active boolean")
    patches = spark.createDataFrame([(1, "ex", None, 1), (1, None, False, 2), (1, "unknown", None, 3)], "competitor_id long, vat_status string, active boolean, patched_at int")
    out = G.patch_competitors(shops, patches)
    assert sorted(map(tuple, out.collect())) == [(1, "unknown", False), (2, "ex", True)]
    assert G.patch_competitors(shops, patches.drop("patched_at")).count() == 2
    twice = spark.createDataFrame([(1, "ex", True), (1, "inc", False)], "competitor_id long, vat_status string, active boolean")
    assert {r.vat_status for r in G.merge_by_key(shops, twice, ["competitor_id"]).where("competitor_id = 1").collect()} == {"inc"}


def test_tables_by_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(100).selectExpr("id", "cast(id * 2 as int) as twice")
    io.write_table(df, url, "overwrite", table="numbers", parts=2, driver="org.apache.derby.jdbc.EmbeddedDriver")
    got = io.read_table(spark, url, "numbers", "id", (0, 99), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(100)]
    assert io.read_table(spark, url, "numbers", driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 100
    io.write_table(df, str(tmp_path / "p"))
    assert io.read_table(spark, str(tmp_path / "p")).count() == 100


def test_search_hits_and_variant_report(spark, tmp_path):
    page = '<a href="https://shop.example/category/">Frames</a><a class="x" href="https://other.example/p/snap-frame-a3/x">Snap frame A3</a><a href="https://shop.example/p/snap-frame-a3/1"><b>Snap frame A3</b> black</a>'
    pages = spark.createDataFrame([(1, "S-1", "shop.example", page), (1, "S-2", "shop.example", "<p>nothing</p>")], "competitor_id long, sku_id string, domain string, html string")
    skus = spark.createDataFrame([("S-1", "Snap Frame A3", None), ("S-2", "Chair", None)], "sku_id string, short_title string, unit_qty int")
    (hit,) = X.search_hits(pages, skus).collect()
    assert (hit.sku_id, hit.url, hit.link_text) == ("S-1", "https://shop.example/p/snap-frame-a3/1", "Snap frame A3  black") and hit.confidence >= 30
    changes = spark.createDataFrame([("S-1", {"Size": "A3"}, 50)], "sku_id string, labels map<string,string>, score int")
    io.export_variant_report(changes, str(tmp_path / "report"))
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "report")).columns == ["sku_id", "labels", "score"]


def test_plans_read_no_more_than_they_need(spark):
    m = Mapped(spark, SF)
    latest = latest_enriched(m.observation, m.sku, m.competitor)
    plan = latest.select("sku_id", "competitor_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "Generate" not in plan
    history = spark.createDataFrame([(1, 1, "SKU-1", 1, 1, 5.0, "in_stock", "x"), (2, 1, "SKU-1", 1, 2, 6.0, "in_stock", "y")], "run_id long, seq int, sku_id string, competitor_id long, scraped_at long, raw_price double, availability string, comp_title string")
    (r,) = latest_enriched(history, m.sku, m.competitor.withColumn("competitor_id", F.lit(1).cast("long")).limit(1)).collect()
    assert r.competitor_price == 6.0


def test_pairs_in_buckets_are_not_shuffled(spark, tmp_path):
    m = Mapped(spark, SF)
    spark.sql("DROP TABLE IF EXISTS hist_b"), spark.sql("DROP TABLE IF EXISTS match_b")
    rows = m.observation.select("run_id", "seq", "sku_id", "competitor_id", "scraped_at", "raw_price")
    for half, mode in (("run_id % 2 = 0", "overwrite"), ("run_id % 2 = 1", "append")):
        write_bucketed(rows.where(half), "hist_b", str(tmp_path / "h"), 4, mode=mode)
    matches = write_bucketed(m.match, "match_b", str(tmp_path / "m"), 4)
    history = known(spark, "hist_again", str(tmp_path / "h"), ", ".join(f"{n} {t}" for n, t in rows.dtypes), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        newest = latest_per_pair(history).select("sku_id", "competitor_id", F.col("raw_price").alias("last"))
        joined = matches.join(newest, ["sku_id", "competitor_id"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = m.match.join(latest_per_pair(rows).select("sku_id", "competitor_id", F.col("raw_price").alias("last")), ["sku_id", "competitor_id"], "left")
        assert Counter(map(tuple, joined.collect())) == Counter(map(tuple, want.select(*joined.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("hist_b", "match_b", "hist_again"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_json_is_parsed_once_a_script(spark):
    pages = spark.createDataFrame([], "competitor_id int, url string, html string")
    for f in (X.page_prices, X.product_profiles, X.jsonld_offers):
        assert f(pages)._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") + f(pages)._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") == 1
    html = '<script type="application/ld+json">[{"@graph":[{"@type":"Product","name":"A","offers":[{"lowPrice":"1,250.00"}]},{"@type":"Offer","price":7}]}]</script><script type="application/ld+json">{broken</script>'
    (r,) = X.product_profiles(spark.createDataFrame([(1, "u", html)], pages.schema)).collect()
    assert (r.title, r.price) == ("A", 1250.0)
    assert [(r.kind, r.price) for r in X.jsonld_offers(spark.createDataFrame([(1, "u", html)], pages.schema)).collect()] == [("Product", 1250.0), ("Offer", 7.0)]


def test_keyset_pages_follow_each_other(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    first = W.page_of(df, 1, [F.asc("k")], 4)
    last = first.collect()[-1].k
    assert list(itertools.chain(r.k for r in W.after(df, (last,), ["k"], 4).collect())) == [4, 5, 6, 7]


def test_named_variants_are_found_in_one_pass(spark):
    """Variants are scored once, moved as the two that may be chosen, and no side is broadcast by the estimated size of a scan."""
    matches = spark.createDataFrame([(f"S-{i}", c, f"https://s.example/p/{i % 4}" + (f"?variant=v{i}" if i % 3 == 0 else "")) for i in range(40) for c in (1, 2)] + [("S-1", 1, "https://s.example/p/2?variant=v39")], "sku_id string, competitor_id long, competitor_url string")
    variants = spark.createDataFrame([(f"https://s.example/p/{i % 4}", f"v{i}", f"item {i}", f"S{i}", i % 5 != 0) for i in range(40)], "parent_url string, variant_id string, variant_title string, variant_sku string, in_stock boolean").withColumn("options", F.create_map().cast("map<string,string>"))
    skus = spark.createDataFrame([(f"S-{i}", f"item {i}") for i in range(40)], "sku_id string, short_title string")
    got = V.resolve_variant(matches, variants, skus, "storefront")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan and plan.count("Exchange") == 5
    scored = V.score_variants(V.variants_for_matches(matches, variants, skus, "storefront", force=True), "storefront").collect()
    for (sku, shop), row in {(r.sku_id, r.competitor_id): r for r in got.collect()}.items():
        mine = [r for r in scored if (r.sku_id, r.competitor_id) == (sku, shop)]
        named = [r for r in mine if r.competitor_url.endswith(f"?variant={r.variant_id}")]
        order = sorted(named or mine, key=lambda r: (0 if named else -r.score, not r.in_stock, r.variant_id))
        near = [r for r in order if r.in_stock and order[0].score - r.score <= 10]
        want = order[0] if named or order[0].in_stock or not near else near[0]
        assert (row.variant_id, row.score) == (want.variant_id, 1000 if named else want.score)
    assert got.count() == 80


def test_lists_of_candidates_are_joined_last(spark):
    """A product is dealt out without its list, which comes with the last join."""
    m = Mapped(spark, "/root/testdata/sf0.001")
    seen = []
    staged = M.staged
    M.staged = lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or staged(df, name)
    try:
        pages, skus = titled(m)
        M.match_candidates(pages, skus, m.match)
    finally:
        M.staged = staged
    plan = dict(seen)["match-left"]
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert "p_of" in joins[0] and "competitor_id" not in joins[0] and "competitor_id" in joins[1]


def test_board_moves_prices_once_by_sku(spark):
    plan = catalogue.QUERIES["jn3_sku_board"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_sku_id" not in plan and "comp_title" not in plan
    assert len([line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(sku_id#\d+, \d+\), REPARTITION", line)]) == 1
    assert not re.search(r"hashpartitioning\([^)]*sku_id#\d+, _?competitor_id", plan)
