"""Fetched pages to facts: prices, profiles, variants, links. html is read once and dropped before any shuffle.

JSON of unknown shape is parsed once a script or document into a VARIANT, and paths are read from that; JSON of a known
shape is parsed once by its schema. What does not parse gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import coalesce_falsy, once, rounded, upper_median
from shelfwise.functions.text import detect_oos, detect_vat, fuzzy_confidence, is_category_url, parent_url, parse_price

LD_SCRIPT = r"(?is)<script[^>]*application/ld.json[^>]*>(.*?)</script>"
# Words that a product code follows.
CODE_WORDS = ["sku", "product.?code", "model", "mpn", "item_number"]
CODE_PATTERNS = [w + r"[\"']?\s*[:=]\s*[\"']?([A-Z0-9\-]{3,20})" for w in CODE_WORDS]


def _text(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _at(v: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path of a VARIANT; null if nothing does, or nothing of the kind."""
    return F.try_variant_get(v, path, kind)


def _each(v: Column, path: str = "$") -> Column:
    """The elements of an array at a path; null unless there is one."""
    return _at(v, path, "array<variant>")


def _first(pattern: str, text: Column, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def jsonld_items(html: Column) -> Column:
    """All JSON-LD objects of a page as VARIANTs: lists and @graph opened, broken scripts left out."""
    scripts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LD_SCRIPT), 1)
    parsed = F.transform(scripts, lambda s: F.try_parse_json(s))
    items = F.flatten(F.transform(parsed, lambda p: F.coalesce(_each(p), F.array(p))))
    opened = F.flatten(F.transform(items, lambda i: F.coalesce(_each(i, '$["@graph"]'), F.array(i))))
    return F.filter(opened, lambda i: _at(i, '$["@type"]').isNotNull())


def _offer_price(item: Column) -> Column:
    offer = F.coalesce(_at(item, "$.offers[0]", "variant"), _at(item, "$.offers", "variant"))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    of_product = coalesce_falsy(number(_at(offer, "$.price")), number(_at(offer, "$.lowPrice")))
    kind = _at(item, '$["@type"]')
    return F.when(kind == "Product", of_product).when(kind == "Offer", coalesce_falsy(number(_at(item, "$.price"))))


def jsonld_price(items: Column) -> Column:
    return F.get(F.filter(F.transform(items, _offer_price), lambda p: p.isNotNull()), 0)


def jsonld_offers(pages: DataFrame) -> DataFrame:
    """One row a priced JSON-LD object: competitor_id, url, item_no, kind, price."""
    at = pages.select("competitor_id", "url", F.posexplode(jsonld_items(F.col("html"))).alias("item_no", "item"))
    return at.select("competitor_id", "url", "item_no", _at(F.col("item"), '$["@type"]').alias("kind"), _offer_price(F.col("item")).alias("price")).where("price is not null")


def _meta_price(html: Column) -> Column:
    found = []
    for name in ("product:price:amount", "og:price:amount"):
        found += [_first(f'(?i)property="{name}"[^>]*content="([^"]+)"', html), _first(f'(?i)content="([^"]+)"[^>]*property="{name}"', html)]
    return F.coalesce(*(parse_price(c) for c in found))


def _itemprop(html: Column) -> Column:
    return F.coalesce(_first(r'(?i)itemprop=[^>]*price[^>]*content="([^"]+)"', html), _first(r'(?i)content="([^"]+)"[^>]*itemprop=[^>]*price', html))


def pound_median(html: Column, most: float = 99999) -> Column:
    values = F.transform(F.regexp_extract_all(html, F.lit(r"£\s*([\d,]+\.\d{2})"), 1), lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("double"))
    return upper_median(F.filter(values, lambda v: (v > 0.01) & (v < most)))


def page_prices(pages: DataFrame) -> DataFrame:
    """competitor_id, url, price: JSON-LD, else meta tags, else itemprop, else the upper median of the £ amounts."""
    html = F.coalesce("html", F.lit(""))
    price = F.coalesce(jsonld_price(jsonld_items(html)), _meta_price(html), parse_price(_itemprop(html)), pound_median(html))
    return pages.select("competitor_id", "url", price.alias("price"))


def _bare(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", ""))


def page_facts(pages: DataFrame) -> DataFrame:
    """competitor_id, url, title, vat, availability from the text of a page."""
    html = F.coalesce("html", F.lit(""))
    body = _bare(html)
    return pages.select("competitor_id", "url", page_title(html).alias("title"), detect_vat(body).alias("vat"), F.when(detect_oos(body), "out_of_stock").otherwise("in_stock").alias("availability"))


def product_profiles(pages: DataFrame) -> DataFrame:
    """competitor_id, url, title, description, price, sku_codes (at most five), profile."""
    html = F.coalesce("html", F.lit(""))
    found = F.filter(jsonld_items(html), lambda i: _at(i, '$["@type"]') == "Product")
    df = once(pages.select("competitor_id", "url", html.alias("html")), items=found)
    products = F.col("items")
    pick = lambda path: F.get(F.filter(F.transform(products, lambda i: _at(i, path)), lambda t: F.coalesce(t, F.lit("")) != ""), 0)
    raw = F.col("html")
    plain = F.trim(F.regexp_replace(page_title(raw), r"\s*[\|\-–]\s*.{3,60}$", ""))
    meta = F.coalesce(
        _first(r"(?i)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']{10,400})", raw),
        _first(r"(?i)content=[\"']([^\"']{10,400})[\"'][^>]*name=[\"']description[\"']", raw),
    )
    price = F.coalesce(jsonld_price(products), F.replace(_itemprop(raw), F.lit(","), F.lit("")).try_cast("double"), pound_median(raw, 9999))
    codes = F.flatten(F.array(*(F.regexp_extract_all(raw, F.lit(f"(?i){p}"), 1) for p in CODE_PATTERNS)))
    out = df.select(
        "competitor_id", "url",
        F.coalesce(pick("$.name"), plain, F.lit("")).alias("title"),
        F.coalesce(F.substring(pick("$.description"), 1, 500), F.trim(meta), F.lit("")).alias("description"),
        price.alias("price"),
        F.slice(F.array_distinct(F.transform(codes, F.upper)), 1, 5).alias("sku_codes"),
    )
    return out.withColumn("profile", F.trim(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("description", F.lit("")))))


def preview_images(pages: DataFrame) -> DataFrame:
    """competitor_id, url, image: og:image, else twitter:image, if it is an http address."""
    html = F.coalesce("html", F.lit(""))
    image = F.trim(F.coalesce(_first(r'(?i)<meta[^>]*property="og:image"[^>]*content="([^"]*)"', html), _first(r'(?i)<meta[^>]*name="twitter:image"[^>]*content="([^"]*)"', html)))
    return pages.select("competitor_id", "url", F.when(image.startswith("http"), image).alias("image"))


def shopify_js_price(docs: DataFrame) -> DataFrame:
    """competitor_id, url, price from a product's .js text: the first variant's pence, else the product's."""
    pence = coalesce_falsy(_text(F.col("json"), "$.variants[0].price").try_cast("double"), _text(F.col("json"), "$.price").try_cast("double"))
    return docs.select("competitor_id", "url", rounded(pence / 100).alias("price"))


def site_prices(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Prices by a pattern that a competitor's rule (competitor_id, pattern) gives."""
    by = rules.select(F.col("competitor_id").alias("rule_for"), "pattern")
    amount = parse_price(F.call_function("regexp_extract", F.col("html"), F.col("pattern"), F.lit(1)))
    return pages.join(by, F.col("competitor_id") == F.col("rule_for")).select("competitor_id", "url", amount.alias("price"))


def search_hits(result_pages: DataFrame, skus: DataFrame, min_conf: int = 30) -> DataFrame:
    """result_pages (competitor_id, sku_id, domain, html) to the first product-like link that fits the SKU."""
    link = r'(?is)<a\s[^>]*href="([^"#]+)"[^>]*>(.*?)</a>'
    urls = F.regexp_extract_all("html", F.lit(link), 1)
    texts = F.regexp_extract_all("html", F.lit(link), 2)
    rows = result_pages.select("competitor_id", "sku_id", "domain", F.posexplode(F.arrays_zip(urls.alias("u"), texts.alias("t"))).alias("place", "hit"))
    rows = rows.select("competitor_id", "sku_id", "domain", "place", F.col("hit.u").alias("url"), F.trim(_bare(F.col("hit.t"))).alias("link_text"))
    rows = rows.where(F.contains(F.col("url"), F.col("domain"))).join(skus.select("sku_id", "short_title", "unit_qty"), "sku_id")
    conf = fuzzy_confidence(F.col("short_title"), F.col("unit_qty"), F.col("link_text"), F.col("url"))
    w = Window.partitionBy("competitor_id", "sku_id").orderBy(is_category_url(F.col("url")), "place")
    good = rows.withColumn("confidence", conf).where(F.col("confidence") >= min_conf)
    return good.withColumn("n", F.row_number().over(w)).where("n = 1").select("competitor_id", "sku_id", "url", "link_text", "confidence")


CONFIG = r"(?s)initConfigurableOptions\(\s*'(\d+)'\s*,\s*(\{.*?\})\s*\)"
_AMOUNT = "struct<amount:double>"
_CONFIG_SCHEMA = (
    "struct<attributes:map<string,struct<code:string,label:string,options:array<struct<id:string,label:string>>>>,"
    f"optionPrices:map<string,struct<basePrice:{_AMOUNT},finalPrice:{_AMOUNT},oldPrice:{_AMOUNT},tierPrices:array<struct<qty:int,price:double,basePrice:double,percentage:double>>,lead_time:string>>,"
    "index:map<string,map<string,string>>,is_saleable:map<string,boolean>>"
)
VARIANT_COLUMNS = ["parent_url", "variant_id", "labels", "variant_title", "variant_sku", "price_ex_vat", "price_inc_vat", "in_stock", "tier_prices", "lead_time", "options"]
_NO_TIERS = "array<struct<qty:int,price:double,basePrice:double,percentage:double>>"


def configurable_variants(pages: DataFrame) -> DataFrame:
    """One row a child of a configurable product's options: VARIANT_COLUMNS. Broken JSON gives no rows."""
    blob = F.from_json(F.regexp_extract("html", CONFIG, 2), _CONFIG_SCHEMA)
    df = pages.select(parent_url(F.col("url")).alias("parent_url"), blob.alias("c"))
    df = df.select("parent_url", "c", F.explode("c.optionPrices").alias("variant_id", "p"))
    index = F.coalesce(F.element_at("c.index", F.col("variant_id")), F.create_map().cast("map<string,string>"))
    attribute = lambda k: F.element_at(F.col("c.attributes"), k)
    label_of = lambda k, v: F.get(F.filter(attribute(k)["options"], lambda o: o["id"] == v)["label"], 0)
    labels = F.map_from_entries(F.transform(F.map_entries(index), lambda e: F.struct(F.coalesce(attribute(e["key"])["label"], e["key"]).alias("k"), label_of(e["key"], e["value"]).alias("v"))))
    return df.select(
        "parent_url", "variant_id", labels.alias("labels"), F.array_join(F.map_values(labels), " / ").alias("variant_title"), F.lit(None).cast("string").alias("variant_sku"),
        F.coalesce("p.basePrice.amount", F.lit(0.0)).alias("price_ex_vat"), F.coalesce("p.finalPrice.amount", F.lit(0.0)).alias("price_inc_vat"),
        F.coalesce(F.element_at("c.is_saleable", F.col("variant_id")), F.lit(True)).alias("in_stock"),
        F.coalesce("p.tierPrices", F.array().cast(_NO_TIERS)).alias("tier_prices"), F.col("p.lead_time").alias("lead_time"), index.alias("options"),
    )


VARIATIONS = r"""(?is)data-product_variations=(?:"([^"]*)"|'([^']*)')"""


def woo_variations(pages: DataFrame) -> DataFrame:
    """One row a variation of a shop page's data-product_variations: VARIANT_COLUMNS."""
    raw = F.concat(F.regexp_extract("html", VARIATIONS, 1), F.regexp_extract("html", VARIATIONS, 2))
    for entity, char in (("&quot;", '"'), ("&#039;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    rows = F.from_json(raw, "array<struct<variation_id:string,attributes:map<string,string>,price_ex_vat:string,display_price:string,price_html:string,is_in_stock:boolean,sku:string>>")
    df = pages.select(parent_url(F.col("url")).alias("parent_url"), F.explode(rows).alias("v")).where("coalesce(v.variation_id, '') <> ''")
    entries = F.map_entries(F.coalesce("v.attributes", F.create_map().cast("map<string,string>")))
    sized = F.filter(entries, lambda e: F.lower(e["key"]).rlike("dimension|size"))
    dimension = F.coalesce(F.nullif(F.get(sized["value"], 0), F.lit("")), F.get(entries["value"], 0), F.lit(""))
    inc = F.col("v.display_price").try_cast("double")
    least = F.array_min(F.transform(F.regexp_extract_all(F.replace(F.coalesce("v.price_html", F.lit("")), F.lit(","), F.lit("")), F.lit(r"\d+\.\d{2}"), 0), lambda p: p.try_cast("double")))
    ex = F.coalesce(F.col("v.price_ex_vat").try_cast("double"), rounded(inc / 1.2, 4), least)
    return df.select(
        "parent_url", F.col("v.variation_id").alias("variant_id"), F.create_map(F.lit("dimension"), dimension).alias("labels"), dimension.alias("variant_title"),
        F.coalesce("v.sku", F.lit("")).alias("variant_sku"), ex.alias("price_ex_vat"), inc.alias("price_inc_vat"), F.coalesce("v.is_in_stock", F.lit(True)).alias("in_stock"),
        F.array().cast(_NO_TIERS).alias("tier_prices"), F.lit(None).cast("string").alias("lead_time"), F.create_map().cast("map<string,string>").alias("options"),
    )


def shopify_variants(pages: DataFrame) -> DataFrame:
    """pages (url, json): a product's JSON, wrapped, bare or as storefront page data, to VARIANT_COLUMNS."""
    j = F.col("j")
    parsed = once(pages.select(parent_url(F.col("url")).alias("parent_url"), "json"), j=F.try_parse_json("json"))
    store = F.coalesce(_at(j, "$.result.data.shopifyProduct", "variant"), _at(j, "$.result.pageContext.product", "variant"))
    variants = F.coalesce(_each(store, "$.variants"), F.when(store.isNull(), F.coalesce(_each(j, "$.product.variants"), _each(j, "$.variants"))))
    df = parsed.select("parent_url", store.isNotNull().alias("is_store"), F.explode(variants).alias("v"))
    v = F.col("v")
    gid = F.coalesce(_at(v, "$.storefrontId"), _at(v, "$.shopifyId"), _at(v, "$.id"))
    number = lambda path: coalesce_falsy(_at(v, path).try_cast("double"))
    price = F.when(F.col("is_store"), F.coalesce(number("$.priceV2.amount"), number("$.price"))).otherwise(F.coalesce(number("$.price"), number("$.compare_at_price")))
    chosen = F.array_join(F.transform(_each(v, "$.selectedOptions"), lambda o: F.coalesce(_at(o, "$.value"), F.lit(""))), " / ")
    title = F.coalesce(F.nullif(chosen, F.lit("")), _at(v, "$.title"), F.lit(""))
    stock = F.coalesce(_at(v, "$.availableForSale"), _at(v, "$.available"), F.lit("true")) == "true"
    variant_id = F.element_at(F.split(gid, "/"), -1)
    return df.select(
        "parent_url", variant_id.alias("variant_id"), F.create_map(F.lit("title"), title).alias("labels"), title.alias("variant_title"), F.coalesce(_at(v, "$.sku"), F.lit("")).alias("variant_sku"),
        F.coalesce(price, F.lit(0.0)).alias("price_ex_vat"), F.lit(None).cast("double").alias("price_inc_vat"), stock.alias("in_stock"),
        F.array().cast(_NO_TIERS).alias("tier_prices"), F.lit(None).cast("string").alias("lead_time"), F.create_map().cast("map<string,string>").alias("options"),
    ).where("coalesce(variant_id, '') <> ''")
