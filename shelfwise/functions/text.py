"""Titles, page text and URLs: columns in, columns out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results and stand as given.
VAT_INC = [
    r"inc(?:l(?:uding)?)?\s*\.?\s*vat",
    r"inc\s+vat",
    r"including\s+vat",
    r"prices?\s+include\s+vat",
    r"vat\s+included",
]
VAT_EX = [
    r"ex(?:cl(?:uding)?)?\s*\.?\s*vat",
    r"excl\s+vat",
    r"excluding\s+vat",
    r"\+\s*vat",
    r"prices?\s+exclude\s+vat",
    r"before\s+vat",
    r"nett\s+price",
]
OUT_OF_STOCK = [
    r"out\s+of\s+stock",
    r"currently\s+unavailable",
    r"temporarily\s+out",
    r"sold\s+out",
    r"no\s+stock",
    r"backordered?",
    r"not\s+available",
]
STOP_WORDS = (
    "the a an and of for with in to self adhesive pack set lot box bag new uk free delivery shipping "
    "holders holder signs sign displays display"
).split()
CATEGORY_SIGNALS = [
    "/collections/", "/categories/", "/category/", "/c/", "/search", "/shop/", "/products?", "/catalogue", ".htm?",
    ".aspx?", "/a-boards", "/pavement-signs/", "/wall-sign-holders", "/acrylic-sign-holder-acrylic-frame/",
    "/a-frame-chalkboard",
]
CONTENT_SIGNALS = [
    "/blog", "/blogs", "/news", "/articles", "/article", "/post/", "/posts/", "/journal/", "/resources/", "/guides/",
    "/guide/", "/tips/", "/about", "/terms", "/privacy", "/contact", "/faq", "/pages/", "/info/", "/help/",
]
MEASURE = r'(?i)\d+(?:\.\d+)?\s*(?:cm|mm|m\b|ft|inch(?:es)?|"|kg\b|g\b)'
PACK_PATTERNS = [
    r"\bpack\s+of\s+(\d+)\b",
    r"\bset\s+of\s+(\d+)\b",
    r"\bbox\s+of\s+(\d+)\b",
    r"\bbag\s+of\s+(\d+)\b",
    r"\bper\s+(\d+)\b",
    r"\bqty\s*[:\-]?\s*(\d+)\b",
    r"\b(\d+)\s*/?\s*pk\b",
    r"\b(\d+)\s*pack\b",
    r"\bx\s*(\d+)\b(?!\s*DIM)",
    r"\b(\d+)\s*x\b(?!\s*\d)",
]
LEGACY_PACK_PATTERNS = [
    r"(?<!\d\s)(?<!\d)\bx\s*(\d+)\b",
    r"\bpack\s+of\s+(\d+)\b",
    r"\b(\d+)\s*pack\b",
    r"\bset\s+of\s+(\d+)\b",
    r"\bbox\s+of\s+(\d+)\b",
    r"\bbag\s+of\s+(\d+)\b",
    r"\bper\s+(\d+)\b",
    r"\bqty\s*[:\-]?\s*(\d+)\b",
    r"\b(\d+)\s*x\b(?!\s*\d)",
]
PRINT_PHRASES = [
    r"\bcustom[- ]?print(?:ed)?\b",
    r"\bwith[- ]?print(?:ed)?[- ]?poster\b",
    r"\bInc(?:\.)?[- ]?Printed\b",
    r"\bCustom[- ]?Printed\b",
    r"\bPrinted\b",
    r"\bBespoke[- ]?Brand(?:ing|ed)?\b",
    r"\bBranded\b",
]
PACK_PHRASES = [r"\bx\s*\d+\b", r"\bpack\s+of\s+\d+\b", r"\b\d+\s*pack\b"]
DIMENSION = r"\b(?:a[0-9]|[0-9]+(?:\.[0-9]+)?(?:cm|mm)|[0-9]+x[0-9]+(?:mm)?)\b"
SIZE = r"(?i)\b(a0|a1|a2|a3|a4|a5|a6|a7|dl|1/3\s*a4|half\s*a4|\d+\s*x\s*\d+\s*(?:mm|cm)?)\b"


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def _first_in_range(text: Column, patterns: list[str]) -> Column:
    """The first pattern whose first hit is a number from 2 to 500; ``text`` is in lower case. Work ends at the first hit,
    a pattern is tried only where its word occurs, and text without a digit is left at once. Lambdas bind the text and each
    hit, so that each is worked out once a row however often it is named."""

    def first(t: Column) -> Column:
        tries = []
        for p in patterns:
            word = re.search(r"pack|set|box|bag|per|qty|pk|x", p).group()
            hit = F.get(F.filter(F.array(_number(t, f"(?i){p}")), lambda n: n.between(2, 500)), 0)
            tries.append(F.when(F.contains(t, F.lit(word)), hit))
        return F.coalesce(*tries)

    return F.when(text.rlike("[0-9]"), F.get(F.transform(F.array(text), first), 0))


def pack_qty(title: Column) -> Column:
    """Pack quantity in a title; numbers with a unit of measure are dimensions and do not count."""
    low = F.lower(title)
    # The unit is left out only where some number may have one
    return _first_in_range(F.when(low.rlike(r"[0-9]\s*[cmfikg\"]"), F.regexp_replace(low, MEASURE, "DIM")).otherwise(low), PACK_PATTERNS)


def pack_qty_legacy(title: Column) -> Column:
    return _first_in_range(F.lower(title), LEGACY_PACK_PATTERNS)


def feed_unit_qty(title: Column) -> Column:
    return _number(title, r"(?i)(?:x\s*|pack\s+of\s+)(\d+)")


def feed_price(text: Column) -> Column:
    return F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double")


def _any(text: Column, patterns: list[str]) -> Column:
    return F.lower(text).rlike("|".join(patterns))


def detect_vat(text: Column) -> Column:
    return F.when(_any(text, VAT_INC), "inc").when(_any(text, VAT_EX), "ex").otherwise("unknown")


def detect_oos(text: Column) -> Column:
    return F.coalesce(_any(text, OUT_OF_STOCK), F.lit(False))


def parse_price(text: Column) -> Column:
    value = F.regexp_extract(F.translate(text, ",£", ""), r"\b(\d{1,5}\.\d{2})\b", 1).try_cast("double")
    return F.when((value > 0.01) & (value < 99999), value)


def search_query(title: Column, sku_id: Column, legacy: bool = False) -> Column:
    """A title without pack sizes and, for printed or branded SKUs, without the words for print."""
    def without(text: Column, phrases: list[str]) -> Column:
        return reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", ""), phrases, text)

    base = title if legacy else F.when(sku_id.rlike("(?i)-(PRINTED|BRANDED)$"), without(title, PRINT_PHRASES)).otherwise(title)
    squeezed = F.trim(F.regexp_replace(without(base, PACK_PHRASES), r"\s{2,}", " "))
    return F.trim(F.regexp_replace(squeezed, "[-—–]+$", ""))


def _tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.lower(text), F.lit("")), F.lit(pattern), 0))


def _stop_words() -> Column:
    return F.array(*map(F.lit, STOP_WORDS))


def fuzzy_confidence(title: Column, unit_qty: Column, comp_title: Column, comp_url: Column) -> Column:
    """0 to 100: how surely a competitor's title and URL are this SKU."""
    low_title, low_url = F.coalesce(F.lower(comp_title), F.lit("")), F.coalesce(F.lower(comp_url), F.lit(""))
    word = r"\b[a-z0-9]{2,}\b"
    own = F.array_except(_tokens(title, word), _stop_words())
    theirs = F.array_except(_tokens(comp_title, word), _stop_words())
    shared = F.when(F.size(own) > 0, F.floor(F.size(F.array_intersect(own, theirs)) / F.size(own) * 40)).otherwise(0)
    dims = _tokens(title, DIMENSION)
    other = F.array_union(_tokens(comp_title, DIMENSION), _tokens(comp_url, DIMENSION))
    alike = (F.size(F.array_except(dims, other)) == 0) & (F.size(F.array_except(other, dims)) == 0)
    by_dims = (
        F.when(F.size(dims) == 0, 0)
        .when(alike, 30)
        .when(F.arrays_overlap(dims, other), 15)
        .when(F.size(other) > 0, -15)
        .otherwise(0)
    )
    qty = unit_qty.cast("string")
    exact = F.concat(F.lit(r"\b"), qty, F.lit(r"\b"))
    number = F.regexp_extract(low_title, r"\b(x?\s*\d{2,4})\b", 1)
    bare = F.trim(F.regexp_replace(number, "^[x ]+|[x ]+$", ""))
    by_qty = (
        F.when(unit_qty.isNull() | (unit_qty == 0), 0)
        .when(F.regexp_like(low_title, exact) | F.regexp_like(low_url, exact), 20)
        .when((number != "") & (bare != qty), -10)
        .otherwise(0)
    )
    long_words = F.regexp_extract_all(F.coalesce(F.lower(title), F.lit("")), F.lit(r"\b[a-z]{4,}\b"), 0)
    keys = F.slice(F.filter(long_words, lambda w: ~F.array_contains(_stop_words(), w)), 1, 5)
    in_url = F.least(F.lit(10), F.size(F.filter(keys, lambda w: F.contains(low_url, w))) * 2)
    return F.greatest(F.lit(0), F.least(F.lit(100), shared + by_dims + by_qty + in_url)).cast("int")


def size_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SIZE), 0)
    return F.array_distinct(F.transform(found, lambda s: F.replace(F.upper(s), F.lit(" "), F.lit(""))))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-|-$", "")


def url_slug(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.substring_index(url, "?", 1), "/+$", ""), "/"), -1)


def image_path(sku: Column, url: Column) -> Column:
    """sku.extension, the extension one of jpg, jpeg, png, webp, gif, else jpg."""
    ext = F.lower(F.regexp_extract(F.substring_index(url, "?", 1), r"\.([A-Za-z0-9]+)$", 1))
    return F.concat(sku, F.lit("."), F.when(ext.isin("jpg", "jpeg", "png", "webp", "gif"), ext).otherwise("jpg"))


def strip_sku_suffix(sku: Column) -> Column:
    return F.regexp_replace(sku, r"[A-Z]\d*$", "")


def title_from_slug(url: Column) -> Column:
    return F.replace(url_slug(url), F.lit("-"), F.lit(" "))


def clean_domain(domain: Column, strip_chars: bool = False) -> Column:
    """Without a leading www.; with ``strip_chars`` any leading w and dot go, as the older runs did."""
    return F.regexp_replace(domain, r"^[w.]+" if strip_chars else r"^www\.", "")


def needs_proxy(url: Column, domains: list[str]) -> Column:
    host = F.replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.lit("www."), F.lit(""))
    return reduce(lambda a, b: a | b, ((host == d) | host.endswith("." + d) for d in domains), F.lit(False))


def _path(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit("")))


def _parts(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "/"), lambda p: p != ""))


def is_category_url(url: Column) -> Column:
    u = F.substring_index(F.lower(url), "?", 1)
    return reduce(lambda a, s: a | F.contains(u, F.lit(s)), CATEGORY_SIGNALS, F.lit(False)) | (_parts(u) <= 2)


def is_content_url(url: Column) -> Column:
    return in_path(url, CONTENT_SIGNALS)


def is_product_url(url: Column) -> Column:
    return ~is_category_url(url) & ~is_content_url(url)


def has_depth(url: Column, n: int = 2) -> Column:
    return _parts(_path(url)) >= n


def in_path(url: Column, segments: list[str]) -> Column:
    return reduce(lambda a, s: a | F.contains(_path(url), F.lit(s.lower())), segments, F.lit(False))


def parent_url(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def has_variant(url: Column, site: str) -> Column:
    """Whether a URL already names a variant: site is configurable, variation or storefront."""
    mark = {"configurable": "super_attribute", "variation": "variation_id=", "storefront": "variant="}[site]
    return F.contains(url, F.lit(mark))


def url_param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def variant_url(base: Column, site: str, variant_id: Column, labels: Column | None = None) -> Column:
    """The URL that selects a variant; ``labels`` maps attribute to option."""
    bare = F.substring_index(base, "?", 1)
    if site == "configurable":
        entries = F.array_sort(F.map_entries(labels))
        said = F.transform(entries, lambda e: F.concat(F.lit("super_attribute["), e["key"], F.lit("]="), e["value"]))
        return F.concat(bare, F.lit("?"), F.array_join(said, "&"))
    if site == "variation":
        label = F.element_at(F.map_values(labels), 1)
        return F.concat(bare, F.lit("?variation_id="), variant_id, F.lit("&attribute_dimension="), F.url_encode(label))
    return F.concat(bare, F.lit("?variant="), variant_id)


def token_overlap(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def token_equal(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
