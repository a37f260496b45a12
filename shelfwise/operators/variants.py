"""Which variant of a competitor's product is our SKU? Scores, choice and repair of match URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import once
from shelfwise.functions.text import has_variant, parent_url, url_param, variant_url
from shelfwise.operators.windows import best_variant, contenders

# A colour and the words for it.
COLOURS = {
    "oak": ["oak", "westminster oak", "dark oak"],
    "dark oak": ["dark oak", "dark", "oak"],
    "westminster oak": ["westminster", "westminster oak"],
    "white": ["white", "white wash", "whitewash"],
    "black": ["black", "black ash", "blackash"],
    "ash": ["ash", "black ash"],
    "grey": ["grey", "gray", "slate", "slate grey"],
    "slate grey": ["slate", "grey", "gray", "slate grey"],
    "natural": ["natural", "wood", "pine", "light"],
    "silver": ["silver", "aluminium", "aluminum", "alu"],
    "gold": ["gold", "brass"],
    "chrome": ["chrome", "stainless"],
}
# What names a size or a colour, and the forms of sizes.
SIZE_AXES = "size|dimension|format|graphic|width|height|length|depth|notice_board"
COLOUR_AXES = "colour|color|finish|stain|material"
SIZE = r"(?i)\b(a[0-7]|[0-9]+\s*x\s*[0-9]+(?:\s*mm)?|[0-9]+(?:\.[0-9]+)?\s*mm|[0-9]+(?:\.[0-9]+)?\s*cm)\b"
DIMENSION = r"(?i)\b(a[0-7](?:\s+(?:portrait|landscape|p|l))?|[0-9]+\s*x\s*[0-9]+(?:\s*mm)?|[0-9]+(?:\.[0-9]+)?\s*mm)\b"


def _found(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    return F.array_distinct(F.transform(hits, lambda s: F.replace(F.lower(s), F.lit(" "), F.lit(""))))


def _colours(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in COLOURS.items())))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b[a-z]{3,}\b"), 0))


def _some(a: Column) -> Column:
    return F.size(a) > 0


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def score_configurable() -> Column:
    """Sum over a variant's labels: a size or colour axis by its tokens, any other by shared words. A size that the SKU id
    names counts on its own, beside the title's."""
    title, sku = F.col("short_title"), F.col("sku_id")
    in_title = _found(title, SIZE)
    by_id = F.lower(F.regexp_extract(sku, "(?i)(A[0-7])", 1))
    in_id = F.when(by_id != "", F.array(by_id)).otherwise(F.array().cast("array<string>"))
    sizes = F.array_union(in_title, in_id)
    id_sizes = F.when(by_id != "", F.array(by_id)).otherwise(_found(sku, SIZE))
    colours, words = _colours(title), _words(title)

    def of_label(entry: Column) -> Column:
        axis, option = F.lower(entry["key"]), F.coalesce(entry["value"], F.lit(""))
        o = _found(option, SIZE)
        first = F.when(_some(sizes) & _some(o), F.when(F.arrays_overlap(sizes, o), 50).otherwise(-20)).when(~_some(sizes), 5).otherwise(-5)
        second = F.when(F.arrays_overlap(in_title, o), 0).when(F.arrays_overlap(id_sizes, o), 50).when(_some(id_sizes) & _some(o), -20).otherwise(0)
        c = _colours(option)
        colour = F.when(_some(colours) & _some(c), F.when(F.arrays_overlap(colours, c), 30).otherwise(-10)).when(~_some(colours), 3).otherwise(0)
        shared = F.least(F.lit(15), F.size(F.array_intersect(words, _words(option))) * 5)
        return F.when(axis.rlike(SIZE_AXES), first + second).when(axis.rlike(COLOUR_AXES), colour).otherwise(shared)

    return _clamp(F.aggregate(F.map_entries("labels"), F.lit(0), lambda total, e: total + of_label(e)))


def score_variation() -> Column:
    title, text = F.col("short_title"), F.col("variant_title")
    own, theirs = _found(title, DIMENSION), _found(text, DIMENSION)
    turn = lambda c: F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b(portrait|landscape)\b", 1))
    a, b = turn(title), turn(text)
    size = F.when(_some(own) & _some(theirs), F.when(F.arrays_overlap(own, theirs), 60).otherwise(-30)).when(~_some(own), 5).otherwise(0)
    turned = F.when((a != "") & (b != ""), F.when(a == b, 30).otherwise(-20)).when(a != "", -5).otherwise(0)
    code = F.lower(F.replace(F.coalesce("variant_sku", F.lit("")), F.lit("-"), F.lit("")))
    squeezed = F.regexp_replace(F.lower(title), "[- ]", "")
    return _clamp(size + turned + F.when((code != "") & F.contains(squeezed, code), 20).otherwise(0))


def score_storefront() -> Column:
    sku, title = F.upper("sku_id"), F.col("short_title")
    suffix = F.lower(F.element_at(F.split(sku, "-"), -1))
    text = F.replace(F.lower(F.coalesce("variant_title", F.lit(""))), F.lit(" "), F.lit(""))
    inside = F.contains(text, suffix)
    by_suffix = F.when(suffix == "", 0).when(suffix.rlike("^[0-9]+$"), F.when(inside, 70).otherwise(-20)).otherwise(F.when(inside, 50).otherwise(0))

    def tokens(c: Column) -> Column:
        # a number with a unit is known by the number alone
        hits = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b\d+\s*mm\b|\ba[0-7]\b|\b\d+(?:\.\d+)?\s*cm\b|\b\d+\b"), 0)
        return F.array_distinct(F.transform(hits, lambda t: F.regexp_replace(t, r"\s*(?:mm|cm)$", "")))

    a, b = tokens(title), tokens(F.col("variant_title"))
    sizes = F.when(_some(a) & _some(b), F.when(F.arrays_overlap(a, b), 20).otherwise(-10)).otherwise(0)
    score = by_suffix + sizes + F.when(F.col("in_stock"), 5).otherwise(0)
    return F.when(F.upper("variant_sku") == sku, F.lit(100)).otherwise(_clamp(score))


SCORES = {"configurable": score_configurable, "variation": score_variation, "storefront": score_storefront}


def score_variants(pairs: DataFrame, site: str) -> DataFrame:
    """pairs of a match (sku_id, short_title) and a variant, with score."""
    return pairs.withColumn("score", SCORES[site]())


def _pointing(matches: DataFrame, site: str, force: bool) -> DataFrame:
    """Matches with the URL of their page; those that name a variant already only if ``force``."""
    df = matches.where("competitor_url is not null")
    if not force:
        df = df.where(~has_variant(F.col("competitor_url"), site))
    return df.withColumn("parent_url", parent_url(F.col("competitor_url")))


def variants_for_matches(matches: DataFrame, variants: DataFrame, skus: DataFrame, site: str, force: bool = False) -> DataFrame:
    """Every variant of the page that a match points to. Variants are parsed once a page and joined by its URL. All sides grow
    with the catalogue, and a scan that is read in part is estimated far below its rows' size, so none is left to be broadcast.
    Titles come before variants, while a match is still one row."""
    titled = _pointing(matches, site, force).join(skus.select("sku_id", "short_title").hint("merge"), "sku_id")
    return titled.join(variants.hint("merge"), "parent_url")


def best_for_matches(matches: DataFrame, variants: DataFrame, skus: DataFrame, site: str, force: bool = False) -> DataFrame:
    """Each match with the best variant of its page. Scores depend on SKU and page alone, so a SKU and a page that many
    competitors' matches share are scored once, and the choice is joined to all of them."""
    df = _pointing(matches, site, force)
    asked = df.select("sku_id", "parent_url").distinct()
    scored = score_variants(asked.join(variants, "parent_url").join(skus.select("sku_id", "short_title"), "sku_id"), site)
    return df.join(best_variant(scored, ["sku_id", "parent_url"]), ["sku_id", "parent_url"])


def resolve_variant(matches: DataFrame, variants: DataFrame, skus: DataFrame, site: str) -> DataFrame:
    """The variant that a match's URL names by id, or by label (equal, else contained); else the best by score."""
    pairs = variants_for_matches(matches, variants, skus, site, force=True)
    name = {"configurable": "child", "variation": "variation_id", "storefront": "variant"}[site]
    url = F.col("competitor_url")
    label = F.lower(F.replace(F.coalesce(url_param(url, "attribute_dimension"), F.lit("")), F.lit("+"), F.lit(" ")))
    text = F.lower(F.coalesce("variant_title", F.lit("")))
    chosen = F.filter(F.map_entries("options"), lambda e: ~F.contains(url, F.concat(F.lit("super_attribute["), e["key"], F.lit("]="), e["value"])))
    all_equal = (F.size(F.col("options")) > 0) & (F.size(chosen) == 0) & F.contains(url, F.lit("super_attribute"))
    named = (
        F.when((url_param(url, name) == F.col("variant_id")) | all_equal, 1000)
        .when((label != "") & (text == label), 900)
        .when((label != "") & F.contains(text, label), 800)
        .otherwise(0)
    )
    # Any that the URL names come before all others, whose scores reach 100 at most, and stock doesn't count against them
    scored = once(score_variants(pairs, site), named_=named).withColumn("score", F.when(F.col("named_") > 0, F.col("named_")).otherwise(F.col("score")))
    margin = F.when(F.col("best_score_") > 100, -1).otherwise(10)
    few = contenders(scored.drop("named_"), ["parent_url", "sku_id", "competitor_id"])
    return best_variant(few, ["sku_id", "competitor_id"], margin=margin)


def repair_variants(matches: DataFrame, variants: DataFrame, skus: DataFrame, site: str, min_score: int = 1, force: bool = False) -> DataFrame:
    """The changes to matches whose URL should name a variant: sku_id, competitor_id, previous_url, competitor_url,
    match_status, awaiting_scrape, score. Nothing is written; unchanged URLs are left out."""
    best = best_for_matches(matches, variants, skus, site, force)
    labels = F.col("options") if site == "configurable" else F.col("labels")
    new = variant_url(F.col("parent_url"), site, F.col("variant_id"), labels)
    return (
        best.where(F.col("score") >= min_score)
        .select("sku_id", "competitor_id", F.col("competitor_url").alias("previous_url"), new.alias("new_url"), "score")
        .where("new_url <> previous_url")
        .select("sku_id", "competitor_id", "previous_url", F.col("new_url").alias("competitor_url"), F.lit("amended").alias("match_status"), F.lit(True).alias("awaiting_scrape"), "score")
    )
