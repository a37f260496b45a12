"""Golden rows of FIXTURES.md §3."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.functions import synonyms as Y
from shelfwise.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, quantity",
    [
        ("pack of 10", 10), ("10/pk", 10), ("10 pack", 10), ("qty: 10", 10), ("10x", 10), ("100 x 4cm", 100), ("80cm x 2m", None),
        ("", None), (None, None), ("pack of 1", None), ("pack of 501", None), ("pack of 501 x 20", 20),
    ],
)
def test_pack_qty(spark, title, quantity):
    assert one(spark, T.pack_qty(F.lit(title).cast("string"))) == quantity


@pytest.mark.parametrize("text, vat", [("£10 inc. VAT (£8.33 ex VAT)", "inc"), ("£10 + VAT", "ex"), ("£10", "unknown"), (None, "unknown")])
def test_vat(spark, text, vat):
    assert one(spark, T.detect_vat(F.lit(text).cast("string"))) == vat


def test_stock_and_price(spark):
    assert one(spark, T.detect_oos(F.lit("Sold out"))) is True
    assert one(spark, T.detect_oos(F.lit("In stock"))) is False
    assert one(spark, T.parse_price(F.lit("£1,234.50"))) == 1234.5
    assert one(spark, T.parse_price(F.lit("£12"))) is None
    assert one(spark, T.parse_price(F.lit("0.01"))) is None


@pytest.mark.parametrize("our, their, diff", [(10.0, 9.0, -10.0), (10.0, 12.0, 20.0), (0.0, 5.0, 0.0)])
def test_diff(spark, our, their, diff):
    assert one(spark, S.diff_pct(F.lit(our), F.lit(their))) == diff


def test_prices(spark):
    assert one(spark, S.normalise_price(F.lit(12.0), F.lit("inc"))) == 10.0
    assert one(spark, S.normalise_price(F.lit(12.0), F.lit("unknown"))) == 12.0
    assert one(spark, S.per_unit_price(F.lit(10.0), F.lit(3))) == 3.333333
    assert one(spark, S.per_unit_price(F.lit(10.0), F.lit(None).cast("int"))) == 10.0
    assert one(spark, S.coalesce_falsy(F.lit(0.0), F.lit(1100.0))) == 1100.0


@pytest.mark.parametrize("diff, tier", [(-10.0, "r"), (-9.99, "a"), (-5.0, "a"), (-4.99, "p"), (1.99, "p"), (2.0, "g"), (None, "par")])
def test_tier(spark, diff, tier):
    assert one(spark, S.tier(F.lit(diff).cast("double"))) == tier


@pytest.mark.parametrize("url, is_category", [("https://a.co", True), ("https://a.co/x", False), ("https://a.co/c/x", True)])
def test_category(spark, url, is_category):
    assert one(spark, T.is_category_url(F.lit(url))) is is_category


@pytest.mark.parametrize("comp, own, points", [(12.0, 10.0, 20), (25.0, 10.0, 5), (0.0, 10.0, 0), (None, 10.0, 0)])
def test_price_score(spark, comp, own, points):
    assert one(spark, S.price_score(F.lit(comp).cast("double"), F.lit(own), F.lit(None).cast("int"))) == points


@pytest.mark.parametrize("other, score", [("click frame a4", 55), ("click frame a3", 5)])
def test_keyword_score(spark, other, score):
    a, b = F.lit("a4 snap frame"), F.lit(other)
    assert one(spark, Y.keyword_score(Y.synonym_groups(b), T.size_tokens(b), Y.synonym_groups(a), T.size_tokens(a))) == score


def test_later_group_wins(spark):
    assert one(spark, Y.synonym_groups(F.lit("a sign holder"))) == [12]


def test_variant_urls(spark):
    labels = F.create_map(F.lit("519"), F.lit("3602"), F.lit("207"), F.lit("3832"))
    assert one(spark, T.variant_url(F.lit("https://a/p?x=1"), "configurable", F.lit("1"), labels)) == "https://a/p?super_attribute[207]=3832&super_attribute[519]=3602"
    label = F.create_map(F.lit("dimension"), F.lit("A5 landscape"))
    assert one(spark, T.variant_url(F.lit("https://a/p"), "variation", F.lit("12345"), label)) == "https://a/p?variation_id=12345&attribute_dimension=A5+landscape"


def test_median_and_query(spark):
    assert one(spark, S.upper_median(F.array(*map(F.lit, [4, 1, 3, 2])))) == 3
    assert one(spark, S.upper_median(F.array(F.lit(5)))) == 5
    assert one(spark, T.search_query(F.lit("Custom Printed A-board x 10"), F.lit("AB-PRINTED"))) == "A-board"
    assert one(spark, T.fuzzy_confidence(F.lit("a4 snap frame silver"), F.lit(10), F.lit("A4 Snap Frame Silver x 10"), F.lit("https://a/snap-frame"))) == 94
