import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays, scoring, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "url, scheme, http",
    [
        ("a.example", "http://a.example", "http://a.example"),
        ("http://a.example", "http://a.example", "http://a.example"),
        ("https://a.example", "https://a.example", "http://https://a.example"),
    ],
)
def test_url_defaults(spark, url, scheme, http):
    assert one(spark, text.url_with_scheme, url) == scheme
    assert one(spark, text.url_with_http, url) == http


def test_html_to_text(spark):
    html = "<html><script>var a = '</p>';</script><STYLE>p{}</STYLE><!-- x\n<b>y</b> --><p class='q'>A&amp;B\n&#169; c</p>"
    assert one(spark, text.html_to_text, html) == "A B c"


def test_bag_counts_every_token(spark):
    bag = one(spark, text.term_bag, "B a b, a!A ß-Ünî9")
    assert [(x["term"], x["tf"]) for x in bag] == [("a", 3), ("b", 2), ("ß", 1), ("ünî9", 1)]
    assert one(spark, text.term_bag, "!!!") == []
    assert one(spark, text.term_bag, "") == []


def test_pad_right_never_cuts(spark):
    assert one(spark, lambda x: text.pad_right(x, 5), "ab") == "ab   "
    assert one(spark, lambda x: text.pad_right(x, 2), "abcd") == "abcd"


@pytest.mark.parametrize(
    "value, shown",
    [(100.0, "100"), (0.0, "0"), (2 / 3, "0.666667"), (66.5, "66.5"), (0.0000005, "0"), (0.0000015, "0.000002")],
)
def test_short_decimal(spark, value, shown):
    assert one(spark, text.short_decimal, value, "double") == shown


def test_variance(spark):
    assert one(spark, arrays.variance, [1.0, 2.0, 3.0, 6.0], "array<double>") == 3.5
    assert one(spark, arrays.variance, [], "array<double>") == 0.0
    assert one(spark, arrays.deviation, [5.0, 5.0], "array<double>") == 0.0


def test_plogp(spark):
    assert one(spark, lambda x: scoring.plogp(x, F.lit(4.0)), 0.0, "double") == 0.0
    assert one(spark, lambda x: scoring.plogp(x, F.lit(4.0)), 1.0, "double") == -0.5


def test_weight_is_single_precision(spark):
    import numpy as np

    got = one(spark, lambda x: scoring.term_weight(x, F.lit(3.0)), 2, "long")
    assert got == float(np.float32(np.sqrt(2.0))) * 3.0
