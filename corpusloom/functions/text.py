"""Text scalar functions, all built from native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let, run_counts

# The token pattern, and the patterns dropped from markup in order.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
SCHEME_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://"
DROPPED_MARKUP = (
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?s)<!--.*?-->",
    r"(?s)<[^>]*>",
    r"&#?[A-Za-z0-9]+;",
    r"\s+",
)


def url_with_scheme(url: Column) -> Column:
    """Prefix ``http://`` unless the url already names a scheme."""
    return F.when(url.rlike(SCHEME_PATTERN), url).otherwise(F.concat(F.lit("http://"), url))


def url_with_http(url: Column) -> Column:
    """Prefix ``http://`` unless the url starts with exactly that.

    An ``https`` url is prefixed too: the literal historic rule.
    """
    return F.when(url.startswith("http://"), url).otherwise(F.concat(F.lit("http://"), url))


def html_to_text(html: Column) -> Column:
    """Visible text of a page: markup and entities become single spaces."""
    for pattern in DROPPED_MARKUP:
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(html)


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits, in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def term_bag(text: Column) -> Column:
    """``array<struct<term,tf>>`` of one text, in term order.

    Counting stays inside the row, so term frequencies need no shuffle.
    """
    return let(F.sort_array(tokens(text)), run_counts)


def pad_right(text: Column, width: int) -> Column:
    """Pad with blanks to ``width``; longer text is kept whole."""
    missing = F.greatest(F.lit(0), F.lit(width) - F.length(text))
    return F.concat(text, F.repeat(F.lit(" "), missing))


def short_decimal(value: Column) -> Column:
    """At most six decimals, half-even, without trailing zeros."""
    fixed = F.bround(value, 6).cast("decimal(32,6)").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "")
