"""Price, boolean, category and quantity cells of a catalog, read without ever failing a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import SPACES_RE, col_of, is_blank, jstrim, let

# Symbols that mark a price cell as carrying a currency.
CURRENCY_CLASS = "[$€£¥₹₽₩₪₺₴₦₱₡₲₵₸₼₾₿]"
# Accepted spellings of true and false.
TRUE_VALUES = ["true", "yes", "y", "1", "on"]
FALSE_VALUES = ["false", "no", "n", "0", "off"]

NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_or_null(c) -> Column:
    """Decimal or exponent notation only, finite values only; everything else is null."""
    c = col_of(c)
    v = F.when(c.rlike(NUMBER_RE), c).try_cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def strip_currency(c) -> Column:
    """Remove the first currency symbol (later ones stay) and all white space."""
    first = F.regexp_replace(col_of(c), f"^([^{CURRENCY_CLASS[1:-1]}]*){CURRENCY_CLASS}", "$1")
    return F.regexp_replace(first, SPACES_RE, "")


COMMA_DECIMAL_RE = r"^(\d{1,3}(\.\d{3})+,\d{1,2}|\d+,\d{1,2})$"


def _bare(c) -> Column:
    return strip_currency(jstrim(F.coalesce(col_of(c), F.lit(""))))


def price_text(c) -> Column:
    """The normalised number text of a price cell: symbol off, comma decimals and thousands resolved."""
    def read(s):
        dotted = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return (
            F.when(s.rlike(r"^\d{1,3}(\.\d{3})+,\d{1,2}$"), dotted)
            .when(s.rlike(r"^\d+,\d{1,2}$"), F.replace(s, F.lit(","), F.lit(".")))
            .when(s.rlike(r"^\d+,\d{3}$"), F.replace(s, F.lit(","), F.lit("")))
            .otherwise(s))
    return let(_bare(c), read)


def price_is_comma_decimal(c) -> Column:
    return _bare(c).rlike(COMMA_DECIMAL_RE)


def price_has_currency(c) -> Column:
    return F.coalesce(col_of(c), F.lit("")).rlike(CURRENCY_CLASS)


def price_value(c) -> Column:
    """Numeric value of a price cell, null when blank or unreadable. A lone symbol reads as 0."""
    return F.when(is_blank(c), None).otherwise(let(price_text(c), lambda t: F.when(t == "", F.lit(0.0)).otherwise(number_or_null(t))))


def price_parse(c) -> Column:
    """All readings of a price cell in one struct."""
    return F.struct(
        price_value(c).alias("value"),
        price_value(c).isNotNull().alias("parseable"),
        price_is_comma_decimal(c).alias("comma_decimal"),
        price_has_currency(c).alias("has_currency"),
        price_text(c).alias("normalized"),
    )


def number_text(value: Column) -> Column:
    """Number to text without a trailing ``.0``."""
    t = F.format_string("%.10f", value)
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def bool_norm(c) -> Column:
    """TRUE, FALSE, or null when the spelling is in neither list."""
    low = F.lower(jstrim(c))
    return F.when(low.isin(TRUE_VALUES), F.lit("TRUE")).when(low.isin(FALSE_VALUES), F.lit("FALSE"))


def category_ok(c) -> Column:
    """Blank, a global taxonomy id, a breadcrumb, or a short taxonomy code."""
    s = jstrim(F.coalesce(col_of(c), F.lit("")))
    return (
        (s == "")
        | s.rlike(r"(?i)^gid://shopify/")
        | s.rlike("[>»›]")
        | s.rlike(r"(?i)^[a-z]{2}(-[a-z0-9]+)+$")
    )


def iso_duration_seconds(c) -> Column:
    """Seconds in a ``PT#H#M#S`` duration; 0 when absent."""
    c = F.coalesce(col_of(c), F.lit(""))
    # the first "PT" decides; each part is optional but ordered
    pat = r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
    part = lambda i: F.coalesce(F.regexp_extract(c, pat, i).try_cast("bigint"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)
