"""Numbers out of texts. The variants differ on purpose; callers choose by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_number(x: Column) -> Column:
    """The longest numeric prefix as a double, null without one."""
    return F.nullif(F.regexp_extract(F.trim(x), r"^(-?\d+\.?\d*|-?\.\d+)", 1), F.lit("")).cast("double")


def digits_and_dots(x: Column) -> Column:
    """All but digits and dots removed, then the leading number: "$90/mo for 12" is 9012."""
    return leading_number(F.regexp_replace(x, "[^0-9.]", ""))


def with_thousands(x: Column) -> Column:
    """Commas and blanks removed, then the leading number, times 1000 where a k follows; null where the text begins otherwise."""
    bare = F.lower(F.regexp_replace(x, r"[,\s]", ""))
    return F.when(bare.rlike(r"k$"), leading_number(bare) * 1000).otherwise(leading_number(bare))


def first_number(x: Column) -> Column:
    """The first number anywhere, commas removed: "$90/mo for 12" is 90."""
    return F.nullif(F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def price_and_currency(x: Column) -> Column:
    """Struct (price, currency): digits and dots as price (0 without), the sign or code as currency (USD without)."""
    currency = F.when(x.rlike("€|EUR"), "EUR").when(x.rlike("£|GBP"), "GBP").when(x.rlike("₹|INR"), "INR").when(x.rlike(r"CA\$|CAD"), "CAD").otherwise("USD")
    return F.struct(F.coalesce(digits_and_dots(x), F.lit(0.0)).alias("price"), currency.alias("currency"))


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)
