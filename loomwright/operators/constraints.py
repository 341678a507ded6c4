"""Constraints on results and their orders.

Two kinds of constraint differ on missing values: a strict one drops a row that has none, a lenient one (after a retrieval that has already ranked) keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import numbers

#: What stands for a missing price in the orders of filtered results.
DEAR, FREE = 99999.0, 0.0
REASON = "No exact matches found matching your specific constraints (price/rating/availability)."


def amount(column: str) -> Column:
    """The number in a price or rating, whatever its type; null where there is none."""
    # A large double prints with an exponent, so what is a number as it stands is taken as one.
    x = F.col(column).cast("string")
    return F.coalesce(x.try_cast("double"), numbers.digits_and_dots(x))


def within(x: Column, low: float | None, high: float | None, missing: bool) -> Column:
    test = (x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True))
    return F.lit(True) if low is None and high is None else F.coalesce(test, F.lit(missing))


def available() -> Column:
    """Still listed (or not said), and an availability that says so or says nothing."""
    said = F.lower(F.coalesce(F.col("availability").cast("string"), F.lit("")))
    return F.coalesce(F.col("still_listed"), F.lit(True)) & (said.contains("stock") | said.contains("available") | said.isin("", "true"))


def strict(rows: DataFrame, min_price: float | None = None, max_price: float | None = None, min_rating: float | None = None, in_stock: bool = False) -> DataFrame:
    """Rows that meet all constraints; a missing price or rating meets none. Reads price, rating, availability and still_listed as far as they are asked for."""
    test = F.lit(True)
    if min_price is not None or max_price is not None:
        test = test & within(amount("price"), min_price, max_price, False)
    if min_rating is not None:
        test = test & within(amount("rating"), min_rating, None, False)
    return rows.where(test & available() if in_stock else test)


def lenient(rows: DataFrame, min_price: float | None = None, max_price: float | None = None) -> DataFrame:
    """Rows that break no bound; a price that is missing or no number breaks none."""
    return rows.where(within(amount("price"), min_price, max_price, True))


def unmet(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row with the reason where there were rows and none is left, else no row. Both sides are cut to one row before they meet."""
    one = lambda df: df.limit(1).select(F.lit(1).alias("__k"))
    return one(rows).join(one(found), "__k", "left_anti").select(F.lit(REASON).alias("reason"))


def sorted_strict(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """cheapest, most_expensive or highest_rated; rows without a value come last in each."""
    key = {"cheapest": amount("price").asc_nulls_last(), "most_expensive": amount("price").desc_nulls_last(), "highest_rated": amount("rating").desc_nulls_last()}[by]
    return rows.orderBy(key, F.col(tie))


def sorted_lenient(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """price_asc or cheapest (missing as dear), price_desc or expensive (missing as free), rating_desc or best_rated (missing as 0)."""
    price = lambda missing: F.coalesce(amount("price"), F.lit(missing))
    up, down, rated = price(DEAR).asc(), price(FREE).desc(), F.coalesce(amount("rating"), F.lit(0.0)).desc()
    key = {"price_asc": up, "cheapest": up, "price_desc": down, "expensive": down, "rating_desc": rated, "best_rated": rated}[by]
    return rows.orderBy(key, F.col(tie))
