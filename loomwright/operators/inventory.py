"""Inventory filters and orders.

Two kinds of filter differ on missing values: ``strict`` drops rows whose column is null (as a table scan does), ``lenient`` keeps them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenants: list, column: str = "widget_id") -> DataFrame:
    """Rows of the given tenants. Without a tenant there are no rows: a missing scope never widens one."""
    return df.where(F.col(column).isin(*tenants)) if tenants else df.limit(0)


def projected(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The named columns with their types; those that an older table lacks are null, further ones go."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()))


def bounds(ranges: Mapping[str, tuple], lenient: bool) -> Column:
    out = F.lit(True)
    for column, (low, high) in ranges.items():
        c = F.col(column)
        test = (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
        out = out & (c.isNull() | test if lenient else test)
    return out


def matches(equal: Mapping[str, object], like: Mapping[str, str], lenient: bool) -> Column:
    """Equality, and case-blind containment of a text taken as it stands."""
    out = F.lit(True)
    tests = [(c, F.col(c) == v) for c, v in equal.items()] + [(c, F.contains(F.lower(F.col(c)), F.lit(v.lower()))) for c, v in like.items()]
    for column, test in tests:
        out = out & (F.col(column).isNull() | test if lenient else test)
    return out


def filtered(df: DataFrame, equal: Mapping = {}, like: Mapping = {}, ranges: Mapping = {}, lenient: bool = False) -> DataFrame:  # noqa: B006
    return df.where(matches(equal, like, lenient) & bounds(ranges, lenient))


def with_all_features(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose features, as parts of texts, hold every wanted one."""
    return df.where(F.forall(F.array(*map(F.lit, wanted)), lambda w: F.exists(column, lambda x: F.contains(F.lower(x), F.lower(w)))))


def ordered(df: DataFrame, by: str, price: str, created: str, tie: str) -> DataFrame:
    """price_asc (missing as 999999), price_desc (missing as 0) or newest; ties by id."""
    key = {"price_asc": F.coalesce(F.col(price), F.lit(999999)).asc(), "price_desc": F.coalesce(F.col(price), F.lit(0)).desc(), "newest": F.col(created).desc_nulls_last()}[by]
    return df.orderBy(key, F.col(tie))


def looked_up(asked: DataFrame, rows: DataFrame, id_col: str, tenant: str) -> DataFrame:
    """asked: tenant and id of each point lookup. Adds ``status``: own, foreign (the id is another tenant's, so nothing may be shown) or absent. One join on the id, which is unique in rows."""
    owners = rows.select(F.col(id_col), F.col(tenant).alias("__owner"))
    status = F.when(F.col("__owner").isNull(), "absent").when(F.col("__owner") == F.col(tenant), "own").otherwise("foreign")
    return asked.join(owners, id_col, "left").withColumn("status", status).drop("__owner")


def tenant_ids(tenants: DataFrame, name: str, ids: list[str]) -> DataFrame:
    """The ids under which rows of the named tenants may stand: a tenant is named by any of its ids, and its rows may carry any of them."""
    named = F.lit(False)
    for c in ids:
        named = named | F.coalesce(F.col(c).cast("string") == name, F.lit(False))
    every = F.array_distinct(F.filter(F.array(*(F.col(c).cast("string") for c in ids)), lambda x: x.isNotNull()))
    return tenants.where(named).select(F.explode(every).alias("id")).distinct()


def with_all(df: DataFrame, column: str, wanted: list) -> DataFrame:
    """Rows whose array holds every wanted value; a null array holds none."""
    return df.where(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(column))) == 0, F.lit(not wanted)))
