"""Product feeds: CSV, JSON with its envelopes, XML items; and their mapping to one schema."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from loomwright.functions import numbers, text

#: Names under which feeds carry a field, first match first.
ALIASES = {
    "external_id": ("id", "g:id", "sku", "item_id", "product_id"), "title": ("title", "g:title", "name", "product_name"), "description": ("description", "g:description", "body", "body_html", "summary"),
    "price": ("sale_price", "g:sale_price", "price", "g:price", "amount"), "url": ("link", "g:link", "url", "product_url"), "image": ("image_link", "g:image_link", "image", "image_url"), "brand": ("brand", "g:brand", "vendor", "manufacturer"), "category": ("product_type", "g:product_type", "category", "google_product_category"), "availability": ("availability", "g:availability", "stock", "in_stock"),
}
ENVELOPES = ("items", "products", "data", "entries")


def sniffed(body: Column) -> Column:
    """json, xml or csv by a body's beginning."""
    head = F.ltrim(body)
    return F.when(head.rlike(r"^[\[{]"), "json").when(head.startswith("<"), "xml").otherwise("csv")


def json_items(bodies: DataFrame, id_col: str, body: str) -> DataFrame:
    """One row an item as a map of texts; a list as it stands, or the first envelope that holds one."""
    v = F.try_parse_json(F.col(body))
    lists = [F.try_variant_get(v, "$", "array<variant>"), *(F.try_variant_get(v, f"$.{e}", "array<variant>") for e in ENVELOPES)]
    return bodies.select(id_col, F.explode(F.coalesce(*lists)).alias("__i")).select(id_col, F.from_json(F.to_json("__i"), "map<string,string>").alias("raw"))


def xml_items(bodies: DataFrame, id_col: str, body: str) -> DataFrame:
    """One row an <item>, <entry> or <product>; of repeated tags the first counts, CDATA is opened."""
    items = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<(item|entry|product)\b[^>]*>(.*?)</\1>"), F.lit(2))
    one = bodies.select(id_col, F.explode(items).alias("__i"))
    pattern = F.lit(r"(?is)<([A-Za-z][\w:.-]*)[^>]*>(.*?)</\1>")
    tags = F.arrays_zip(F.regexp_extract_all("__i", pattern, F.lit(1)).alias("k"), F.regexp_extract_all("__i", pattern, F.lit(2)).alias("v"))
    value = lambda x: text.decode_entities(F.trim(F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))
    first = F.aggregate(tags, F.create_map().cast("map<string,string>"), lambda m, t: F.when(F.map_contains_key(m, t["k"]), m).otherwise(F.map_concat(m, F.create_map(t["k"], value(t["v"])))))
    return one.select(id_col, first.alias("raw"))


def csv_records(body: str) -> list[dict[str, str]]:
    """Records of a CSV text by its header; tab or semicolon delimits where the first line holds more of it than of the others, else the comma."""
    head = body.lstrip("\ufeff \r\n").split("\n", 1)[0]
    tabs, semicolons, commas = (head.count(c) for c in "\t;,")
    csv.field_size_limit(2**31 - 1)
    lines = csv.reader(io.StringIO(body.lstrip("\ufeff"), newline=""), delimiter="\t" if tabs > max(semicolons, commas) else ";" if semicolons > commas else ",")
    rows = [[v.strip() for v in line] for line in lines if any(v.strip() for v in line)]
    names = [n.strip("'\"").strip() for n in rows[0]] if rows else []
    return [{n: v for n, v in zip(names, r + [""] * len(names), strict=False) if n} for r in rows[1:]]


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def _csv_records(body: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else csv_records(b) for b in body], dtype=object)


def csv_items(bodies: DataFrame, id_col: str, body: str) -> DataFrame:
    """One row a record of fetched CSV texts: id, place, raw (map of texts). Quotes protect delimiters and line ends; missing values are empty, values beyond the header and those under an empty name go.

    Lines without any value are passed over; null bodies and bodies without a record give no row; of equal names the last counts.
    """
    return bodies.select(id_col, F.posexplode(_csv_records(F.col(body))).alias("place", "raw"))


def csv_rows(spark, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True)


def field(raw: Column, name: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.element_at(raw, a)), F.lit("")) for a in ALIASES[name]))


def mapped(items: DataFrame, id_col: str) -> DataFrame:
    """The common schema; keys that no field claims are kept in ``extra``. Items without a title go."""
    raw = F.col("raw")
    known = [a for names in ALIASES.values() for a in names]
    money = numbers.price_and_currency(field(raw, "price"))
    out = items.select(id_col, *(field(raw, n).alias(n) for n in ("external_id", "title", "url", "image", "brand", "category", "availability")), text.truncated(text.strip_tags(field(raw, "description"))).alias("description"), money["price"].alias("price"), money["currency"].alias("currency"), F.map_filter(raw, lambda k, v: ~k.isin(*known)).alias("extra"))
    return out.where("title is not null")


def split_bad(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the names of what they lack."""
    lacking = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda x: x.isNotNull())
    marked = rows.withColumn("errors", lacking)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)
