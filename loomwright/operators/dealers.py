"""Profiles and opening hours of dealers, from what their pages state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.vehicles import clock
from loomwright.operators.ordered import spread

# Days from 0, known by their first two or three letters or in full; words of closed days; names by which a dealer's title tells.
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
CLOSED = ("closed", "off")
DEALER_WORDS = ("dealer", "chrysler", "jeep", "dodge", "ram", "ford", "hyundai", "toyota", "honda", "automotive", "motors", "sales")


def day_of(word: Column) -> Column:
    names = [(name[:n], i) for i, name in enumerate(DAYS) for n in (2, 3, len(name))]
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names for x in pair)), F.lower(word))


def opening_hours(hours: Column) -> Column:
    """A week of seven entries (day, opens, closes, closed) from the hours a page states: a text such as ``Mo-Fr 9am-6pm``, an opening-hours object, or a list of these (as JSON). Later ones replace earlier ones of the same day; days
    that nothing names are closed, null or empty hours give null. Unknown words for days count as Monday, as the end of a range as Friday."""
    stated = F.coalesce(F.try_parse_json(hours), F.try_parse_json(F.concat(F.lit('"'), F.regexp_replace(hours, r'["\\\\]', " "), F.lit('"'))))
    items = F.coalesce(F.try_variant_get(stated, "$", "array<variant>"), F.array(stated))
    entry = lambda day, opens, closes: F.struct(day.cast("int").alias("day"), opens.alias("opens"), closes.alias("closes"))
    nothing = F.array().cast("array<struct<day:int,opens:string,closes:string>>")

    def of_text(said: Column) -> Column:
        words = F.split(F.lower(said), r"\s+")
        days, times = F.split(F.get(words, 0), "-"), F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")
        first = F.coalesce(day_of(F.get(days, 0)), F.lit(1))
        last = F.when(F.size(days) > 1, F.coalesce(day_of(F.get(days, 1)), F.lit(5))).otherwise(first)
        span = F.sequence(first, F.when(last < first, last + 7).otherwise(last))
        shut = times.rlike("|".join(CLOSED))
        ends = F.split(times, "-")
        at = lambda i: F.when(~shut, clock(F.get(ends, i)))
        return F.when((F.size(words) > 1) & (shut | times.contains("-")), F.transform(span, lambda d: entry(d % 7, at(0), at(1)))).otherwise(nothing)

    def of_object(v: Column) -> Column:
        get = lambda *names: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names))
        days = F.coalesce(F.try_variant_get(v, "$.dayOfWeek", "array<string>"), F.array(F.try_variant_get(v, "$.dayOfWeek", "string")))
        known = F.filter(F.transform(days, lambda d: day_of(F.regexp_replace(F.lower(d), "^https?://schema[.]org/", ""))), lambda d: d.isNotNull())
        return F.transform(known, lambda d: entry(d, clock(get("opens", "openTime")), clock(get("closes", "closeTime"))))

    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    entries = F.flatten(F.transform(items, lambda v: F.when(is_object(v), of_object(v)).otherwise(F.coalesce(of_text(F.try_variant_get(v, "$", "string")), nothing))))

    def week(d: Column, entries: Column) -> Column:
        last = F.element_at(F.filter(F.concat(F.array(entry(d, F.lit(None), F.lit(None))), entries), lambda e: e["day"] == d), -1)
        return once(last, lambda e: F.struct(d.alias("day"), e["opens"].alias("opens"), e["closes"].alias("closes"), (e["opens"].isNull() & e["closes"].isNull()).alias("closed")))

    # Entries are read off the text once, not once a day and member.
    return F.when(F.coalesce(hours, F.lit("")) != "", once(entries, lambda es: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: week(d, es))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out one time however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def profiles(entities: DataFrame, site: str, url: str) -> DataFrame:
    """entities: site, url, and the columns that structured data gives. One row a site: name, phone, email, address, city, region, postal_code, country, logo, description, hours; from its first entity that can be the dealer's.

    That is one with a telephone number, an address or hours, or one with a mail address that is a contact or whose title has a dealer's word (also inside a word). Sites without one have no row.
    """
    get = lambda name: F.nullif(F.try_element_at("details", F.lit(name)), F.lit(""))
    stated = get("phone").isNotNull() | get("address").isNotNull() | get("hours").isNotNull()
    told = get("email").isNotNull() & ((F.col("data_type") == "contact") | F.lower("title").rlike("|".join(DEALER_WORDS)))
    country = F.when(F.col(url).contains(".ca"), "CA").otherwise("US")
    row = F.struct(
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Dealership")).alias("name"), *(get(n).alias(n) for n in ("phone", "email", "address", "city", "region", "postal_code")), country.alias("country"), F.get("images", 0).alias("logo"),
        F.coalesce("description", "content").alias("description"), get("hours").alias("hours"),
    )
    first = entities.where(stated | told).groupBy(site).agg(F.min_by(row, F.struct(F.col(url), F.col("place"))).alias("__r")).select(site, "__r.*")
    return spread(first).withColumn("hours", opening_hours(F.col("hours")))
