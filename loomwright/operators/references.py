"""What a turn of a conversation refers to: "the second one", "it", "how much"; and the context that a session carries from turn to turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of places in a list (-1 is the last), of what was meant before, and of follow-up questions.
ORDINALS = {"first": 0, "1st": 0, "top": 0, "second": 1, "2nd": 1, "third": 2, "3rd": 2, "fourth": 3, "4th": 3, "fifth": 4, "5th": 4, "last": -1}
POINTERS = ("it", "its", "it's", "that", "that's", "this", "this one", "that one", "the one", "the vehicle", "the car", "the product", "the course", "the service", "the offering", "the listing", "the property", "there")
FOLLOW_UPS = ("how much", "how much is it", "what does it cost", "price", "cost", "discount", "on sale", "sale price", "deal", "offer", "promo", "pictures?", "photos?", "images?", "gallery", "open it", "open that", "take me there", "navigate to it", "prerequisites?", "requirements?", "duration", "who teaches")
REWRITES = (
    (("price", "how much", "cost"), "price of ", ""),
    (("pictures?", "photos?", "images?", "gallery"), "show me pictures of ", ""),
    (("open", "take me", "navigate", "go there"), "take me to the page for ", ""),
    (("discount", "sale", "deal", "offer"), "", " discount price"),
)


def has_word(x: Column, words: tuple[str, ...]) -> Column:
    return x.rlike(r"\b(?:" + "|".join(words) + r")\b")


def ordinal(x: Column) -> Column:
    """The place that the first ordinal in a text names, from 0; -1 for the last; null without one."""
    word = F.regexp_extract(F.lower(x), r"\b(" + "|".join(ORDINALS) + r")\b", 1)
    return F.element_at(F.create_map(*(F.lit(v) for pair in ORDINALS.items() for v in pair)), F.nullif(word, F.lit("")))


def picked(pool: Column, place: Column) -> Column:
    """The entry at a place; beyond the end the last one."""
    return F.get(pool, F.when(place < 0, F.size(pool) - 1).otherwise(F.least(place, F.size(pool) - 1)))


def resolved(turns: DataFrame, conv: str, turn: str, text: str, shown: str, pinned: str) -> DataFrame:
    """Adds ``refers`` (whether the turn points back), ``entity`` (to what) and ``rewritten`` (the query with its name in it, null where nothing is resolved).

    shown: the titles a turn showed, null or empty elsewhere; pinned: the title a turn settled on, null elsewhere. Each turn sees what earlier ones left.
    An ordinal picks from the list last shown; pointers and follow-up questions mean what was pinned last, else the first of that list.
    One window over the conversation's turns, which carries only the last list and the last title.
    """
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    listed = F.when(F.size(F.coalesce(F.col(shown), F.array().cast("array<string>"))) > 0, F.col(shown))
    known = turns.withColumn("__pool", F.last(listed, True).over(before)).withColumn("__pin", F.last(F.col(pinned), True).over(before))
    pool, pin, said = F.col("__pool"), F.col("__pin"), F.coalesce(F.col(text), F.lit(""))
    low, place = F.lower(F.trim(said)), ordinal(said)
    by_place = F.coalesce(place.isNotNull() & pool.isNotNull(), F.lit(False))
    points = has_word(low, POINTERS) | (has_word(low, FOLLOW_UPS) & (pin.isNotNull() | pool.isNotNull()))
    by_pin = F.concat_ws(" ", pin, said)
    for words, head, tail in reversed(REWRITES):
        by_pin = F.when(has_word(low, words), F.concat(F.lit(head), pin, F.lit(tail))).otherwise(by_pin)
    entity = F.when(by_place, picked(pool, place)).when(points, F.coalesce(pin, F.get(pool, F.lit(0))))
    rewritten = F.when(by_place, F.concat(picked(pool, place), F.lit(" details"))).when(points & pin.isNotNull(), by_pin).when(points & pool.isNotNull(), F.concat_ws(" ", F.get(pool, F.lit(0)), said))
    return known.withColumn("refers", by_place | points).withColumn("entity", entity).withColumn("rewritten", rewritten).drop("__pool", "__pin")


def session_context(updates: DataFrame, session: str, ts: str, tie: str, fields: list[str], ttl: float = 1800.0) -> DataFrame:
    """The context after each update: turn_count (one more an update) and the last value of each field that is not null. After more than ``ttl`` seconds without an update it starts anew."""
    ordered = Window.partitionBy(session).orderBy(ts, tie)
    seconds = F.col(ts).cast("timestamp").cast("double")
    gap = F.coalesce(seconds - F.lag(seconds).over(ordered) > ttl, F.lit(False))
    lives = updates.withColumn("__gap", gap.cast("int")).withColumn("__life", F.sum("__gap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy(session, "__life").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return lives.select(session, ts, tie, F.count("*").over(so_far).alias("turn_count"), *(F.last(f, True).over(so_far).alias(f) for f in fields))
