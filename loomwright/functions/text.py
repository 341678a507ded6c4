"""Text expressions: normal forms, tokens, hashes, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(x: Column) -> Column:
    """Lower case; everything but ASCII letters, digits, underscore, white space and hyphen becomes a blank; blanks collapse."""
    plain = F.regexp_replace(F.lower(x), r"[^A-Za-z0-9_\s-]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


#: Letters with diacritics and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def fold(x: Column) -> Column:
    """As normalize, with diacritics stripped first and hyphens as blanks."""
    return F.trim(F.regexp_replace(F.translate(normalize(F.translate(x, ACCENTED, PLAIN)), "-", " "), r"\s+", " "))


def tokens(x: Column, least: int = 2) -> Column:
    """Words of the normal form with at least ``least`` characters."""
    return F.filter(F.split(normalize(x), " "), lambda w: F.length(w) >= least)


def fuzzy_word(a: Column, b: Column) -> Column:
    """Both of 4 or more characters, lengths at most one apart, and one edit apart (two, beyond 5 characters)."""
    most = F.when(F.length(a) <= 5, 1).otherwise(2)
    return (F.length(a) >= 4) & (F.length(b) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) <= most)


def content_hash(x: Column) -> Column:
    """SHA-256 of a text in which white space does not count between tags and counts once elsewhere."""
    tight = F.regexp_replace(F.regexp_replace(F.trim(x), r">\s+<", "><"), r"\s+", " ")
    return F.sha2(tight, 256)


def decode_entities(x: Column) -> Column:
    """The common named entities; the ampersand first, so that a doubly coded entity is decoded twice."""
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def strip_tags(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(bare), r"\s+", " "))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element with this tag, null without one."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(strip_tags(inner), F.lit(""))


def truncated(x: Column, most: int = 300) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def masked_ip(x: Column) -> Column:
    """The last part of an IPv4 address hidden."""
    return F.regexp_replace(x, r"^(\d+\.\d+\.\d+)\.\d+$", "$1.xxx")


def message(x: Column, most: int = 1000) -> Column:
    """valid, error and sanitized (without white space at its ends) of a user's message; null and blank ones are empty, longer ones than ``most`` characters are refused whole."""
    plain = F.regexp_replace(x, r"^\s+|\s+$", "")
    error = F.when(F.coalesce(plain, F.lit("")) == "", "empty").when(F.length(plain) > most, "too_long")
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), plain).alias("sanitized"))
