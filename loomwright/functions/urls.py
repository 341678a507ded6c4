"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that do not tell pages apart.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "msclkid")
#: Endings of files that are no pages.
NOT_PAGES = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "pdf", "zip", "mp4", "mp3", "woff", "woff2", "xml", "json")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def without_tracking(url: Column) -> Column:
    """No fragment, no tracking parameters, no slash at the end."""
    names = "|".join(TRACKING)
    bare = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(bare, rf"(?<=[?&])(?:{names})=[^&]*(?:&|$)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?&]$", ""), r"(?<=[^/:])/$", "")


def host_and_path(url: Column) -> Column:
    """Host and path in lower case, without query and closing slash: the key under which pages are matched."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)), r"/+$", "")


def is_page(url: Column) -> Column:
    return ~F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(" + "|".join(NOT_PAGES) + ")$")


def within(url: Column, domain: Column) -> Column:
    """The url's host is the domain or lies below it."""
    return (host(url) == F.lower(domain)) | F.endswith(host(url), F.concat(F.lit("."), F.lower(domain)))


def is_safe(url: Column) -> Column:
    """http or https, no credentials, no private or local address."""
    h = host(url)
    private = h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0|\[)")
    return url.rlike("(?i)^https?://") & ~h.contains("@") & (h != "") & ~private
