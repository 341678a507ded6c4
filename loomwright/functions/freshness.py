"""Ages of rows, as of a given moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours up to which a row is fresh, then recent, by how it came in.
CONNECTOR, CRAWL = (24, 72), (6, 24)
# Types and channels of connectors, and what rows are called that are too old or gone.
CONNECTORS = ("api", "feed", "direct")
CHANNELS = ("connector", "api", "feed")
STALE = "stale_or_unlisted"
#: Hours between syncs by frequency.
SYNC_HOURS = {"hourly": 1, "daily": 24, "weekly": 168, "monthly": 720}


def hours_since(moment: Column, as_of: Column) -> Column:
    return (as_of.cast("double") - moment.cast("double")) / 3600


def freshness(last_seen: Column, listed: Column, data_type: Column, as_of: Column, channel: Column | None = None) -> Column:
    """fresh, recent or STALE. Rows of a connector (by their type, or by the channel they came through): up to 24 h fresh, up to 72 h recent; others: under 6 h and up to 24 h.

    Unlisted rows are STALE. A row without a moment counts as seen now, and so does one seen later than ``as_of``: a live feed need not date its rows.
    """
    age = F.greatest(F.coalesce(hours_since(last_seen, as_of), F.lit(0.0)), F.lit(0.0))
    backed = F.coalesce(data_type.isin(*CONNECTORS), F.lit(False))
    if channel is not None:
        backed = backed | F.coalesce(channel.isin(*CHANNELS), F.lit(False))
    connector = F.when(age <= CONNECTOR[0], "fresh").when(age <= CONNECTOR[1], "recent").otherwise(STALE)
    crawl = F.when(age < CRAWL[0], "fresh").when(age <= CRAWL[1], "recent").otherwise(STALE)
    return F.when(~F.coalesce(listed, F.lit(True)), STALE).when(backed, connector).otherwise(crawl)


def due_for_sync(frequency: Column, last: Column, as_of: Column) -> Column:
    """Never synced, or its interval has gone by; manual and unknown frequencies are never due."""
    hours = F.lit(None).cast("int")
    for name, h in SYNC_HOURS.items():
        hours = F.when(frequency == name, h).otherwise(hours)
    return F.coalesce(hours.isNotNull() & (last.isNull() | (hours_since(last, as_of) >= hours)), F.lit(False))
