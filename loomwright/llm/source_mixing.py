"""Mixing sources to target weights by Pfair scheduling.

A source's documents fill blocks of a fixed number of characters. With weight w, its i-th block (from 0) is released at
slot floor(i / w) and due by slot ceil((i + 1) / w); each slot goes to the released block with the earliest deadline. Weights are
whole shares of PERIOD, so the schedule repeats after PERIOD slots and is worked out once, for one period: at any
slot each source has had its due number of blocks, less than one more or less. Block i of a source with k shares then has
slot (i // k) * PERIOD + (the place of its (i % k)-th block in the period).

Without targets all documents are in the mixture: a source that runs dry leaves, and the others go on in the order of their slots, which shares its
room among them as their weights stand. With targets the mixture ends where the first source runs out. Up to there, in either case, all weights hold; documents
beyond have their slot too and are marked. The period doubles until it holds a slot for each source, so any number of sources (hosts, say) has its place; the driver holds one
name and some whole numbers a source, never anything of its documents.

Cases: a null source is a source of its own; null and empty texts take one character's room; a source without a target weight has weight 0 and stays outside the
mixture, one with a target but no documents ends the mixture at once; equal or null ids keep their own places; an empty table gives no
rows; rows that are equal in id and size may change places; other columns stay as they are, whatever their names. The hot source's running sum is dealt over shares by a hash of the id.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused
from .ranks import running_sum

#: Slots of one period at least, and characters of one block.
PERIOD, BLOCK = 1024, 16_384
#: Slots up to which their table is broadcast (some megabytes); beyond, the join is dealt by source.
BROADCAST = 131_072
#: Default target: a source's share of characters to this power, made to sum to one.
TEMPER = 0.7


def period_for(sources: int, period: int = PERIOD) -> int:
    """The period, doubled until each source can have a slot of it."""
    while period < sources:
        period *= 2
    return period


def shares(targets: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of the period: one for each source with a target above 0, the rest in proportion, by largest remainders (of equal ones, by name)."""
    some = {s: w for s, w in sorted(targets.items()) if w > 0}
    if len(some) > period:
        raise ValueError(f"{len(some)} sources need a longer period than {period}")
    total = sum(some.values())
    exact = {s: w / total * (period - len(some)) for s, w in some.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(share: Mapping[str, int], period: int = PERIOD) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks; of equal deadlines, the tighter next window, then the name."""
    waiting = [(0, s, 0) for s in sorted(share)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            k = share[s]
            heapq.heappush(ready, (-(-(i + 1) * period // k), -k, s, i))
        due, _, s, i = heapq.heappop(ready)
        assert due > slot, "a block missed its deadline"
        out.append(s)
        if i + 1 < share[s]:
            heapq.heappush(waiting, ((i + 1) * period // share[s], s, i + 1))
    return out


def tempered(totals: Mapping[str, int], power: float = TEMPER) -> dict[str, float]:
    raw = {s: float(n) ** power for s, n in totals.items() if n > 0}
    return {s: w / sum(raw.values()) for s, w in raw.items()}


ADDED = ("source", "block", "slot", "all_sources", "in_mix")


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, prefix: str = "__") -> DataFrame:
    """Adds __source, __block, __slot (null without a target), __all_sources (before the first source runs dry) and __in_mix to docs, which needs source, text and doc_id.

    targets: weight of each source ("" for null). A column of docs that has one of the added names (with another prefix where one is given) gives way.
    """
    source, number_, slot_, all_, in_mix = (prefix + x for x in ADDED)
    docs = docs.drop(source, number_, slot_, all_, in_mix)
    size_, before_, places = unused(docs, "__size", "__before", "__places")
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    sized = docs.withColumn(source, F.coalesce("source", F.lit(""))).withColumn(size_, size)
    counts = materialise(sized.groupBy(source).agg(F.sum(size_).alias("size"), F.count("*").alias("n")))
    whole = targets is None
    if targets is None:
        targets = tempered({r[source]: r["size"] for r in counts.collect()})  # one row a source
    period = period_for(sum(w > 0 for w in targets.values()), period)
    share = shares(targets, period) if any(w > 0 for w in targets.values()) else {}
    place: dict[str, list[int]] = {s: [] for s in share}
    for slot, s in enumerate(schedule(share, period) if share else []):
        place[s].append(slot)
    spark = docs.sparkSession
    slots = spark.createDataFrame([(s, p) for s, p in place.items()], f"`{source}` string, `{places}` array<int>")
    named = counts.join(slots, source, "inner")
    # The slot at which each source has no block left; the first of them ends the time in which all weights hold.
    k = F.size(places)
    blocks = F.ceil(F.col("size") / block).cast("long")
    dry = F.floor(blocks / k) * period + F.element_at(places, (blocks % k + 1).cast("int"))
    ends = named.agg(F.min(dry).alias("end"), F.count("*").alias("n")).first()
    end = ends["end"] if ends["n"] == len(share) and share else 0
    total = counts.agg(F.sum("n")).first()[0] or 0
    # A hash that SQL has as well.
    deal = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    ran = running_sum(sized, [source], ["doc_id", size_], size_, before_, total, deal)
    number = F.floor(F.col(before_) / block).cast("long")
    placed = ran.withColumn(number_, number).join(F.broadcast(slots) if period <= BROADCAST else slots, source, "left")
    slot = F.floor(F.col(number_) / k) * period + F.element_at(places, (F.col(number_) % k + 1).cast("int"))
    placed = placed.withColumn(slot_, slot).withColumn(all_, F.coalesce(F.col(slot_) < end, F.lit(False)))
    return placed.withColumn(in_mix, F.lit(True) if whole else F.col(all_)).drop(places, size_, before_)


def mixture(docs: DataFrame, targets: Mapping[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents of the mixture in the order of their slots, with the columns they came with: all of them without targets."""
    prefix = "__"
    while any((prefix + x).lower() == c.lower() for x in ADDED for c in docs.columns):
        prefix += "_"
    slot = prefix + "slot"
    mixed = mix(docs, targets, block, prefix=prefix).where(F.col(prefix + "in_mix"))
    return mixed.repartitionByRange(slot, "doc_id").sortWithinPartitions(slot, "doc_id").select(*docs.columns)
