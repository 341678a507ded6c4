"""One-to-one matching of incoming entities with existing ones, where several keys compete.

The outcome is that of a scan: incoming rows in the order of their ids, each taking the first existing row (by id) that any of its keys finds and that no earlier one took. Rows meet in hubs, one for
each value of each key: every incoming row of a hub may take every existing row of it, and no hub is ever spread out into all its pairs.

Large hubs whose rows have mostly no other key are settled in rounds. In a round the j-th incoming row of a hub still free is held against the j-th existing one. Such a pair is final if neither row could do
better elsewhere (no other hub of the incoming row holds an earlier existing row, none of the existing row an earlier incoming row) and all pairs before it in the hub are. Where hubs compete, a round
settles few pairs a hub; as soon as one leaves more than half of the links, the rest goes by blocks.

Both sides are cut by their ids into blocks of bounded size. What block a of the incoming rows takes from block b of the existing ones depends only on what block a took from earlier existing blocks, and on what earlier
incoming blocks took from b: a row that finds nothing in b takes something later, which no other row of b can notice. So in step d all pairs of blocks with a + b = d are scanned at once, a task each, and after as many
steps as both sides have blocks (less one) all is settled. A task holds two blocks, however long the chains of competing rows are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.ordered import numbered
from loomwright.operators.scratch import discard, materialise

SIDES = {"i": "e", "e": "i"}
#: Rows of the largest hub up to which places come from a window; beyond, from ranges that spread a hub over tasks.
HUB = 1_000_000
#: Links that are settled by blocks without any round before, when no more are left.
FEW = 100_000
#: Links that a block of one side is meant to hold.
BLOCK = 500_000
#: What a step of the blocks writes.
LINK = pa.schema([("hub", pa.int64()), ("id", pa.int64()), ("comes", pa.bool_()), ("block", pa.int32()), ("until", pa.int32()), ("mate", pa.int64())])


def scanned(step: int):
    """The scan of one block of incoming rows over one of existing rows. Gives the pairs (hub -1, mate: the existing row) and the links of rows still free that have something to meet later."""

    def run(key: tuple[pa.Scalar], links: pa.Table) -> pa.Table:
        a = key[0].as_py()
        hub, id_, comes, until = (links.column(c).to_numpy() for c in ("hub", "id", "comes", "until"))
        used = np.zeros(len(hub), dtype=bool)
        i, e, pairs = np.flatnonzero(comes), np.flatnonzero(~comes), ([], [])
        i = i[np.isin(hub[i], hub[e])]
        if len(i):
            # Each hub keeps its existing rows in order and passes over those taken.
            e = e[np.lexsort((id_[e], hub[e]))]
            names, first = np.unique(hub[e], return_index=True)
            ids, offers = np.unique(id_[e], return_inverse=True)
            at, end, offers, taken = first.tolist(), [*first[1:].tolist(), len(e)], offers.tolist(), bytearray(len(ids))
            i = i[np.argsort(id_[i], kind="stable")]
            rows, start = np.unique(id_[i], return_index=True)
            asked, start = np.searchsorted(names, hub[i]).tolist(), [*start.tolist(), len(i)]
            for n in range(len(rows)):
                best = len(ids)
                for h in asked[start[n] : start[n + 1]]:
                    p = at[h]
                    while p < end[h] and taken[offers[p]]:
                        p += 1
                    at[h] = p
                    if p < end[h] and offers[p] < best:
                        best = offers[p]
                if best < len(ids):
                    taken[best] = 1
                    pairs[0].append(n)
                    pairs[1].append(best)
            pairs = (rows[pairs[0]], ids[pairs[1]])
            used = np.where(comes, np.isin(id_, pairs[0]), np.isin(id_, pairs[1]))
        free = links.filter(pa.array(~used & (until > np.where(comes, step - a, a)))).select(["hub", "id", "comes", "block", "until"])
        n = len(pairs[0])
        found = [np.full(n, -1), pairs[0], np.ones(n, dtype=bool), np.zeros(n), np.zeros(n), pairs[1]]
        free = free.append_column("mate", pa.array(np.full(len(free), -1)))
        return pa.concat_tables([free.cast(LINK), pa.Table.from_arrays([pa.array(x).cast(t) for x, t in zip(found, LINK.types, strict=True)], schema=LINK)])

    return run


def by_blocks(live: DataFrame, block: int = BLOCK) -> DataFrame:
    """live: hub, i, e (one of them null), a written table. Returns i, e: the pairs of the scan, from step to step over blocks of both sides."""
    hubs = materialise(live.select("hub").distinct().withColumn("number", F.monotonically_increasing_id()))
    sides = {}
    for own in SIDES:
        rows = materialise(live.where(f"{own} is not null").join(hubs, "hub").select(F.col("number").alias("hub"), F.col(own).alias("id")))
        # Ranges of ids: all links of a row are in one block, and blocks follow one another as ids do.
        sides[own] = materialise(rows.repartitionByRange(max(1, -(-rows.count() // block)), "id").withColumn("block", F.spark_partition_id()))
        discard(rows)
    # A link is kept until its hub has no later block on the other side.
    last = {own: df.groupBy("hub").agg(F.max("block").alias("until")) for own, df in sides.items()}
    links = materialise(sides["i"].withColumn("comes", F.lit(True)).join(last["e"], "hub").unionByName(sides["e"].withColumn("comes", F.lit(False)).join(last["i"], "hub")).repartitionByRange("block"))
    steps = sum((df.agg(F.max("block")).first()[0] or 0) + 1 for df in sides.values()) - 1
    discard(hubs, *sides.values())
    done, out = None, None
    for step in range(steps):
        now = links.where(F.col("block") == step)
        if done is not None:
            now = now.unionByName(done.where("hub >= 0").drop("mate"))
        task = F.when(F.col("comes"), F.col("block")).otherwise(step - F.col("block"))
        then = materialise(now.withColumn("task", task).groupBy("task").applyInArrow(scanned(step), "hub long, id long, comes boolean, block int, until int, mate long"))
        won = materialise(then.where("hub = -1").select(F.col("id").alias("i"), F.col("mate").alias("e")))
        out = won if out is None else out.unionByName(won)
        if done is not None:
            discard(done)
        done = then
    discard(links, done)
    return out


def claimed(incoming: DataFrame, existing: DataFrame, few: int = FEW, hub_rows: int = HUB, block: int = BLOCK) -> DataFrame:
    """incoming, existing: hub, id (whole numbers that order the rows), one row for each hub a row is in. Returns i, e: the pairs."""
    no = F.lit(None).cast("long")
    links = incoming.select("hub", F.col("id").cast("long").alias("i"), no.alias("e")).unionByName(existing.select("hub", no.alias("i"), F.col("id").cast("long").alias("e"))).where("hub is not null").distinct()
    links, out, had = materialise(links), None, None
    while True:
        # Hubs that lack one side can make no pair.
        hubs = links.groupBy("hub").agg(F.min("i").alias("first_i"), F.min("e").alias("first_e"), F.count("*").alias("n")).where("first_i is not null and first_e is not null")
        live = materialise(links.join(hubs, "hub"))
        discard(links)
        size = live.agg(F.count("*").alias("links"), F.max("n").alias("largest")).first()
        if size["links"] <= few or (had and 2 * size["links"] > had):
            if not size["links"]:
                return live.select("i", "e").limit(0) if out is None else out
            done = by_blocks(live, block)
            discard(live)
            return done if out is None else out.unionByName(done)
        had = size["links"]
        # The j-th free incoming row of a hub is held against its j-th free existing one: as many pairs as its smaller side has rows.
        place = lambda own: numbered(live.where(f"{own} is not null").select("hub", own), "hub", own) if size["largest"] > hub_rows else live.where(f"{own} is not null").select("hub", own, F.row_number().over(Window.partitionBy("hub").orderBy(own)).alias("place"))  # noqa: B023, E731
        firm = materialise(firmed(place("i").join(place("e"), ["hub", "place"]), live))
        broken = firm.where("not fine").groupBy("hub").agg(F.min("place").alias("until"))
        won = materialise(firm.join(broken, "hub", "left").where("until is null or place < until").select("i", "e").distinct())
        out = won if out is None else out.unionByName(won)
        rest = live.select("hub", "i", "e").join(won.select("i"), "i", "left_anti").join(won.select("e"), "e", "left_anti")
        links = materialise(rest.select("hub", "i", "e"))
        discard(live, firm)


def firmed(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """Adds ``fine``: no other hub of either row offers it anything earlier than its mate in this hub."""
    out = pairs
    for own, other in SIDES.items():
        # For each row its best offer outside a hub: the two least offers over its hubs, with the hub of the first.
        offers = live.where(f"{own} is not null").select(own, "hub", F.col(f"first_{other}").alias("offer"))
        least = offers.groupBy(own).agg(F.min(F.struct("offer", "hub")).alias("one"))
        second = offers.join(least, own).where("hub <> one.hub").groupBy(own).agg(F.min("offer").alias("two"))
        known = least.join(second, own, "left").select(own, F.col("one.hub").alias("hub_1"), F.col("one.offer").alias("offer_1"), "two")
        out = out.join(known, own).withColumn(f"else_{other}", F.when(F.col("hub_1") == F.col("hub"), F.col("two")).otherwise(F.col("offer_1"))).drop("hub_1", "offer_1", "two")
    fine = (F.coalesce(F.col("else_e") >= F.col("e"), F.lit(True))) & (F.coalesce(F.col("else_i") >= F.col("i"), F.lit(True)))
    return out.withColumn("fine", fine)


def url_key(url: Column) -> Column:
    """Host and path of a url in lower case, without the closing slash; a url without a scheme counts as https."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.regexp_replace(url, r"^(?!https?://)", "https://"), r"^[A-Za-z]+://([^?#]*)", 1)), r"/+$", ""), F.lit(""))


def entity_hubs(incoming: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hubs of entities by shop number, ids at platforms, title with type, and url where the titles agree.

    Both: id and, as strings, sku, shopify_id, woo_id, external_id, title, entity_type, source_url. At one url, titles agree if one is empty or part of the other; which distinct
    titles of a url hold others is found over their three-letter pieces: a title is looked for under its rarest one.
    """

    def plain(df: DataFrame) -> DataFrame:
        title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
        return df.select("id", F.nullif(F.lower(F.trim("sku")), F.lit("")).alias("sku"), *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("shopify_id", "woo_id", "external_id")), title.alias("title"), F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("product")).alias("kind"), url_key(F.col("source_url")).alias("url"))

    sides = {"i": materialise(plain(incoming)), "e": materialise(plain(existing))}
    named = lambda kind, *values: F.when(F.lit(True) if not values else F.concat(*values).isNotNull(), F.to_json(F.struct(F.lit(kind).alias("k"), *(v.alias(f"v{n}") for n, v in enumerate(values)))))
    keyed = {}
    for side, df in sides.items():
        hubs = [named(c, F.col(c)) for c in ("sku", "shopify_id", "woo_id", "external_id")]
        hubs.append(F.when(F.col("title") != "", named("title", F.col("title"), F.col("kind"))))
        hubs.append(F.when(F.col("title") == "", named(f"untitled_{side}", F.col("url"))))  # meets every row of the url on the other side
        hubs.append(named(f"untitled_{SIDES[side]}", F.col("url")))
        keyed[side] = df.select("id", "url", "title", F.explode(F.array_compact(F.array(*hubs))).alias("hub")).select("hub", "id")
    titles = {side: df.where("url is not null and title <> ''").select("url", "title").distinct() for side, df in sides.items()}
    # Only urls that both sides have matter.
    both = titles["i"].select("url").distinct().join(titles["e"].select("url").distinct(), "url")
    titles = {side: materialise(df.join(both, "url")) for side, df in titles.items()}
    alike = titles["i"].join(titles["e"], ["url", "title"]).select("url", F.col("title").alias("title_i"), F.col("title").alias("title_e"))
    for part, whole in SIDES.items():
        held = contained(titles[part], titles[whole]).select("url", F.col("part").alias(f"title_{part}"), F.col("whole").alias(f"title_{whole}"))
        alike = alike.unionByName(held)
    alike = materialise(alike.distinct())
    for side, df in sides.items():
        hub = named("url", F.col("url"), F.col("title_i"), F.col("title_e"))
        keyed[side] = keyed[side].unionByName(df.withColumnRenamed("title", f"title_{side}").join(alike, ["url", f"title_{side}"]).select(hub.alias("hub"), "id"))
    return keyed["i"], keyed["e"]


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """Both: url, title. Returns url, part, whole: titles of parts that stand, and are shorter, within a title of wholes at the same url."""
    pieces = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, 3)))
    posted = materialise(wholes.where(F.length("title") > 3).select("url", F.col("title").alias("whole"), F.explode(pieces(F.col("title"))).alias("piece")))
    often = posted.groupBy("url", "piece").agg(F.count("*").alias("n"))
    asked = parts.where(F.length("title") >= 3).select("url", F.col("title").alias("part"), F.explode(pieces(F.col("title"))).alias("piece"))
    rarest = asked.join(often, ["url", "piece"]).groupBy("url", "part").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    long = rarest.join(posted, ["url", "piece"]).where(F.contains("whole", "part") & (F.length("whole") > F.length("part"))).select("url", "part", "whole")
    # One or two letters have no piece of three; they are looked for under themselves.
    bits = lambda t: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.array(F.substring(t, i, 1), F.substring(t, i, 2)))))
    short = parts.where(F.length("title") < 3).select("url", F.col("title").alias("part"))
    tiny = wholes.join(short.select("url").distinct(), "url", "left_semi").select("url", F.col("title").alias("whole"), F.explode(bits(F.col("title"))).alias("part"))
    return long.unionByName(short.join(tiny, ["url", "part"]).where(F.length("whole") > F.length("part")).select("url", "part", "whole"))


def matched_entities(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """i, e: which existing row each incoming row takes."""
    return claimed(*entity_hubs(incoming, existing))
