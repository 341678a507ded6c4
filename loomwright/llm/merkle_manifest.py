"""Merkle manifests of tables: a root over all rows, and for each row the path that proves it.

Rows of a group (a language, say) are leaves in the order of an id; every 8 neighbours (fewer in the last run, even one) become one node, until one is left, the subroot. Subroots in the order of
their groups make the root the same way. Paths are worked out block by block (8 ** 4 neighbouring leaves, a subtree of its own) by Merkle traversal: for each level one treehash stack takes in one
leaf a step and so has the next run's nodes ready when the present run is passed, so what a traversal holds grows with the logarithm of the block. The path from a block's root
to the root is the same for its leaves; it comes from the same steps over the blocks' roots and is appended.

A path is an array of levels from the leaf up, each with the digests before and after the own one in its run, joined; a lone node of a run has a level of two empty strings. ``folded``
makes the root from a leaf and its path, in SQL functions.

Cases: a null value is written as ``-``, an empty one as ``0:``; rows with the same id stand in the order of their leaves, and equal rows have equal leaves, so the root does not depend on the
order of rows; null ids and a null group come first; an empty table gives no rows; columns that are not named are passed over, whatever their names. Places are found by ranges
of (group, id), so that a group of any size is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Nodes of one run, levels of one block, and so its leaves.
RUN, LEVELS = 8, 4
#: Rows that one range is meant to hold.
RANGE = 50_000

PATH = "array<struct<before:string,after:string>>"


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """Hash of the values: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(value(c.cast("string")) for c in columns)).cast("binary"), 256)


class Treehash:
    """A stack that takes leaves one by one and keeps the nodes of one level; below it holds less than a run a level."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def take(self, leaf: str) -> None:
        self.stack[0].append(leaf)
        for below, above in zip(self.stack, self.stack[1:], strict=False):
            if len(below) < RUN:
                break
            above.append(hashed("".join(below)))
            below.clear()

    def nodes(self) -> list[str]:
        """The level's nodes, when no leaf is left to come: what lower levels still hold makes shorter runs."""
        for below, above in zip(self.stack, self.stack[1:], strict=False):
            if below:
                above.append(hashed("".join(below)))
                below.clear()
        return self.stack[-1]


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def top(leaves: list[str], levels: int) -> str:
    """The root of a block."""
    tree = Treehash(levels)
    for leaf in leaves:
        tree.take(leaf)
    return tree.nodes()[0]


def traversal(leaves: list[str], levels: int) -> Iterator[list[dict[str, str]]]:
    """The authentication path of each leaf in turn. Each level keeps the run it is in and one stack that gathers the next run, fed by one leaf a step."""
    width = [RUN ** (level + 1) for level in range(levels)]  # leaves below a run of the level
    now: list[list[str]] = []
    for level in range(levels):
        tree = Treehash(level)
        for leaf in leaves[: width[level]]:
            tree.take(leaf)
        now.append(tree.nodes())
    coming = [Treehash(level) for level in range(levels)]
    path: list[dict[str, str]] = [{} for _ in range(levels)]
    for i in range(len(leaves)):
        for level in range(levels):
            below = width[level] // RUN
            if i % below:
                break  # nor does any level above change here
            if i and i % width[level] == 0:
                now[level], coming[level] = coming[level].nodes(), Treehash(level)
            own = i // below % RUN
            path[level] = {"before": "".join(now[level][:own]), "after": "".join(now[level][own + 1 :])}
        yield list(path)
        for level in range(levels):  # the leaf so far ahead belongs to the level's next run
            ahead = i + width[level]
            if ahead < len(leaves):
                coming[level].take(leaves[ahead])


def placed(nodes: DataFrame, group: str, order: list[str], rows: int, range_: int = RANGE) -> DataFrame:
    """Adds ``place`` (from 0, in the order within the group) and ``n`` (the group's rows); written.

    Rows are dealt by ranges of group and order; a row's place is its number in its range, less that of its group's first row there, plus the group's rows in the ranges before.
    """
    # The last key only splits equal rows, whose order makes no difference.
    spread = nodes.withColumn("__r", F.monotonically_increasing_id())
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("__r")]
    ranges = max(1, -(-rows // range_))
    sorted_ = spread.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("__r")
    at = F.monotonically_increasing_id()  # the range in the upper bits, the row's number in it in the lower 33
    numbered = materialise(sorted_.withColumn("__at", at).withColumn("__range", F.shiftright("__at", 33)))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # nulls are one group
    groups = materialise(numbered.groupBy("__range", key.alias("__group_key")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows")))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("__group_key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select("__range", "__group_key", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(Window.partitionBy("__group_key")).alias("n"))
    out = numbered.withColumn("__group_key", key).join(starts, ["__range", "__group_key"])
    done = materialise(out.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift", "__group_key"))
    discard(numbered)
    discard(groups)
    return done


def _streamed(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys; no more than one run and one batch are held."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        columns = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, key in enumerate(columns):
            if key != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now, start = [], key, i
        if columns:
            held.append(batch.slice(start))
    if held:
        yield now, pa.Table.from_batches(held)


def _levels(n: int, levels: int) -> int:
    """Levels of the blocks of a group with n nodes: all up to its root if one block holds them."""
    return height(n) if n <= RUN**levels else levels


def _tops(levels: int):
    """One row a block: its root, as a node of the tree above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _streamed(batches, ("__key", "block")):
            below = rows["n"][0].as_py()
            made = top(rows["digest"].to_pylist(), _levels(below, levels))
            first = rows.slice(0, 1).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([first.column("__key"), pa.array([made]), first.column("block"), pa.array([-(-below // RUN**levels)])], names=["__key", "digest", "place", "n"])

    return run


def _paths(keep: list[str], levels: int):
    """Rows of a block behind one row that has the path of the block itself, its group's root and no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _streamed(batches, ("__key", "block")):
            upper, subroot = rows["upper"][0].as_py(), rows["subroot"][0].as_py()
            rows = rows.slice(1)
            paths = [path + upper for path in traversal(rows["digest"].to_pylist(), _levels(rows["n"][0].as_py(), levels))]
            for s in range(0, len(paths), 512):
                some = rows.slice(s, 512).combine_chunks().to_batches()[0]
                out = pa.array(paths[s : s + 512], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array([subroot] * len(out)), out], names=[*keep, "subroot", "path"])

    return run


def climbed(nodes: DataFrame, keep: list[str], levels: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """nodes: __key (the group), digest, place, n and the columns to keep.

    Returns the root of each group (__key, digest), and a function that takes one row a group (__key, subroot, above: the path from the group's root on) and gives the kept columns,
    subroot and the whole path of each node.
    """
    by = ["__key", "block"]
    blocks = nodes.withColumn("block", F.call_function("div", F.col("place"), F.lit(RUN**levels)))
    runs = blocks.select("__key", "digest", "place", "n", "block").repartition(*by).sortWithinPartitions(*by, "place")
    roots = materialise(runs.mapInArrow(_tops(levels), "__key string, digest string, place long, n long"))
    if single := roots.where("n > 1").isEmpty():
        tops = roots.select("__key", "digest")
    else:  # 4096 times fewer rows each time
        tops, higher = climbed(roots, ["__key", "place"], levels)

    def paths(ways: DataFrame) -> DataFrame:
        upper = roots.join(ways, "__key").withColumnRenamed("above", "path") if single else higher(ways)
        none = lambda c: F.lit(None).cast(dict(blocks.dtypes)[c]).alias(c)
        own = sorted({*keep, "__key", "digest", "place", "n"})
        heads = upper.select(F.col("place").alias("block"), F.col("path").alias("upper"), "subroot", *("__key" if c == "__key" else F.lit(-1).cast("long").alias(c) if c == "place" else none(c) for c in own))
        rows = blocks.select("block", F.lit(None).cast(PATH).alias("upper"), F.lit(None).cast("string").alias("subroot"), *own).unionByName(heads)
        kinds = ", ".join(f"`{c}` {dict(blocks.dtypes)[c]}" for c in keep)
        return rows.repartition(*by).sortWithinPartitions(*by, "place").mapInArrow(_paths(keep, levels), f"{kinds}, subroot string, path {PATH}")

    return tops, paths


def manifest(leaves: DataFrame, order: str, group: str, keep: list[str], levels: int = LEVELS, range_: int = RANGE) -> DataFrame:
    """leaves: order (the id), group, leaf and the columns to keep. Returns the kept columns, leaf, subroot, root and path for every row. levels: of one block."""
    spark = leaves.sparkSession
    at, g = "__order", "__group"
    written = materialise(leaves.select(*keep, "leaf", F.col(order).alias(at), F.col(group).cast("string").alias(g)))
    numbered = placed(written, g, [at, "leaf"], written.count(), range_)
    discard(written)
    nodes = numbered.withColumn("__key", F.coalesce(F.concat(F.lit("="), g), F.lit(""))).withColumn("digest", F.col("leaf"))
    subroots, paths = climbed(nodes, [*keep, "leaf"], levels)
    subroots = materialise(subroots)
    # All groups are one run of nodes in the order of their names; the mark before a name puts null first.
    ordered = placed(subroots.select(F.lit("").alias("__key"), F.col("__key").alias("name"), "digest"), "__key", ["name"], subroots.count(), range_)
    tops, above = climbed(ordered, ["name", "digest"], levels)
    root = (tops.first() or {"digest": None})["digest"]
    way = spark.createDataFrame([("", root, [])], f"__key string, subroot string, above {PATH}")
    ways = materialise(above(way).select(F.col("name").alias("__key"), F.col("digest").alias("subroot"), F.col("path").alias("above")))  # one row a group
    return paths(ways).select(*keep, "leaf", "subroot", F.lit(root).alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path make."""
    return F.aggregate(path, leaf, lambda digest, level: F.sha2(F.concat(level["before"], digest, level["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, joined."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")
