"""URL filters by a sort-merge range join.

A host with its labels reversed (``com.example.www``) turns "this host and all below it" into an interval of
keys. Rules are copied to the key ranges (partitions) that their intervals touch, urls go to the one range of
their key, and each partition sweeps its rows in key order with a stack of the rules whose intervals are
open. Path rules of one host nest in the same way: each knows the nearest rule whose path is a prefix of its own.
The longest fitting rule (host and path together, then the longer host, then the text) decides.

Cases: a null url or one without ``://`` has empty host and path; an empty rule host fits every url with a host; repeated
rules count once, and of equal rules with different verdicts ``block`` stands; empty tables give empty or unruled results; repeated urls are judged row
by row; the id may be null; further columns of either table are passed over. Work a partition does grows with its own rows and the rules
that touch it; a hot host is one key range and is split by a salt, its few open rules being copied.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed rules of the registered query: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that one partition of the sweep is meant to hold.
ROWS_A_PARTITION = 200_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by \\x01, which sorts before any character of a host: a rule's key is a prefix of what lies below it."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\x01"), F.lit("\x01")))


def nested(rules: Iterable[tuple[str, str, str]]) -> tuple[list[str], list[int], list[tuple[str, str]]]:
    """Path rules of one host, sorted, with the place of the nearest enclosing one (-1: none)."""
    paths: list[str] = []
    parent: list[int] = []
    said: list[tuple[str, str]] = []
    stack: list[int] = []
    for path, rule, verdict in sorted(rules, key=lambda r: (r[0], r[2] != "block")):
        if paths and paths[-1] == path:
            continue
        while stack and not path.startswith(paths[stack[-1]]):
            stack.pop()
        parent.append(stack[-1] if stack else -1)
        stack.append(len(paths))
        paths.append(path)
        said.append((rule, verdict))
    return paths, parent, said


def longest(frame: tuple, path: str) -> int:
    paths, parent, _ = frame
    i = bisect_right(paths, path) - 1
    while i >= 0 and not path.startswith(paths[i]):
        i = parent[i]
    return i


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of their key, a key's rules before its urls."""
    stack: list[tuple[str, tuple]] = []
    opening: tuple[str, list] | None = None
    part = None
    for batch in batches:
        rules_out, verdicts_out, keep = [], [], []
        for row in batch.itertuples(index=False):
            key = row.key
            if row.part != part:  # a range starts with its own copies of all rules that reach into it
                stack, opening, part = [], None, row.part
            if opening and opening[0] != key or opening and not row.is_rule:
                stack.append((opening[0], nested(opening[1])))
                opening = None
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if row.is_rule:
                opening = opening or (key, [])
                opening[1].append((row.path, row.rule, row.verdict))
                keep.append(False)
                continue
            best = (-1, 0, None, None)
            for depth, (host, frame) in enumerate(stack if key else ()):
                if (i := longest(frame, row.path)) >= 0:
                    best = max(best, (len(host) + len(frame[0][i]), depth, *frame[2][i]), key=lambda b: b[:2])
            keep.append(True)
            rules_out.append(best[2])
            verdicts_out.append(best[3])
        out = batch.loc[keep, ["id", "host", "path"]]
        yield out.assign(verdict=pd.Series(verdicts_out, index=out.index, dtype=object), rule=pd.Series(rules_out, index=out.index, dtype=object))


def placing(bounds: list[tuple[int, str, str]]):
    """Copies each rule to the key ranges that its interval touches; the ranges are in order, so they are neighbours."""
    parts_, highs, lows = [b[0] for b in bounds], [b[2] for b in bounds], [b[1] for b in bounds]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, to = [], []
            for row, key in enumerate(batch["key"]):
                i = bisect_left(highs, key)
                while i < len(parts_) and (lows[i] <= key or lows[i].startswith(key)):
                    at.append(row)
                    to.append(parts_[i])
                    i += 1
            yield batch.iloc[at].assign(part=to)

    return place


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls: id and url. rules: verdict, host, path. Returns id, host, path, rule (host and path of the rule, or null), verdict.

    The keyed urls are range-partitioned by key and, within a hot key, by a hash of their id, and written once; the lowest and
    highest key of each range (one row a partition) tell where rules must go.
    """
    host, path = parts(F.col(url_col))
    keyed = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    n = max(urls.sparkSession.sparkContext.defaultParallelism, -(-urls.count() // ROWS_A_PARTITION))
    keyed = materialise(keyed.repartitionByRange(n, "key", F.xxhash64("id", "path")).withColumn("part", F.spark_partition_id()))
    bounds = [tuple(b) for b in keyed.groupBy("part").agg(F.min("key"), F.max("key")).orderBy("part").collect()]
    ruled = rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    ruled = ruled.withColumn("key", host_key(F.col("host"))).withColumn("rule", F.concat("host", "path"))
    copies = ruled.mapInPandas(placing(bounds), "host string, path string, verdict string, key string, rule string, part int").withColumn("is_rule", F.lit(True))
    rows = keyed.withColumn("is_rule", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    placed = rows.repartition(n, "part").sortWithinPartitions("part", "key", F.desc("is_rule"))
    kind = keyed.schema["id"].dataType.simpleString()
    out = placed.mapInPandas(sweep, f"id {kind}, host string, path string, verdict string, rule string")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
