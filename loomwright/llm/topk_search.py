"""Exact search for the largest inner products, by buckets of vectors of like length.

Candidates are grouped into classes of length (one a hundredth part longer than the one before); neighbouring classes make a bucket, and a bucket beyond
``block`` rows is cut into blocks by a hash, so that a class that most vectors share (unit vectors, say) is many units of work. Each query first
meets the longest vectors of all: its k-th best score there is a floor that its answer can't fall below. A unit of work is a block of candidates with a block of queries whose floors
the bucket can reach at all; others are never formed. Inside a unit each query has a local threshold, the cosine that a candidate as long as the block's longest must have
to reach the floor. Where it is low, length prunes: candidates stand by falling length, and only those long enough are multiplied. Where it is high, coordinates prune: at the query's
largest coordinates a candidate's own coordinate must lie in a narrow range, which sorted lists give. What is left is verified by the integer product.

Cases: vectors that are null or hold nulls take no part, nor do those whose squared length is 2**62 or more (their scores would not fit); vectors meet only those with as many
components; empty and zero vectors score 0; each row with a query's id is a query of its own, and a row of the same id beside it is a candidate; a null id is no query, and
stands behind all others in ties; an empty table gives no rows; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .embedding_dedup import rows_of

#: How much longer a class of length may be at its top than at its bottom.
RATIO = 1.01
#: Candidates and queries of one unit of work at most, and numbers that either holds at most.
BLOCK, QUERIES, NUMBERS = 8192, 2048, 4_000_000
#: Longest vectors that give each query its floor.
HEAD = 2048
#: Local threshold from which coordinates prune, and how many of a query's coordinates are looked at.
COORDINATES_FROM, FOCUS = 0.7, 5
#: Stands for a null id inside tasks.
LAST = 2**63 - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as an int; null for vectors that are null, hold null or non-finite components, or are too long."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * scale)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31 - 1))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(scaled, lambda x: F.floor(x).cast("int")))


def products(x: np.ndarray, y: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of all rows, exact: in doubles while no sum can leave their whole numbers. longest: product of the greatest lengths."""
    kind = np.float64 if longest < 2.0**52 else np.int64
    return (x.astype(kind) @ y.astype(kind).T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _floors(head: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """For each query, its k-th best score among the longest vectors (null where they are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rids = rows_of(batch.column("v")), batch.column("rid").to_numpy(zero_copy_only=False)
            out: list = [None] * len(vectors)
            for width in {len(v) for v in vectors}:
                long_rids, long = head[width]
                at = [i for i, v in enumerate(vectors) if len(v) == width]
                for s in range(0, len(at), 256):
                    some = at[s : s + 256]
                    q = np.array([vectors[i] for i in some]).reshape(len(some), width)
                    top = np.sqrt((q.astype(float) ** 2).sum(axis=1).max(initial=0) * (long.astype(float) ** 2).sum(axis=1).max(initial=0))
                    for i, row in zip(some, products(q, long, top), strict=True):
                        row = row[long_rids != rids[i]]
                        if len(row) >= k:
                            out[i] = int(np.partition(row, len(row) - k)[len(row) - k])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "id", "v", "norm", "width")), pa.array(out, pa.int64())], names=["rid", "id", "v", "norm", "width", "low"])

    return run


class Block:
    """The candidates of one unit, by falling length, with sorted lists of single coordinates made on demand."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray):
        order = np.argsort(-norms, kind="stable")
        self.rids, self.ids, self.x, self.norms = rids[order], ids[order], x[order], norms[order]
        self.longest = float(self.norms[0])
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.pruned = 0

    def reach(self, need: np.ndarray) -> np.ndarray:
        """How many candidates, from the longest on, are at least so long."""
        return np.searchsorted(-self.norms, -need * (1 - 1e-9), side="right")

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places by the f-th coordinate of the vectors made to length 1, and these coordinates in order."""
        if f not in self.lists:
            values = self.x[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(values, kind="stable")
            self.lists[f] = order, values[order]
        return self.lists[f]

    def by_coordinates(self, q: np.ndarray, norm: float, cosine: float, reach: int) -> np.ndarray:
        """Places whose coordinates allow a cosine of at least ``cosine`` with q: with b = 1 - a * a, a coordinate lies within cosine * a -+ sqrt((1 - cosine ** 2) * b), or beyond on the side where a itself is larger than cosine."""
        unit, slack = q / norm, 1e-7
        slices = []
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            a = float(unit[f])
            room = math.sqrt(max((1 - cosine * cosine) * (1 - a * a), 0.0))
            low = -1.0 if a < -cosine else cosine * a - room
            high = 1.0 if a > cosine else cosine * a + room
            order, values = self.column(f)
            slices.append((np.searchsorted(values, low - slack, "left"), np.searchsorted(values, high + slack, "right"), low - slack, high + slack, f, order))
        start, end, _, _, first, order = min(slices, key=lambda s: s[1] - s[0])
        places = order[start:end]
        places = places[places < reach]
        for _, _, low, high, f, _ in slices:
            if f != first and len(places):
                values = self.x[places, f] / np.maximum(self.norms[places], 1e-300)
                places = places[(values >= low) & (values <= high)]
        return places


def answers(block: Block, rids: np.ndarray, q: np.ndarray, norms: np.ndarray, lows: list[int | None], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query with anything to tell: its place, and places and scores of its best candidates here, none below its floor."""
    low = np.array([-np.inf if x is None or n == 0 else x for x, n in zip(lows, norms, strict=True)])
    need = np.where(low > 0, low / np.maximum(norms, 1e-300), 0.0)
    cosine = np.clip(need / max(block.longest, 1e-300), 0.0, 1.0) * (1 - 1e-9)
    reach = block.reach(need)
    exact = float(norms.max(initial=0)) * block.longest

    def chosen(i: int, places: np.ndarray, scores: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        fine = block.rids[places] != rids[i]
        if lows[i] is not None:
            fine &= scores >= lows[i]
        places, scores = places[fine], scores[fine]
        top = best(scores, block.ids[places], k)
        return i, places[top], scores[top]

    narrow = cosine >= COORDINATES_FROM
    for i in np.flatnonzero(narrow & (reach > 0)).tolist():
        places = block.by_coordinates(q[i], float(norms[i]), float(cosine[i]), int(reach[i]))
        block.pruned += int(reach[i]) - len(places)
        if len(places):
            yield chosen(i, places, products(q[i : i + 1], block.x[places], exact)[0])
    wide = np.flatnonzero(~narrow & (reach > 0))
    wide = wide[np.argsort(-reach[wide], kind="stable")]
    for s in range(0, len(wide), 128):
        some = wide[s : s + 128]
        scores = products(q[some], block.x[: reach[some[0]]], exact)
        for i, row in zip(some.tolist(), scores, strict=True):
            row = row[: reach[i]]
            places = np.flatnonzero(row >= lows[i]) if lows[i] is not None else np.arange(len(row))
            yield chosen(i, places, row[places])


def _units(k: int):
    """Rows in runs of one unit: candidates (side 0) and queries (side 1)."""

    def told(held: list) -> pa.RecordBatch | None:
        sides = np.array([h[0] for h in held])
        rids = np.array([h[1] for h in held])
        ids = np.array([h[2] for h in held])
        norms = np.array([h[4] for h in held])
        mine, asked = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if not len(mine) or not len(asked):
            return None
        stacked = lambda at: np.array([held[i][3] for i in at]).reshape(len(at), -1)
        block = Block(rids[mine], ids[mine], stacked(mine), norms[mine])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, places, scores in answers(block, rids[asked], stacked(asked), norms[asked], [held[a][5] for a in asked], k):
            for column, values in zip(out, (np.full(len(places), rids[asked[i]]), np.full(len(places), ids[asked[i]]), block.ids[places], scores), strict=True):
                column.append(values)
        if not out[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["rid", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "team", "sub")), strict=True)
            columns = [batch.column(c).to_pylist() for c in ("side", "rid")] + [batch.column("id").fill_null(LAST).to_pylist(), rows_of(batch.column("v")), batch.column("norm").to_pylist(), batch.column("low").to_pylist()]
            for now, *row in zip(keys, *columns, strict=True):
                if now != key:
                    if held and (out := told(held)):
                        yield out
                    key, held = now, []
                held.append(row)
        if held and (out := told(held)):
            yield out

    return run


def level_of(length: Column) -> Column:
    """The class of a length; -1 for nothing. Lengths from 1 to 2**31 have 2160 classes."""
    return F.when(length > 0, F.greatest(F.floor(F.log(length) / math.log(RATIO)).cast("int"), F.lit(0))).otherwise(F.lit(-1))


def runs_of(classes: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """Neighbouring classes (level, rows) joined until they hold ``most`` rows: lowest level, highest level, rows."""
    out: list[tuple[int, int, int]] = []
    for level, n in sorted(classes):
        if out and out[-1][2] < most:
            out[-1] = (out[-1][0], level, out[-1][2] + n)
        else:
            out.append((level, level, n))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "id", vector_col: str = "v", block: int = BLOCK, queries: int = QUERIES, head: int = HEAD) -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: the k highest inner products of each query with every row but its own.

    vectors: id_col and vector_col, an array of ints. is_query: which rows ask.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<int>").alias("v"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("asks")).where(F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False)))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))).where(f"norm < {2.0**31 - 1}")
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "v", "asks", "norm", F.size(v).alias("width"), level_of(F.col("norm")).alias("level")))
    size = lambda width, most: max(1, min(most, NUMBERS // max(width, 1)))
    # One row for each class of length and number of components reaches the driver.
    classes: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("width", "level").count().collect():
        classes.setdefault(r["width"], []).append((r["level"], r["count"]))
    first = Window.partitionBy("width").orderBy(F.desc("norm"), "rid")
    longest: dict[int, tuple[list, list]] = {}
    for r in rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= head).where(F.col("at") <= F.greatest(F.lit(1), F.floor(F.lit(NUMBERS) / F.greatest("width", F.lit(1))))).select("width", "rid", "v").toLocalIterator():
        at, x = longest.setdefault(r["width"], ([], []))
        at.append(r["rid"])
        x.append(r["v"])
    fixed = {w: (np.array(at), np.array(x, dtype=np.int32).reshape(len(at), w)) for w, (at, x) in longest.items()}
    asked = rows.where("asks").select("rid", "id", "v", "norm", "width").mapInArrow(_floors(fixed, k), "rid long, id long, v array<int>, norm double, width int, low long")
    need = F.when((F.col("low") > 0) & (F.col("norm") > 0), F.col("low") / F.col("norm")).otherwise(0.0)
    asked = materialise(asked.withColumn("level", F.greatest(level_of(need) - 1, F.lit(-1))))  # one class lower, against rounding
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in asked.groupBy("width", "level").count().collect():
        wanted.setdefault(r["width"], []).append((r["level"], r["count"]))
    buckets, teams, count = [], [], 0
    for width, own in classes.items():
        made = [(lo, hi, -(-n // size(width, block))) for lo, hi, n in runs_of(own, size(width, block))]
        asking = [(lo, hi, -(-n // size(width, queries))) for lo, hi, n in runs_of(wanted.get(width, []), size(width, queries))]
        met = lambda bucket, team: bucket[1] >= team[0]  # noqa: E731  its longest vectors may reach the least floor
        first_bucket, first_team = len(buckets), len(teams)
        for lo, hi, n in made:
            buckets.append((width, lo, hi, len(buckets), n, [(first_team + j, team[2]) for j, team in enumerate(asking) if met((lo, hi), team)]))
        for lo, hi, n in asking:
            teams.append((width, lo, hi, len(teams), n, [(first_bucket + j, bucket[2]) for j, bucket in enumerate(made) if met(bucket, (lo, hi))]))
        count += sum(b[2] * t[2] for b in made for t in asking if met(b, t))
    plan = "width int, lo int, hi int, own int, parts int, others array<struct<other:int,parts:int>>"

    def dealt(side: DataFrame, table: list, mine: tuple[str, str], theirs: tuple[str, str]) -> DataFrame:
        """Each row once for every unit that its block is in."""
        levels = [(w, level, own, parts, others) for w, lo, hi, own, parts, others in table for level in range(lo, hi + 1)]
        known = spark.createDataFrame(levels, plan.replace("lo int, hi int", "level int"))
        placed = side.join(F.broadcast(known), ["width", "level"])  # some thousand rows a width at most
        placed = placed.withColumn(mine[0], F.col("own")).withColumn(mine[1], F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
        met = placed.select("*", F.explode("others").alias("__o")).withColumn(theirs[0], F.col("__o.other"))
        return met.withColumn(theirs[1], F.explode(F.sequence(F.lit(0), F.col("__o.parts") - 1)))

    keys = ["bucket", "block", "team", "sub"]
    left = dealt(rows, buckets, ("bucket", "block"), ("team", "sub")).select(*keys, F.lit(0).alias("side"), "rid", "id", "v", "norm", F.lit(None).cast("long").alias("low"))
    right = dealt(asked, teams, ("team", "sub"), ("bucket", "block")).select(*keys, F.lit(1).alias("side"), "rid", "id", "v", "norm", "low")
    work = left.unionByName(right).repartition(max(1, min(4 * count, 20_000)), *keys).sortWithinPartitions(*keys)
    found = work.mapInArrow(_units(k), "rid long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") < LAST, F.col("vec_id")).alias("vec_id"), "score")
