"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosines, and connected components.

A table's code is the signs of a vector's products with some hyperplanes; two vectors at cosine 0.93 agree in one sign with
chance 0.880. The number of signs follows the largest label, so that a code's bucket keeps its size, and the number of tables
follows from it, so that a pair is missed less than once in 10 million: tables grow as the rows to the power 0.18. Only vectors of one label and code are compared, all of them, in double precision.
Equal vectors are compared once: a class of copies carries the number of its vectors.

A code's bucket is cut into blocks of bounded size, and each pair of blocks is one unit of work: a matrix product. A pair that agrees in several
tables counts in the first of them, which both codes tell. Per class, only the number of links and a few links that join components leave a task.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label, link with nothing, and are their own component; vectors of different
lengths are never linked; a repeated vec_id counts as one vector for each row; a null vec_id is kept, with a null component; an empty table gives no
rows; other columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, materialise
from .components import components

THRESHOLD, SEED = 0.93, 20240101
#: Chance that a pair at the threshold is missed; vectors that a bucket of one code is meant to hold; fewest and most signs.
MISS, BUCKET, BITS = 1e-7, 64, (4, 24)
#: Vectors that one block of a bucket is meant to hold.
BLOCK = 1024


def shape(largest: int) -> tuple[int, int]:
    """Tables and signs a table, for so many vectors in the largest label."""
    bits = min(max(round(math.log2(max(largest, 1) / BUCKET)), BITS[0]), BITS[1])
    agree = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-agree)), bits


def codes_of(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One code for each vector and table."""
    planes = np.random.default_rng(SEED + x.shape[1]).standard_normal((x.shape[1], tables * bits))
    return ((x @ planes > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int32))).astype(np.int32)


def rows_of(column: pa.ListArray) -> list[np.ndarray]:
    """A list column as one array a row, without copies."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _codes(tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = rows_of(batch.column("v"))
            out: list = [None] * len(vectors)
            for width in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == width]
                for i, c in zip(rows, codes_of(np.array([vectors[i] for i in rows]), tables, bits), strict=True):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int32()))], names=["id", "codes"])

    return run


def _spanning(link: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects: from a row at once to all it reaches that is still apart."""
    labels, out = np.arange(n), []
    for r in range(len(rows)):
        to = columns[link[r]]
        if not len(to):
            continue
        fresh, first = np.unique(labels[to], return_index=True)
        own = labels[rows[r]]
        for label, at in zip(fresh, first, strict=True):
            if label != own:
                out.append((int(rows[r]), int(to[at])))
        labels[np.isin(labels, fresh)] = own
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of one pair of blocks. Gives (id, links, null) for counts and (id, null, other) for links that join."""
    key, held = None, []

    def found() -> pa.RecordBatch | None:
        table, first = key[0], key[2]
        ids = np.array([h[0] for h in held])
        copies = np.array([h[1] for h in held])
        codes = np.array([h[3] for h in held])
        sides = np.array([h[4] for h in held])
        x = np.array([h[2] for h in held])
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        within = not len(b) if first == key[3] else False
        if within:
            b = a
        if not len(a) or not len(b):
            return None
        link = x[a] @ x[b].T >= THRESHOLD
        if within:
            np.fill_diagonal(link, False)
        at, to = np.nonzero(link)
        # An earlier table in which the two agree has counted them.
        for s in range(0, len(at), 500_000):
            part = slice(s, s + 500_000)
            earlier = (codes[a[at[part]], :table] == codes[b[to[part]], :table]).any(axis=1)
            link[at[part][earlier], to[part][earlier]] = False
        counts = np.zeros(len(held), dtype=np.int64)
        counts[a] += link @ copies[b]
        if not within:
            counts[b] += link.T @ copies[a]
        pairs = _spanning(link, a, b, len(held))
        some = np.flatnonzero(counts)
        one = [*ids[some].tolist(), *(int(ids[i]) for i, _ in pairs)]
        n = [*counts[some].tolist(), *[None] * len(pairs)]
        other = [*[None] * len(some), *(int(ids[j]) for _, j in pairs)]
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], names=["id", "links", "other"])

    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("table", "bucket", "lo", "hi")]
        columns = [*keys, batch.column("id").to_pylist(), batch.column("copies").to_pylist(), rows_of(batch.column("v")), rows_of(batch.column("codes")), batch.column("side").to_pylist()]
        for table, bucket, lo, hi, *row in zip(*columns, strict=True):
            if (table, bucket, lo, hi) != key:
                if held and (out := found()):
                    yield out
                key, held = (table, bucket, lo, hi), []
            held.append(row)
    if held and (out := found()):
        yield out


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Returns id_col, n_links, component_id, kept: a row for each row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    # The largest component first, so that no square overflows; each divisor once a row.
    scaled = let(F.array_max(F.transform("v", F.abs)), lambda m: F.transform("v", lambda x: x / m))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = let(scaled, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))
    good = materialise(rows.where("usable").select("id", "label", unit.alias("v")))
    classes = good.groupBy("label", "v").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    # One number a class, even where a vec_id is given to several vectors; the written table fixes it.
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()))
    tables, bits = shape(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    coded = materialise(classes.join(classes.select("id", "v").mapInArrow(_codes(tables, bits), "id long, codes array<int>"), "id"))
    members = coded.select("id", F.posexplode("codes").alias("table", "code"), "label", F.size("v").alias("width"))
    keyed = members.select("id", "table", F.xxhash64("label", "code", "width").alias("bucket"))
    buckets = keyed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = keyed.join(buckets, ["table", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("table", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "id")
    work = units.join(coded.select("id", "copies", "v", "codes"), "id")
    work = work.repartition("table", "bucket", "lo", "hi").sortWithinPartitions("table", "bucket", "lo", "hi")
    found = materialise(work.mapInArrow(_compare, "id long, links long, other long"))
    counts = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = coded.select("id", "label", "v", "class", "copies").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("class").alias("component_id"))
    named = named.join(least, "component").join(counts, "id", "left").select("label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    back = good.withColumnRenamed("id", id_col).join(named, ["label", "v"]).select(id_col, "n_links", "component_id")
    alone = rows.where("not usable").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return back.unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
