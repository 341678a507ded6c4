"""Near-duplicate documents by min-max hashing.

Each of 96 permutations of the shingle hashes keeps both its minimum and its maximum: 192 values from 96 hash
evaluations, each equal for two documents with their similarity as probability. 32 bands of 6 values each give
buckets; a pair at 0.85 meets in none of them once in 4 million, one at 0.80 six times in 100,000.

Copies with equal sets are one class from the start, and buckets with the same members are one bucket. A bucket's members
are compared on their full sets, in blocks of bounded size that each hold the bucket's smallest member as well. Where
blocks of one bucket still lie in different components, the blocks are compared with each other. Within a task, a pair
already joined by other links is not compared again, so a group of n gives fewer than n links. Components come from alternating stars.

Cases: null texts, and texts without words, have no shingles and no links; fewer than five words make one shingle; a null
doc_id is its own component (null) and is kept; rows with the same doc_id are linked, whatever their texts (a repeated row is kept with its twin);
empty tables give empty results; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bit_filter import passing
from .common import materialise
from .components import components
from .shingles import WordHashes, scrambled, shingle_set

PERMUTATIONS, BANDS, ROWS = 96, 32, 6
#: A link: 100 * intersection >= percent * union; what the query op1 asks for.
PERCENT = 85
#: Shingles hashed at once in a task.
CHUNK = 100_000
#: Members, and shingles of all members together, that one block of a bucket is meant to hold.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000

SKETCH = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seeds = scrambled(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
    return seeds[:PERMUTATIONS], seeds[PERMUTATIONS:] | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum of each permutation for non-empty sets: one row a set, the minima first."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    for k, (x, m) in enumerate(zip(*_parameters(), strict=True)):
        v = (flat ^ x) * m
        out[:, k] = np.minimum.reduceat(v, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(v, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; a band's values come from six different permutations."""
    order = np.concatenate([np.arange(PERMUTATIONS), PERMUTATIONS + np.roll(np.arange(PERMUTATIONS), 1)])
    values = signature[:, order].reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2])
    for i in range(ROWS):
        key = scrambled(key ^ values[:, :, i])
    return key.view(np.int64)


def set_id(s: np.ndarray) -> bytes:
    """128 bits over the whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _rows(ids: list, sets: list[np.ndarray], part: pa.Schema) -> pa.RecordBatch:
    some = [i for i, s in enumerate(sets) if len(s)]
    bands: list = [None] * len(sets)
    if some:
        for i, keys in zip(some, band_keys(signatures([sets[i] for i in some])), strict=True):
            bands[i] = keys
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=part)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, ids, sets, held = WordHashes(), [], [], 0
    part = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            s = shingle_set(text.as_py(), memo)
            ids.append(doc_id)
            sets.append(s)
            held += len(s)
            if held >= CHUNK or len(ids) >= 2000:
                yield _rows(ids, sets, part)
                ids, sets, held = [], [], 0
    if ids:
        yield _rows(ids, sets, part)


def sketch(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch, SKETCH)


def links_within(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """What full sets link among members of different labels; where sides differ from -1, across sides only.

    Each member of a group so joined is given with one fixed member of the group (a star). One pass over all members' shingles gives a member's intersections with every other one.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(vocabulary), dtype=np.int32)
    labels = np.unique(labels, return_inverse=True)[1]
    before = labels.copy()
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        open_ = (labels[rest] != labels[i]) & (percent * np.maximum(sizes[rest], sizes[i]) <= 100 * np.minimum(sizes[rest], sizes[i]))
        if sides[i] >= 0:
            open_ &= sides[rest] != sides[i]
        if not open_.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat[starts[i + 1] :]], starts[rest] - starts[i + 1])
        mark[own] = 0
        for j in i + 1 + np.flatnonzero(open_ & (100 * common >= percent * (sizes[rest] + sizes[i] - common))):
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
    # One member of each label there was stands for the others, which are joined already.
    _, first = np.unique(before, return_index=True)
    return [(int(ids[group[0]]), int(ids[x])) for label in np.unique(labels[first]) for group in [first[labels[first] == label]] for x in group[1:]]


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs of one block: block (two longs), side, id, label, text."""
    memo, key, rows = WordHashes(), None, []
    part = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links() -> pa.RecordBatch:
        ids, sides, labels, sets = zip(*rows, strict=True)
        found = links_within(np.array(ids), sets, np.array(labels), np.array(sides), percent) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=part)

    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("band", "block", "side", "id", "label")]
        for i, (band, block, side, id_, label) in enumerate(zip(*columns, strict=True)):
            if (band, block) != key:
                if rows:
                    yield links()
                key, rows = (band, block), []
            own = shingle_set(batch.column("text")[i].as_py().encode(), memo)
            if len(own):
                rows.append((id_, side, label, own))
    if rows:
        yield links()


def compare(members: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members: band, block, side, id, label. texts: id, text (one row an id). Returns links a, b."""
    rows = members.join(texts, "id").select("band", "block", "side", "id", "label", "text")
    return rows.repartition("band", "block").sortWithinPartitions("band", "block").mapInArrow(partial(_compare, percent=percent), "a long, b long")


def links_of(sets: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sets: id, n, bands; one row for each distinct set. texts: id and whole text. Returns links a, b that connect what is linked."""
    members = sets.select("id", "n", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("members"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("members > 1")
    buckets = buckets.groupBy("hub", "members", "shingles", "x", "y").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    buckets = materialise(buckets.select("band", "hub", blocks.alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    held = materialise(passing(members.select("band", "id"), "band", buckets, "band").join(buckets, "band").withColumn("block", own))
    texts = passing(texts, "id", held, "id")
    at = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = held.select("band", "id", F.explode(at).alias("block"), F.lit(-1).alias("side"), F.col("id").alias("label"))
    links = materialise(compare(first, texts, percent))
    wide = held.where("blocks > 1")
    if wide.isEmpty():
        return links
    known = components(links)
    wide = wide.join(known.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = wide.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    wide = wide.join(split, "band", "left_semi")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    second = wide.select("band", "id", "label", F.col("block").alias("side"), "blocks", other).where("other <> side")
    pair = F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")
    second = second.select("band", pair.alias("block"), F.col("side").cast("int"), "id", "label")
    return links.unionByName(materialise(compare(second, texts, percent)))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    sketches = materialise(sketch(docs))
    known = sketches.where("doc_id is not null and set_id is not null")
    sets = materialise(known.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min_by("n_shingles", "doc_id").alias("n"), F.min_by("bands", "doc_id").alias("bands")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    # A doc_id that has several texts links their sets.
    several = known.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi").select("doc_id")
    through = known.select("doc_id", "set_id").join(several, "doc_id", "left_semi").join(sets.select("set_id", "id"), "set_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = links_of(sets, texts, percent).unionByName(through)
    classes = components(links).select(F.col("node").alias("id"), F.col("component").alias("component_id"))
    named = sets.select("set_id", "id").join(classes, "id", "left").select("set_id", F.coalesce("component_id", "id").alias("component_id"))
    known = known.join(named, "set_id", "left").select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("doc_id is null or set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are near copies of one with a smaller doc_id."""
    gone = dedup(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
