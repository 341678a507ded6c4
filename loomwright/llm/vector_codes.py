"""Compression of vectors to codes: each vector is cut into parts, and a part's code is its nearest entry of the part's codebook, found by Lloyd's rounds with Elkan's bounds.

What a round leaves is written: for each part its entry, an upper bound of the distance to it, and one lower bound of the distance to every entry (a byte each, a share of the row's
largest, rounded down). After the entries move, bounds are shifted by the movement. An entry is passed over only where a bound proves that it is strictly
farther than the present one: its lower bound is above the upper bound, or half the distance between the two entries is. All other distances are worked out in whole numbers, and equal ones
go to the lower index, so the codes are those of the plain rounds. Sums of a round are one partial aggregate a task; the driver holds the codebooks, whose size is a parameter.

Cases: vectors that are null or hold nulls, whose parts are too long for exact sums (a component of 2**26 or more), or that are not as wide as the first one by id are left out; parts are equal where the
width is a multiple of their number, else as equal as can be; of equal ids the smaller vector counts first for the first codebooks, a null id comes last; with fewer vectors than entries there are
fewer entries; repeated rows are coded alike; an empty table gives no rows; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .embedding_dedup import rows_of

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components below this keep every squared distance in whole doubles and every sum in a long.
LARGEST = 2**26
#: Floating-point room: upper bounds are raised, lower bounds lowered by this share.
ROOM = 1e-9

STATE = "vec_id long, label_key string, v array<int>, entry binary, upper binary, most binary, lower binary"


def cuts(width: int, parts: int) -> list[slice]:
    ends = [width * i // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries that stand side by side, exact."""
    d = x.astype(np.int64) - entries
    return (d * d).sum(axis=1)


def from_all(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first assignment: entry, upper bound and lower bounds from every distance."""
    wide = x.astype(np.int64)
    exact = np.float64 if 4 * x.shape[1] * float(max(abs(wide).max(initial=0), abs(book).max(initial=0), 1)) ** 2 < 2.0**52 else np.int64
    a, b = wide.astype(exact), book.astype(exact)
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    entry = d2.argmin(axis=1)  # the first of equals
    lower = np.sqrt(d2.astype(float))
    return entry, lower[np.arange(len(x)), entry] * (1 + ROOM), lower * (1 - ROOM)


class Book:
    """A part's codebook with what Elkan's tests need: half the distances between entries, and for each entry half the way to the nearest other."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        self.entries, self.moved = entries, moved * (1 + ROOM)
        gaps = np.sqrt(((entries[:, None, :].astype(float) - entries[None, :, :]) ** 2).sum(axis=2))
        self.half = gaps / 2 * (1 - ROOM)
        others = self.half + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
        self.near = others.min(axis=1)


def reassign(x: np.ndarray, book: Book, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Shifts the bounds by the entries' movement and mends entry, upper and lower in place; returns how many distances were worked out."""
    upper += book.moved[entry]
    lower -= book.moved
    np.maximum(lower, 0, out=lower)
    open_ = np.flatnonzero(upper >= book.near[entry])  # the others are strictly nearer to their entry than to any
    if not len(open_):
        return 0
    # Only where some entry is still open is the distance to the present one worked out.
    some = (upper[open_, None] >= lower[open_]) & (upper[open_, None] >= book.half[entry[open_]])
    some[np.arange(len(open_)), entry[open_]] = False
    open_ = open_[some.any(axis=1)]
    if not len(open_):
        return 0
    d2 = distances(x[open_], book.entries[entry[open_]])
    done = len(open_)
    now = np.sqrt(d2.astype(float))
    upper[open_] = now * (1 + ROOM)
    lower[open_, entry[open_]] = now * (1 - ROOM)
    for j in range(len(book.entries)):
        at = entry[open_]
        asks = np.flatnonzero((at != j) & (upper[open_] >= lower[open_, j]) & (upper[open_] >= book.half[at, j]))
        if not len(asks):
            continue
        rows = open_[asks]
        to = distances(x[rows], book.entries[j])
        done += len(rows)
        far = np.sqrt(to.astype(float))
        lower[rows, j] = far * (1 - ROOM)
        nearer = (to < d2[asks]) | ((to == d2[asks]) & (j < entry[rows]))
        won = asks[nearer]
        d2[won], entry[open_[won]], upper[open_[won]] = to[nearer], j, far[nearer] * (1 + ROOM)
    return done


def packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes, rounded down, with each row's largest."""
    most = lower.max(axis=1, initial=0).astype(np.float32)
    most = np.nextafter(most, np.float32(0))
    share = lower / np.maximum(most[:, None].astype(float), 1e-30)
    return np.clip(np.floor(share * 255 * (1 - 1e-6)), 0, 255).astype(np.uint8), most


def unpacked(codes: np.ndarray, most: np.ndarray) -> np.ndarray:
    return codes.astype(float) * (most[:, None].astype(float) / 255)


def _binary(values: np.ndarray) -> pa.Array:
    """One binary a row of a matrix of bytes."""
    data = np.ascontiguousarray(values)
    width = data.shape[1] * data.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width).copy()


def _round(books: list[np.ndarray], moved: list[np.ndarray] | None):
    """One assignment of all parts: from every distance where nothing has moved yet, else from the state's bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Book(b, m) for b, m in zip(books, moved, strict=True)] if moved else []
        n_parts, k = len(books), len(books[0])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.array(rows_of(batch.column("v"))).reshape(n, -1)
            where = cuts(x.shape[1], n_parts)
            entry = np.zeros((n, n_parts), dtype=np.uint16)
            upper, most, lower = np.zeros((n, n_parts)), np.zeros((n, n_parts), dtype=np.float32), np.zeros((n, n_parts * k), dtype=np.uint8)
            if moved:
                entry, upper = _matrix(batch.column("entry"), np.uint16, n_parts), _matrix(batch.column("upper"), np.float64, n_parts)
                most, lower = _matrix(batch.column("most"), np.float32, n_parts), _matrix(batch.column("lower"), np.uint8, n_parts * k)
            for p, s in enumerate(where):
                own = slice(p * k, p * k + k)
                if moved:
                    e, u, low = entry[:, p].astype(np.int64), upper[:, p].copy(), unpacked(lower[:, own], most[:, p])
                    reassign(x[:, s], known[p], e, u, low)
                else:
                    e, u, low = from_all(x[:, s], books[p])
                entry[:, p], upper[:, p] = e, u
                lower[:, own], most[:, p] = packed(low)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), batch.column("v"), _binary(entry), _binary(upper), _binary(most), _binary(lower)], names=["vec_id", "label_key", "v", "entry", "upper", "most", "lower"])

    return run


def _sums(n_parts: int, k: int, width: int):
    """What a task's parts add up to, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k * n_parts, width), dtype=np.int64), np.zeros(k * n_parts, dtype=np.int64)
        where = cuts(width, n_parts)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(rows_of(batch.column("v"))).reshape(batch.num_rows, -1).astype(np.int64)
            entry = _matrix(batch.column("entry"), np.uint16, n_parts).astype(np.int64)
            for p, s in enumerate(where):
                at = entry[:, p] + p * k
                np.add.at(total[:, s], at, x[:, s])
                np.add.at(count, at, 1)
        some = np.flatnonzero(count)
        lists = [total[i, where[i // k]].tolist() for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(lists, pa.list_(pa.int64()))], names=["slot", "n", "total"])

    return run


def _coded(books: list[np.ndarray]):
    """The codes and errors of assigned rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(rows_of(batch.column("v"))).reshape(batch.num_rows, -1)
            entry = _matrix(batch.column("entry"), np.uint16, len(books)).astype(np.int64)
            error = sum(distances(x[:, s], books[p][entry[:, p]]) for p, s in enumerate(cuts(x.shape[1], len(books))))
            codes = ["".join(f"{j:02x}" for j in row) for row in entry.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), pa.array(codes), pa.array(error)], names=["vec_id", "label_key", "code", "error"])

    return run


def trained(rows: DataFrame, n_parts: int = PARTS, k: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The assigned rows after ``rounds`` of Lloyd, and each part's codebook (entries x components). rows: vec_id, label_key, v of one width."""
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(k).select("v").collect()]  # k rows at most
    x = np.array(first, dtype=np.int64)
    where = cuts(x.shape[1], n_parts)
    books = [x[:, s].copy() for s in where]
    state = materialise(rows.mapInArrow(_round(books, None), STATE))
    for _ in range(rounds):
        # One row a part and entry from each task, and as many at the driver.
        sums = state.select("v", "entry").mapInArrow(_sums(n_parts, len(first), x.shape[1]), "slot int, n long, total array<long>")
        moved_books = [b.copy() for b in books]
        for r in sums.select("slot", "n", F.posexplode("total").alias("at", "x")).groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            moved_books[r["slot"] // len(first)][r["slot"] % len(first), r["at"]] = r["x"] // r["n"]
        moved = [np.sqrt(((a - b).astype(float) ** 2).sum(axis=1)) for a, b in zip(moved_books, books, strict=True)]
        books = moved_books
        after = materialise(state.mapInArrow(_round(books, moved), STATE))
        discard(state)
        state = after
    return state, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()


#: Labels whose sums are broadcast; more are joined by label, dealt over shares of a label.
BROADCAST, SHARES = 200_000, 64


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "v", label_col: str = "label", n_parts: int = PARTS, k: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Returns vec_id, code (two hex digits a part), error, label_error, codebooks_sha256. vector_col: arrays of ints; k: 256 at most."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label_key"), F.col(vector_col).cast("array<int>").alias("v"))
    rows = rows.where(F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("long")) < LARGEST)), F.lit(False)))
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    out = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if least is None:
        return vectors.sparkSession.createDataFrame([], out)
    state, books = trained(rows.where(F.size("v") == least["n"]), n_parts, k, rounds)
    coded = materialise(state.mapInArrow(_coded(books), "vec_id long, label_key string, code string, error long"))
    discard(state)
    sums = materialise(coded.groupBy("label_key").agg(F.sum("error").alias("label_error")))
    key = F.coalesce(F.concat(F.lit("="), "label_key"), F.lit(""))  # nulls are one label
    if sums.count() <= BROADCAST:
        joined = coded.withColumn("key", key).join(F.broadcast(sums.select(key.alias("key"), "label_error")), "key")
    else:
        share = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SHARES)).cast("int")
        spread = sums.select(key.alias("key"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
        joined = coded.withColumn("key", key).withColumn("share", share).join(spread, ["key", "share"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
