"""Best-fit packing of token pieces into sequences through a configuration linear program.

A configuration is a multiset of lengths that fits one sequence. The program (cover every length's count with as few
sequences as possible) is solved over the histogram of lengths by multiplicative weights. Each round a knapsack dynamic program prices all open lengths by their
weights; from its table every open length gets a configuration of (nearly) the most worth that holds it, filled up with lengths that still lack cover. All of these are used at once, as
often as none of their lengths is covered beyond its count; weights of what is covered fall, weights of lengths that no best configuration holds rise. The round's
weights over the worth of the best configuration are a solution of the dual, so they tell a lower bound on the sequences.
The uses are rounded down, then up where the counts still allow it, largest part first; what is left goes by best fit, longest
first, into the free ends of the sequences and into new ones, many equal sequences at a time. Best fit alone is held beside it and stands where it needs fewer sequences.

The driver holds the histogram (one count for each length up to the limit) and the plan, both bounded by the limit and not by the rows. Pieces
get their place from their rank within their length, found by running sums over shares.

Where documents have an order (that of a mixture, say), pieces of one length are ranked by it, and the configurations are spread evenly over the numbers of the sequences, so every length's pieces go through the
sequences from first to last in that order. As few sequences are needed as without.

Cases: a null or empty text is one piece that holds only the end id; a longer document is cut at the limit; rows with equal or null ids are packed
each by itself (rows that are the same in every column keep their own places); lengths that tie go in a fixed order; other columns are passed over, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .ranks import SHARE, running_sum

LIMIT, END_ID = 4096, 1
#: Rounds of multiplicative weights, the share of a sequence by which a length's weight may fall (half a token), and draws for each place of a configuration.
ROUNDS, FALL, DRAWS = 140, 0.5 / LIMIT, 12
#: Of the rounds, those at first that only raise weights, for a better bound; covering begins at the tokens' prices again, which most lengths can meet.
DUAL = 8
#: Where documents have an order: no group of equal sequences that stay together is more than this part of all.
EVEN = 1000
#: Words whose ids a Python worker remembers before it starts anew, and words of texts that are looked up together.
MEMO, HELD = 1_200_000, 300_000
#: A letter and stops before white space: the stops are a piece of their own.
#: Where a text holds nothing else (Latin letters, stops that stand alone, white space), the cuts need no pattern.
PLAIN = b"abcdefghijklmnopqrstuvwxyz., \n\xc3" + bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))
STOP = re.compile(rb"([a-z])([.,]+)(?=[ \n])")


class WordIds(dict):
    """Memo from a word to its ids as little-endian unsigned 32-bit numbers; lives as long as the Python worker.

    The vocabulary drops white space before it merges, so a text's ids are its words' ids, one after another. It also lowers case and cuts
    between letters and other signs, so doing both for ASCII beforehand changes nothing and leaves fewer words to learn.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)

    def words(self, text: bytes | None) -> list[bytes]:
        if not text:
            return []
        if b"<|" in text:  # special strings are looked for as they stand
            return text.split()
        text = text.lower()
        if not text.translate(None, PLAIN) and not any(x in text for x in (b"..", b".,", b",.", b",,")):
            return text.replace(b".", b" . ").replace(b",", b" , ").split()
        return STOP.sub(rb"\1 \2", text).split()

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        got = list(map(self.get, words))
        missing, i = [], -1
        with suppress(ValueError):  # no further one
            while True:
                missing.append(i := got.index(None, i + 1))
        if missing:
            self.learn({words[i] for i in missing})
            for i in missing:
                got[i] = self[words[i]]
        return got

    def learn(self, new: set[bytes]) -> None:
        if len(self) + len(new) > MEMO:
            self.clear()
        for w, e in zip(new, self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, dtype="<u4").tobytes()


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(path: str, own: int):
    kinds = [*[pa.int64()] * own, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [*("doc_id", "at")[:own], "piece", "start", "length", "ids_crc32"]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(memo: WordIds, docs: list[tuple], texts: list[list[bytes]]) -> pa.RecordBatch:
        out, got, at = [], memo.ids([w for words in texts for w in words]), 0
        for doc, words in zip(docs, texts, strict=True):
            ids = b"".join(got[at : (at := at + len(words))]) + end
            for piece, start in enumerate(range(0, len(ids), 4 * LIMIT)):
                part = ids[start : start + 4 * LIMIT]
                out.append((*doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, docs, texts, held = word_ids(path), [], [], 0
        for batch in batches:
            for *doc, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1].cast(pa.binary()), strict=True):
                docs.append(doc)
                texts.append(memo.words(text.as_py()))
                held += len(texts[-1])
                if held > HELD:
                    yield cut(memo, docs, texts)
                    docs, texts, held = [], [], 0
        if docs:
            yield cut(memo, docs, texts)

    return run


def pieces(docs: DataFrame, path: str, at: Column | None = None) -> DataFrame:
    """doc_id, at (where given), piece, start, length, ids_crc32 of every document's pieces."""
    own = [F.col("doc_id").cast("long"), *([] if at is None else [at.cast("long").alias("at")])]
    return docs.select(*own, "text").mapInArrow(_pieces(path, len(own)), f"doc_id long, {'' if at is None else 'at long, '}piece int, start long, length long, ids_crc32 long")


def dearest(lengths: np.ndarray, worth: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most worth that fits each capacity, and the length taken first there (0: none that the capacity below does not hold as well)."""
    value = np.full(limit + 1, -np.inf)
    value[lengths] = worth
    best, choice = np.zeros(limit + 1), np.zeros(limit + 1, dtype=np.int64)
    for c in range(1, limit + 1):
        total = value[1 : c + 1] + best[c - 1 :: -1] if c > 1 else value[1:2]
        i = int(total.argmax())
        best[c] = max(total[i], best[c - 1])
        choice[c] = i + 1 if total[i] > best[c - 1] else 0
    return best, choice


def configurations(lengths: np.ndarray, worth: np.ndarray, lack: np.ndarray, best: np.ndarray, choice: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A configuration around each length, as pairs (number of the configuration, place in lengths).

    A free place takes a length drawn by the tokens that lack cover, if the configuration can still come within FALL of the most worth, else what the table says.
    """
    limit, m = len(best) - 1, len(lengths)
    place = np.full(limit + 1, -1)
    place[lengths] = np.arange(m)
    down = np.maximum.accumulate(np.where(choice > 0, np.arange(limit + 1), 0))
    odds = np.cumsum(lack * lengths)
    who, room, had = np.arange(m), limit - lengths, worth.copy()
    numbers, places = [who], [who]
    while len(who):
        drawn = np.searchsorted(odds, rng.random((len(who), DRAWS)) * odds[-1], side="right").clip(max=m - 1)
        rest = room[:, None] - lengths[drawn]
        fine = (rest >= 0) & (had[:, None] + worth[drawn] + best[rest.clip(min=0)] >= best[limit] * (1 - FALL))
        at = down[room]
        took = np.where(fine.any(axis=1), drawn[np.arange(len(who)), fine.argmax(axis=1)], place[choice[at]])
        more = fine.any(axis=1) | (choice[at] > 0)
        who, took = who[more], took[more]
        room, had = room[more] - lengths[took], had[more] + worth[took]
        numbers.append(who)
        places.append(took)
    return np.concatenate(numbers), np.concatenate(places)


def solve(lengths: np.ndarray, counts: np.ndarray, limit: int = LIMIT, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """Configurations, as tuples of (place in lengths, times), with how often the fractional solution uses each, and the dual's lower bound on the sequences.

    Weights begin at length over limit, the prices at which full sequences cost nothing beyond their tokens.
    """
    rng, used, bound = np.random.default_rng(1), {}, 0.0
    lack, price = counts.astype(float), lengths / limit
    trial = price.copy()
    for turn in range(rounds):
        dual = turn < min(DUAL, rounds - 1)
        open_ = np.flatnonzero(lack > 1e-6)
        if lack @ lengths <= 1e-3 * (counts @ lengths):
            break
        size, lacking = lengths[open_], lack[open_]
        # A length's weight falls with its cover, by half a token of a sequence at most, so that what is dearest stays so.
        worth = trial if dual else price[open_] * np.exp(-FALL * (1 - lacking / counts[open_]))
        best, choice = dearest(size, worth, limit)
        if len(open_) == len(lengths):
            bound = max(bound, float(worth @ counts) / best[limit])
        number, item = configurations(size, worth, lacking, best, choice, rng)
        total = np.bincount(number, weights=worth[item], minlength=len(open_))
        good = total >= best[limit] * (1 - 2 * FALL)
        # What no best configuration holds becomes dearer, up to what its own configuration lacks.
        dearer = np.minimum(best[limit] / total, 1.5)
        if dual:
            trial = np.where(good, trial, trial * dearer)
            continue
        price[open_[~good]] *= dearer[~good]
        if not good.any():
            continue
        keep = good[number]
        keys, times = np.unique(number[keep] * len(open_) + item[keep], return_counts=True)
        number, item = keys // len(open_), keys % len(open_)
        own = np.zeros(len(open_))
        own[number[number == item]] = times[number == item]
        use = np.where(good, lacking / np.maximum(own, 1), 0.0)
        for _ in range(2):  # no length beyond its count
            share = lacking / np.maximum(np.bincount(item, weights=use[number] * times, minlength=len(open_)), 1e-300)
            least = np.ones(len(open_))
            np.minimum.at(least, number, np.minimum(share[item], 1.0))
            use *= least
        lack[open_] = np.maximum(lacking - np.bincount(item, weights=use[number] * times, minlength=len(open_)), 0.0)
        edges = np.searchsorted(number, np.arange(len(open_) + 1))
        for c in np.flatnonzero(use > 1e-6):
            key = tuple(zip(open_[item[edges[c] : edges[c + 1]]].tolist(), times[edges[c] : edges[c + 1]].tolist(), strict=True))
            used[key] = used.get(key, 0.0) + float(use[c])
    return used, bound


def rounded(used: dict[tuple, float], counts: np.ndarray, up: bool) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """Whole uses of the configurations and what they leave: rounded down, then, largest part first, up where the counts allow it."""
    left, whole = counts.astype(np.int64).tolist(), {}
    for key, x in used.items():
        if (n := min(int(x + 1e-9), *(left[i] // k for i, k in key))) > 0:
            whole[key] = n
            for i, k in key:
                left[i] -= n * k
    for key in sorted(used, key=lambda key: (int(used[key]) - used[key], key)) if up else ():
        if all(left[i] >= k for i, k in key):
            whole[key] = whole.get(key, 0) + 1
            for i, k in key:
                left[i] -= k
    return [(n, dict(key)) for key, n in whole.items()], np.array(left, dtype=np.int64)


def best_fit(groups: list[tuple[int, dict[int, int]]], lengths: np.ndarray, left: np.ndarray, limit: int = LIMIT) -> list[tuple[int, dict[int, int]]]:
    """Puts what is left, longest first, where it leaves least free; equal sequences are filled together.

    groups: (number of equal sequences, {place in lengths: times}).
    """
    free: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(limit + 1)]
    for number, held in groups:
        free[limit - sum(int(lengths[i]) * n for i, n in held.items())].append((number, held))
    some = np.array([bool(x) for x in free])
    for i in np.argsort(-lengths, kind="stable"):
        size, n = int(lengths[i]), int(left[i])
        while n:
            spot = np.flatnonzero(some[size:])
            room = size + int(spot[0]) if len(spot) else limit
            number, held = free[room].pop() if len(spot) else (n, {})
            some[room] = bool(free[room])
            each = min(room // size, n)
            full = min(number, n // each)
            if number > full:
                free[room].append((number - full, held))
                some[room] = True
            now = held | {int(i): held.get(int(i), 0) + each}
            free[room - each * size].append((full, now))
            some[room - each * size] = True
            n -= full * each
    return [g for x in free for g in x if g[1]]


def spread(packed: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """Cuts large groups of equal sequences and deals their parts evenly, others anywhere, so that any run of sequences has its share of every length."""
    rng, most = np.random.default_rng(2), max(1, sum(number for number, _ in packed) // EVEN)
    parts = []
    for number, held in packed:
        n = -(-number // most)
        sizes = np.diff(np.arange(n + 1) * number // n).tolist()
        parts += [(t, size, held) for t, size in zip(((np.arange(n) + rng.random()) / n).tolist(), sizes, strict=True)]
    return [(size, held) for _, size, held in sorted(parts, key=lambda x: x[0])]


def plan(lengths: np.ndarray, counts: np.ndarray, limit: int = LIMIT, rounds: int = ROUNDS, even: bool = False) -> pd.DataFrame:
    """Where the pieces of each length go: ranks from ``first`` on, ``each`` to a sequence, from ``sequence`` on, at ``place``.

    even: each length's ranks go evenly through all sequences.
    """
    used, _ = solve(lengths, counts, limit, rounds)
    ways = [rounded(used, counts, True), rounded(used, counts, False), ([], counts)]
    packed = min((best_fit(fixed, lengths, left, limit) for fixed, left in ways), key=lambda groups: sum(number for number, _ in groups))
    packed = spread(packed) if even else packed
    rows, rank, sequence = [], np.zeros(len(lengths), dtype=np.int64), 0
    for number, held in packed:
        place = 0
        for i, n in sorted(held.items(), key=lambda x: -lengths[x[0]]):
            rows.append((int(lengths[i]), int(rank[i]), n, sequence, place))
            rank[i] += number * n
            place += int(lengths[i]) * n
        sequence += number
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "place"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, path: str, rounds: int = ROUNDS, at: Column | None = None) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    at: a whole number that tells documents apart and orders them; sequences are then numbered along it (0 first), as far as lengths allow.
    """
    spark = docs.sparkSession
    found = materialise(pieces(docs, path, at).withColumn("one", F.lit(1).cast("long")))
    histogram = found.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toPandas()  # at most LIMIT rows
    table, rows = plan(histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), LIMIT, rounds, at is not None), int(histogram["n"].sum())
    held = spark.sparkContext.broadcast({c: table[c].to_numpy(np.int64) for c in table})  # a few rows for each length and round
    if at is None:
        ranked = running_sum(found, ["length"], ["doc_id", "piece", "ids_crc32"], "one", "rank", rows)
    else:
        # Shares follow one another as the order does; there are no more ranges than shares.
        dealt = materialise(found.repartitionByRange(max(1, -(-rows // SHARE)), "at").withColumn("range", F.spark_partition_id()))
        discard(found)
        ranked = running_sum(dealt, ["length"], ["at", "piece"], "one", "rank", rows, F.col("range"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = held.value
        keys = t["length"] << np.int64(48) | t["first"]
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            at = np.searchsorted(keys, length << np.int64(48) | rank, side="right") - 1
            beyond = rank - t["first"][at]
            yield frame.drop(columns="rank").assign(sequence_id=t["sequence"][at] + beyond // t["each"][at], offset=t["place"][at] + beyond % t["each"][at] * length)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
