"""Document probability under a subword lattice.

Every way to cut a word into pieces of an existing vocabulary counts: the word's probability is the sum, over all segmentations, of the
product of the pieces' probabilities, by the forward recursion in log space. A text's probability is the product over its
words and one end token. The vocabulary is the pieces of a public byte-level tokenizer (a word's first piece carries the mark of its
beginning) and the end; a piece's probability is its share of the pieces that the tokenizer's own cuts give for the training documents' words, smoothed by a half.
These probabilities sum to one over pieces and end, so those of all texts do. Any text has a probability, as every byte is a piece.

The distinct words of all documents are one table, which grows with the corpus: each word's count in training and, by one forward recursion, its score. Words come in
order, and a word takes over the recursion of the letters that it shares with the word before. Words that are frequent enough that there cannot be more than FREQUENT of
them are looked up in the tasks that read the texts; all others are joined by the word itself.

Cases: a null or empty text is one end token; rows with equal or null ids are scored each by itself (the id decides whether a row is held out; a null id is trained on);
without training documents all counts are 0; an empty table gives no rows; a word of any length is scored whole; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import json
import math
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .token_transducer import _bytes_of_alphabet

#: Words counted at least N / FREQUENT times are FREQUENT at most.
FREQUENT = 1_000_000
#: Words that a task counts before it hands the counts on.
HELD = 300_000
#: The end token, which no word equals.
END = b"\n"


def pieces_of(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each piece, a leading space for the beginning of a word, and its number."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    alphabet, added = _bytes_of_alphabet(), {x["content"] for x in said["added_tokens"]}
    out = {}
    for token, number in said["model"]["vocab"].items():
        if token not in added:
            piece = bytes(alphabet[c] for c in token)
            if b" " not in piece[1:]:
                out[piece] = number
    return out


def log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms]))


def endings(log_p: dict[bytes, float]) -> dict[bytes, float]:
    """The pieces' log-probabilities, and minus infinity for what longer pieces end with but no piece is: where a string is not in here, no longer one before its end is a piece."""
    out = {piece[i:]: -math.inf for piece in log_p for i in range(1, len(piece))}
    return out | log_p


def word_scores(words: Iterable[bytes], ends: dict[bytes, float]) -> Iterator[float]:
    """Natural logarithm of each word's probability. The forward probabilities of the letters shared with the word before stay; in sorted order these are most."""
    before, forward, get = b"", [0.0], ends.get
    for word in words:
        text = b" " + word
        n = len(text)
        same = 0
        for x, y in zip(before, text):
            if x != y:
                break
            same += 1
        del forward[same + 1 :]
        for end in range(same + 1, n + 1):
            terms = []
            for start in range(end - 1, -1, -1):
                p = get(text[start:end])
                if p is None:
                    break
                if p != -math.inf:
                    terms.append(forward[start] + p)
            forward.append(log_sum(terms))
        before = text
        yield forward[n]


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, between ASCII white space."""
    return text.lower().split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trained, held_out = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = list(trained | held_out)
        n = np.fromiter((trained[w] for w in words), dtype=np.int64, count=len(words))
        rest = np.fromiter((held_out[w] for w in words), dtype=np.int64, count=len(words))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(n + rest)], names=["word", "n", "total"])

    for batch in batches:
        for text, held in zip(batch.column("text").cast(pa.binary()), batch.column("held_out").to_pylist(), strict=True):
            into = held_out if held else trained
            into.update(tokens(text.as_py()))
            into[END] += 1
            if len(trained) + len(held_out) >= HELD:
                yield out()
                trained.clear()
                held_out.clear()
    yield out()


def word_counts(rows: DataFrame) -> DataFrame:
    """rows: text, held_out. Returns word, n (in training texts) and total of every token, the end token with them."""
    return rows.select("text", "held_out").mapInArrow(_count, "word binary, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _cuts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_file(path)
        library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        library.encode_special_tokens = True
        total = np.zeros(library.get_vocab_size(), dtype=np.float64)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for at in range(0, len(words), 20_000):
                part = [" " + w.decode("utf-8", "replace") for w in words[at : at + 20_000] if w != END]
                weight = [c for w, c in zip(words[at : at + 20_000], n[at : at + 20_000], strict=True) if w != END]
                cut = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
                ids = np.fromiter((i for x in cut for i in x), dtype=np.int64)
                total += np.bincount(ids, weights=np.repeat(weight, [len(x) for x in cut]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["piece", "n"])

    return run


def piece_scores(counts: DataFrame, ends: int, path: str) -> tuple[dict[bytes, float], float]:
    """Natural logarithm of each piece's probability and of the end's; one number a piece of the vocabulary reaches the driver."""
    got = counts.where("n > 0").select("word", "n").mapInArrow(_cuts(path), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    seen = {r.piece: r.n for r in got.collect()}
    vocabulary = pieces_of(path)
    total = sum(seen.values()) + ends + 0.5 * (len(vocabulary) + 1)
    return {piece: math.log((seen.get(number, 0.0) + 0.5) / total) for piece, number in vocabulary.items()}, math.log((ends + 0.5) / total)


def scored_words(counts: DataFrame, ends: dict[bytes, float]) -> DataFrame:
    """Adds log_p to counts: each distinct word of the corpus is scored once. ends holds a few numbers a piece of the vocabulary."""
    held = counts.sparkSession.sparkContext.broadcast(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.fromiter(word_scores(batch.column("word").to_pylist(), held.value), dtype=np.float64, count=len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "log_p"])

    return counts.sortWithinPartitions("word").mapInArrow(run, "word binary, n long, total long, log_p double")


def score(docs: DataFrame, held_out: Column, path: str) -> DataFrame:
    """docs: doc_id, text. held_out: a Column over docs. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialise(word_counts(rows))
    n, v, every = counts.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.sum("total")).first()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    n, v, every = n or 0, v or 0, every or 0
    log_p, log_end = piece_scores(counts.where(F.col("word") != F.lit(END)), ends, path)
    words = materialise(scored_words(counts.where(F.col("word") != F.lit(END)), endings(log_p)))
    floor = max(1, -(-every // FREQUENT))
    often = list(words.where(F.col("total") >= floor).select("word", "n", "log_p").toLocalIterator(prefetchPartitions=True))  # FREQUENT rows at most
    bottom = math.log10(n + 0.5 * (v + 1))
    place = {bytes(r.word): i for i, r in enumerate(often)}
    figures = np.array([(r.n > 0, math.log10(r.n + 0.5) - bottom, r.log_p) for r in often] or np.empty((0, 3)))
    model = spark.sparkContext.broadcast((place, figures))
    end = np.array([ends > 0, math.log10(ends + 0.5) - bottom, log_end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_, figures_ = model.value
        for batch in batches:
            out = []
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                said = tokens(text.as_py())
                at = np.fromiter(map(place_.get, said, repeat(-1)), dtype=np.int64, count=len(said))
                known, base, log_p_ = figures_[at[at >= 0]].sum(axis=0) + end
                rest = Counter(said[i] for i in np.flatnonzero(at < 0))
                out.append((doc_id, held, len(said) + 1, int(known), base, log_p_, list(rest), list(rest.values())))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "known", "base", "log_p", "words", "times"])

    kind = "doc_id long, held_out boolean, n_tokens long, known long, base double, log_p double, words array<binary>, times array<int>"
    read = materialise(rows.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))
    rare = words.where(F.col("total") < floor).select("word", (F.col("n") > 0).alias("seen"), (F.log10(F.col("n") + 0.5) - F.lit(bottom)).alias("b"), F.col("log_p").alias("p"))
    wanted = read.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = wanted.join(rare, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("b")).alias("more_base"), F.sum(F.col("times") * F.col("p")).alias("more"), F.sum(F.when(F.col("seen"), F.col("times")).otherwise(0)).alias("more_known"))
    out = read.drop("words", "times").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), (plus("log_p", "more") / math.log(10)).alias("score"))
