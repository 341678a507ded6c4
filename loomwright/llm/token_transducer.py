"""Token counts by finite-state transducers.

Two machines stand for the byte-level BPE tokenizer. The first splits text into pieces: its states are character
classes, and a transition says whether a piece begins at the character just read or at the one before. A batch of texts is cut into chunks;
each chunk gives a map from every state it may be entered in to the state it is left in, the maps are composed by a parallel
prefix scan, and with every chunk's entry state known one more pass marks the pieces. The second reads the bytes of a piece. Its state is, for each
suffix that may still grow into a token, that suffix's length, the token before it and how many tokens the text is
ahead of there; a transition carries the change in the number of tokens. States are made when first reached; there are
finitely many, as suffixes are no longer than the longest token.

Cases: null texts count as empty (0 bytes, 0 tokens); special strings in a text count as the library counts them by default (one token);
rows with equal or null ids are counted each by itself; other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose counts, and states that a task remembers before it starts anew.
MEMO, STATES = 300_000, 150_000
CHUNK = 256

# Character classes: end of text, space, other white space, letter, number, apostrophe, anything else, and letters of contractions.
END, SPACE, WHITE, LETTER, NUMBER, QUOTE, OTHER = range(7)


def _bytes_of_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The transducer of one piece. Tokens are numbered by rank: the 256 bytes, then the merges in their order."""

    def __init__(self, model: dict) -> None:
        alphabet = _bytes_of_alphabet()
        coded = lambda token: bytes(alphabet[c] for c in token)
        number = {bytes([b]): b for b in range(256)}
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int] | None] = [None] * 256
        for merge in model["merges"]:
            left, right = (coded(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = number.setdefault(left + right, len(self.split))
            if whole == len(self.split):
                self.split.append((number[left], number[right]))
            self.pairs.setdefault((number[left], number[right]), whole)
        # The trie of all tokens: a node for each prefix, its token if it is one.
        self.child: dict[int, int] = {}
        self.token = [-1]
        for token, t in number.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = t
        self.agreed: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the first state, (trie node, token before, tokens ahead of there): one for each suffix, the empty one last."""
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.keys: list[tuple] = [((0, -1, 0),)]
        self.next: dict[int, tuple[int, int]] = {}

    def stands(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their bytes are merged together.

        Both tokens are taken apart, latest merge first; a pair across the cut that merges before either side is made would have joined them.
        """
        known = self.agreed.get((left, right))
        if known is None:
            a, b, bound = left, right, len(self.split)
            known = True
            while known:
                joint = self.pairs.get((a, b))
                if joint is not None and joint < bound:
                    known = False
                elif a < 256 and b < 256:
                    break
                elif a > b:
                    bound, a = a, self.split[a][1]
                else:
                    bound, b = b + 1, self.split[b][0]
            self.agreed[left, right] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change in the number of tokens."""
        grown, last, change = [], -1, 0
        for node, before, ahead in self.keys[state]:
            new = self.child.get(node << 8 | byte)
            if new is None:
                continue
            grown.append((new, before, ahead))
            token = self.token[new]
            if token >= 0 and last < 0 and (before < 0 or self.stands(before, token)):
                last, change = token, 1 - ahead
        key = (*((n, b, ahead + change) for n, b, ahead in grown), (0, last, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append(key)
        return to, change

    def count(self, piece: bytes) -> int:
        if len(self.keys) > STATES:
            self.forget()
        state = total = 0
        for b in piece:
            key = state << 8 | b
            move = self.next.get(key)
            if move is None:
                move = self.next[key] = self.step(state, b)
            state = move[0]
            total += move[1]
        return total


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # White_Space of Unicode, as fixed values.
    out[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    out[32], out[39] = SPACE, QUOTE
    return out


#: What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first machine: symbol of each ASCII character beyond its class, transitions, and marks.

    Marks: 1, a piece begins at the character just read; 2, one begins at the character before it.
    """
    letters = sorted(set("".join(CONTRACTIONS)))
    symbol = np.zeros(128, dtype=np.uint8)
    for i, x in enumerate(letters):
        symbol[ord(x)] = 7 + i
    width = 7 + len(letters)
    names = ["start", "space", "white", "letter", "number", "other", "quote", "r", "v", "l", "done", "space_first", "white_first"]
    at = {x: i for i, x in enumerate(names)}
    to, marks = np.zeros((len(names), width), dtype=np.uint8), np.zeros((len(names), width), dtype=np.uint8)
    for name, state in at.items():
        for s in range(width):
            kind = s if s < 7 else LETTER
            letter = letters[s - 7] if s >= 7 else ""
            mark = 1
            if kind == END:
                go, mark = "start", 1
            elif kind in (SPACE, WHITE):
                inside = name in ("space", "white", "space_first", "white_first")
                go = ("space" if kind == SPACE else "white") + ("" if inside else "_first")
                mark = 0 if inside else 1
            else:
                body = {LETTER: "letter", NUMBER: "number", QUOTE: "other", OTHER: "other"}[kind]
                go = body
                if name == "space":
                    mark = 2  # the last of several spaces goes with what follows
                elif name == "space_first":
                    mark = 0
                elif name == "white":
                    mark = 3  # the last of several white characters stands alone
                elif name == "letter" and kind == LETTER or name == "number" and kind == NUMBER or name == "other" and body == "other":
                    mark = 0
                elif name == "quote":
                    if letter in ("s", "t", "m", "d") and letter:
                        go, mark = "done", 0
                    elif letter in ("r", "v", "l") and letter:
                        go, mark = letter, 0  # whether it is a contraction shows at the next character
                    elif body == "other":
                        mark = 0
                elif name in ("r", "v", "l"):
                    if letter == {"r": "e", "v": "e", "l": "l"}[name]:
                        go, mark = "done", 0
                    elif kind == LETTER:
                        mark = 2
                    else:
                        mark = 3
                if kind == QUOTE and mark & 1 and name not in ("space", "space_first"):
                    go = "quote"
            if name in ("r", "v", "l") and kind in (END, SPACE, WHITE):
                mark = 3
            to[state, s], marks[state, s] = at[go], mark
    return symbol, to, marks


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Where pieces begin in a run of texts, given as classes, each closed by END. Chunks are read side by side."""
    _, to, marks = splitter()
    n, states = len(symbols), len(to)
    chunks = -(-n // CHUNK)
    grid = np.zeros(chunks * CHUNK, dtype=np.uint8)
    grid[:n] = symbols
    grid = grid.reshape(chunks, CHUNK).T.copy()
    # 1: the map of each chunk, from every state at once.
    now = np.tile(np.arange(states, dtype=np.uint8), (chunks, 1))
    for column in grid:
        now = to[now, column[:, None]]
    # 2: prefix scan; after step d a map covers the 2d chunks up to its own.
    d = 1
    while d < chunks:
        now[d:] = np.take_along_axis(now[d:], now[:-d].copy(), axis=1)
        d *= 2
    entry = np.zeros(chunks, dtype=np.uint8)
    entry[1:] = now[:-1, 0]
    # 3: with the entry states known, the marks.
    out = np.empty_like(grid)
    for i, column in enumerate(grid):
        out[i] = marks[entry, column]
        entry = to[entry, column]
    flat = out.T.reshape(-1)[:n]
    starts = (flat & 1).astype(bool)
    starts[:-1] |= (flat[1:] & 2).astype(bool)
    return np.flatnonzero(starts)


@cache
def tokenizer(path: str) -> tuple[Bpe, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    return Bpe(said["model"]), tuple(x["content"] for x in said["added_tokens"])


class Counter:
    """Token counts of texts, batch by batch."""

    def __init__(self, path: str) -> None:
        self.bpe, self.special = tokenizer(path)
        self.memo: dict[str, int] = {}

    def plain(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = classes()[codes]
        more = splitter()[0]
        low = codes < 128
        extra = more[codes[low]]
        symbols[low] = np.where(extra > 0, extra, symbols[low])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        symbols[ends] = END
        starts = piece_starts(symbols)
        bounds = [*starts.tolist(), len(codes)]
        memo, count = self.memo, self.bpe.count
        counts = np.zeros(len(starts), dtype=np.int64)
        is_end = symbols[starts] == END
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            piece = joined[a:b]
            c = memo.get(piece)
            if c is None:
                if len(memo) >= MEMO:
                    memo.clear()
                c = memo[piece] = count(piece.encode("utf-8", "surrogatepass"))
            out.append(c)
        counts[:] = out
        counts[is_end] = 0
        total = np.concatenate([[0], np.cumsum(counts)])
        upto = total[np.searchsorted(starts, ends, side="left")]
        return np.diff(np.concatenate([[0], upto])).tolist()

    def __call__(self, texts: list[str]) -> list[int]:
        if not any(s in t for t in texts for s in self.special):
            return self.plain(texts)
        parts, owner, extra = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            held = [text]
            for s in self.special:
                extra[i] += sum(h.count(s) for h in held)
                held = [y for h in held for y in h.split(s)]
            parts += held
            owner += [i] * len(held)
        for i, c in zip(owner, self.plain(parts), strict=True):
            extra[i] += c
        return extra


def token_counts(docs: DataFrame, path: str, chars: int = 1_000_000) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, n_tokens.

    path: a byte-level BPE file, the same on every machine. chars: text that the first machine reads at once (or one whole text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            counts: list[int] = []
            held: list[str] = []
            for t in batch.column("text").to_pylist():
                held.append(t or "")
                if sum(map(len, held[-64:])) >= chars or len(held) >= 256:
                    counts += counter(held)
                    held = []
            counts += counter(held)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
