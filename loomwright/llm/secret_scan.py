"""Secret scans: three fixed patterns, and the entropy of sliding windows over long unbroken strings.

A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_=-]``. Its character class sets the entropy that a
window of 20 characters must reach. The counts of a window's characters are carried along: a step takes one off for the character that
leaves, adds one for the character that enters, and changes the entropy's sum by just these. What a fixed pattern covers is cut out of a candidate, and so is
each token between ``/ + =`` that holds an allowed word (a word joined by ``-`` or ``_`` belongs to its token); what is left on each
side is scored as a candidate of its own, unless it is allowed as a whole.

Cases: null or empty texts have no spans; places are code points, ends exclusive; overlapping spans of different
kinds all stay; repeated rows and ties are scanned alike, each row by itself; an empty table gives no rows; other columns stay, whatever their names.
Every step is a DataFrame expression inside one row: no shuffle, and no Python runs on executors. Time grows about as a text's length, however many spans it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, between, chars_of, let, text_of, unused

# Fixed patterns: keyword assignments, access keys, long hexadecimal runs. Letters of the keywords in either case.
KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Bits that a window of each class must reach: hexadecimal, one case with digits, both cases with digits.
BITS = {"hex": 3.2, "one_case": 3.4, "mixed": 3.7}
#: Runs that look random but are no secrets: one pattern for a whole run, the others for words of a token.
ALLOW_PATTERNS = ("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "(?i)example|sample|placeholder|dummy|changeme", "(?i)abcdefghij|0123456789|qwertyuiop")
ALLOWED_RUN, ALLOWED_WORDS = ALLOW_PATTERNS[0], "|".join(ALLOW_PATTERNS[1:])
#: What separates the tokens of a run.
SEPARATOR = "[/+=]"
#: What stands in a text for a secret that was taken out.
MASK = "[SECRET]"

SPAN = "array<struct<start:int,kind:int,end:int,inner:int>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Spans of all matches, leftmost first, with the matched text and the length of the given group (inner): what stands between the matches gives their places."""

    def place(gaps: Column, found: Column, parts: Column) -> Column:
        gap = lambda i: F.length(F.get(gaps, i))
        span = lambda w, i, at: F.struct((at + gap(i)).alias("start"), (at + gap(i) + F.length(w)).alias("end"), F.length(F.get(parts, i)).alias("inner"), w.alias("whole"))
        return let(before(F.transform(found, lambda w, i: gap(i) + F.length(w))), lambda at: F.transform(found, lambda w, i: span(w, i, F.get(at, i))))

    every = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    return let(F.split(text, pattern, -1), lambda gaps: let(every(0), lambda found: place(gaps, found, found) if group == 0 else let(every(group), lambda parts: place(gaps, found, parts))))


def kind_spans(text: Column, kind: int, guard: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Spans of one kind as structs that sort by start, then kind; the guard spares most texts the full search."""
    spans = F.filter(located(text, pattern, group), lambda s: s["inner"] >= least)
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["inner"].alias("inner")))
    return F.when(guard, spans).otherwise(F.array().cast(SPAN))


#: Characters of candidates; twelve counts of five bits go into one number.
ALPHABET, PACKED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 12


def window_entropy(run: Column, bits: Column) -> Column:
    """First and last place (from 0, end exclusive) of windows in run that reach bits; nulls without such a window.

    With S the sum of c * log2(c) over the counts c in a window, its entropy is log2(W) - S / W. The state holds the counts of all characters, packed, and S.
    """
    limit = WINDOW * (math.log2(WINDOW) - bits) + 1e-9
    weights = F.array(*(F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(WINDOW + 2)))
    ones = F.array(*(F.lit(1 << 5 * i).cast("long") for i in range(PACKED)))
    place = lambda code: F.floor(code / PACKED).cast("int")
    count = lambda a, code: F.call_function("shiftright", F.get(a["counts"], place(code)), code % PACKED * 5).bitwiseAND(F.lit(31)).cast("int")
    weight = lambda c: F.get(weights, c)
    state = lambda counts, s, lo, hi: F.struct(counts.alias("counts"), s.alias("s"), lo.alias("lo"), hi.alias("hi"))

    def changed(a: Column, code: Column, by: int) -> Column:
        counts = F.transform(a["counts"], lambda x, j: F.when(j == place(code), x + by * F.get(ones, code % PACKED)).otherwise(x))
        return let(count(a, code), lambda c: state(counts, a["s"] - weight(c) + weight(c + by), a["lo"], a["hi"]))

    def judged(a: Column, i: Column) -> Column:
        hot = (i >= WINDOW - 1) & (a["s"] <= limit)
        return state(a["counts"], a["s"], F.coalesce(a["lo"], F.when(hot, i - WINDOW + 1)), F.when(hot, i + 1).otherwise(a["hi"]))

    def pass_over(codes: Column) -> Column:
        none = F.lit(None).cast("int")
        start = state(F.array(*(F.lit(0).cast("long") for _ in range(-(-len(ALPHABET) // PACKED)))), F.lit(0.0), none, none)

        def step(a: Column, i: Column) -> Column:
            left = F.when(i >= WINDOW, changed(a, F.get(codes, i - WINDOW), -1)).otherwise(a)
            return let(left, lambda b: let(changed(b, F.get(codes, i), 1), lambda c: judged(c, i)))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))

    return let(F.transform(chars_of(run), lambda c: F.instr(F.lit(ALPHABET), c) - 1), pass_over)


PART = "array<struct<start:int,end:int,whole:string>>"


def without_allowed(s: Column) -> Column:
    """Parts of a candidate between its tokens that hold an allowed word."""
    run = s["whole"]

    def part(start: Column, end: Column) -> Column:  # an array of one, or of none where it is shorter than a window
        one = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(run, start - s["start"] + 1, end - start).alias("whole"))
        return F.when(end - start >= WINDOW, F.array(one)).otherwise(F.array().cast(PART))

    begin = F.struct(s["start"].alias("at"), s["start"].alias("start"), F.array().cast(PART).alias("out"))

    def step(a: Column, token: Column) -> Column:  # from the token at a.at to the next; a part ends before the separator
        after, allowed = a["at"] + F.length(token) + 1, token.rlike(ALLOWED_WORDS)
        return F.struct(after.alias("at"), F.when(allowed, after).otherwise(a["start"]).alias("start"), F.when(allowed, F.concat(a["out"], part(a["start"], a["at"] - 1))).otherwise(a["out"]).alias("out"))

    cut = F.aggregate(F.split(run, SEPARATOR, -1), begin, step, lambda a: F.concat(a["out"], part(a["start"], s["end"])))
    return F.when(run.rlike(ALLOWED_WORDS), cut).otherwise(part(s["start"], s["end"]))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spans (sorted by start) turned into blanks, code point by code point."""
    reach = before(F.transform(spans, lambda s: s["end"]), F.greatest)

    def cut(chars: Column, to: Column) -> Column:
        blank = lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))
        kept = F.transform(spans, lambda s, i: F.concat(between(chars, F.get(to, i), s["start"]), blank(s, F.get(to, i))))
        return F.concat(F.array_join(kept, ""), between(chars, F.array_max(F.transform(spans, lambda s: s["end"])), F.size(chars)))

    return F.when(F.size(spans) > 0, let(chars_of(text), lambda chars: let(reach, lambda to: cut(chars, to)))).otherwise(text)


def judged(s: Column, allow: tuple[str, ...]) -> Column:
    """The span of windows that reach the entropy of their class, as a struct; its start is null without one."""
    run = s["whole"]
    allowed = (run.isin(*allow) if allow else F.lit(False)) | run.rlike(ALLOWED_RUN)
    digit, low, up = run.rlike("[0-9]"), run.rlike("[a-z]"), run.rlike("[A-Z]")
    bits = F.when(~digit | ~(low | up), F.lit(None)).when(run.rlike("^[0-9a-fA-F]+$"), BITS["hex"]).when(low & up, BITS["mixed"]).otherwise(BITS["one_case"])
    hot = let(bits, lambda b: F.when(b.isNotNull() & ~allowed, window_entropy(run, b)))
    return let(hot, lambda h: F.struct((s["start"] + h["lo"]).alias("start"), F.lit(3).alias("kind"), (s["start"] + h["hi"]).alias("end"), F.lit(0).alias("inner")))


def scan(docs: DataFrame, allow: tuple[str, ...] = (), name: str = "__secrets") -> DataFrame:
    """Adds the spans (start, kind as a place in KINDS, end, inner) of each row's text, sorted, under the given name; a column that has it already gives way.

    allow: strings that are no secrets. Each step is a column of its own, analysed by itself, so that no expression nests deep.
    """
    text, docs = text_of(), docs.drop(name)
    base, taken, blank, runs, free = unused(docs.withColumn(name, F.lit(0)), "__base", "__taken", "__blank", "__runs", "__free")
    found = F.concat(
        kind_spans(text, 0, text.rlike(KEYWORDS), ASSIGN, 1, 6),
        kind_spans(text, 1, F.contains(text, F.lit("AKIA")), ACCESS),
        kind_spans(text, 2, text.rlike(HEX), HEX),
    )
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    covered = F.transform(base, place)
    if allow:  # whole runs that are no secrets
        covered = F.sort_array(F.concat(covered, F.transform(F.filter(located(text, CANDIDATE), lambda s: s["whole"].isin(*allow)), place)))
    out = docs.withColumn(base, F.sort_array(found)).withColumn(taken, F.when(text.rlike(CANDIDATE), covered))  # null: no candidate
    out = out.withColumn(blank, F.when(F.col(taken).isNotNull(), blanked(text, F.col(taken)))).withColumn(runs, located(F.col(blank), CANDIDATE))
    out = out.withColumn(free, F.flatten(F.transform(runs, without_allowed)))
    hot = F.filter(F.transform(free, lambda s: judged(s, allow)), lambda s: s["start"].isNotNull())
    return out.withColumn(name, F.sort_array(F.concat(base, F.coalesce(hot, F.array().cast(SPAN))))).drop(base, taken, blank, runs, free)


def joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """The documents with every found span replaced by MASK (spans that overlap or touch, by one), n_chars set anew where that changed a text."""
    text = F.col("text")

    def cut(spans: Column) -> Column:
        def pieces(chars: Column, to: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                at = F.get(to, i)
                return F.when((s["start"] > at) | (i == 0), F.concat(between(chars, at, s["start"]), F.lit(MASK))).otherwise(F.lit(""))

            return F.concat(F.array_join(F.transform(spans, piece), ""), between(chars, F.array_max(F.transform(spans, lambda s: s["end"])), F.size(chars)))

        return let(chars_of(text), lambda chars: let(before(F.transform(spans, lambda s: s["end"]), F.greatest), lambda to: pieces(chars, to)))

    (name,) = unused(docs, "__secrets")
    found = scan(docs, allow, name)
    hit = F.size(name) > 0
    out = found.withColumn("text", F.when(hit, cut(F.col(name))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
