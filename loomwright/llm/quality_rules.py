"""Quality rules with risk-controlled cutoffs.

A rule rejects a document whose feature exceeds its cutoff. A setting gives some of the rules a cutoff each, from one of five levels. In each
stratum, labelled holdout documents prove a setting by the exact binomial tail, with Bonferroni's correction over all strata and settings: of the good documents that
pass the base rule, all rules of the setting together reject at most ``risk``. Of the proven settings the one acts that rejects most
labelled bad documents (of equals, the strictest); as all settings are tested, the choice among them costs no validity. A stratum without a proven setting rejects nothing beyond the base rule.

Cases: null or empty texts have no words and fail the base rule; a null stratum is a stratum of its own (with the empty one);
labels that are null are left out, a document labelled twice counts once and as good if any label is good;
of several rows under one labelled doc_id the one with the least features (compared in their order) counts for the proof, so the outcome does not depend on the order of rows;
without labels only the base rule acts; repeated rows are judged alike; an empty table gives no rows; columns beyond the ones named are
passed over, whatever their names. Everything is DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, text_of, unused, words_of

SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
#: rule -> its cutoff at each level, strictest first.
LEVELS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.1, 0.2, 0.3, 0.5, 1.0),
    "dup_line_share": (0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.2, 0.25, 0.3, 0.4, 0.5),
    "upper_share": (0.2, 0.3, 0.4, 0.5, 0.7),
}
#: Every level with every choice of rules, the strictest first.
SETTINGS: tuple[tuple[int, tuple[str, ...]], ...] = tuple((level, some) for level in range(5) for size in range(len(LEVELS), 0, -1) for some in combinations(LEVELS, size))
#: Largest share of a stratum's good documents that the rules may reject, and the chance that any such claim is wrong.
RISK, DELTA = 0.01, 0.05


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows' 64-bit hashes are sorted with their places, so equal windows stand side by side: n log n for any text.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

        def spread(places: Column) -> Column:
            steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(placed, again), spread)

    def windows(h: Column) -> Column:
        all_of = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return F.slice(all_of, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    once = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    return let(let(hashed, windows), lambda w: F.when(once(w), F.lit(0).cast("long")).otherwise(covered(w)))


def features(docs: DataFrame, stratum: str = "lang", name: str = "__quality") -> DataFrame:
    """Adds one struct column of the given name to docs, in place of one that has it already; every other column stays."""
    text = text_of()

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        letters = F.length(F.array_join(words, ""))
        return F.struct(
            F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), n.alias("n_words"), letters.cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeat_words(words).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
        )

    return docs.withColumn(name, let(words_of(text), of))


def rule_values(q: Column) -> dict[str, Column]:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_share": share(q["n_symbols"], q["n_words"]), "dup_line_share": share(q["lines"]["dup"], q["lines"]["n"]),
        "repeat_share": share(q["n_repeat_words"], q["n_words"]), "upper_share": share(q["n_upper"], q["word_chars"]),
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by eight; x >= 1."""
    z = x + 8.0
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    tail = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), for k up to the mean; 1 beyond it and for n = 0.

    The terms fall off from k downwards; 40 standard deviations below it they no longer count.
    """
    kd, nd, q = k.cast("double"), n.cast("double"), 1 - p
    first = F.exp(_log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log(q))
    steps = F.least(k, (40 * F.sqrt(nd * p * q) + 40).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (kd - j + 1) / (nd - kd + j) * (q / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>")), start, step)["sum"]
    return F.when((n > 0) & (kd <= nd * p), first * total).otherwise(F.lit(1.0))


def calibrate(judged: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, doc_id: str = "doc_id", name: str = "__quality") -> DataFrame:
    """One row a stratum with a proven setting: the cutoff of each rule, null where it is off.

    judged: doc_id and the features, of the labelled documents at least. labels: doc_id, quality (1 good). Counts are one aggregation: what moves is a row a
    stratum, setting and task.
    """
    said = labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.max("quality") == 1).alias("good"))
    one_each = judged.select(F.col(doc_id).alias("id"), F.col(name).alias("q")).join(said, "id").groupBy("id").agg(F.min("q").alias("q"), F.first("good").alias("good"))
    q = F.col("q")
    # How many of a rule's cutoffs a value exceeds; equal profiles are counted together before they meet the settings.
    beyond = {rule: sum(((value > c).cast("int") for c in LEVELS[rule]), F.lit(0)) for rule, value in rule_values(q).items()}
    profiles = one_each.where(~base_failed(q)).groupBy(q["stratum"].alias("stratum"), "good", *(v.alias(rule) for rule, v in beyond.items())).agg(F.count("*").alias("docs"))
    settings = F.array(*(F.struct(*(F.lit(level if rule in some else None).cast("int").alias(rule) for rule in LEVELS)) for level, some in SETTINGS))
    hit = lambda s: F.coalesce(*(F.when(F.col(rule) > s[rule], True) for rule in LEVELS), F.lit(False))
    tried = profiles.select("stratum", "good", "docs", F.posexplode(F.transform(settings, hit)).alias("setting", "hit"))
    total = lambda test, as_: F.sum(F.when(test, F.col("docs")).otherwise(0)).alias(as_)
    counts = materialise(tried.groupBy("stratum", "setting").agg(total(F.col("good"), "n"), total(F.col("good") & F.col("hit"), "k"), total(~F.col("good") & F.col("hit"), "bad")))
    tests = counts.where("n > 0").count()  # one for each setting of each stratum
    proven = counts.where(binomial_tail(F.col("k"), F.col("n"), risk) * tests <= delta)
    best = proven.groupBy("stratum").agg(F.max_by("setting", F.struct("bad", -F.col("setting"))).alias("setting"))
    chosen = F.get(settings, F.col("setting"))
    return best.select("stratum", *(F.get(F.array(*map(F.lit, LEVELS[rule])), chosen[rule]).alias(rule) for rule in LEVELS))


def decide(judged: DataFrame, cutoffs: DataFrame, name: str = "__quality", kept: str = "__kept") -> DataFrame:
    """Adds the verdict under the name ``kept`` to rows with features."""
    q = F.col(name)
    stratum, cut = unused(judged, "__stratum", "__cut")
    named = cutoffs.select(F.col("stratum").alias(stratum), F.struct(*LEVELS).alias(cut))
    rejected = F.lit(False)
    for rule, value in rule_values(q).items():
        rejected = rejected | F.coalesce(value > F.col(cut)[rule], F.lit(False))
    joined = judged.withColumn(stratum, q["stratum"]).join(named, stratum, "left")
    return joined.withColumn(kept, ~(base_failed(q) | rejected)).drop(stratum, cut)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with. Features for the calibration are worked out for labelled documents alone."""
    name, kept = unused(docs, "__quality", "__kept")
    labelled = docs.join(labels.where("quality is not null").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", "lang")
    cutoffs = calibrate(features(labelled), labels)
    return decide(features(docs, name=name), cutoffs, name, kept).where(F.col(kept)).select(*docs.columns)
