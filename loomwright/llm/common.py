"""What the operators of this folder share: words, in-row helpers, scratch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.scratch import discard, materialise  # noqa: F401  for the modules of this folder

#: A word is a run of characters other than ASCII white space.
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that df does not have yet: the given ones, lengthened where they clash (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Values that one block of a running fold holds.
STEP = 64


def part(xs: Column, start: Column, end: Column) -> Column:
    """Places start to end (exclusive, beyond start) of an array; slice() would walk through all of it each time."""
    return F.transform(F.sequence(start, end - 1), lambda i: F.get(xs, i))


def before(values: Column, op: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each place of an array of ints, what op makes of all values before it, from 0 on; op is associative, 0 neutral.

    An array grows step by step only within blocks and over the blocks' totals, so even many thousand values take little time.
    """

    def grown(xs: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, begin, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def in_blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / STEP).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: part(v, b * STEP, F.least(b * STEP + STEP, F.size(v))))
        starts = lambda bs: grown(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: op(a, x))), F.lit(0))
        return let(blocks, lambda bs: let(starts(bs), lambda at: F.flatten(F.transform(bs, lambda b, i: grown(b, F.get(at, i))))))

    return let(values, lambda v: F.when(F.size(v) > STEP, in_blocks(v)).otherwise(grown(v, F.lit(0))))


def chars_of(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def between(chars: Column, start: Column, end: Column) -> Column:
    """The text of code points start to end (exclusive) of an array of them; empty where end is not beyond start. Its cost does not depend on the place."""
    return F.when(end > start, F.array_join(part(chars, start, end), "")).otherwise(F.lit(""))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK, -1), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
