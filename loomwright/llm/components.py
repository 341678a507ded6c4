"""Connected components over links, by alternating large and small stars.

Each round points every node at the smallest node it sees; edges with the same ends melt together, so a hot node costs one
partial minimum a task and a join whose larger side may be split. Every round is written to the shared
folder. The driver learns only whether another round is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    turned = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component for every node with a link; component is the smallest node reachable.

    Links of a node with itself and links with a null end are passed over; links given twice count once; no links, no rows.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        new = materialise(_small_star(_large_star(now)))
        discard(now)
        now = new
        # Done when every node has one parent and no parent has one itself.
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        if ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child = 1 and parent = 1").isEmpty():
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
