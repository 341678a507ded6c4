"""Hybrid retrieval: tenant scope, vector similarity, freshness and rule ranking in one plan; what answers rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.freshness import STALE, freshness
from loomwright.operators import inventory, rerank, vectors


#: Rows that the vector channel gives, and the similarity that they must exceed.
CHANNEL, LEAST = 10, 0.25


def retrieve(rows: DataFrame, tenants: list, intent: rerank.Intent, as_of: Column, query_vector: list[float] | None = None, limit: int = 5, min_score: float = 0) -> DataFrame:
    """The best rows of the tenants with score and reasons.

    The vector channel gives the few rows most like the query, if they are like enough; they alone have a similarity, joined by id (a table of ten rows). Without a query vector it is empty.
    rows: widget_id, id, title and what else ``rerank`` knows; embedding, last_seen, still_listed, data_type and channel where there are any.
    """
    df = inventory.scoped(rows, tenants)
    if query_vector is not None and "embedding" in rows.columns:
        near = vectors.top_k(df.select("id", "embedding"), query_vector, CHANNEL, "embedding", "id", LEAST)
        df = df.drop("similarity").join(F.broadcast(near.groupBy("id").agg(F.max("similarity").alias("similarity"))), "id", "left")
    if "last_seen" in rows.columns:
        listed = F.col("still_listed") if "still_listed" in rows.columns else F.lit(True)
        kind = F.col("data_type") if "data_type" in rows.columns else F.lit("crawl")
        df = df.withColumn("freshness", freshness(F.col("last_seen"), listed, kind, as_of, F.col("channel") if "channel" in rows.columns else None))
    return rerank.rerank(df, intent, limit, min_score)


def grounded(results: DataFrame) -> DataFrame:
    """One row on a result (a top-k, so a few rows): grounded, top score, confidence, freshness and how careful an answer must be."""
    top = F.max_by(F.struct("score", "freshness"), F.struct("score", F.col("id")))
    out = results.agg(F.count("*").alias("n"), top.alias("top"), F.count_if(F.col("freshness") == STALE).alias("stale"), F.count_if(F.col("freshness") == "recent").alias("recent"))
    score = F.col("top.score")
    confidence = F.when(F.col("n") == 0, "unverified").when(score >= 1000, "high").when(score >= 400, "medium").otherwise("low")
    hedge = F.when(F.col("n") == 0, "none").when(F.col("stale") > 0, "strong").when(F.col("recent") > 0, "light").otherwise("none")
    return out.select((F.col("n") > 0).alias("grounded"), score.alias("top_score"), confidence.alias("confidence"), F.col("top.freshness").alias("freshness"), hedge.alias("hedge"))


def decided(scored: DataFrame, query: str, score: str, tie: str, least: float = 450, margin: float = 120) -> DataFrame:
    """The best target of each query at ``least`` points; ambiguous where the next one is within ``margin``."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    ranked = scored.withColumn("__next", F.lead(score).over(w)).withColumn("__rn", F.row_number().over(w)).where(f"__rn = 1 and {score} >= {least}")
    return ranked.withColumn("ambiguous", F.coalesce(F.col(score) - F.col("__next") < margin, F.lit(False))).drop("__next", "__rn")


def context(results: DataFrame, title: str = "title", content: str = "content", most: int = 300) -> DataFrame:
    """One text of a top-k's titles and openings, best first."""
    line = F.concat_ws(": ", title, F.substring(content, 1, most))
    lines = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id"), line.alias("line"))))
    return results.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
