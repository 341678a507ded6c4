"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash_dedup as m

    return m.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q

    judged = materialise(q.features(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "__quality"))
    out = q.decide(judged, q.calibrate(judged, table(spark, sf_dir, "labels")))
    x = F.col("__quality")
    return out.select("doc_id", x["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["lines"]["dup"].alias("n_dup_lines"), x["n_repeat_words"].alias("n_repeat_words"), q.base_failed(x).alias("base_failed"), F.col("__kept").alias("kept"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import source_mixing as m

    mixed = m.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__all_sources").alias("in_mix"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import lattice_lm as m

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return m.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, public_tokenizers.path("byte_bpe_50k.json"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_rules as u

    rules = spark.createDataFrame(u.RULES, "verdict string, host string, path string")
    out = u.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as s

    found = s.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("__secrets")
    base = F.filter(spans, lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(s.joined(base), 256).alias("base_sha256"), s.joined(spans).alias("spans"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import sequence_packing as s

    return s.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii_surrogates as p

    out = p.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), "loomwright")
    return out.select("doc_id", F.col("__n_entities").cast("long").alias("n_entities"), F.col("__new_text").alias("text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_transducer as t

    out = t.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup as e

    return e.dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk_search as s

    rows = table(spark, sf_dir, "embeddings").select("vec_id", s.quantised(F.col("embedding"), 64).alias("v"))
    return s.top_k(rows, F.col("vec_id") % 20 == 0, 20, id_col="vec_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle_manifest as m

    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: m.leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(lowered))
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    out = m.manifest(leaves, "doc_id", "lang", ["doc_id", "tampered"])
    out = out.withColumn("proof_sha256", F.sha2(m.siblings(F.col("path")).cast("binary"), 256)).withColumn("folded_root", m.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk_search as s
    from . import vector_codes as c

    return c.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", s.quantised(F.col("embedding"), 1024).alias("v")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_dedup, op2_quality_rules, op3_source_mixing, op4_lattice_lm, op5_url_rules, op6_sequence_packing, op7_secret_scan, op8_pii_surrogates, op9_token_counts, op10_embedding_dedup, op11_topk_search, op12_merkle_manifest, op13_vector_codes)}
