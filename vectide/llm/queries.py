"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bpe, langid, linededup, minhash, mixing, quality, sharding, substring, toxicity, vecdedup


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = quality.judge(docs)
    return judged.select("doc_id", *(f"quality.{c}" for c in (*quality.STATS, "base_failed", "kept")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), minhash.Params(width=2))


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return kept.select("doc_id", F.col("spans.n").alias("n_sentences"), F.col("spans.removed").alias("n_removed"), "spans.removed_words", text.alias("text_md5"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.choose(docs, mixing.PRODUCTION, mixing.domain_of(F.col("source")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return kept.select("doc_id", F.col("lines.n").alias("n_lines"), F.col("lines.removed").alias("n_removed"), text.alias("text_md5"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_minhash": op2_minhash,
        "op3_spans": op3_spans,
        "op4_language": op4_language,
        "op5_mixing": op5_mixing,
        "op6_lines": op6_lines,
        "op7_toxicity": op7_toxicity,
        "op8_vectors": op8_vectors,
        "op9_sharding": op9_sharding,
        "op10_bpe": op10_bpe,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": quality.ORACLE,
        "op2_minhash": minhash.ORACLE,
        "op3_spans": substring.ORACLE,
        "op5_mixing": mixing.ORACLE,
        "op6_lines": linededup.ORACLE,
        "op8_vectors": vecdedup.ORACLE,
    }
