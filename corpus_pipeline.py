"""From raw documents to token ids: language, repeated lines, near copies, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bpe, langid, linededup, minhash, mixing
from vectide.llm.common import save

#: Least score of a language for a document to stay.
LEAST_SCORE = 0.5
#: The stage's mix: nine tenths of the tokens that are left, each document once at most.
MIX = mixing.Mix(weights=mixing.PRODUCTION.weights, share=0.9, epochs=1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a text without a letter, or between languages, goes. `lang` becomes the predicted one."""
    model = langid.fit(docs, rows=langid.train_rows())
    kept = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line of the corpus resembles; one that has no line with a word left goes."""
    kept = linededup.deduplicate(docs)
    has_word = F.coalesce(F.length(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))) > 0, F.lit(False))
    out = kept.where((F.col("lines.removed") == 0) | has_word)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines.removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more, the smallest id stays."""
    return minhash.deduplicate(docs, minhash.Params())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen so that domains, languages and sources come near their weights."""
    return mixing.mix(docs, MIX, mixing.domain_of(F.col("source")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256): each text encoded, and decoded again."""
    import public_tokenizers

    done = bpe.digests(docs.select(F.struct("doc_id", "lang", "source").alias("of"), "text"), public_tokenizers.path("byte_bpe_50k.json"), "of")
    return done.select("of.*", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: Neither the classifier nor the encoder can be told in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over all that the one before has kept; what is between them is written to the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"pipeline-{name}")
    return docs
