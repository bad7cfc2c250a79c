"""The thin queries over the operators, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chosen_path, itq, langid, mixing, nbsvm, oracles, quotes, suffix, textbytes, tokens, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    textbytes.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out(n: int, rest: int) -> Column:
    return F.coalesce(remainder(n) == rest, F.lit(False)).alias("held_out")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(quotes.reply_threads(table(spark, sf_dir, "conversations")))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over the same conversations made to quote each other, as the given ones don't."""
    return quotes.reply_ordered(quotes.reply_threads(quotes.quoting(table(spark, sf_dir, "conversations"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid.learned(docs, remainder(4) != 2)
    return langid.predict(docs, trees).select("doc_id", held_out(4, 2), "lang_pred", "score", "bits_per_byte")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = suffix.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")
    return judged.select("*", *[F.col(f"longest.{c}").alias(f"longest_{c}") for c in ("words", "doc_word", "item_id", "item_word")]).drop("longest")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.learned(docs, table(spark, sf_dir, "labels"), "quality", remainder(5) != 0, nbsvm.quality_grams)
    return nbsvm.score(docs, model).select("doc_id", held_out(5, 0), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.learned(docs, table(spark, sf_dir, "labels"), "toxic", remainder(4) != 2, nbsvm.toxicity_grams)
    return nbsvm.score(docs, model).select("doc_id", held_out(4, 2), "score", "predicted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_documents(table(spark, sf_dir, "documents"), size=3, similar=(85, 100))


QUERIES = {f.__name__: f for f in (op1_quotation_linking, quoted_conversations, op2_language_id, op3_decontamination, op4_embeddings, op5_html_extraction, op6_mixing, op7_token_counts, op8_quality, op9_toxicity, op10_minhash)}
ORACLES = oracles.ORACLES
