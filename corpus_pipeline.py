"""Stages of a training corpus: language, toxicity, near copies, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last returns the mixture's
account. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chosen_path, langid, mixing, nbsvm, queries, suffix
from quire.llm.shared import Scratch, swept
from quire.llm.textbytes import BOXED, boxed, small_batches

#: A document whose best language has less than this share of the likelihoods is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and texts whose language is open."""
    trees = langid.learned(docs, queries.remainder(4) != 2)
    return langid.predict(boxed(docs), trees, [BOXED]).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(f"{BOXED}.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the classifier calls toxic."""
    model = nbsvm.learned(docs, queries.table(spark, sf_dir, "labels"), "toxic", queries.remainder(4) != 2, nbsvm.toxicity_grams)
    return nbsvm.score(boxed(docs), model, keep=[BOXED]).where("predicted = 0").select(f"{BOXED}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group the document of the smallest id, and of rows that repeat an id the one of the least text. Rows without an id are kept."""
    found = chosen_path.similar_documents(docs).where("kept and doc_id is not null")
    kept = Scratch(spark).save(found.groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    rows = boxed(docs)
    out = rows.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    again = kept.where("n > 1").select("doc_id")
    if not again.isEmpty():
        order = F.struct(F.col(f"{BOXED}.text"), F.to_json(BOXED))
        least = out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(BOXED, order).alias(BOXED))
        out = out.join(again, "doc_id", "left_anti").unionByName(least)
    return out.select(BOXED).union(rows.where("doc_id is null").select(BOXED)).select(f"{BOXED}.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold benchmark passages."""
    return suffix.contamination(boxed(docs), queries.table(spark, sf_dir, "benchmark"), [BOXED]).where("not contaminated").select(f"{BOXED}.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document that is left."""
    return mixing.mixed_documents(docs)


def _bounded(stage: Callable) -> Callable:
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


STAGES = [(f.__name__, _bounded(f)) for f in (language, toxicity, near_duplicates, decontamination, mixture)]

#: The stages learn, hash and draw: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's account of all documents that the stages keep. What a stage leaves in the shared folder goes when its rows are written, the last one's rows with the session."""
    scratch = Scratch(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with swept():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
