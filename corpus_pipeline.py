"""The corpus pipeline: stages over documents, each calling one operator of panelforge.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns the token ids of the texts that remain.

What happens to odd rows: a null or empty text, or one without a letter, goes with language ID. A null lang is filled in, a
given one stays. Rows without a doc_id keep all their lines, are no near-duplicates of any row, and stay unless they hold a
passage of the benchmark; other columns may be null. Of equal lines and near-equal documents the earliest by doc_id stays; of
rows that repeat a doc_id, one, that with the first text. Texts of any length are worked on whole; bytes that are no UTF-8
become replacement characters in the first stage. An empty table gives an empty result. Further columns are kept by all
stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm import bpe, decontaminate, jaccard, langid, linededup
from panelforge.llm.common import table, written
from panelforge.llm.queries import BPE_FILE, held_out


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it differ from all columns."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with it as lang where that was null; those without a letter go."""
    label, score = unused(docs, "lang_pred"), unused(docs, "score")
    judged = langid.identify(docs, langid.learn(docs, ~held_out()), label, score)
    return judged.where(F.col(label) != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", label)).drop(label, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; those of which no word is left, as all was there before, go."""
    kept = linededup.without(docs, linededup.find(docs)).where(F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents that with the smallest doc_id; of rows with one doc_id, that with the first text. Rows without a doc_id all stay."""
    found = jaccard.cluster(docs)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    kept = docs.where("doc_id is not null").join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    place = unused(docs, "place")
    order = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    once = kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return once.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of the texts that remain."""
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]
#: Language profiles, edit distances of lines and byte-level merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
