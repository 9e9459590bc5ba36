"""A corpus from documents to packed sequences: language, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.llm.common import shared_folder, table
from msgrisk.llm.jaccard import ngram_components
from msgrisk.llm.langid import identify_languages, learn_languages
from msgrisk.llm.packing import pack_sequences
from msgrisk.llm.suffixes import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay, with the predicted language; texts without a letter (``und``) go."""
    named = identify_languages(docs, learn_languages(docs), keep=["doc_id", "text", "source", "n_chars"])
    return named.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked word 5-gram sets stays: the one with the smallest doc_id."""
    staying = ngram_components(docs, words=5, percent=80, row_key=True).where("stays").select("rid").distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("rid"))
    return keyed.join(staying, "rid", "left_semi").dropDuplicates(["rid"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 50-byte strings of documents before them; a document of which nothing is left goes."""
    cut = remove_repeats(docs, window=50, keep=["lang", "source"], texts=True)
    left = (F.col("n_removed") == 0) | (F.trim("kept_text") != "")
    return cut.where(left).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces of sequences of at most 2048 ids."""
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packing)]

#: Language models, set joins over hashed words and merged transforms have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each result is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
