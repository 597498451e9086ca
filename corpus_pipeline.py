"""From raw documents to token ids: quality rules, near duplicates, repeated substrings, benchmark passages, BPE.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's input.  All but the last return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, decontamination, ngram_join, quality_rules, suffix_dedup
from shelfspark.llm.storage import cut, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality rules keep.

    A null or empty text has no words and goes; repeated rows and rows without a doc_id are judged one by one; an empty
    table gives no rows; columns that documents do not have are left behind.
    """
    # written first, so that the filter does not compute the verdict a second time
    return cut(quality_rules.judge(docs.select(*COLUMNS)).select(*COLUMNS, "kept")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near duplicates: the one with the smallest doc_id, null being the largest.

    A row is its doc_id and text together, so rows that share a doc_id (or have none) are told apart by their text; of
    rows that are alike in both, one stays.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    joined = cut(ngram_join.near_duplicates(docs.select(row.alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"))
    several = cut(joined.groupBy("component_id").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("component_id"))
    members = cut(joined.join(several, "component_id").distinct())
    ranked = docs.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("rank")).join(members, "row")
    first = cut(ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("component_id", F.col("rank.row").alias("first")))
    others = cut(members.join(first, "component_id").where("row <> first").select("row"))
    kept = docs.select(*COLUMNS, row).join(others, "row", "left_anti")
    repeated = cut(joined.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"))
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, "row", "left_semi").dropDuplicates(["row"])
    return kept.join(repeated, "row", "left_anti").unionByName(once).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what stands elsewhere too, and drops documents of which it leaves no word.

    A text of which nothing is cut stays as it is (a null one as an empty one) with its n_chars; a text of any length is cut
    whole; n_chars of a cut text is counted anew, and a character that a cut goes through goes with it.  Repeated rows of
    200 bytes or more are cut out of each other; rows without a doc_id are told apart by their texts; an empty table
    gives no rows; columns that documents do not have are left behind.
    """
    cleaned = suffix_dedup.dedup_substrings(docs, whole=True, carried=("doc_id", "lang", "source", "n_chars"))
    cut_out = F.col("n_removed") > 0
    cleaned = cleaned.where(~cut_out | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(cut_out, F.length("kept_text").cast("long")).otherwise(F.col("_n_chars"))
    return cleaned.select(
        F.col("_doc_id").alias("doc_id"), F.col("kept_text").alias("text"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), n_chars.alias("n_chars")
    )


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    A null or empty text holds none and stays; each of repeated rows is judged, with or without a doc_id; without
    documents there are no rows, and without items all documents stay; columns that documents do not have are left behind.
    """
    return decontamination.clean_rows(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and the decoded text of each document.

    A null text counts as empty and has no ids; repeated rows and rows without a doc_id have a row each; an empty table
    gives no rows; further columns are left behind.
    """
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), texts=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_substrings),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Tokenizers, edit distances, suffix arrays and similarity joins have no counterpart in SQL that whole tables allow.
ORACLE_SQL = None
