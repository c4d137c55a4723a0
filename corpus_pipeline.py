"""A training corpus from raw documents: each stage is written and read again as the documents of the next."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.decontaminate import decontaminate
from pagemill.llm.language import identify, profiles
from pagemill.llm.near import ngram_jaccard_join
from pagemill.llm.packing import pack
from pagemill.llm.queries import fold, tokenizer_path
from pagemill.llm.session import removed, shared_folder
from pagemill.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; profiles are learned from the training fold of the documents. lang becomes the prediction.

    Texts that are null or have no letter go. Null and repeated doc_ids stay, as do repeated rows; an empty table stays empty.
    """
    judged = identify(docs, profiles(docs.where(fold() != 0)))
    return judged.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents exactly one row, of the smallest doc_id; all rows with a null doc_id.

    Where a doc_id is repeated, rows are documents of their own, named by 64-bit hashes of all their columns: equal rows become one,
    different texts of one doc_id stay unless they are linked. Texts without words have no links and stay.
    """
    named = docs.where("doc_id is not null").select(*COLUMNS)
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = named.withColumn("row_key", F.col("doc_id").cast("long"))
    else:
        rows = named.withColumn("row_key", F.xxhash64(*COLUMNS)).dropDuplicates(["row_key"])
    classes = ngram_jaccard_join(rows.select("doc_id", "text", "row_key"), doc_id="row_key").groupBy("class_id")
    kept = classes.agg(F.min(F.struct("doc_id", "row_key")).alias("one")).select("one.row_key")
    return rows.join(kept, "row_key", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document of smaller doc_id has; n_chars is of what is left.

    All rows stay, also those that are left empty. A null doc_id neither takes nor loses; rows of one doc_id take nothing from each other.
    """
    return suffix_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item (all its words, if it has fewer). Null and empty texts are clean and stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, mixed by source. Null and empty texts are one end token; null sources are a queue."""
    return pack(docs, tokenizer=tokenizer_path()).select("doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("suffix_dedup", repeated_strings), ("decontamination", benchmark), ("packing", packing)]

#: Near duplicates, suffix order and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the cluster's checkpoint folder and read again; the next stage's end removes it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        path = posixpath.join(folder, str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
