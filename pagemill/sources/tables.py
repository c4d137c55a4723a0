"""Readers and writers of pages, usage and versions, and the mapping of the supplied tables to them."""

from __future__ import annotations

import gc
import posixpath
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.ranges import earlier, ranged, row_numbers
from pagemill.sources.merged import MergedTable

CACHE_VERSION = 4
FIELDS = ["ocrPages", "aiActions", "cloudVoiceChars", "pdfs", "failedRequests", "cacheHits"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Extracted pages: trimmed texts, pages from 1."""
    return spark.read.parquet(path).select("doc_id", "page", X.trim(F.coalesce("text", F.lit(""))).alias("text"), F.lit("native").alias("source"))


def read_usage(spark: SparkSession, path: str, months: list[str], users: DataFrame | None = None) -> DataFrame:
    """Monthly counters of these months, read from their partitions only; missing ones are 0, and so are all of a user (app_user_id) without any."""
    usage = spark.read.parquet(path).where(F.col("month").cast("string").isin(months)).select(F.col("month").cast("string").alias("month"), "app_user_id", *FIELDS)
    if users is not None:
        wanted = users.select("app_user_id").distinct().select(F.explode(F.array(*map(F.lit, months))).alias("month"), "app_user_id")
        usage = wanted.join(usage, ["month", "app_user_id"], "left")
    return usage.select("month", "app_user_id", *(F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in FIELDS))


def write_usage(usage: DataFrame, path: str) -> None:
    usage.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_versions(versions: DataFrame, version: int = CACHE_VERSION) -> DataFrame:
    """Documents of this version; where rows say when they were saved, the last one of each doc_id, and of several at that time the one with the largest hash."""
    rows = versions.where(F.col("cache_version") == version)
    if "saved_at" not in rows.columns:
        return rows
    best = rows.groupBy(F.struct("doc_id").alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct("saved_at", F.xxhash64(*rows.columns))).alias("_row"))
    return best.select("_row.*")


def saved_versions(spark: SparkSession, path: str, version: int = CACHE_VERSION) -> MergedTable:
    """The saved documents of a version, the last saved one of each doc_id. Each version is a table of its own, so others are not read."""
    return MergedTable(spark, posixpath.join(path, f"cache_version={version}"), ["doc_id"], ["saved_at"])


def write_versions(documents: DataFrame, path: str, saved_at: Column | None = None) -> None:
    """Saves documents. One that was saved before is superseded unless it has a later saved_at; of equal times the document written last stays."""
    stamped = documents.withColumn("cache_version", F.lit(CACHE_VERSION)).withColumn("saved_at", F.current_timestamp() if saved_at is None else saved_at)
    saved_versions(documents.sparkSession, path).append(stamped)


def expire_results(results: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """Page results of hashes whose newest write is at most ttl_days old, without pages from before a longer pause in writes.

    Pauses are looked for within ranges of time and between one range and the next, so a hash of very many pages is no task's alone. Results without a time
    are as old as can be.
    """
    ttl = ttl_days * 86_400_000_000
    us = F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62)))
    rows = ranged(results.withColumn("_us", us), ["content_hash"], F.col("_us"))
    pause = F.col("_us") - F.lag("_us").over(Window.partitionBy("_at").orderBy("_us")) > ttl
    spans = rows.select("_at", "_key", "_range", "_us", pause.alias("_pause")).groupBy("_at", "_key", "_range").agg(F.min("_us").alias("first"), F.max("_us").alias("last"), F.max(F.when(F.col("_pause"), F.col("_us"))).alias("inner"))
    before = F.max("last").over(earlier())
    start = F.coalesce("inner", F.when(before.isNull() | (F.col("first") - before > ttl), F.col("first")))
    whole = Window.partitionBy("_key")
    spans = spans.withColumn("_start", start).select("_at", F.max("_start").over(whole).alias("_start"), F.max("last").over(whole).alias("_newest"))
    fresh = (F.col("_us") >= F.col("_start")) & (F.unix_micros(now.cast("timestamp")) - F.col("_newest") <= ttl)
    return rows.join(spans, "_at").where(fresh).select(*results.columns)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied documents as pages: a source is a book, its documents in order are pages. Null and repeated doc_ids are pages of their own."""
    rows = read_table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", "text")
    numbered = row_numbers(rows, ["book"], F.col("doc_id"), ["doc_id", "text"], "page")
    return numbered.select(F.col("book").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("native").alias("source"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; a local session without it (tests) uses its own disk."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
    return posixpath.join(folder, uuid.uuid4().hex)


#: Bytes of rows that go to a Python worker at once, one row at least.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about BATCH_BYTES, and not 10,000 rows or 64 MB at once; a smaller limit of its own stays.

    What a worker and the JVM hold beside them follows that: a page's items take many times the bytes that go to Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = {"b": 0, "k": 10, "m": 20, "g": 30}
    digits, unit = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(digits) << units[unit or "b"] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles of steps that are written and done with, instead of waiting for the driver's next full collection.

    Python's and the JVM's garbage goes; a small job before takes the place of the last one, which the driver still holds. The JVM hears of Python's garbage a moment later.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(1)
        spark.range(2).repartition(1).count()
        spark._jvm.System.gc()


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied events as usage: app_user_id, ts, event_id, field, amount."""
    kind = F.col("event_type")
    field = F.when(kind == "signup", "pdfs").when(kind == "click", "aiActions").when(kind == "purchase", "cloudVoiceChars").when(kind == "view", "cacheHits").otherwise("failedRequests")
    amount = F.when(kind == "purchase", F.floor("value")).otherwise(1).cast("long")
    return read_table(spark, sf_dir, "events").select(F.col("user_id").alias("app_user_id"), "ts", "event_id", field.alias("field"), amount.alias("amount"), F.get_json_object("props", "$.k").cast("long").alias("k"))
