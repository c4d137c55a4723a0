"""Versions of a page, what is pending, and verdicts on documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X

PAGE = ["doc_id", "page"]


def _confidence(pages: DataFrame) -> Column:
    return F.col("confidence") if "confidence" in pages.columns else F.lit(None)


def longer(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages with recognised ones where the page is missing or its text strictly shorter; blank ones are ignored. Other pages keep their confidence."""
    new = recognised.where(X.trim("text") != "").select(*PAGE, F.col("text").alias("new_text"), F.col("confidence").alias("new_confidence"))
    wins = F.col("new_text").isNotNull() & (F.col("text").isNull() | (F.length("new_text") > F.length("text")))
    own = pages.select(*PAGE, "text", "source", _confidence(pages).alias("confidence"))
    return own.join(new, PAGE, "full").select(*PAGE, F.when(wins, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(wins, "ocr").otherwise(F.col("source")).alias("source"), F.when(wins, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"))


def merge_ocr_longer(pages: DataFrame, recognised: DataFrame, pending: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, pending): longer recognised texts win; all pages that were wanted leave pending, with or without a result."""
    return longer(pages, recognised), pending_except(pending, wanted)


def merge_ocr_strict(pages: DataFrame, recognised: DataFrame, targets: DataFrame, force: Column) -> tuple[DataFrame, DataFrame]:
    """(pages, pending): pages (with `low`) replaced by recognised text that is not blank, if forced, of low quality, or longer; `replaced` tells.

    Targets that were not replaced are pending. Pages that are not replaced keep their confidence.
    """
    new = recognised.select(*PAGE, F.col("text").alias("new_text"), F.col("confidence").alias("new_confidence"))
    wins = F.coalesce((X.trim("new_text") != "") & (force | F.col("low") | (F.length("new_text") > F.length("text"))), F.lit(False))
    own = pages.select(*PAGE, "text", "source", "low", _confidence(pages).alias("confidence"))
    merged = own.join(new, PAGE, "left").select(*PAGE, F.when(wins, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(wins, "ocr").otherwise(F.col("source")).alias("source"), F.when(wins, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), wins.alias("replaced"))
    return merged, pending_except(targets, merged.where("replaced"))


def doc_needs_paid_ocr(pages: DataFrame, lang: Column) -> DataFrame:
    """doc_id, needs: whether too few of a document's pages can be read as they are."""
    long = F.length(X.trim(F.coalesce("text", F.lit("")))) >= 40
    rows = pages.select("doc_id", X.needs_ocr("text", lang).alias("low"), long.alias("long"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("low").alias("low"), F.count_if(~F.col("low") & F.col("long")).alias("good"), F.count_if(F.col("low") & F.col("long")).alias("bad"))
    verdict = F.when(F.col("low") == 0, False).when(F.col("good") > 0, False).otherwise(F.col("bad") >= F.greatest(F.lit(2), F.ceil(F.col("n") * F.lit(0.2))))
    # pages that are blank throughout count as unreadable
    return counts.select("doc_id", verdict.alias("needs"))


def doc_flags(pages: DataFrame, kind: Column) -> DataFrame:
    """doc_id, has_text, scanned, ocr_pages; scanned is a document of kind pdf (any of its pages says so) without text."""
    has = F.bool_or(X.trim(F.coalesce("text", F.lit(""))) != "")
    return pages.groupBy("doc_id").agg(has.alias("has_text"), (F.coalesce(F.bool_or(kind == "pdf"), F.lit(False)) & ~has).alias("scanned"), F.count_if(F.col("source") == "ocr").alias("ocr_pages"))


def ocr_progress(pages: DataFrame, pending: DataFrame) -> DataFrame:
    """doc_id, total, done, pending, percent."""
    done = pages.groupBy("doc_id").agg(F.count_if((F.col("source") == "ocr") & (X.trim("text") != "")).alias("done"))
    left = pending.groupBy("doc_id").agg(F.count("*").alias("pending"))
    rows = done.join(left, "doc_id", "left").select("doc_id", (F.col("done") + F.coalesce("pending", F.lit(0))).alias("total"), "done", F.coalesce("pending", F.lit(0)).alias("pending"))
    return rows.withColumn("percent", F.when(F.col("total") == 0, 100).otherwise(F.floor(F.lit(100.0) * F.col("done") / F.greatest(F.lit(1), "total") + 0.5)).cast("int"))


def batch_priority(pending: DataFrame, focus: Column, n: int = 4) -> DataFrame:
    """The next n pages of each document, nearest to the page in focus first."""
    order = Window.partitionBy("doc_id").orderBy(F.abs(F.col("page") - focus), "page")
    return pending.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n)


def eager_split(low: DataFrame, n: int = 4) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("page")
    return low.withColumn("eager", F.row_number().over(order) <= n)


def cap_of(page_cap: Column, max_pages: Column) -> Column:
    """Pages of a document that a plan allows: its cap where it has one, but never more than its most."""
    return F.when(page_cap > 0, F.least(page_cap, max_pages)).otherwise(max_pages)


def page_cap(pages: DataFrame, tiers: DataFrame) -> DataFrame:
    """pages (with the tier of their document) up to the plan's cap, and whether the document had more. A plan that is not known allows none."""
    caps = tiers.select(F.col("key").alias("tier"), cap_of(F.col("page_cap"), F.col("max_pages")).alias("_cap"))
    order = Window.partitionBy("doc_id").orderBy("page")
    rows = pages.withColumn("_at", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id")))
    return rows.join(F.broadcast(caps), "tier").where(F.col("_at") <= F.col("_cap")).withColumn("truncated", F.col("_n") > F.col("_cap")).drop("_at", "_n", "_cap")


def blank_pages(pages: DataFrame, hidden: DataFrame) -> DataFrame:
    return pages.join(hidden.select(*PAGE).distinct().withColumn("hide", F.lit(True)), PAGE, "left").withColumn("text", F.when(F.col("hide"), "").otherwise(F.col("text"))).drop("hide")


def pending_union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*PAGE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*PAGE))
    return out.distinct()


def pending_except(pending: DataFrame, done: DataFrame) -> DataFrame:
    return pending.join(done.select(*PAGE), PAGE, "left_anti")


def merge_cached(fresh: DataFrame, fresh_docs: DataFrame, cached: DataFrame, cached_docs: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, pending, docs) of documents parsed anew: recognised pages kept from before win where they are longer and are not pending.

    Documents (doc_id, lang, force_ocr) count as kept only in the same language (null is eng); force_ocr holds if either says so.
    """
    spoken = F.coalesce("lang", F.lit("eng"))
    same = fresh_docs.select("doc_id", spoken.alias("_lang")).join(cached_docs.select("doc_id", spoken.alias("_lang"), F.col("force_ocr").alias("_forced")), ["doc_id", "_lang"])
    kept = cached.where((F.col("source") == "ocr") & (F.col("text") != "")).join(same, "doc_id", "left_semi")
    docs = fresh_docs.join(same.drop("_lang"), "doc_id", "left").withColumn("force_ocr", F.coalesce("force_ocr", F.lit(False)) | F.coalesce("_forced", F.lit(False))).drop("_forced")
    return longer(fresh, kept), pending_except(pending, kept), docs
