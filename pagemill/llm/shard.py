"""Sharding by sampled splitters: size-weighted key samples give range boundaries; ranges that turn out overfull are sampled again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.session import fresh, saved

SHARDS, RANGES_A_SHARD = 40, 64
#: A group of equal texts is cut only if it is larger than this share of a shard.
TOLERANCE = 0.02


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def _ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """rows with `range`: how many splitters are at or before the key."""
    cuts = np.array(splitters, dtype="S48")

    def run(batches):
        for b in batches:
            keys = np.array(b.column("key").to_pylist(), dtype="S48")
            at = np.searchsorted(cuts, keys, side="right") if len(cuts) else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "range"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("range", T.LongType())]))


def _sampled(rows: DataFrame, a_byte: float, seed: int) -> list[str]:
    """Keys drawn with a chance in proportion to size; their expected number is bytes * a_byte."""
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return [r.key for r in rows.where(chance < F.col("size") * a_byte).select("key").toLocalIterator()]


def shard(documents: DataFrame, *, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", overhead: int = 16, ranges: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Per document its columns but the text, and size, text_crc32, law, shard, slot, grown_shard; columns of these names are replaced.

    Rows are ordered by a hash of the text. Equal texts have one key and stay together, but for groups of more than `tolerance` of a
    shard (there are less than shards / tolerance of them), whose rows have keys of their own, by a hash of doc_id and a row number.
    Sampled splitters cut the order into `ranges` small ranges (64 for each shard) whose exact sizes are
    summed; ranges of over four times the intended size are cut by a denser sample until none is left or has one key. A
    group, or a row of a large one, then goes to the shard that holds the middle of its bytes in the whole order, so each
    shard has its share of bytes but for one group at either end: the law is `bytes`. Only keys and sizes are shuffled;
    the driver sees splitters, sums of ranges and large groups, whose numbers do not follow the rows.

    Null texts are empty ones: no bytes, only the overhead. Null ids and repeated rows are placed like any other row. Shards may be
    empty if there are fewer documents. Slots count from 0 without gaps in each shard.
    """
    spark = documents.sparkSession
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in documents.columns if c not in (*made, text)]
    names = fresh(["key", "range", "size", "crc", "group", "tie"], *(f"own_{c}" for c in kept))
    rows = saved(documents.select(
        *(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("group"), F.concat(_hex(F.xxhash64(doc_id, F.lit(1))), _hex(F.monotonically_increasing_id())).alias("tie"),
    ))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = [r.group for r in rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > tolerance * total / shards).select("group").collect()]
    is_large = F.broadcast(spark.createDataFrame([(g,) for g in large], "group long").withColumn("large", F.lit(True)))
    rows = rows.join(is_large, "group", "left").withColumn("key", F.concat(_hex(F.col("group")), F.when(F.col("large"), F.col("tie")).otherwise("0" * 32))).drop("large", "group")
    ranges = ranges or shards * RANGES_A_SHARD
    rate = ranges / max(total, 1)
    splitters = set(_sampled(rows, rate, 0))
    while True:
        cut = _ranged(rows, sorted(splitters))
        found = cut.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("key") == F.max("key")).alias("one")).collect()
        sums = {r.range: (r.bytes, r.n) for r in found}
        overfull = [r.range for r in found if not r.one and r.bytes > 4 * total / ranges]
        if not overfull:
            break
        rate *= 8
        splitters |= set(_sampled(cut.where(F.col("range").isin(overfull)), rate, 1))
    before, bytes_before, rows_before = [], 0, 0
    for k in sorted(sums):
        before.append((k, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + sums[k][0], rows_before + sums[k][1]
    starts = F.broadcast(spark.createDataFrame(before, "range long, bytes_before long, rows_before long"))
    order = Window.partitionBy("range").orderBy("key", "tie")
    own = Window.partitionBy("range", "key")  # sorted alike, so it needs no shuffle of its own
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("bytes_before")
    placed = cut.join(starts, "range", "left").select(*names, "size", "crc", "range", "key", upto.alias("upto"), (F.row_number().over(order) + F.col("rows_before") - 1).alias("row"))
    middle = F.max("upto").over(own) - F.sum("size").over(own) / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int"))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first")))
    return placed.join(firsts, "shard").select(
        *(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)),
        "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
