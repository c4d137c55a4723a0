"""Metering over streams of requests, and pages that are recognised later; over rows in order of time each gives what its batch twin gives.

Stateful streams keep their state in RocksDB (see with_rocksdb) and drop it by timers of event time. The watermark's column does not reach the
stateful operator, so Spark drops no late row: what is later than the watermark gets an answer of its own here. Between micro-batches, rows have to
come in order of time; within one they may come in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagemill.functions import text as X
from pagemill.operators.usage import NEVER, metered, month_of, quota_steps, timed, ttl_steps
from pagemill.operators.versions import ocr_progress, pending_except
from pagemill.sources.merged import MergedTable
from pagemill.sources.tables import FIELDS

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _end_of(month: str) -> int:
    """The first millisecond behind a month like 2024-01."""
    return int((pd.Timestamp(f"{month}-01") + pd.DateOffset(months=1)).value // 1_000_000)


def _watermarked(rows: DataFrame, late: str, *kept: Column | str) -> DataFrame:
    """The kept columns of rows, behind a watermark on ts."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(*kept)


def _together(tables: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order of time."""
    return pd.concat(list(tables)).sort_values(["us", "req_id"], kind="stable")


#: Users or keys share a state by hash: a micro-batch asks for so many states at most, however many users there are.
BUCKETS = 1024


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def _listed(values: pd.Series) -> list:
    return values.astype(object).where(values.notna(), None).tolist()


class _Counters(StatefulProcessor):
    """Six sums of a month and each user of a bucket, of one part of the users' events, until the watermark has passed the month's end."""

    def init(self, handle):
        self._handle, self._held = handle, handle.getValueState("held", "app_user_id array<string>, " + ", ".join(f"{f} array<bigint>" for f in FIELDS))

    def handleInputRows(self, key, rows, timerValues):
        summed = lambda table: table.groupby("app_user_id", dropna=False, sort=False, as_index=False).sum()
        sums = summed(pd.concat([summed(table[["app_user_id", *FIELDS]]) for table in rows])).assign(now=1)
        month, part, _ = key
        late = month is None or timerValues.getCurrentWatermarkInMs() >= _end_of(month)
        if not late:
            before = self._held.get()
            if before is None:
                self._handle.registerTimer(_end_of(month))
            else:
                sums = summed(pd.concat([sums, pd.DataFrame(dict(zip(["app_user_id", *FIELDS], before, strict=True))).assign(now=0)]))
            self._held.update((_listed(sums["app_user_id"]), *(sums[f].tolist() for f in FIELDS)))
            sums = sums[sums["now"] > 0]
        yield sums.assign(month=month, part=part, late=late)[["month", "app_user_id", "part", "late", *FIELDS]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._held.clear()
        yield pd.DataFrame(columns=["month", "app_user_id", "part", "late", *FIELDS])

    def close(self):
        pass


def usage_stream(events: DataFrame, late: str = "1 day", parts: int = 8, buckets: int = BUCKETS // 8) -> DataFrame:
    """month, app_user_id, part, late and the six counters, for output mode update; read_counters sums them up.

    A row that is not late replaces the one before it of its month, user and part. Parts are shares of a user's events, by hash, so that a user with very many of them
    is not one task's; users share states by buckets. Rows of a month that the watermark has passed (or without a time) are late: their sums stand for themselves, and no state
    is kept for them; a month's state goes once the watermark, `late` behind the newest event, passes its end.
    """
    sums = [F.when(F.col("field") == f, F.coalesce("amount", F.lit(0))).otherwise(0).cast("long").alias(f) for f in FIELDS]
    part = F.pmod(F.xxhash64(*(c for c in events.columns if c != "app_user_id")), F.lit(parts)).cast("int")
    user = events.schema["app_user_id"].dataType.simpleString()
    rows = _watermarked(events, late, month_of("ts").alias("month"), F.col("app_user_id").cast("string").alias("app_user_id"), part.alias("part"), _bucket("app_user_id", buckets), *sums)
    schema = "month string, app_user_id string, part int, late boolean, " + ", ".join(f"{f} long" for f in FIELDS)
    return rows.groupBy("month", "part", "bucket").transformWithStateInPandas(_Counters(), schema, "update", "eventTime").withColumn("app_user_id", F.col("app_user_id").cast(user))


def keep_counters(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over usage_stream: the newest sums at path/now, those of late rows at path/late. A batch that comes again changes nothing."""
    keys = ["month", "app_user_id", "part"]

    def keep(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        MergedTable(spark, f"{path}/now", keys).append(batch.where("not late").drop("late"), n)
        MergedTable(spark, f"{path}/late", [*keys, "batch"]).append(batch.where("late").drop("late").withColumn("batch", F.lit(n).cast("long")), n)
        batch.unpersist()

    return keep


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """month, app_user_id and the six counters: what usage_monthly gives for all events that were streamed, late ones included."""
    now, late = MergedTable(spark, f"{path}/now", ["month", "app_user_id", "part"]).read(), MergedTable(spark, f"{path}/late", ["month", "app_user_id", "part", "batch"]).read()
    return now.unionByName(late.drop("batch")).groupBy("month", "app_user_id").agg(*(F.sum(f).cast("long").alias(f) for f in FIELDS))


class _Quota(StatefulProcessor):
    """What each user of a bucket has used of a month."""

    def init(self, handle):
        self._handle, self._held = handle, handle.getValueState("held", "users array<string>, used array<bigint>")

    def _read(self, month: str | None) -> dict:
        held = self._held.get()
        if held is None and month is not None:
            self._handle.registerTimer(_end_of(month))
        return {} if held is None else dict(zip(*held, strict=True))

    def _keep(self, used: dict) -> None:
        self._held.update((list(used), list(used.values())))

    def handleInitialState(self, key, initialState, timerValues):
        used = self._read(key[0])
        for user, n in zip(_listed(initialState["app_user_id"]), initialState["used"].tolist(), strict=True):
            used[user] = used.get(user, 0) + n
        self._keep(used)

    def handleInputRows(self, key, rows, timerValues):
        month, rows = key[0], _together(rows)
        codes, _ = pd.factorize(rows["app_user_id"], use_na_sentinel=False)
        rows = rows.iloc[np.argsort(codes, kind="stable")]
        codes, users = np.sort(codes), _listed(rows["app_user_id"])
        admitted, after = np.zeros(len(rows), dtype=bool), np.full(len(rows), None)
        if month is None or timerValues.getCurrentWatermarkInMs() < _end_of(month):
            amount, limit, ok = (rows[c].to_numpy() for c in ("amount", "limit", "ok"))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]]).tolist()
            used = self._read(month)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                used[users[a]], admitted[a:b], after[a:b] = quota_steps(used.get(users[a], 0), amount[a:b], limit[a:b], ok[a:b])
            self._keep(used)
        yield pd.DataFrame({"req_id": rows["req_id"].to_numpy(), "app_user_id": users, "month": month, "admitted": admitted, "used": pd.array(after, dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._held.clear()
        yield pd.DataFrame(columns=["req_id", "app_user_id", "month", "admitted", "used"])

    def close(self):
        pass


def quota_stream(requests: DataFrame, limit: int | None = None, initial: DataFrame | None = None, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """req_id, app_user_id, month, admitted, used as quota_admit_amount has them, for requests with ts, amount, limit and, if it is known, ok.

    initial (app_user_id, month, used) is what was used before the stream began. State is one number for a user and month, users share states by buckets, and it goes once the watermark passes the month's end;
    requests of such a month are refused, with null in used. Requests without a month are one month that does not end.
    """
    kind = requests.schema["app_user_id"].dataType.simpleString()
    user = F.col("app_user_id").cast("string").alias("app_user_id")
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER))
    rows = _watermarked(metered(requests, None if limit is None else limit).withColumn("us", us), late, "month", _bucket("app_user_id", buckets), user, "req_id", "us", "amount", "limit", "ok")
    known = None if initial is None else initial.select("month", _bucket("app_user_id", buckets), user, F.col("used").cast("long").alias("used")).groupBy("month", "bucket")
    out = rows.groupBy("month", "bucket").transformWithStateInPandas(_Quota(), "req_id long, app_user_id string, month string, admitted boolean, used long", "append", "eventTime", known)
    return out.withColumn("app_user_id", F.col("app_user_id").cast(kind))


class _Cached(StatefulProcessor):
    """When each key of a bucket was last set."""

    def __init__(self, ttl: int):
        self._ttl = ttl

    def init(self, handle):
        self._handle, self._held = handle, handle.getValueState("held", "keys array<string>, at array<bigint>")

    def _read(self) -> dict:
        held = self._held.get()
        return {} if held is None else dict(zip(*held, strict=True))

    def _due(self, at: dict) -> int | None:
        """When the last of the keys goes."""
        return (max(at.values()) + self._ttl) // 1000 + 1 if at else None

    def _keep(self, at: dict, due: int | None, watermark: int) -> None:
        """Writes the keys that the watermark has not passed. One timer, due before, holds for all: a bucket that nobody asks for goes with its last key."""
        at = {k: us for k, us in at.items() if (us + self._ttl) // 1000 >= watermark}
        now = self._due(at)
        if at:
            self._held.update((list(at), list(at.values())))
        else:
            self._held.clear()
        if now != due:
            if due is not None:
                self._handle.deleteTimer(due)
            if now is not None:
                self._handle.registerTimer(now)

    def handleInitialState(self, key, initialState, timerValues):
        at = self._read()
        due = self._due(at)
        for k, us in zip(_listed(initialState["key"]), initialState["us"].tolist(), strict=True):
            at[k] = max(us, at.get(k, NEVER))
        self._keep(at, due, NEVER)

    def handleInputRows(self, key, rows, timerValues):
        rows = _together(rows)
        codes, _ = pd.factorize(rows["key"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        codes, ids, us, ok = codes[order], rows["req_id"].to_numpy()[order], rows["us"].to_numpy()[order], rows["ok"].to_numpy()[order]
        keys, edges = _listed(rows["key"].iloc[order]), np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]]).tolist()
        at = self._read()
        due, hits = self._due(at), np.zeros(len(codes), dtype=bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now, hits[a:b] = ttl_steps(at.get(keys[a], NEVER), us[a:b], ok[a:b], self._ttl)
            if now != NEVER:
                at[keys[a]] = now
        self._keep(at, due, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key": keys, "req_id": ids, "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._keep(self._read(), None, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(columns=["key", "req_id", "hit"])

    def close(self):
        pass


def ttl_dedupe_stream(requests: DataFrame, ttl_hours: int = 24, initial: DataFrame | None = None, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """key, req_id, hit as ttl_dedupe has them, for requests with key, ts and, if it is known, ok.

    initial (key, set_at) is what was set before the stream began. State is one time for a key, and keys share states by buckets; a key goes when its bucket is written and the
    watermark is more than the time to live behind it, at the latest with the last key of its bucket.
    """
    kind = requests.schema["key"].dataType.simpleString()
    key = F.col("key").cast("string").alias("key")
    rows = _watermarked(timed(requests), late, _bucket("key", buckets), key, "req_id", "us", "ok")
    known = None if initial is None else initial.select(_bucket("key", buckets), key, F.unix_micros(F.col("set_at").cast("timestamp")).alias("us")).groupBy("bucket")
    out = rows.groupBy("bucket").transformWithStateInPandas(_Cached(ttl_hours * 3_600_000_000), "key string, req_id long, hit boolean", "append", "eventTime", known)
    return out.withColumn("key", F.col("key").cast(kind))


def page_table(spark: SparkSession, path: str, codec: str | None = None) -> MergedTable:
    """Pages of documents at a path: of a page, the longer text stays, and of texts as long as each other the one that was there."""
    return MergedTable(spark, path, ["doc_id", "page"], ["length(text)"], first_stays=True, codec=codec)


def page_backfill(spark: SparkSession, pages: MergedTable, pending: DataFrame, report: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over recognised pages (doc_id, page, text, confidence): adds them to the table of pages and reports progress of the batch's documents.

    Only the batch is written, and only pages of its documents are read; no text is moved or kept for progress. Blank texts are left out. A batch that comes
    again, or that broke off before it was listed, changes nothing twice.
    """
    some = F.left(X.trim("text"), F.lit(1))  # tells whether a text is blank as well as the whole of it

    def merge(batch: DataFrame, n: int) -> None:
        batch = batch.select("doc_id", "page", "text", F.lit("ocr").alias("source"), "confidence")
        pages.append(batch.where(X.trim("text") != ""), n)
        documents = batch.select("doc_id").distinct().persist()
        have = pages.read(documents, ["doc_id", "page", "source", some.alias("text")]).persist()
        left = pending_except(pending.join(documents, "doc_id", "left_semi"), have.where("source = 'ocr'"))
        report(ocr_progress(have, left), n)
        have.unpersist()
        documents.unpersist()

    return merge
