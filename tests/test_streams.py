"""Streams against their batch twins: several micro-batches, restarts from the checkpoint, ties, nulls, rows out of order within a batch, late rows and state that goes."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import requests as Q
from pagemill.operators import usage as U
from pagemill.sources.tables import FIELDS
from pagemill.streaming import usage as S

SCHEMA = "req_id long, app_user_id string, ts timestamp, month string, amount long, limit long, key string, field string, ok boolean"


def at(hours):
    return None if hours is None else dt.datetime(2024, 1, 20) + dt.timedelta(hours=hours)


def request(k, hours, rng):
    ts = at(hours)
    return (k, f"u{k % 3}", ts, ts and ts.strftime("%Y-%m"), rng.choice([None, 0, 3, 5, 7]), rng.choice([20, 20, 12, None]), rng.choice(["k0", "k1", None]), rng.choice(FIELDS), rng.choice([True, True, False, None]))


def parts_of(rows, n=3):
    size = -(-len(rows) // n)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


@pytest.fixture(scope="module")
def parts():
    """Three batches over three months, in order of time from batch to batch, in reverse order within each, with ties; rows without a time are in the first."""
    rng = random.Random(3)
    hours = sorted(rng.choice(range(0, 1500, 7)) for _ in range(150))
    rows = [request(k, h, rng) for k, h in enumerate([None] * 6 + hours)]
    return [list(reversed(p)) for p in parts_of(rows)]


def replay(spark, parts, start, tmp_path, name):
    """Runs a stream once for each batch, each time anew from the checkpoint; gives what each run's progress says of state rows."""
    path, state = str(tmp_path / f"{name}-in"), []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(path)
        with S.with_rocksdb(spark):
            query = start(spark.readStream.schema(SCHEMA).parquet(path)).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination(180)
        assert query.exception() is None
        state.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    return state


def appended(spark, parts, make, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    state = replay(spark, parts, lambda s: make(s).writeStream.format("parquet").option("path", out).outputMode("append"), tmp_path, name)
    return spark.read.parquet(out), state


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def batch_of(spark, parts):
    return spark.createDataFrame([r for p in parts for r in p], SCHEMA)


def test_counters(spark, parts, tmp_path):
    """Sums of on-time and late rows are those of the batch twin; a month's state goes once the watermark has passed it."""
    late = [(900 + k, f"u{k % 3}", at(24 * k), "2024-01", 1000, None, None, "pdfs", True) for k in range(4)]
    path = str(tmp_path / "counters")
    state = replay(spark, [*parts, late], lambda s: S.usage_stream(s).writeStream.outputMode("update").foreachBatch(S.keep_counters(spark, path)), tmp_path, "counters")
    want = U.usage_monthly(batch_of(spark, [*parts, late])).select("month", "app_user_id", *FIELDS)
    assert rows_of(S.read_counters(spark, path).select("month", "app_user_id", *FIELDS)) == rows_of(want)
    held = spark.createDataFrame([r for p in parts for r in p], SCHEMA).where("month is not null").groupBy("month", "app_user_id").count().count()
    assert held == 9 and state[-1] <= 2 * 3 * 8 < 9 * 8 and state[-1] == state[-2]
    side = S.MergedTable(spark, f"{path}/late", ["month", "app_user_id", "part", "batch"]).read()
    assert side.where("month = '2024-01'").agg(F.sum("pdfs")).first()[0] == 4000 and side.where("month is null").count() > 0


def test_quota(spark, parts, tmp_path):
    got, state = appended(spark, parts, S.quota_stream, tmp_path, "quota")
    columns = ["req_id", "app_user_id", "month", "admitted", "used"]
    assert rows_of(got.select(columns)) == rows_of(U.quota_admit_amount(batch_of(spark, parts)).select(columns))
    assert got.where("not admitted").count() > 5 and state[-1] < 3 * 4


def test_quota_goes_on_from_before_and_refuses_late_requests(spark, tmp_path):
    initial = spark.createDataFrame([("u0", "2024-01", 15), ("u2", "2024-01", 3)], "app_user_id string, month string, used long")
    row = lambda k, user, hours, amount: (k, user, at(hours), at(hours).strftime("%Y-%m"), amount, 20, None, None, True)
    batches = [[row(1, "u0", 1, 6), row(2, "u0", 2, 5), row(3, "u1", 1, 20)], [row(4, "u0", 24 * 40, 20)], [row(5, "u0", 3, 1), row(6, "u0", 24 * 40, 1)]]
    got, _ = appended(spark, batches, lambda s: S.quota_stream(s, initial=initial), tmp_path, "initial")
    assert sorted((r.req_id, r.admitted, r.used) for r in got.collect()) == [(1, False, 15), (2, True, 20), (3, True, 20), (4, True, 20), (5, False, None), (6, False, 20)]


def test_cached(spark, parts, tmp_path):
    got, state = appended(spark, parts, S.ttl_dedupe_stream, tmp_path, "cached")
    columns = ["key", "req_id", "hit"]
    assert rows_of(got.select(columns)) == rows_of(U.ttl_dedupe(batch_of(spark, parts)).select(columns))
    assert got.where("hit").count() > 5 and state[-1] <= 3 * 2


def test_cached_goes_on_from_before(spark, tmp_path):
    initial = spark.createDataFrame([("k0", at(-10)), ("k1", at(-30))], "key string, set_at timestamp")
    row = lambda k, key, hours: (k, "u", at(hours), None, None, None, key, None, True)
    got, state = appended(spark, [[row(1, "k0", 14), row(2, "k1", 0)], [row(3, "k0", 15), row(4, "k0", 16)], [row(5, "z", 24 * 30)]], lambda s: S.ttl_dedupe_stream(s, initial=initial), tmp_path, "before")
    assert sorted((r.req_id, r.hit) for r in got.collect()) == [(1, True), (2, False), (3, False), (4, True), (5, False)] and state[-1] <= 2


def test_only_fresh_work_that_succeeded_sets_a_key(spark):
    rows = [(1, 0, False), (2, 1, True), (3, 2, True), (4, 24.9, False), (5, 25.1, False), (6, 25.2, True), (7, 49.3, True), (8, None, True)]
    frame = spark.createDataFrame([(k, at(h), ok, "k") for k, h, ok in rows], "req_id long, ts timestamp, ok boolean, key string")
    assert {r.req_id: r.hit for r in U.ttl_dedupe(frame).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}


def test_limits_of_tiers(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "req_id long, app_user_id string")
    users = spark.createDataFrame([("a", "power"), ("b", "gone")], "app_user_id string, tier string")
    got = {r.req_id: r.limit for r in U.with_limits(requests, users, U.tiers(spark), "cloudVoiceChars").collect()}
    assert got == {1: 100_000, 2: 0, 3: 0, 4: 0}


PAGES = "doc_id string, page int, text string, source string, confidence int"
NEW = "doc_id string, page int, text string, confidence int"


def written(table):
    return {r["name"]: r["bytes"] for r in table.state()["runs"]}


def test_backfill(spark, tmp_path):
    """Two batches: what a batch does not replace keeps its text, source and confidence, and each batch adds no more than its own rows."""
    pages, new, seen = S.page_table(spark, str(tmp_path / "pages")), str(tmp_path / "new"), []
    many = [(f"x{k}", 1, "y" * 200 + str(k), "native", None) for k in range(5000)]
    pages.append(spark.createDataFrame([("d", 1, "abc", "native", None), ("d", 2, "", "native", None), ("d", 4, None, "native", None), ("e", 1, "x", "ocr", 50), *many], PAGES))
    first = written(pages)
    pending = spark.createDataFrame([("d", 2), ("d", 3), ("x1", 9)], "doc_id string, page int")
    for rows in ([("d", 2, "recognised", 90), ("d", 2, "rec", 10)], [("d", 3, "third", 70), ("d", 2, "short", 20), ("d", 1, " ", 5), ("d", 1, "xyz", 1), ("d", 4, "four", 4)]):
        spark.createDataFrame(rows, NEW).coalesce(1).write.mode("append").parquet(new)
        merge = S.page_backfill(spark, pages, pending, lambda df, n: seen.append([tuple(r) for r in df.collect()]))
        spark.readStream.schema(NEW).parquet(new).writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [[("d", 2, 1, 1, 50)], [("d", 3, 3, 0, 100)]]
    got = {tuple(r) for r in pages.read().where("doc_id not like 'x%'").collect()}
    assert got == {("d", 1, "abc", "native", None), ("d", 2, "recognised", "ocr", 90), ("d", 3, "third", "ocr", 70), ("d", 4, "four", "ocr", 4), ("e", 1, "x", "ocr", 50)}
    assert pages.read().count() == 5005
    (large,), runs = first.values(), written(pages)
    assert set(first) < set(runs) and sum(runs.values()) - large < large / 20


def test_backfill_that_breaks_off(spark, tmp_path, monkeypatch):
    """What is written but not listed does not count, and the batch that comes again is added once."""
    pages = S.page_table(spark, str(tmp_path / "pages"))
    pages.append(spark.createDataFrame([("d", 1, "abc", "native", None)], PAGES))
    before = pages.state()
    batch = spark.createDataFrame([("d", 1, "longer text", 9), ("d", 2, "two", 8)], NEW)
    merge = S.page_backfill(spark, pages, spark.createDataFrame([], "doc_id string, page int"), lambda df, n: df.collect())
    with monkeypatch.context() as broken:
        broken.setattr(type(pages), "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            merge(batch, 0)
    assert pages.state() == before and pages.read().count() == 1
    merge(batch, 0)
    after = pages.state()
    merge(batch, 0)
    assert pages.state() == after and sorted((r.page, r.text) for r in pages.read().collect()) == [(1, "longer text"), (2, "two")]


def test_replies(spark):
    rows = spark.createDataFrame([("not json",), ('{"summary":"s","key_points":"x"}',), (None,)], "raw string").select(Q.parse_ai_result(F.col("raw")).alias("x")).select("x.*").collect()
    assert [(r.summary, r.key_points, r.answer) for r in rows] == [("not json", [], None), ("s", [], None), ("", [], None)]


def test_states_follow_buckets_and_not_keys(spark, tmp_path):
    """Of 400 users and keys, null ones among them, over two micro-batches: as many states as buckets, and the rows of the batch twins."""
    row = lambda k, hours: (k, k % 399 and f"u{k % 399}" or None, at(hours), at(hours).strftime("%Y-%m"), k % 5, 9, k % 399 and f"k{k % 399}" or None, FIELDS[k % 6], k % 4 != 1)
    batches = [[row(k, 1) for k in range(1000)], [row(k, 20) for k in range(1000, 1800)]]
    path = str(tmp_path / "few")
    state = replay(spark, batches, lambda s: S.usage_stream(s, parts=2, buckets=3).writeStream.outputMode("update").foreachBatch(S.keep_counters(spark, path)), tmp_path, "few-counters")
    assert rows_of(S.read_counters(spark, path).select("month", "app_user_id", *FIELDS)) == rows_of(U.usage_monthly(batch_of(spark, batches)).select("month", "app_user_id", *FIELDS)) and max(state) <= 2 * 3
    got, state = appended(spark, batches, lambda s: S.ttl_dedupe_stream(s, buckets=3), tmp_path, "few-keys")
    assert rows_of(got.select("key", "req_id", "hit")) == rows_of(U.ttl_dedupe(batch_of(spark, batches)).select("key", "req_id", "hit")) and max(state) <= 2 * 3
    got, state = appended(spark, batches, lambda s: S.quota_stream(s, buckets=3), tmp_path, "few-users")
    columns = ["req_id", "app_user_id", "month", "admitted", "used"]
    assert rows_of(got.select(columns)) == rows_of(U.quota_admit_amount(batch_of(spark, batches)).select(columns)) and max(state) <= 2 * 3


def test_backfill_numbers_its_pages_once(spark, monkeypatch):
    from pagemill.plans import metering as M

    calls, books = [], M.books
    monkeypatch.setattr(M, "books", lambda *a: calls.append(a) or books(*a))
    assert M.page_backfill(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1


def test_backfill_keeps_few_copies(spark, tmp_path, monkeypatch):
    """What the query writes of its texts is less than four times its input."""
    from pagemill.plans import metering as M

    monkeypatch.setattr(M, "scratch", lambda _: str(tmp_path / os.urandom(8).hex()))
    path = "/root/testdata/sf0.01"
    assert M.page_backfill(spark, path).count() > 0
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 4 * os.path.getsize(f"{path}/documents.parquet")
