"""Libraries, chunks, sessions and metering against plain Python, with hot keys, ties, nulls and borders of ranges."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import ranges as G
from pagemill.operators import reading as R
from pagemill.operators import usage as U

EVENTS = "doc_id string, event_id long, ts timestamp, kind string, title string, page_count int, page int, sentence int, total int"


def at(hours):
    return None if hours is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def shelf(events):
    """What a reader's shelf holds after the events, one after another."""
    items = {}
    for doc, _, ts, kind, title, count, page, sentence, total in sorted(events, key=lambda e: (e[2] is not None, e[2] or at(0), e[1])):
        own = items.get(doc)
        if kind == "remove":
            items.pop(doc, None)
        elif kind == "open":
            items[doc] = {"added_at": ts, "last_page": 1, "last_sentence": 0, "progress": 0.0} | (own or {}) | {"title": title, "page_count": count, "updated_at": ts}
        elif kind == "progress" and own:
            pages = max(1, total or own["page_count"] or 1)
            own |= {"last_page": max(1, page or 1), "last_sentence": max(0, sentence or 0), "progress": min(1.0, max(0.0, (page or 0) / pages)), "updated_at": ts}
    return items


def library(spark, events, parts=G.PARTS):
    rows = R.library_latest(spark.createDataFrame(events, EVENTS).repartition(3), parts).collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: {c: r[c] for c in r.__fields__ if c != "doc_id"} for r in rows}


def test_removed_and_opened_again(spark):
    """Opened at 1, read to page 7, removed, opened again at 4: added at 4, page 1."""
    events = [("d", 1, at(1), "open", "a", 10, None, None, None), ("d", 2, at(2), "progress", None, None, 7, 5, 20), ("d", 3, at(3), "remove", None, None, None, None, None), ("d", 4, at(4), "open", "b", 10, None, None, None)]
    assert library(spark, events) == {"d": {"title": "b", "page_count": 10, "added_at": at(4), "updated_at": at(4), "last_page": 1, "last_sentence": 0, "progress": 0.0}}
    assert library(spark, events[:3]) == {} and library(spark, events[1:2]) == {}
    assert library(spark, events[:2])["d"]["progress"] == 7 / 20


@pytest.mark.parametrize("seed", range(6))
def test_library_by_brute_force(spark, seed):
    rng = random.Random(seed)
    events = []
    for k in range(400):
        kind = rng.choice(["open", "progress", "progress", "remove", "other"] if seed % 2 else ["open", "progress", "progress", "progress", "progress"])
        events.append((rng.choice(["hot", "hot", "a", "b", None]), k, at(rng.choice([None, *range(60)])), kind, f"t{k}", rng.choice([None, 0, 9]), rng.choice([None, -2, 0, 3, 40]), rng.choice([None, -1, 8]), rng.choice([None, 0, -4, 20])))
    assert library(spark, events, rng.choice([2, 5, 64])) == shelf(events)


def test_progress(spark):
    events = spark.createDataFrame([(1, "d", 0, -1, 10), (2, "d", -3, 4, 0), (3, "d", 5, None, None), (4, "e", 5, 0, 0), (5, None, None, None, 7), (6, "d", 99, 0, 10)], "k int, doc_id string, page int, sentence int, total int")
    headers = spark.createDataFrame([("d", 20), ("f", 1)], "doc_id string, page_count int")
    got = {r.k: (r.last_page, r.last_sentence, r.progress) for r in R.reading_progress(events, headers).collect()}
    assert got == {1: (1, 0, 0.0), 2: (1, 4, 0.0), 3: (5, 0, 0.25), 4: (5, 0, 1.0), 5: (1, 0, 0.0), 6: (99, 0, 1.0)}


def test_missing_products(spark):
    expected = spark.createDataFrame([("a:b",), ("a",), ("a:b:c",), ("b",), ("a:",), ("",), ("c",)], "expected string")
    offered = spark.createDataFrame([("a:b:c",), ("bb",), ("c",), (None,)], "offered string")
    assert {r.expected for r in R.missing_products(expected, offered).collect()} == {"b", "a:", ""}
    assert R.missing_products(expected, offered.limit(0)).count() == 7


@pytest.mark.parametrize("stretch", [3, 4096])
def test_chunk_of_page(spark, monkeypatch, stretch):
    monkeypatch.setattr(R, "PAGES_A_STRETCH", stretch)
    rng = random.Random(stretch)
    chunks, refs = [], [(d, p) for d in ("a", "b", "none", None) for p in (None, *range(-3, 130, 2), 7, 7)]
    for d in ("a", "b", None):
        page = rng.randint(1, 5)
        for k in range(20):
            size = rng.choice([0, 1, 2, 9])
            chunks.append((d, k, page, page + size))
            page += size + rng.choice([1, 1, 4])
    got = Counter(tuple(r) for r in R.chunk_of_page(spark.createDataFrame(refs, "doc_id string, page int"), spark.createDataFrame(chunks, "doc_id string, chunk_ix int, start_page int, end_page int")).collect())
    want = Counter((d, p, next((k for e, k, a, b in chunks if e == d and p is not None and a <= p <= b), -1)) for d, p in refs)
    assert got == want


def test_chunks_are_swept_and_not_joined_with_pages(spark):
    refs, chunks = spark.range(5000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page")), spark.range(5000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("chunk_ix"), F.col("id").cast("int").alias("start_page"), F.col("id").cast("int").alias("end_page"))
    rows = R.chunk_of_page(refs, chunks)
    plan = str(rows._jdf.queryExecution().optimizedPlan())
    assert "doc_id" not in " ".join(x for x in plan.splitlines() if "Join" in x and "_at" not in x) and rows.where("chunk_ix = page").count() == 5000


def test_page_chunks_of_a_long_document(spark):
    pages = spark.createDataFrame([("d", p * 3) for p in range(1, 2001)] + [("e", 5), (None, 1)], "doc_id string, page int").repartition(4)
    got = sorted(map(tuple, R.page_chunks(pages).where("doc_id = 'd'").collect()))
    assert got == [("d", k, 30 * k + 3, 30 * k + 30) for k in range(200)]


@pytest.mark.parametrize("parts", [2, 64])
def test_sessions(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "a", None]), k, rng.choice([None, *(15 * x for x in range(800))])) for k in range(900)]
    frame = spark.createDataFrame([(key, k, at(None if m is None else m / 60)) for key, k, m in rows], "key string, req_id long, ts timestamp").repartition(4)
    got = {r.req_id: r.session_id for r in U.sliding_sessions(frame, "key", parts=parts).collect()}
    for key in {r[0] for r in rows}:
        session, last = 0, None
        for _, k, m in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            session += last is not None and m - last >= 45
            last = m if m is not None else last
            assert got[k] == session
    assert len(got) == 900


def test_entitlements_of_many_grants(spark):
    """One row for each entitlement, by the grant that lasts longest."""
    requests = spark.createDataFrame([(k, "u", at(k)) for k in range(20)] + [(50, "v", at(1)), (51, "u", None), (52, None, at(1))], "req_id long, app_user_id string, ts timestamp")
    grants = [("u", "pro", f"2024-01-01 {h:02d}:00:00") for h in range(10)] * 50 + [("u", "plus", None), ("u", "plus", "2020-01-01"), ("u", "bad", "soon"), ("v", "pro", "2023-01-01"), (None, "pro", None)]
    got = Counter(tuple(r) for r in U.active_entitlements(requests, spark.createDataFrame(grants, "app_user_id string, entitlement_id string, expires string")).collect())
    assert got == Counter([(k, "pro") for k in range(9)] + [(k, "plus") for k in [*range(20), 51]])


def test_quota_steps():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.choice([0, 5, 60, 400])
        amounts, limits, ok = np.array([rng.randint(0, 6) for _ in range(n)], dtype=np.int64), np.array([rng.choice([90, 90, 200, 5]) for _ in range(n)], dtype=np.int64), np.array([rng.random() < 0.9 for _ in range(n)], dtype=bool)
        used = start = rng.randint(0, 20)
        want = []
        for a, m, fine in zip(amounts, limits, ok, strict=True):
            fits = used + a <= m
            used = used + a if fits and fine else used
            want.append((fits, used))
        end, admitted, after = U.quota_steps(start, amounts, limits, ok)
        assert end == used and list(zip(admitted, after, strict=True)) == want


def test_ttl_steps():
    rng = random.Random(10)
    for _ in range(500):
        n = rng.choice([0, 4, 40])
        us = np.array(sorted(rng.choice([U.NEVER, *range(60)]) for _ in range(n)), dtype=np.int64)
        ok = np.array([rng.random() < 0.6 for _ in range(n)], dtype=bool)
        start = now = rng.choice([U.NEVER, 3, -5])
        want = []
        for t, fine in zip(us.tolist(), ok, strict=True):
            want.append(t != U.NEVER and now != U.NEVER and t <= now + 7)
            now = t if not want[-1] and fine and t != U.NEVER else now
        end, hits = U.ttl_steps(start, us, ok, 7)
        assert end == now and hits.tolist() == want


def test_metering_over_batches_and_keys(spark):
    """Keys that go over many Arrow batches, nulls among keys and amounts, and limits of each request."""
    rng = random.Random(11)
    rows = [(k, rng.choice(["hot", "hot", "b", None]), rng.choice(["2024-01", "2024-02", None]), k // 3, rng.choice([None, 1, 4]), rng.choice([30, None, 500]), rng.choice([True, False, None])) for k in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.req_id: (r.admitted, r.used) for r in U.quota_admit_amount(spark.createDataFrame(rows, "req_id long, app_user_id string, month string, ts long, amount long, limit long, ok boolean").repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    used = defaultdict(int)
    for k, user, month, _, amount, limit, ok in rows:
        fits = used[user, month] + (amount or 0) <= (limit or 0)
        used[user, month] += (amount or 0) if fits and ok is not False else 0
        assert got[k] == (fits, used[user, month])
    assert len(got) == 2000


def test_contexts_of_one_book_are_many_groups(spark):
    """Pages at borders of stretches see both sides, also where pages are missing, and no window goes over a whole document."""
    pages = [p for p in range(1, 300) if p % 9 or p % 64 == 0]
    rows = spark.createDataFrame([("d", k, p, f"t{p}") for k, p in enumerate(pages)] + [("e", 0, None, "none")], "doc_id string, id long, page int, text string")
    out = R.context_text(rows)
    got = {(r.doc_id, r.page): r.context for r in out.collect()}
    assert got == {("d", p): " ".join(f"t{q}" for q in pages if abs(q - p) <= 2) for p in pages} | {("e", None): "none"}
    assert "_stretch" in next(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window " in x)


def test_anchors_read_sentences_once(spark):
    rows = spark.range(40).selectExpr("'d' doc_id", "id", "cast(id div 10 as int) page", "concat('t', id) text")
    anchors = spark.createDataFrame([("d", 0, 3), ("d", 0, 3), ("d", 1, 99), ("d", 2, -1), ("d", 9, 0), ("d", 3, None)], "doc_id string, page int, k int")
    out = R.reanchor(anchors, rows)
    assert sorted((r.page, r.id) for r in out.collect()) == [(0, 3), (0, 3), (1, 19), (3, 39)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
