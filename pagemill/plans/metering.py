"""Queries on usage, versions of pages and reading state, with SQL for each."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagemill.operators import lines as L
from pagemill.operators import reading as R
from pagemill.operators import requests as Q
from pagemill.operators import speech as P
from pagemill.operators import usage as U
from pagemill.operators import versions as V
from pagemill.operators.ranges import cuts, range_of
from pagemill.plans.text import BP, NEEDS, SE, TRIM
from pagemill.sources import tables as S
from pagemill.sources.tables import books, expire_results, read_table, read_versions, scratch, swept, usage_events
from pagemill.streaming import usage as ST

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


EV = """ev AS (SELECT event_id AS req_id, user_id AS app_user_id, ts, strftime(ts, '%Y-%m') AS month,
CASE event_type WHEN 'signup' THEN 'pdfs' WHEN 'click' THEN 'aiActions' WHEN 'purchase' THEN 'cloudVoiceChars' WHEN 'view' THEN 'cacheHits' ELSE 'failedRequests' END AS field,
CAST(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 1 END AS BIGINT) AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""
MONTHLY = EV + ",\nmu AS (SELECT month, app_user_id, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN field = '{f}' THEN amount END), 0) AS BIGINT) AS {f}" for f in ["ocrPages", "aiActions", "cloudVoiceChars", "pdfs", "failedRequests", "cacheHits"]) + " FROM ev GROUP BY month, app_user_id)"
_SQL = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
TIERS = f"tiers({', '.join(U.TIER_FIELDS)}) AS (VALUES {', '.join('(' + ', '.join(map(_SQL, t)) + ')' for t in U.TIERS)})"
UT = "en AS (SELECT DISTINCT user_id AS app_user_id, CASE user_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'reader_plus' WHEN 2 THEN 'ai_pro' ELSE 'power' END AS e FROM events), ut AS (SELECT app_user_id, coalesce(arg_max(key, rank), 'free') AS tier FROM en LEFT JOIN tiers ON e = key GROUP BY app_user_id)"


def _requests(spark, d):
    return usage_events(spark, d).withColumnRenamed("event_id", "req_id").withColumn("month", U.month_of("ts"))


def _entitlements(spark, d):
    k = F.col("user_id") % 4
    return read_table(spark, d, "events").select(F.col("user_id").alias("app_user_id"), F.when(k == 0, "none").when(k == 1, "reader_plus").when(k == 2, "ai_pro").otherwise("power").alias("entitlement_id")).distinct()


@query(f"WITH {MONTHLY} SELECT * FROM mu")
def usage_monthly(spark, d):
    return U.usage_monthly(usage_events(spark, d))


@query(f"WITH {TIERS}, {UT} SELECT app_user_id, tier FROM ut")
def highest_tier(spark, d):
    return U.highest_tier(_entitlements(spark, d), U.tiers(spark))


@query(f"""WITH {MONTHLY}, {TIERS}, {UT},
c AS (SELECT month, mu.app_user_id, unnest([{{'field': 'ocrPages', 'used': mu.ocrPages, 'm': t.ocrPages}}, {{'field': 'aiActions', 'used': mu.aiActions, 'm': t.aiActions}}, {{'field': 'cloudVoiceChars', 'used': mu.cloudVoiceChars, 'm': t.cloudVoiceChars}}, {{'field': 'pdfs', 'used': mu.pdfs, 'm': t.pdfs}}]) AS x
FROM mu JOIN ut USING (app_user_id) JOIN tiers t ON t.key = ut.tier)
SELECT month, app_user_id, x.field AS field, x.used AS used, CAST(x.m AS BIGINT) AS "limit", CAST(greatest(0, x.m - x.used) AS BIGINT) AS remaining FROM c""")
def usage_remaining(spark, d):
    return U.usage_remaining(U.usage_monthly(usage_events(spark, d)), U.highest_tier(_entitlements(spark, d), U.tiers(spark)), U.tiers(spark))


@query(f"""WITH {EV} SELECT month, app_user_id, count(*) FILTER (o = 'hit') AS hits, count(*) FILTER (o = 'fresh') AS fresh, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'denied') AS denied
FROM (SELECT *, CASE field WHEN 'cacheHits' THEN 'hit' WHEN 'failedRequests' THEN 'failed' WHEN 'pdfs' THEN 'denied' ELSE 'fresh' END AS o FROM ev) GROUP BY month, app_user_id""")
def request_outcomes(spark, d):
    outcome = F.when(F.col("field") == "cacheHits", "hit").when(F.col("field") == "failedRequests", "failed").when(F.col("field") == "pdfs", "denied").otherwise("fresh")
    return U.request_outcomes(_requests(spark, d).withColumn("outcome", outcome))


@query(f"WITH {EV} SELECT req_id, row_number() OVER (PARTITION BY app_user_id, month, field ORDER BY ts, req_id) <= 5 AS admitted FROM ev")
def quota_admit_unit(spark, d):
    return U.quota_admit_unit(_requests(spark, d), F.lit(5)).select("req_id", "admitted")


@query(f"""WITH RECURSIVE {EV.replace("ev AS", "ev AS MATERIALIZED")}, {TIERS}, {UT},
o AS MATERIALIZED (SELECT req_id, app_user_id, month, amount, req_id % 10 <> 3 AS ok, t.cloudVoiceChars // 50 AS lim, row_number() OVER (PARTITION BY app_user_id, month ORDER BY ts, req_id) AS k FROM ev JOIN ut USING (app_user_id) JOIN tiers t ON t.key = ut.tier WHERE field = 'cloudVoiceChars'),
w AS (SELECT req_id, app_user_id, month, k, amount <= lim AS admitted, CASE WHEN amount <= lim AND ok THEN amount ELSE 0 END AS used FROM o WHERE k = 1
UNION ALL SELECT o.req_id, o.app_user_id, o.month, o.k, w.used + o.amount <= lim, CASE WHEN w.used + o.amount <= lim AND ok THEN w.used + o.amount ELSE w.used END FROM w JOIN o ON o.app_user_id = w.app_user_id AND o.month = w.month AND o.k = w.k + 1)
SELECT req_id, app_user_id, month, admitted, CAST(used AS BIGINT) AS used FROM w""")
def quota_admit_amount(spark, d):
    return U.quota_admit_amount(_voice_requests(spark, d)).select("req_id", "app_user_id", "month", "admitted", "used")


def _voice_requests(spark, d):
    """Requests for voice with the limits of their user's tier, at a fiftieth so that they are met; a tenth of the requests fail."""
    small = U.tiers(spark).withColumn("cloudVoiceChars", F.floor(F.col("cloudVoiceChars") / 50))
    rows = _requests(spark, d).where("field = 'cloudVoiceChars'").withColumn("ok", F.col("req_id") % 10 != 3)
    return U.with_limits(rows, U.highest_tier(_entitlements(spark, d), U.tiers(spark)), small, "cloudVoiceChars")


@query(f"""WITH {EV} SELECT req_id, CAST(g AS BIGINT) AS granted, CAST(k - g AS BIGINT) AS pending FROM (
SELECT req_id, k, greatest(0, least(k, 1000 - coalesce(sum(k) OVER (PARTITION BY app_user_id, month ORDER BY ts, req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS g FROM ev)""")
def quota_trim_pages(spark, d):
    return U.quota_trim_pages(_requests(spark, d).withColumnRenamed("k", "n"), F.lit(1000)).select("req_id", "granted", "pending")


@query(f"""WITH RECURSIVE {EV.replace("ev AS", "ev AS MATERIALIZED")},
o AS MATERIALIZED (SELECT req_id, ts, req_id % 4 <> 1 AS ok, field || '|' || app_user_id AS key, row_number() OVER (PARTITION BY field || '|' || app_user_id ORDER BY ts, req_id) AS i FROM ev),
w AS (SELECT req_id, key, i, false AS hit, CASE WHEN ok THEN ts END AS set_at FROM o WHERE i = 1
UNION ALL SELECT o.req_id, o.key, o.i, coalesce(o.ts <= w.set_at + INTERVAL 24 HOUR, false), CASE WHEN coalesce(o.ts <= w.set_at + INTERVAL 24 HOUR, false) OR NOT o.ok THEN w.set_at ELSE o.ts END FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
SELECT key, req_id, hit FROM w""")
def ttl_dedupe(spark, d):
    return U.ttl_dedupe(_keyed(spark, d))


def _keyed(spark, d):
    """Requests with the key of what they ask for; a fourth of them fail or are denied, if they are fresh."""
    return _requests(spark, d).withColumn("key", F.concat_ws("|", "field", "app_user_id")).withColumn("ok", F.col("req_id") % 4 != 1)


@query(f"""WITH {EV} SELECT req_id, CAST(sum(p) OVER (PARTITION BY app_user_id ORDER BY ts, req_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY app_user_id ORDER BY ts, req_id) >= INTERVAL 45 MINUTE THEN 1 ELSE 0 END AS p FROM ev)""")
def sliding_sessions(spark, d):
    return U.sliding_sessions(_requests(spark, d), "app_user_id").select("req_id", "session_id")


ROUTE = "CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'ai' WHEN 'signup' THEN 'ai' ELSE 'tts' END"


@query(f"""WITH r AS (SELECT user_id % 40 AS app_user_id, {ROUTE} AS route, date_trunc('week', ts) AS minute FROM events)
SELECT app_user_id, route, minute, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > CASE route WHEN 'extract' THEN 12 WHEN 'ai' THEN 20 ELSE 180 END""")
def rate_violations(spark, d):
    """A week's requests within one minute, so that limits are met."""
    seconds = F.expr("make_interval(0, 0, 0, 0, 0, 0, event_id % 60)")
    rows = read_table(spark, d, "events").select((F.col("user_id") % 40).alias("app_user_id"), F.expr(ROUTE).alias("route"), (F.date_trunc("week", "ts") + seconds).alias("ts"))
    return U.rate_violations(rows).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(f"""WITH {EV}, g AS (SELECT user_id AS app_user_id, CASE event_id % 3 WHEN 0 THEN 'ai_pro' WHEN 1 THEN 'power' ELSE 'reader_plus' END AS entitlement_id,
CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts + to_days(CAST(event_id % 4 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS expires FROM events)
SELECT DISTINCT req_id, entitlement_id FROM ev JOIN g USING (app_user_id) WHERE expires IS NULL OR TRY_CAST(expires AS TIMESTAMP) > ts""")
def active_entitlement(spark, d):
    """Every event is a grant as well, so users have many for each entitlement."""
    k = F.col("event_id")
    name = F.when(k % 3 == 0, "ai_pro").when(k % 3 == 1, "power").otherwise("reader_plus")
    end = F.when(k % 97 == 0, F.lit(None)).when(k % 5 == 0, "soon").otherwise(F.date_format(F.col("ts") + F.make_interval(days=(k % 4).cast("int")), "yyyy-MM-dd HH:mm:ss"))
    grants = read_table(spark, d, "events").select(F.col("user_id").alias("app_user_id"), name.alias("entitlement_id"), end.alias("expires"))
    return U.active_entitlements(_requests(spark, d), grants)


@query(f"""WITH {TIERS}, u AS (SELECT DISTINCT user_id AS app_user_id FROM events),
c AS (SELECT key, 0.84::DOUBLE * least(monthly, yearly / 12) AS net, cloudVoiceChars * (30 / 1000000::DOUBLE) + aiActions * 0.00185::DOUBLE AS cost FROM tiers WHERE ai OR voice), {UT}
SELECT app_user_id, tier, net, net * 0.2::DOUBLE AS budget, cost, cost <= net * 0.2::DOUBLE + 0.005 AS ok FROM ut JOIN c ON tier = key""")
def plan_economics(spark, d):
    users = U.highest_tier(_entitlements(spark, d), U.tiers(spark))
    return users.join(F.broadcast(U.plan_economics(U.tiers(spark)).withColumnRenamed("key", "tier")), "tier").select("app_user_id", "tier", "net", "budget", "cost", "ok")


@query(f"WITH {BP} SELECT doc_id, volume, 100.0::DOUBLE * 25 / volume AS usd_per_100 FROM (SELECT doc_id, count(*) AS volume FROM bp GROUP BY doc_id)")
def ocr_unit_cost(spark, d):
    return U.ocr_unit_cost(books(spark, d).groupBy("doc_id").agg(F.count("*").alias("volume")), 25)


# versions of pages: recognised texts are blank, shorter or longer by the length of the page's own
LOW = "length(trim(text)) < 600"
OCR = "oc AS (SELECT doc_id, page, CASE WHEN length(text) < 100 THEN ' ' WHEN length(text) < 1000 THEN substr(text, 2) ELSE text || ' more' END AS text, length(text) % 101 AS confidence FROM bp)"
#: Pages that are there: all but very long ones; recognised ones have a confidence.
HAVE = "hv AS (SELECT *, CASE WHEN source = 'ocr' THEN length(text) % 89 END AS confidence FROM bp WHERE length(text) < 8000)"


def _pages(spark, d, pages=None):
    return books(spark, d) if pages is None else pages


def _recognised(spark, d, pages=None):
    n = F.length("text")
    return _pages(spark, d, pages).select("doc_id", "page", F.when(n < 100, " ").when(n < 1000, F.expr("substr(text, 2)")).otherwise(F.concat("text", F.lit(" more"))).alias("text"), (n % 101).alias("confidence"))


def _have(spark, d, pages=None):
    return _pages(spark, d, pages).where(F.length("text") < 8000).withColumn("confidence", F.when(F.col("source") == "ocr", F.length("text") % 89))


def _low(spark, d, pages=None):
    return _pages(spark, d, pages).where(F.expr(LOW))


@query(f"""WITH {BP}, {OCR}, {HAVE}, o AS (SELECT * FROM oc WHERE trim(text) <> '')
SELECT doc_id, page, CASE WHEN w THEN n ELSE t END AS text, CASE WHEN w THEN 'ocr' ELSE source END AS source, CASE WHEN w THEN c ELSE confidence END AS confidence FROM (
SELECT doc_id, page, hv.text AS t, hv.source, hv.confidence, o.text AS n, o.confidence AS c, o.text IS NOT NULL AND (hv.text IS NULL OR length(o.text) > length(hv.text)) AS w FROM hv FULL JOIN o USING (doc_id, page))""")
def merge_ocr_longer(spark, d):
    low = _low(spark, d)
    return V.merge_ocr_longer(_have(spark, d), _recognised(spark, d), low, low)[0]


@query(f"WITH {BP} SELECT doc_id, page FROM bp WHERE source = 'ocr' AND NOT {LOW}")
def merge_ocr_longer_pending(spark, d):
    """What is left after the low pages were asked for, blank results included."""
    return V.merge_ocr_longer(_have(spark, d), _recognised(spark, d), books(spark, d).where("source = 'ocr'"), _low(spark, d))[1].select("doc_id", "page")


STRICT = f"""{BP}, {OCR}, {HAVE}, j AS (SELECT hv.*, o.text AS n, o.confidence AS c, coalesce(trim(o.text) <> '' AND (length(trim(hv.text)) < 600 OR length(o.text) > length(hv.text)), false) AS replaced FROM hv LEFT JOIN oc o USING (doc_id, page))"""


@query(f"WITH {STRICT} SELECT doc_id, page, CASE WHEN replaced THEN n ELSE text END AS text, CASE WHEN replaced THEN 'ocr' ELSE source END AS source, CASE WHEN replaced THEN c ELSE confidence END AS confidence, replaced FROM j")
def merge_ocr_strict(spark, d):
    return V.merge_ocr_strict(_have(spark, d).withColumn("low", F.expr(LOW)), _recognised(spark, d), _low(spark, d), F.lit(False))[0]


@query(f"WITH {STRICT} SELECT doc_id, page FROM j WHERE length(trim(text)) < 600 AND NOT replaced")
def merge_ocr_strict_pending(spark, d):
    return V.merge_ocr_strict(_have(spark, d).withColumn("low", F.expr(LOW)), _recognised(spark, d), _low(spark, d), F.lit(False))[1].select("doc_id", "page")


@query(f"""WITH {BP}, r AS (SELECT doc_id, {NEEDS.format('t')} AS low, length(t) >= 40 AS l FROM (SELECT doc_id, {TRIM.format('text')} AS t FROM bp)),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (low) AS low, count(*) FILTER (NOT low AND l) AS good, count(*) FILTER (low AND l) AS bad FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN low = 0 OR good > 0 THEN false ELSE bad >= greatest(2, ceil(n * 0.2::DOUBLE)) END AS needs FROM c""")
def doc_needs_paid_ocr(spark, d):
    return V.doc_needs_paid_ocr(books(spark, d), F.lit("eng"))


@query(f"""WITH {BP}, k AS (SELECT doc_id, page, CASE WHEN length(text) < 2000 THEN '' ELSE text END AS text, source, CASE WHEN substr(doc_id, -1) IN ('0', '2', '4') THEN 'pdf' ELSE 'docx' END AS kind FROM bp WHERE substr(doc_id, -1) <> '2'
UNION ALL SELECT doc_id, page, ' ', source, 'pdf' FROM bp WHERE substr(doc_id, -1) = '2')
SELECT doc_id, bool_or(trim(text) <> '') AS has_text, bool_or(kind = 'pdf') AND NOT bool_or(trim(text) <> '') AS scanned, count(*) FILTER (source = 'ocr') AS ocr_pages FROM k GROUP BY doc_id""")
def doc_flags(spark, d):
    last = F.substring("doc_id", -1, 1)
    pages = books(spark, d).withColumn("text", F.when(last == "2", " ").when(F.length("text") < 2000, "").otherwise(F.col("text")))
    return V.doc_flags(pages, F.when(last.isin("0", "2", "4"), "pdf").otherwise("docx"))


@query(f"""WITH {BP}, a AS (SELECT doc_id, count(*) FILTER (source = 'ocr' AND trim(text) <> '') AS done, count(*) FILTER ({LOW}) AS pending FROM bp GROUP BY doc_id)
SELECT doc_id, done + pending AS total, done, pending, CAST(CASE WHEN done + pending = 0 THEN 100 ELSE floor(100.0::DOUBLE * done / (done + pending) + 0.5) END AS INTEGER) AS percent FROM a""")
def ocr_progress(spark, d):
    return V.ocr_progress(books(spark, d), _low(spark, d))


@query(f"WITH {BP} SELECT doc_id, page, CAST(r AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(page - 10), page) AS r FROM bp) WHERE r <= 4")
def batch_priority(spark, d):
    return V.batch_priority(books(spark, d), F.lit(10)).select("doc_id", "page", "turn")


@query(f"WITH {BP} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 4 AS eager FROM bp WHERE {LOW}")
def eager_split(spark, d):
    return V.eager_split(_low(spark, d)).select("doc_id", "page", "eager")


@query(f"""WITH {BP}, t(tier, cap) AS (VALUES ('free', 10), ('reader_plus', 20), ('ai_pro', 15), ('power', 50)),
p AS (SELECT *, CASE substr(doc_id, -1) WHEN '0' THEN 'free' WHEN '1' THEN 'reader_plus' WHEN '2' THEN 'ai_pro' WHEN '3' THEN 'gone' ELSE 'power' END AS tier, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM bp)
SELECT doc_id, page, tier, n > cap AS truncated FROM p JOIN t USING (tier) WHERE k <= cap""")
def page_cap(spark, d):
    """Plans with a hundredth of their most pages and a tenth of their cap, so that caps are met."""
    last = F.substring("doc_id", -1, 1)
    tier = F.when(last == "0", "free").when(last == "1", "reader_plus").when(last == "2", "ai_pro").when(last == "3", "gone").otherwise("power")
    small = U.tiers(spark).withColumn("max_pages", F.col("max_pages") / 100).withColumn("page_cap", F.col("page_cap") / 10)
    return V.page_cap(books(spark, d).withColumn("tier", tier), small).select("doc_id", "page", "tier", "truncated")


@query(f"WITH {BP} SELECT doc_id, page, CASE WHEN {LOW} THEN '' ELSE text END AS text FROM bp")
def blank_pages(spark, d):
    return V.blank_pages(books(spark, d), _low(spark, d)).select("doc_id", "page", "text")


@query(f"WITH {BP} SELECT doc_id, page FROM bp WHERE {LOW} OR source = 'ocr'")
def pending_union(spark, d):
    return V.pending_union(_low(spark, d), books(spark, d).where("source = 'ocr'"))


@query(f"WITH {BP} SELECT doc_id, page FROM bp WHERE {LOW} AND source <> 'ocr'")
def pending_except(spark, d):
    return V.pending_except(_low(spark, d).select("doc_id", "page"), books(spark, d).where("source = 'ocr'"))


# readers and writers: what is written is read again
@query("SELECT doc_id, 1 AS page, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text, 'native' AS source FROM documents")
def read_pages(spark, d):
    path = scratch(spark)
    read_table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("\n "), "text", F.lit(" ")).alias("text")).write.parquet(path)
    return S.read_pages(spark, path)


SUMS = ", ".join(f"CAST(coalesce(sum(CASE WHEN field = '{f}' THEN amount END), 0) AS BIGINT) AS {f}" for f in S.FIELDS)


def _two_months(spark, d):
    rows = usage_events(spark, d)
    return rows.unionByName(rows.where("field = 'aiActions'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 31 DAYS")).where("date_format(ts, 'yyyy-MM') = '2024-02'"))


@query(f"WITH {EV}, ev2 AS (SELECT month, app_user_id, field, amount FROM ev UNION ALL SELECT '2024-02', app_user_id, field, amount FROM ev WHERE field = 'aiActions' AND strftime(ts + INTERVAL 31 DAY, '%Y-%m') = '2024-02') SELECT month, app_user_id, {SUMS} FROM ev2 GROUP BY month, app_user_id")
def write_usage(spark, d):
    """Both months are written, one of them twice; the second write replaces its own month only."""
    path, usage = scratch(spark), U.usage_monthly(_two_months(spark, d))
    S.write_usage(usage, path)
    S.write_usage(usage.where("month = '2024-02'"), path)
    return S.read_usage(spark, path, ["2024-01", "2024-02"])


@query(f"""WITH {EV}, ev2 AS (SELECT month, app_user_id, field, amount FROM ev UNION ALL SELECT '2024-02', app_user_id, field, amount FROM ev WHERE field = 'aiActions' AND strftime(ts + INTERVAL 31 DAY, '%Y-%m') = '2024-02'),
w AS (SELECT DISTINCT month, app_user_id FROM (SELECT unnest(['2024-02', '2024-03']) AS month), (SELECT app_user_id FROM ev UNION SELECT -1))
SELECT month, app_user_id, {SUMS} FROM w LEFT JOIN ev2 USING (month, app_user_id) GROUP BY month, app_user_id""")
def read_usage(spark, d):
    """Users without a record, and a month without any, have zeros."""
    path, users = scratch(spark), usage_events(spark, d).select("app_user_id")
    S.write_usage(U.usage_monthly(_two_months(spark, d)), path)
    return S.read_usage(spark, path, ["2024-02", "2024-03"], users.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("app_user_id"))))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(source) ELSE source END AS source, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS saved FROM documents")
def write_versions(spark, d):
    """All documents are saved, then the French ones again, then all at an earlier time; the French ones are saved twice at one time. Another version is not read."""
    path, rows = scratch(spark), read_table(spark, d, "documents").select("doc_id", "source", "lang")
    french = rows.where("lang = 'fr'")
    at = lambda second: F.lit(f"2024-01-01 00:00:0{second}").cast("timestamp")
    S.write_versions(rows, path, at(1))
    S.write_versions(french.withColumn("source", F.lit("superseded")), path, at(2))
    S.write_versions(french.withColumn("source", F.upper("source")), path, at(2))
    S.write_versions(rows.withColumn("source", F.lit("too early")), path, at(0))
    S.saved_versions(spark, path, 3).append(rows.withColumn("cache_version", F.lit(3)).withColumn("saved_at", at(9)))
    return S.saved_versions(spark, path).read().select("doc_id", "source", F.second("saved_at").alias("saved"))


# streams: rows arrive in three parts, by time
def _replayed(spark, rows, run):
    """Runs a stream (run(stream), up to its query) over three parts of the rows, by ts, from one checkpoint; each run begins anew and ends with its part."""
    path, checkpoint = scratch(spark), scratch(spark)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = cuts(rows, us, 3)
    for part in range(len(edges) + 1):
        rows.where(F.greatest(F.lit(0), range_of(us, edges)) == part).write.mode("append").parquet(path)
        with ST.with_rocksdb(spark):
            stream = spark.readStream.schema(rows.schema).parquet(path)
            run(stream).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _ran(spark, rows, make):
    """Rows that make(stream) gives in append mode."""
    path = scratch(spark)
    _replayed(spark, rows, lambda s: make(s).writeStream.format("parquet").option("path", path).outputMode("append"))
    return spark.read.parquet(path)


@query(ORACLE_SQL["usage_monthly"])
def usage_stream(spark, d):
    path = scratch(spark)
    rows = usage_events(spark, d)
    _replayed(spark, rows, lambda s: ST.usage_stream(s).writeStream.outputMode("update").foreachBatch(ST.keep_counters(spark, path)))
    return ST.read_counters(spark, path)


@query(ORACLE_SQL["quota_admit_amount"])
def quota_stream(spark, d):
    return _ran(spark, _voice_requests(spark, d).select("req_id", "app_user_id", "month", "ts", "amount", "limit", "ok"), ST.quota_stream)


@query(ORACLE_SQL["ttl_dedupe"])
def ttl_dedupe_stream(spark, d):
    return _ran(spark, _keyed(spark, d).select("req_id", "key", "ts", "ok"), ST.ttl_dedupe_stream)


@query(ORACLE_SQL["merge_ocr_longer"])
def page_backfill(spark, d):
    """Recognised pages arrive in two batches, by the length of their document's pages."""
    stored = _stored(spark, books(spark, d), "zstd")  # numbered once, as batches and progress read them again
    swept(spark)  # the shuffle that numbered them
    new, checkpoint = scratch(spark), scratch(spark)
    pages = ST.page_table(spark, scratch(spark), "zstd")
    pages.append(_have(spark, d, stored).select("doc_id", "page", "text", "source", F.col("confidence").cast("int").alias("confidence")))
    pending, rows = _stored(spark, _low(spark, d, stored).select("doc_id", "page")), _recognised(spark, d, stored)
    for part in ("length(text) < 2000", "length(text) >= 2000"):
        rows.where(part).write.mode("append").option("compression", "zstd").parquet(new)
        merge = ST.page_backfill(spark, pages, pending, lambda progress, n: progress.write.format("noop").mode("overwrite").save())
        stream = spark.readStream.schema(rows.schema).parquet(new)
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return pages.read()


@query("""WITH v AS (SELECT doc_id, text, CAST(2 + doc_id % 4 AS INTEGER) AS cache_version FROM documents) SELECT doc_id, text, cache_version FROM v WHERE cache_version = 4""")
def read_versions_query(spark, d):
    return read_versions(read_table(spark, d, "documents").select("doc_id", "text", (2 + F.col("doc_id") % 4).cast("int").alias("cache_version")))


@query("""WITH r AS (SELECT user_id AS content_hash, event_id AS page, ts AS updated_at FROM events),
p AS (SELECT *, CASE WHEN epoch(updated_at) - epoch(lag(updated_at) OVER (PARTITION BY content_hash ORDER BY updated_at, page)) > 172800 THEN 1 ELSE 0 END AS z FROM r),
e AS (SELECT *, sum(z) OVER (PARTITION BY content_hash ORDER BY updated_at, page ROWS UNBOUNDED PRECEDING) AS era FROM p)
SELECT content_hash, page FROM (SELECT *, max(era) OVER (PARTITION BY content_hash) AS l, max(updated_at) OVER (PARTITION BY content_hash) AS m FROM e) WHERE era = l AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(m) <= 172800""")
def expire_results_query(spark, d):
    rows = read_table(spark, d, "events").select(F.col("user_id").alias("content_hash"), F.col("event_id").alias("page"), F.col("ts").alias("updated_at"))
    return expire_results(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), 2).select("content_hash", "page")


# reading
def _sentences(spark, d):
    return L.build_sentences(books(spark, d))


def _units(spark, d):
    """Sentences without their ids: sums by page or document need no numbers, so texts cross no shuffle for them."""
    return L.page_units(L.clean_pages(books(spark, d)))


def _numbered(spark, d, kept=lambda x: x, beside=None, upto=None, stored=None):
    """Pages with what is kept of their sentences and the id of the first one. Pages beyond `upto` are left out before texts are moved, as no id depends on a later page."""
    cleaned = L.clean_pages(books(spark, d) if stored is None else stored)
    if upto is not None:
        cleaned = cleaned.where(F.col("page").isNull() | (F.col("page") <= upto))
    return L.numbered_pages(L.page_sentences(cleaned).withColumn("sentences", kept(F.col("sentences"))), beside)


def _stored(spark, rows, codec="snappy"):
    """rows that are read more than once: made once and kept in the shared folder, of which each read takes its own columns."""
    path = scratch(spark)
    rows.write.option("compression", codec).parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {SE} SELECT doc_id, id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY id) - 1 AS within FROM se")
def within_page(spark, d):
    return R.within_page(_sentences(spark, d)).select("doc_id", "id", "page", F.col("within").cast("long").alias("within"))


CH = "ch AS (SELECT doc_id, CAST((page - 1) // 10 AS INTEGER) AS chunk_ix, min(page) AS start_page, max(page) AS end_page FROM bp GROUP BY doc_id, (page - 1) // 10)"


@query(f"WITH {BP}, {CH} SELECT * FROM ch")
def page_chunks(spark, d):
    return R.page_chunks(books(spark, d))


@query(f"WITH {BP}, {CH}, r AS (SELECT doc_id, page * 2 AS page FROM bp) SELECT r.doc_id, r.page, coalesce(chunk_ix, -1) AS chunk_ix FROM r LEFT JOIN ch ON r.doc_id = ch.doc_id AND page BETWEEN start_page AND end_page")
def chunk_of_page(spark, d):
    return R.chunk_of_page(books(spark, d).select("doc_id", (F.col("page") * 2).alias("page")), R.page_chunks(books(spark, d)))


@query(f"WITH {SE} SELECT doc_id, CAST((page - 1) // 10 AS INTEGER) AS chunk_ix, string_agg(text, ' ' ORDER BY id) AS text FROM se GROUP BY doc_id, (page - 1) // 10")
def chunk_text(spark, d):
    return R.chunk_text(_stored(spark, _sentences(spark, d)), R.page_chunks(books(spark, d)))


@query(f"WITH {SE}, p AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY id) AS t FROM se GROUP BY doc_id, page) SELECT doc_id, page, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY page RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM p")
def context_text(spark, d):
    return R.context_text(_sentences(spark, d))


@query(f"WITH {SE}, r AS (SELECT doc_id, page * 2 AS page FROM bp) SELECT r.doc_id, r.page, coalesce(min(id), -1) AS id FROM r LEFT JOIN se USING (doc_id, page) GROUP BY r.doc_id, r.page")
def first_of_page(spark, d):
    pages = _stored(spark, books(spark, d))  # numbered once, as they are asked for as well
    firsts = _numbered(spark, d, lambda x: F.transform(x, F.length), stored=pages).where(F.size("sentences") > 0).select("doc_id", "page", F.col("first").alias("id"))
    return R.first_of_page(pages.select("doc_id", (F.col("page") * 2).alias("page")), firsts)


@query(f"""WITH {SE}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM se)
SELECT doc_id, page, CAST(page % 40 AS INTEGER) AS k, id FROM w WHERE k = least(page % 40, n - 1)""")
def reanchor(spark, d):
    return R.reanchor(books(spark, d).select("doc_id", "page", (F.col("page") % 40).alias("k")), _sentences(spark, d))


PAIRS = """ft AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY doc_id, page ORDER BY id) + 1 + n <= 420, false) AS fits FROM sp),
rn AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM ft),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, run ORDER BY id) % 2 = 0 AS second FROM rn),
ck AS (SELECT *, CAST(sum(CASE WHEN second THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY id ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS chunk_ix FROM pr)"""
CHUNKS = "SELECT doc_id, page, chunk_ix, string_agg(text, ' ' ORDER BY id) AS text, string_agg(id || ':' || (CASE WHEN second THEN p ELSE 0 END) || '-' || ((CASE WHEN second THEN p ELSE 0 END) + n) || '@' || source_start, ',' ORDER BY id) AS spans FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id, page ORDER BY id) + 1 AS p FROM ck) GROUP BY doc_id, page, chunk_ix"


def _spans(chunks):
    """Spans as text, which SQL engines write alike."""
    own = F.transform("spans", lambda s: F.format_string("%d:%d-%d@%d", s["sentence_id"], s["start"], s["end"], s["source_start"]))
    return chunks.withColumn("spans", F.array_join(own, ","))


@query(f"WITH {SE}, sp AS (SELECT *, length(text) AS n, 0 AS source_start FROM se WHERE trim(text) <> ''), {PAIRS} {CHUNKS}")
def speech_chunks(spark, d):
    return _spans(R.page_speech(_numbered(spark, d)))


@query(f"""WITH {SE}, sp AS (SELECT doc_id, page, id, text, length(text) AS n, source_start FROM (SELECT doc_id, page, id, substr(text, o + 1) AS text, o AS source_start FROM (SELECT *, CASE WHEN id = 3 THEN least(length(text), 7) ELSE 0 END AS o FROM se WHERE id >= 3 AND page <= 30)) WHERE trim(text) <> ''), {PAIRS} {CHUNKS}""")
def speech_chunks_from(spark, d):
    """Reading begins within the fourth sentence, and a plan ends after page 30."""
    starts = read_table(spark, d, "documents").select(F.col("source").alias("doc_id")).distinct().select("doc_id", F.lit(3).alias("start_id"), F.lit(7).alias("offset"))
    return _spans(R.page_speech(_numbered(spark, d, beside=starts, upto=30), page_cap=30))


@query(f"WITH {SE} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY id) - 1 AS INTEGER) AS chunk_ix, text, id || ':0-' || length(text) || '@0' AS spans FROM se WHERE trim(text) <> ''")
def speech_chunks_natural(spark, d):
    return _spans(R.page_speech(_numbered(spark, d), mode="natural"))


@query(f"""WITH {SE}, sp AS (SELECT *, length(text) AS n, 0 AS source_start FROM se WHERE trim(text) <> ''), {PAIRS},
c AS (SELECT doc_id, page, chunk_ix, min(id) AS a, max(id) AS b, min_by(n, id) AS n1, sum(n) + count(*) - 1 AS total FROM ck GROUP BY doc_id, page, chunk_ix),
o AS (SELECT *, greatest(0, least(total - 1, k * 150 - 20)) AS place, k * 150 - 20 AS asked FROM c, (SELECT unnest([0, 1, 2]) AS k))
SELECT doc_id || '/' || page || '/' || chunk_ix AS chunk, CAST(asked AS BIGINT) AS "at", CASE WHEN place <= n1 THEN a ELSE b END AS sentence_id, CAST(CASE WHEN place <= n1 THEN place ELSE greatest(0, place - n1 - 1) END AS BIGINT) AS char_offset FROM o""")
def locate_span(spark, d):
    """Places in what is spoken, found in the spans of its chunks."""
    places = _stored(spark, R.speech_places(_numbered(spark, d, R.spoken_lengths)))  # made once, as places are asked of all
    chunks = places.select(F.concat_ws("/", "doc_id", "page", "chunk_ix").alias("chunk"), "length", "spans")
    offsets = chunks.select("chunk", F.explode(F.array(*(F.lit(k * 150 - 20).cast("long") for k in range(3)))).alias("at"))
    return R.locate_span(offsets, chunks).select("chunk", "at", "sentence_id", "char_offset")


@query(f"WITH {SE}, {CH}, s AS (SELECT doc_id, CAST((page - 1) // 10 AS INTEGER) AS chunk_ix, count(*) AS n, string_agg(page || '.' || id, ' ' ORDER BY id) AS ids FROM se GROUP BY doc_id, (page - 1) // 10) SELECT ch.*, coalesce(n, 0) AS n, coalesce(ids, '') AS ids FROM ch LEFT JOIN s USING (doc_id, chunk_ix)")
def chunk_sentences(spark, d):
    rows = R.chunk_sentences(R.page_chunks(books(spark, d)), _stored(spark, _sentences(spark, d)))
    ids = F.array_join(F.transform("sentences", lambda x: F.concat_ws(".", x["page"], x["id"])), " ")
    return rows.select("doc_id", "chunk_ix", "start_page", "end_page", F.size("sentences").cast("long").alias("n"), ids.alias("ids"))


@query("""WITH b AS (SELECT event_id, user_id AS doc_id, ' Tag' || (event_id % 7) || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END AS tag, ts, CAST(floor(value) AS INTEGER) AS page, event_type = 'error' AS removed FROM events)
SELECT doc_id, trim(tag) AS tag, page, ts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(tag)) ORDER BY ts DESC, event_id DESC) AS k FROM b) WHERE k = 1 AND NOT removed""")
def bookmarks_latest(spark, d):
    tag = F.concat(F.lit(" Tag"), (F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 2 == 0, " ").otherwise(""))
    return R.bookmarks_latest(read_table(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), tag.alias("tag"), "ts", F.floor("value").cast("int").alias("page"), (F.col("event_type") == "error").alias("removed")))


READ = """CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 300 - 5 END AS INTEGER) AS page, CAST(event_id % 50 - 3 AS INTEGER) AS sentence, CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN event_id % 40 + 1 ELSE 200 END AS INTEGER) AS total"""
PROGRESS = "greatest(0::DOUBLE, least(1::DOUBLE, coalesce({0}.page, 0) / greatest(1, coalesce(nullif({0}.total, 0), nullif({1}.page_count, 0), 1))::DOUBLE))"


def _read_events(spark, d):
    k = F.col("event_id")
    page = F.when(k % 11 == 0, F.lit(None)).otherwise(k % 300 - 5).cast("int")
    total = F.when(k % 4 == 0, 0).when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, k % 40 + 1).otherwise(200).cast("int")
    return read_table(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), "ts", "event_type", page.alias("page"), (k % 50 - 3).cast("int").alias("sentence"), total.alias("total"))


@query(f"""WITH e AS (SELECT event_id, user_id AS doc_id, ts, 'T' || event_id AS title, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE event_id % 90 + 1 END AS INTEGER) AS page_count, {READ},
CASE event_type WHEN 'error' THEN 'remove' WHEN 'click' THEN 'progress' WHEN 'view' THEN 'progress' ELSE 'open' END AS kind FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS o FROM e),
c AS (SELECT doc_id, coalesce(max(o) FILTER (kind = 'remove'), 0) AS cut FROM l GROUP BY doc_id),
a AS (SELECT doc_id, min(o) AS added FROM l JOIN c USING (doc_id) WHERE kind = 'open' AND o > cut GROUP BY doc_id),
n AS (SELECT l.* FROM l JOIN a USING (doc_id) WHERE o >= added),
k AS (SELECT doc_id, min(o) AS added, max(o) AS newest, max(o) FILTER (kind = 'open') AS opened, max(o) FILTER (kind = 'progress') AS read FROM n GROUP BY doc_id),
b AS (SELECT k.doc_id, max(n.o) AS header FROM k JOIN n ON n.doc_id = k.doc_id AND n.kind = 'open' AND n.o < k.read GROUP BY k.doc_id)
SELECT k.doc_id, h.title, h.page_count, f.ts AS added_at, u.ts AS updated_at, greatest(1, coalesce(p.page, 1)) AS last_page, greatest(0, coalesce(p.sentence, 0)) AS last_sentence, {PROGRESS.format("p", "g")} AS progress
FROM k JOIN n h ON h.doc_id = k.doc_id AND h.o = k.opened JOIN n f ON f.doc_id = k.doc_id AND f.o = k.added JOIN n u ON u.doc_id = k.doc_id AND u.o = k.newest
LEFT JOIN n p ON p.doc_id = k.doc_id AND p.o = k.read LEFT JOIN b ON b.doc_id = k.doc_id LEFT JOIN n g ON g.doc_id = k.doc_id AND g.o = b.header""")
def library_latest(spark, d):
    """Events are openings, reading and removals in turn, so documents come back after they were removed."""
    k, kind = F.col("event_id"), F.col("event_type")
    count = F.when(k % 5 == 0, 0).when(k % 5 == 1, F.lit(None)).otherwise(k % 90 + 1).cast("int")
    what = F.when(kind == "error", "remove").when(kind.isin("click", "view"), "progress").otherwise("open")
    return R.library_latest(_read_events(spark, d).withColumns({"title": F.concat(F.lit("T"), "event_id"), "page_count": count, "kind": what}))


@query(f"""WITH e AS (SELECT event_id, user_id AS doc_id, {READ} FROM events), h AS (SELECT DISTINCT user_id AS doc_id, CAST(user_id % 7 * 20 AS INTEGER) AS page_count FROM events WHERE user_id % 5 <> 0)
SELECT event_id, greatest(1, coalesce(page, 1)) AS last_page, greatest(0, coalesce(sentence, 0)) AS last_sentence, {PROGRESS.format("e", "h")} AS progress FROM e LEFT JOIN h USING (doc_id)""")
def reading_progress(spark, d):
    """Pages below 1, totals that are 0 or missing, and documents without a header."""
    headers = read_table(spark, d, "events").where("user_id % 5 <> 0").select(F.col("user_id").alias("doc_id"), (F.col("user_id") % 7 * 20).cast("int").alias("page_count")).distinct()
    return R.reading_progress(_read_events(spark, d), headers).select("event_id", "last_page", "last_sentence", "progress")


@query("""SELECT req_id, page, CAST(turn AS INTEGER) AS turn FROM (SELECT req_id, page, row_number() OVER (PARTITION BY req_id ORDER BY pos) AS turn FROM
(SELECT user_id AS req_id, event_id % 40 - 3 AS page, min(event_id) AS pos FROM events WHERE event_id % 40 - 3 > 0 GROUP BY 1, 2)) WHERE turn <= 12""")
def requested_pages(spark, d):
    return R.requested_pages(read_table(spark, d, "events").select(F.col("user_id").alias("req_id"), (F.col("event_id") % 40 - 3).alias("page"), F.col("event_id").alias("pos")))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT 'p' || user_id || CASE WHEN user_id % 4 = 1 THEN ':base' ELSE '' END AS expected FROM u),
o AS (SELECT 'p' || user_id || CASE user_id % 5 WHEN 0 THEN ':base' WHEN 1 THEN ':base:month' WHEN 2 THEN 'x' WHEN 3 THEN ':' ELSE '' END AS offered FROM u WHERE user_id % 3 = 0)
SELECT expected FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE offered = expected OR starts_with(offered, expected || ':'))""")
def missing_products(spark, d):
    k = F.col("user_id")
    users = read_table(spark, d, "events").select("user_id").distinct()
    ends = F.when(k % 5 == 0, ":base").when(k % 5 == 1, ":base:month").when(k % 5 == 2, "x").when(k % 5 == 3, ":").otherwise("")
    return R.missing_products(users.select(F.concat(F.lit("p"), k, F.when(k % 4 == 1, ":base").otherwise("")).alias("expected")), users.where("user_id % 3 = 0").select(F.concat(F.lit("p"), k, ends).alias("offered")))


@query("""WITH b AS (SELECT event_id, user_id AS doc_id, 'Tag' || (event_id % 7) AS tag, ts FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tag ORDER BY ts DESC, event_id DESC) AS k FROM b)
SELECT doc_id, tag, ts FROM l WHERE k = 1 ORDER BY doc_id, ts DESC, tag""")
def bookmark_list(spark, d):
    rows = read_table(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), F.concat(F.lit("Tag"), F.col("event_id") % 7).alias("tag"), "ts", F.lit(1).alias("page"), F.lit(False).alias("removed"))
    return R.bookmark_list(R.bookmarks_latest(rows)).select("doc_id", "tag", "ts")


@query("SELECT user_id AS doc_id, max(ts) AS updated_at FROM events GROUP BY user_id ORDER BY updated_at DESC, doc_id")
def library_list(spark, d):
    return R.library_list(read_table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("updated_at")))


@query(f"""WITH {SE} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) * 15.0::DOUBLE / 1000000 AS usd FROM se GROUP BY doc_id""")
def voice_cost(spark, d):
    return P.voice_cost(_units(spark, d), 15)


@query(f"""WITH {SE}, w AS (SELECT *, greatest(1, len(regexp_extract_all(text, '\\S+'))) AS words, CASE page % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 4.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 1.5::DOUBLE END AS rate FROM se)
SELECT doc_id, page, round(sum(greatest(0.75::DOUBLE, words / (165.0::DOUBLE * rate) * 60)), 6) AS seconds FROM w GROUP BY doc_id, page""")
def listening_time(spark, d):
    """At rates that are missing, too fast, too slow and fine."""
    k = F.col("page") % 4
    return P.listening_time(_units(spark, d), F.when(k == 0, F.lit(None).cast("double")).when(k == 1, 9.0).when(k == 2, 0.1).otherwise(1.5))


@query("""SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'summary' WHEN 1 THEN 'explain' WHEN 2 THEN 'simplify' WHEN 3 THEN 'key_points' ELSE 'ask' END AS task, substr(text, 1, 12000) AS text FROM conversations WHERE turn % 6 < 5 AND regexp_replace(text, '\\s', '', 'g') <> ''""")
def valid_ai_request(spark, d):
    task = F.get(F.array(*map(F.lit, ["summary", "explain", "simplify", "key_points", "ask", "translate"])), (F.col("turn") % 6).cast("int"))
    return Q.valid_ai_requests(read_table(spark, d, "conversations").withColumn("task", task)).select("conv_id", "turn", "task", "text")


@query("""SELECT doc_id, CASE WHEN u = '' OR length(u) > 128 OR NOT regexp_full_match(u, '[A-Za-z0-9:_\\-.$]+') THEN NULL ELSE u END AS user_id FROM (SELECT doc_id, trim(CASE doc_id % 3 WHEN 0 THEN ' ' || source || ' ' WHEN 1 THEN text ELSE '' END) AS u FROM documents)""")
def valid_user_id(spark, d):
    k = F.col("doc_id") % 3
    one = F.when(k == 0, F.concat(F.lit(" "), "source", F.lit(" "))).when(k == 1, F.col("text")).otherwise("")
    return read_table(spark, d, "documents").select("doc_id", Q.valid_user_id(one).alias("user_id"))


FAILED = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 422 WHEN 2 THEN 402 ELSE 500 END AS status, CASE event_id % 5 WHEN 0 THEN 'QUOTA_exceeded' WHEN 1 THEN 'doc_expired' WHEN 2 THEN 'cloud_voice_language_unsupported' WHEN 3 THEN '' END AS code,
CASE event_id % 11 WHEN 0 THEN 'Network request failed' WHEN 1 THEN 'TypeError: Failed to fetch' WHEN 2 THEN 'Request timed out' WHEN 3 THEN 'upgrade_required' WHEN 4 THEN 'network down' WHEN 5 THEN NULL WHEN 6 THEN 'doc_expired (410)' ELSE event_type END AS message,
CASE WHEN event_id % 13 = 0 THEN 'cloudVoice' END AS feature FROM events"""


@query(f"""SELECT event_id, CASE WHEN regexp_matches(lower(m), 'network request failed|network error|failed to fetch|timeout|timed out') THEN 'network' WHEN contains(c, 'quota_exceeded') THEN 'quota' WHEN contains(c, 'doc_expired') THEN 'expired' WHEN contains(c, 'upgrade_required') THEN 'upgrade' ELSE 'other' END AS class,
CASE WHEN status = 429 OR code = 'quota_exceeded' OR feature = 'cloudVoice' THEN 'quota' WHEN status = 422 OR code = 'cloud_voice_language_unsupported' THEN 'language_unsupported' WHEN regexp_matches(lower(m), 'network|fetch') THEN 'network' ELSE 'error' END AS speech_class
FROM (SELECT *, coalesce(message, '') AS m, lower(coalesce(nullif(code, ''), message, '')) AS c FROM ({FAILED}))""")
def error_class(spark, d):
    rows = read_table(spark, d, "events").selectExpr(*(f"{x}" for x in FAILED_COLUMNS))
    return rows.select("event_id", Q.error_class("code", "message").alias("class"), Q.speech_error_class("status", "code", "feature", "message").alias("speech_class"))


FAILED_COLUMNS = [x.strip() for x in re.split(r",\s*(?=CASE)", FAILED.removeprefix("SELECT ").removesuffix(" FROM events"))]


@query("""SELECT conv_id, turn, 'Language: ' || CASE turn % 3 WHEN 0 THEN 'fr' ELSE 'en' END || chr(10) || 'Task: ' || task || chr(10) ||
CASE task WHEN 'ask' THEN 'User question: ' || CASE WHEN turn % 2 = 0 THEN 'Why?' ELSE '' END || chr(10) """ + " ".join(f"WHEN '{k}' THEN '{v} '" for k, v in Q.ASKED.items()) + f""" ELSE '{Q.ASKED_ELSE} ' END ||
'{Q.REPLY}' """ + """|| chr(10) || chr(10) || 'TEXT:' || chr(10) || text AS prompt
FROM (SELECT *, CASE conv_id % 5 WHEN 0 THEN 'summary' WHEN 1 THEN 'explain' WHEN 2 THEN 'simplify' WHEN 3 THEN 'key_points' ELSE 'ask' END AS task FROM conversations)""")
def ai_prompt(spark, d):
    task = F.get(F.array(*map(F.lit, Q.TASKS)), (F.col("conv_id") % 5).cast("int"))
    language = F.when(F.col("turn") % 3 == 0, "fr").when(F.col("turn") % 3 == 1, "")
    question = F.when(F.col("turn") % 2 == 0, "Why?")
    return read_table(spark, d, "conversations").select("conv_id", "turn", Q.ai_prompt(task, "text", language, question).alias("prompt"))
