"""Queries on what requests may do, voices, places in spoken text and replies, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import reading as R
from pagemill.operators import requests as Q
from pagemill.operators import usage as U
from pagemill.operators import versions as V
from pagemill.plans.text import BP
from pagemill.sources.tables import books, read_table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

TIER = "CASE event_id % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'reader_plus' WHEN 2 THEN 'ai_pro' WHEN 3 THEN 'power' ELSE 'gone' END"
CODE = "CASE event_id % 7 WHEN 0 THEN 'EN_us' WHEN 1 THEN ' pt-BR ' WHEN 2 THEN 'xx-YY' WHEN 3 THEN 'fa' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'ja' END"
#: What CODE stands for in the registry.
KNOWN = "CASE event_id % 7 WHEN 1 THEN 'pt' WHEN 3 THEN 'fa' WHEN 6 THEN 'ja' ELSE 'en' END"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _events(spark, d, **columns):
    return read_table(spark, d, "events").select("event_id", *(F.expr(x).alias(n) for n, x in columns.items()))


@query(f"SELECT event_id, {KNOWN} AS code, CASE {KNOWN} WHEN 'pt' THEN 'por' WHEN 'fa' THEN 'fas' WHEN 'ja' THEN 'jpn' ELSE 'eng' END AS ocr_lang FROM events")
def language_lookup(spark, d):
    return Q.language_lookup(_events(spark, d, language=CODE), "language").select("event_id", "code", "ocr_lang")


FEATURE = "CASE event_id % 3 WHEN 0 THEN 'ai' WHEN 1 THEN 'voice' ELSE 'none' END"


@query(f"SELECT event_id, tier, feature, CASE WHEN tier IN ('ai_pro', 'power') AND feature <> 'none' THEN 200 ELSE 402 END AS status FROM (SELECT event_id, {TIER} AS tier, {FEATURE} AS feature FROM events)")
def feature_gate(spark, d):
    return Q.feature_gate(_events(spark, d, tier=TIER, feature=FEATURE), U.tiers(spark)).select("event_id", "tier", "feature", "status")


UPLOAD = {
    "tier": TIER, "has_file": "event_id % 11 <> 0", "size": "CAST(value * 400000 AS BIGINT)", "used": "event_id % 120", "force_ocr": "CASE WHEN event_id % 2 = 0 THEN ' Yes' END",
    "file_name": "CASE event_id % 4 WHEN 0 THEN 'A.PDF' WHEN 1 THEN 'b.docx' WHEN 2 THEN 'c.txt' END", "mime": "CASE WHEN event_id % 4 = 3 THEN 'application/pdf' ELSE 'text/plain' END",
}


@query(f"""WITH u AS (SELECT event_id, {", ".join(f"{x} AS {n}" for n, x in UPLOAD.items())} FROM events),
t(tier, mb, files, ocr) AS (VALUES ('free', 20, 1, false), ('reader_plus', 100, 100, false), ('ai_pro', 100, 300, true), ('power', 200, 1000, true))
SELECT event_id, CASE WHEN mb IS NULL THEN 402 WHEN NOT has_file THEN 400 WHEN size > mb * 1048576 THEN 413 WHEN used >= files THEN 429 WHEN file_name = 'c.txt' THEN 415
WHEN event_id % 2 = 0 AND file_name = 'A.PDF' AND NOT ocr THEN 402 ELSE 200 END AS status FROM u LEFT JOIN t USING (tier)""")
def file_admission(spark, d):
    return Q.file_admission(_events(spark, d, **UPLOAD), U.tiers(spark)).select("event_id", "status")


ENGINE, READY = "CASE event_id % 3 WHEN 0 THEN 'local_ai' WHEN 1 THEN 'cloud' ELSE 'device' END", "CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true END"


@query(f"""SELECT event_id, CASE WHEN e = 'local_ai' AND t IN ('ai_pro', 'power') AND c = 'en' AND r THEN 'local' WHEN e = 'cloud' AND t IN ('ai_pro', 'power') AND c IN ('en', 'pt') THEN 'natural' ELSE 'device' END AS mode
FROM (SELECT event_id, {ENGINE} AS e, {TIER} AS t, {KNOWN} AS c, coalesce({READY}, true) AS r FROM events)""")
def voice_mode(spark, d):
    return Q.voice_mode(_events(spark, d, engine=ENGINE, language=CODE, tier=TIER, local_ready=READY), U.tiers(spark)).select("event_id", "mode")


VOICE = "CASE event_id % 9 WHEN 0 THEN 'en_GB' WHEN 1 THEN 'en-US' WHEN 2 THEN 'en-AU' WHEN 3 THEN 'nb-NO' WHEN 4 THEN 'no' WHEN 5 THEN 'en-ZA' WHEN 6 THEN 'en_IE' WHEN 7 THEN 'en-IN' ELSE NULL END"
NAME = "CASE event_id % 5 WHEN 0 THEN 'Network' WHEN 1 THEN 'Offline' ELSE 'Voice' END"


@query(f"""WITH v AS (SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS voice_id, CASE WHEN event_id % 9 IN (3, 4) THEN 'no' ELSE 'en' END AS code,
CASE event_id % 9 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' WHEN 2 THEN 'AU' WHEN 5 THEN 'ZA' WHEN 6 THEN 'IE' WHEN 7 THEN 'IN' ELSE 'NO' END AS region,
CASE event_id % 9 WHEN 0 THEN 'British English' WHEN 1 THEN 'American English' WHEN 2 THEN 'Australian English' WHEN 5 THEN 'South African English' WHEN 6 THEN 'Irish English' WHEN 7 THEN 'Indian English' ELSE 'Norwegian (Norway)' END AS label,
CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS q, CASE event_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 9 END AS r FROM events WHERE event_id % 9 < 8),
f AS (SELECT *, r * 10 + q AS rank FROM v QUALIFY row_number() OVER (PARTITION BY code, region, q = 2 ORDER BY r * 10 + q, label, region, voice_id) = 1),
p AS (SELECT code, CAST(row_number() OVER (PARTITION BY code ORDER BY rank, label, region, voice_id) AS INTEGER) AS place, voice_id, rank, label FROM f)
SELECT * FROM p WHERE place <= 8""")
def voices_ranked(spark, d):
    return Q.voices_ranked(_events(spark, d, voice_id="lpad(CAST(event_id AS STRING), 9, '0')", name=NAME, language=VOICE).drop("event_id"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'sum' ELSE '' END AS summary, CASE WHEN event_id % 3 = 1 THEN 'plainly ' || event_type ELSE '' END AS simple_explanation, CAST(CASE WHEN event_id % 3 = 1 THEN [event_type] ELSE [] END AS VARCHAR[]) AS key_points,
CASE WHEN event_id % 3 = 1 THEN event_type || '=what it is;other=' ELSE '' END AS terms, CASE WHEN event_id % 3 = 2 THEN event_type END AS answer
FROM (SELECT event_id, event_type, 'not json ' || props AS props FROM events)""")
def parse_ai_result(spark, d):
    raw = """CASE event_id % 3 WHEN 0 THEN concat('not json ', props)
    WHEN 1 THEN concat('{"summary": "sum", "simple_explanation": "plainly ', event_type, '", "key_points": ["', event_type, '"], "terms": [{"term": "', event_type, '", "meaning": "what it is"}, {"term": "other"}]}')
    ELSE concat('{"key_points": "x", "terms": 5, "answer": "', event_type, '"}') END"""
    terms = F.array_join(F.transform("x.terms", lambda t: F.concat(t["term"], F.lit("="), F.coalesce(t["meaning"], F.lit("")))), ";")
    return _events(spark, d, raw=raw).withColumn("x", Q.parse_ai_result(F.col("raw"))).select("event_id", "x.summary", "x.simple_explanation", "x.key_points", terms.alias("terms"), "x.answer")


@query("SELECT event_id, CASE WHEN event_id % 50 % 2 = 1 OR event_id % 30 - 5 <= 9 THEN 0 ELSE 1 END AS line_ix FROM events")
def locate_line(spark, d):
    offsets = _events(spark, d, sentence_id="event_id % 50", at="event_id % 30 - 5")
    lines = "array(named_struct('start', 0L, 'end', 9L), named_struct('start', 10L, 'end', 15L))"
    return R.locate_line(offsets, offsets.where("sentence_id % 2 = 0").select("sentence_id").distinct().withColumn("lines", F.expr(lines))).select("event_id", "line_ix")


# documents parsed anew have only pages of up to 2000 characters, some without their end; kept ones are whole and in other languages for some books
FRESH = """fr AS (SELECT doc_id, page, CASE WHEN length(text) > 900 THEN substr(text, 1, 900) ELSE text END AS text, 'native' AS source FROM bp WHERE length(text) < 2000),
kp AS (SELECT doc_id, page, text, length(text) % 101 AS confidence FROM bp WHERE source = 'ocr' AND text <> '' AND substr(doc_id, -1) <> '0')"""


def _cached(spark, d):
    pages, n = books(spark, d), F.length("text")
    fresh = pages.where(n < 2000).select("doc_id", "page", F.when(n > 900, F.substring("text", 1, 900)).otherwise(F.col("text")).alias("text"), F.lit("native").alias("source"))
    last = F.substring("doc_id", -1, 1)
    docs = pages.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("lang"), (last == "1").alias("force_ocr"))
    kept_docs = docs.select("doc_id", F.when(last == "0", "fra").otherwise("eng").alias("lang"), last.isin("0", "2").alias("force_ocr"))
    return V.merge_cached(fresh, docs, pages.withColumn("confidence", n % 101), kept_docs, pages.where(n < 2000))


@query(f"""WITH {BP}, {FRESH} SELECT doc_id, page, CASE WHEN w THEN k.text ELSE fr.text END AS text, CASE WHEN w THEN 'ocr' ELSE fr.source END AS source, CASE WHEN w THEN k.confidence END AS confidence
FROM (SELECT doc_id, page, kp.text IS NOT NULL AND (fr.text IS NULL OR length(kp.text) > length(fr.text)) AS w FROM fr FULL JOIN kp USING (doc_id, page)) LEFT JOIN fr USING (doc_id, page) LEFT JOIN kp k USING (doc_id, page)""")
def merge_cached(spark, d):
    return _cached(spark, d)[0]


@query(f"WITH {BP}, {FRESH} SELECT doc_id, page FROM bp WHERE length(text) < 2000 AND NOT EXISTS (SELECT 1 FROM kp WHERE kp.doc_id = bp.doc_id AND kp.page = bp.page)")
def merge_cached_pending(spark, d):
    return _cached(spark, d)[1].select("doc_id", "page")


@query(f"WITH {BP} SELECT DISTINCT doc_id, substr(doc_id, -1) IN ('1', '2') AS force_ocr FROM bp")
def merge_cached_docs(spark, d):
    return _cached(spark, d)[2].select("doc_id", "force_ocr")


@query("SELECT event_id, upper(event_type) AS note FROM events")
def enrich_distinct(spark, d):
    return Q.enrich_distinct(_events(spark, d, kind="event_type"), ["kind"], lambda x: x["kind"].str.upper(), "note").select("event_id", "note")
