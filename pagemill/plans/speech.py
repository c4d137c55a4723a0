"""Queries on requests for speech, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators.speech import tts_requests
from pagemill.sources.tables import read_table


def speech_requests(spark, d):
    """Turns of conversations as requests, with languages, voices and speeds of all kinds."""
    k, turn = F.col("conv_id"), F.col("turn")
    language = F.when(k % 5 == 0, "en_US").when(k % 5 == 1, "FR-ca").when(k % 5 == 2, "zh-CN").when(k % 5 == 3, " no ")
    voice = F.when(turn % 3 == 0, "onyx").when(turn % 3 == 1, "Nova")
    speed = F.when(k % 6 == 0, "0").when(k % 6 == 1, "9").when(k % 6 == 2, "abc").when(k % 6 == 3, "1.5").when(k % 6 == 4, "0.1")
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", "text", language.alias("language"), voice.alias("voice"), speed.alias("speed"))
    return tts_requests(rows)


QUERIES = {"speech_requests": speech_requests}
ORACLE_SQL = {
    "speech_requests": r"""
SELECT conv_id, turn, substr(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), 1, 1200) AS text,
CASE conv_id % 5 WHEN 1 THEN 'fr' WHEN 2 THEN 'zh' WHEN 3 THEN 'no' ELSE 'en' END AS language, coalesce(conv_id % 5 <> 2, true) AS supported,
CASE WHEN turn % 3 = 0 THEN 'onyx' ELSE 'nova' END AS voice,
CASE conv_id % 6 WHEN 1 THEN 4.0::DOUBLE WHEN 3 THEN 1.5::DOUBLE WHEN 4 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS speed
FROM conversations""",
}
