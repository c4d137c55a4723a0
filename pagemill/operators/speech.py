"""Requests for speech as they are read: language, voice, speed and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X

#: Fixed values.
VOICES = ["alloy", "ash", "ballad", "coral", "echo", "fable", "nova", "onyx", "sage", "shimmer"]
LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "nl", "sv", "no", "nb", "nn", "da", "fi", "tr", "id", "vi"]


VOICE, SLOWEST, FASTEST, LONGEST = "nova", 0.25, 4.0, 1200
#: Words a minute, and least seconds of a sentence; fixed values.
WORDS_A_MINUTE, LEAST_SECONDS = 165, 0.75


def seconds_of(text: Column | str, rate: Column | float = 1.0) -> Column:
    """How long a sentence is heard: a text has one word at least, rates are held to 0.25 .. 4, and none or 0 is 1."""
    words = F.greatest(F.lit(1), F.coalesce(X.word_count(text), F.lit(0)))
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    rate = F.when(rate.isNull() | F.isnan(rate) | (rate == 0), 1.0).otherwise(F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), rate)))
    return F.greatest(F.lit(LEAST_SECONDS), words / (F.lit(float(WORDS_A_MINUTE)) * rate) * 60)


def listening_time(sentences: DataFrame, rate: Column | float = 1.0) -> DataFrame:
    """doc_id, page, seconds, of sentences (doc_id, page, text), which need no ids."""
    return sentences.groupBy("doc_id", "page").agg(F.round(F.sum(seconds_of("text", rate)), 6).alias("seconds"))


def voice_cost(sentences: DataFrame, usd_per_million: float) -> DataFrame:
    """doc_id, chars, usd of the spoken text at a price for a million characters."""
    chars = F.sum(F.length("text"))
    return sentences.groupBy("doc_id").agg(chars.cast("long").alias("chars"), (chars * F.lit(float(usd_per_million)) / 1000000).alias("usd"))


def tts_language(code: Column) -> Column:
    """The primary part of a language code, lower-cased; en where there is none."""
    first = F.split_part(F.replace(F.lower(X.trim(F.coalesce(code, F.lit("")))), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.when(first == "", "en").otherwise(first)


def tts_requests(requests: DataFrame) -> DataFrame:
    """requests with text, language, voice and speed as they are served, and supported; other columns stay.

    Texts are trimmed and cut to 1200 characters, as the service does; a null one is empty. Voices not on the list are nova. Speeds
    are held to 0.25 .. 4; one that is null, no number or 0 is 1. A language that is not served stays, with supported false.
    """
    speed = F.col("speed").cast("string").try_cast("double")
    language = tts_language(F.col("language"))
    return requests.withColumns({
        "text": F.substring(X.trim(F.coalesce("text", F.lit(""))), 1, LONGEST),
        "language": language,
        "supported": language.isin(LANGUAGES),
        "voice": F.when(F.col("voice").isin(VOICES), F.col("voice")).otherwise(VOICE),
        "speed": F.when(speed.isNull() | F.isnan(speed) | (speed == 0), 1.0).otherwise(F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), speed))),
    })
