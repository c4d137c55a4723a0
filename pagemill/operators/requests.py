"""What a request may do: languages, features of a plan, uploads, voices, prompts and replies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X

#: code, language of voices, language of recognition, prefixes of voices, local voice, cloud voice; fixed values.
LANGUAGES = [
    ("en", "en-US", "eng", ["en"], True, True),
    ("es", "es-ES", "spa", ["es"], False, True),
    ("fr", "fr-FR", "fra", ["fr"], False, True),
    ("de", "de-DE", "deu", ["de"], False, True),
    ("it", "it-IT", "ita", ["it"], False, True),
    ("pt", "pt-BR", "por", ["pt"], False, True),
    ("nl", "nl-NL", "nld", ["nl"], False, True),
    ("sv", "sv-SE", "swe", ["sv"], False, True),
    ("no", "nb-NO", "nor", ["no", "nb", "nn"], False, True),
    ("da", "da-DK", "dan", ["da"], False, True),
    ("fi", "fi-FI", "fin", ["fi"], False, True),
    ("tr", "tr-TR", "tur", ["tr"], False, True),
    ("id", "id-ID", "ind", ["id", "in"], False, True),
    ("vi", "vi-VN", "vie", ["vi"], False, True),
    ("ja", "ja-JP", "jpn", ["ja"], False, False),
    ("ko", "ko-KR", "kor", ["ko"], False, False),
    ("zh", "zh-CN", "chi_sim", ["zh"], False, False),
    ("hi", "hi-IN", "hin", ["hi"], False, False),
    ("ru", "ru-RU", "rus", ["ru"], False, False),
    ("ar", "ar-SA", "ara", ["ar"], False, False),
    ("fa", "fa-IR", "fas", ["fa", "fas"], False, False),
]
LANGUAGE_SCHEMA = "code string, voice_language string, ocr_lang string, prefixes array<string>, local_voice boolean, cloud_voice boolean"
#: Preference of regions after that of the language; fixed values.
REGIONS = {"US": 1, "GB": 2, "UK": 2, "ES": 3, "MX": 4, "FR": 5, "CA": 6, "DE": 7, "BR": 8, "PT": 9}
#: Names of languages, of regions, and of English by region; fixed values.
LANGUAGE_LABELS = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish", "no": "Norwegian", "da": "Danish", "fi": "Finnish",
    "tr": "Turkish", "id": "Indonesian", "vi": "Vietnamese", "ja": "Japanese", "ko": "Korean", "zh": "Chinese (Simplified)", "hi": "Hindi", "ru": "Russian", "ar": "Arabic", "fa": "Persian",
}
ENGLISH_REGION_LABELS = {
    "AU": "Australian English", "CA": "Canadian English", "GB": "British English", "IE": "Irish English", "IN": "Indian English", "NZ": "New Zealand English", "UK": "British English", "US": "American English", "ZA": "South African English",
}
REGION_LABELS = {
    "AE": "UAE", "AR": "Argentina", "AT": "Austria", "AU": "Australia", "BE": "Belgium", "BR": "Brazil", "CA": "Canada", "CH": "Switzerland", "CN": "China", "CO": "Colombia", "DE": "Germany", "DK": "Denmark", "EG": "Egypt",
    "ES": "Spain", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "ID": "Indonesia", "IE": "Ireland", "IN": "India", "IR": "Iran", "IT": "Italy", "JP": "Japan", "KR": "Korea", "MX": "Mexico", "NL": "Netherlands",
    "NO": "Norway", "NZ": "New Zealand", "PT": "Portugal", "RU": "Russia", "SA": "Saudi Arabia", "SE": "Sweden", "TR": "Turkey", "TW": "Taiwan", "US": "United States", "VN": "Vietnam", "ZA": "South Africa",
}
PDF, DOCX = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, LANGUAGE_SCHEMA)


def _dashed(code: Column) -> Column:
    """Lower case, the first underscore a dash."""
    return F.regexp_replace(F.lower(code), "^([^_]*)_", "$1-")


def reading_language(code: Column) -> Column:
    """A code of the registry: the given one, else its primary part, else en (also for null)."""
    known = [x[0] for x in LANGUAGES]
    whole = _dashed(X.trim(F.coalesce(code, F.lit(""))))
    primary = F.split_part(whole, F.lit("-"), F.lit(1))
    return F.when(whole.isin(known), whole).when(primary.isin(known), primary).otherwise("en")


def language_lookup(rows: DataFrame, column: str) -> DataFrame:
    """rows with the registry's row for a column of codes; the registry is 21 rows and is broadcast."""
    registry = F.broadcast(languages(rows.sparkSession))
    return rows.withColumn("code", reading_language(F.col(column))).join(registry, "code")


def feature_gate(requests: DataFrame, tiers: DataFrame) -> DataFrame:
    """requests (with tier and feature) with status: 200 where the plan has the feature (a boolean of tiers), 402 where not.

    Unknown features and plans are denied. There are as many tiers as plans, so they are broadcast.
    """
    features = [f.name for f in tiers.schema if f.dataType.simpleString() == "boolean"]
    flags = F.create_map(*(c for f in features for c in (F.lit(f), F.col(f))))
    plans = tiers.select(F.col("key").alias("tier"), flags.alias("flags"))
    allowed = F.coalesce(F.col("flags")[F.col("feature")], F.lit(False))
    return requests.join(F.broadcast(plans), "tier", "left").withColumn("status", F.when(allowed, 200).otherwise(402)).drop("flags")


def file_admission(uploads: DataFrame, tiers: DataFrame) -> DataFrame:
    """uploads (tier, has_file, size, file_name, mime, force_ocr, used) with the status of the first rule that refuses, else 200.

    400 no file, 413 larger than the plan's MB, 429 the month's files are used up, 415 neither PDF nor Word by type or ending,
    402 recognition forced for a PDF without the feature. A plan that is not known refuses with 402 first.
    """
    plans = tiers.select(F.col("key").alias("tier"), F.col("max_mb").alias("_mb"), F.col("pdfs").alias("_files"), F.col("ocr").alias("_ocr"))
    name = F.lower(F.coalesce("file_name", F.lit("")))
    mime = F.coalesce("mime", F.lit(""))
    pdf, docx = (mime == PDF) | name.endswith(".pdf"), (mime == DOCX) | name.endswith(".docx")
    forced = pdf & F.lower(X.trim(F.coalesce("force_ocr", F.lit("")))).isin("1", "true", "yes")
    status = (
        F.when(F.col("_mb").isNull(), 402).when(~F.coalesce("has_file", F.lit(False)), 400).when(F.col("size") > F.col("_mb") * 1024 * 1024, 413)
        .when(F.coalesce("used", F.lit(0)) + 1 > F.col("_files"), 429).when(~pdf & ~docx, 415).when(forced & ~F.col("_ocr"), 402).otherwise(200)
    )
    return uploads.join(F.broadcast(plans), "tier", "left").withColumn("status", status).drop("_mb", "_files", "_ocr")


def voice_mode(preferences: DataFrame, tiers: DataFrame) -> DataFrame:
    """preferences (engine, language, tier, local_ready) with mode: local, natural or device, by plan and language."""
    plans = tiers.select(F.col("key").alias("tier"), F.col("ai").alias("_ai"), F.col("voice").alias("_voice"), F.col("cloudVoiceChars").alias("_chars"))
    rows = language_lookup(preferences, "language").join(F.broadcast(plans), "tier", "left")
    local = (F.col("engine") == "local_ai") & F.col("_ai") & F.col("local_voice") & F.coalesce("local_ready", F.lit(True))
    cloud = (F.col("engine") == "cloud") & F.col("cloud_voice") & F.col("_voice") & (F.col("_chars") > 0)
    return rows.select(*preferences.columns, F.when(local, "local").when(cloud, "natural").otherwise("device").alias("mode"))


def _mapped(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def _region(language: Column) -> Column:
    """The region of a voice's language, in capitals; the language itself where none is named."""
    parts = F.split(F.regexp_replace(language, "^([^_]*)_", "$1-"), "-")
    return F.upper(F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.nullif(F.get(parts, F.lit(0)), F.lit("")), F.lit("default")))


def voices_ranked(voices: DataFrame, n: int = 8) -> DataFrame:
    """code, place, voice_id, label of the n best voices (voice_id, name, language) of each reading language.

    Rank: region (the language's own first), then offline, phone and network voices; of a region and availability only the
    first one stays. Ties go by what is shown of the region, then to the region and the voice_id. A voice without a language fits none.
    """
    registry = languages(voices.sparkSession).select("code", "voice_language", F.explode("prefixes").alias("prefix"))
    rows = voices.withColumn("prefix", F.split_part(_dashed("language"), F.lit("-"), F.lit(1))).join(F.broadcast(registry), "prefix")
    region = _region(F.col("language"))
    words = F.lower(F.concat_ws(" ", "name", "voice_id"))
    quality = F.when(words.contains("network"), 2).when(words.rlike("local|offline|google"), 0).otherwise(1)
    spoken, place = _mapped(LANGUAGE_LABELS, F.col("code")), _mapped(REGION_LABELS, region)
    label = F.coalesce(F.when(F.col("code") == "en", _mapped(ENGLISH_REGION_LABELS, region)), F.when(place.isNotNull(), F.concat(spoken, F.lit(" ("), place, F.lit(")"))), spoken)
    rank = F.when(region == _region(F.col("voice_language")), 0).otherwise(F.coalesce(_mapped(REGIONS, region), F.lit(9))) * 10 + quality
    rows = rows.select("code", "voice_id", region.alias("region"), label.alias("label"), (quality == 2).alias("far"), rank.alias("rank"))
    # one voice for each region and availability remains, of which there are few for a language
    first = rows.groupBy("code", "region", "far").agg(F.min(F.struct("rank", "label", "region", "voice_id")).alias("x")).select("code", "x.*")
    best = Window.partitionBy("code").orderBy("rank", "label", "region", "voice_id")
    return first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).select("code", "place", "voice_id", "rank", "label")


#: Tasks, and what they ask for; fixed values.
TASKS = ["summary", "explain", "simplify", "key_points", "ask"]
ASKED = {
    "simplify": 'Rewrite the meaning simply (aim for a 12-year-old) in "simple_explanation".',
    "key_points": "Focus on extracting the most important key_points.",
    "explain": "Explain what this passage means and why it matters.",
}
ASKED_ELSE = "Summarize concisely."
REPLY = 'Return JSON with keys: summary (string), simple_explanation (string), key_points (string[] up to 6), terms (array of {term, meaning} up to 5), answer (string, only for the "ask" task else empty).'
TEXT_CHARS = 12000


def valid_user_id(user_id: Column | str) -> Column:
    """The trimmed id; null if it is empty, longer than 128 characters or has others than letters, digits and : _ - . $"""
    one = X.trim(user_id)
    return F.when((F.length(one) <= 128) & one.rlike(r"\A[A-Za-z0-9:_\-.$]+\z"), one)


def valid_ai_requests(requests: DataFrame) -> DataFrame:
    """Requests of a known task with a text that is not blank; the service reads its first 12000 characters."""
    return requests.where(F.col("task").isin(TASKS) & (X.trim("text") != "")).withColumn("text", F.substring("text", 1, TEXT_CHARS))


def ai_prompt(task: Column | str, text: Column | str, language: Column | str, question: Column | str) -> Column:
    """What a model is asked; no language is en, no question and no text are empty, an unknown task is a summary."""
    task, text = F.coalesce(X.col(task), F.lit("")), F.coalesce(X.col(text), F.lit(""))
    language = F.coalesce(F.nullif(X.col(language), F.lit("")), F.lit("en"))
    wanted = F.lit(ASKED_ELSE + " ")
    for name, words in ASKED.items():
        wanted = F.when(task == name, words + " ").otherwise(wanted)
    wanted = F.when(task == "ask", F.concat(F.lit("User question: "), F.coalesce(X.col(question), F.lit("")), F.lit("\n"))).otherwise(wanted)
    return F.concat(F.lit("Language: "), language, F.lit("\nTask: "), task, F.lit("\n"), wanted, F.lit(REPLY + "\n\nTEXT:\n"), text)


def error_class(code: Column | str, message: Column | str) -> Column:
    """network, quota, expired, upgrade or other, by the message and, before it, the code of a failed request."""
    message = F.coalesce(X.col(message), F.lit(""))
    named = F.coalesce(F.nullif(X.col(code), F.lit("")), message)
    return (
        F.when(message.rlike("(?i)network request failed|network error|failed to fetch|timeout|timed out"), "network")
        .when(named.rlike("(?i)quota_exceeded"), "quota").when(named.rlike("(?i)doc_expired"), "expired").when(named.rlike("(?i)upgrade_required"), "upgrade").otherwise("other")
    )


def speech_error_class(status: Column | str, code: Column | str, feature: Column | str, message: Column | str) -> Column:
    """Why speech falls back to the device: quota, language_unsupported, network or error."""
    status, code, feature, message = map(X.col, (status, code, feature, message))
    quota = (status == 429) | (code == "quota_exceeded") | (feature == "cloudVoice")
    language = (status == 422) | (code == "cloud_voice_language_unsupported")
    return F.when(quota, "quota").when(language, "language_unsupported").when(message.rlike("(?i)network|fetch"), "network").otherwise("error")


def parse_ai_result(raw: Column) -> Column:
    """A reply as a struct. What is not JSON is the summary as it stands; missing or ill-typed fields are '', [] or null."""
    reply = F.coalesce(raw, F.lit("{}"))
    parsed = F.try_parse_json(reply)
    text = lambda f: F.coalesce(F.try_variant_get(parsed, f"$.{f}", "string"), F.lit(""))
    items = lambda f, kind: F.coalesce(F.try_variant_get(parsed, f"$.{f}", kind), F.array().cast(kind))
    summary = F.when(parsed.isNull(), reply).otherwise(text("summary"))
    terms = items("terms", "array<struct<term:string,meaning:string>>")
    return F.struct(summary.alias("summary"), text("simple_explanation").alias("simple_explanation"), items("key_points", "array<string>").alias("key_points"), terms.alias("terms"), F.nullif(text("answer"), F.lit("")).alias("answer"))


def enrich_distinct(rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.Series], output: str, kind: str = "string") -> DataFrame:
    """rows with output = fn(keys), where fn sees batches of distinct keys only; null keys are keys."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def work(batches):
        for batch in batches:
            yield batch.assign(**{output: fn(batch)})

    done = rows.select(*keys).distinct().mapInPandas(work, f"{schema}, `{output}` {kind}")
    done = done.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), output)
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return rows.join(done, same, "left").drop(*(f"_key{i}" for i in range(len(keys))))
