"""Language identification by rank-order profiles: the out-of-place distance of a document's most frequent n-grams to those of each language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.session import small_batches

LONGEST, RANKS, TRAIN_DOCS = 5, 300, 2000
#: n-grams of a language that a task holds before it counts them.
GRAMS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(text: str | None) -> np.ndarray:
    """Hashes of the 1- to 5-grams of letters of a text's words, each word with a blank at either end; sorted, with repeats."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.concatenate([[0], np.where(_is_letter()[points], points, 0), [0]]).astype(np.uint64)
    points = points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))]
    if not points.any():
        return np.zeros(0, np.uint64)
    blanks = np.concatenate([[0], np.cumsum(points == 0)])
    code, out = points + np.uint64(1), [points[points != 0] + np.uint64(1)]
    for n in range(2, LONGEST + 1):
        if len(points) < n:
            break
        code = code[:-1] * _STEP + points[n - 1 :] + np.uint64(1)
        out.append(code[blanks[n - 1 : len(blanks) - 1] == blanks[1 : len(blanks) - n + 1]] if n > 2 else code)
    out = np.concatenate(out)
    out.sort()
    return out


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted codes and how often each occurs."""
    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[start], np.diff(np.append(start, len(codes)))


def ranked(codes: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes in order, ties by the smaller signed code."""
    values, counts = counted(codes)
    if len(values) > ranks:
        least = np.partition(counts, -ranks)[-ranks]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values.view(np.int64), -counts))][:ranks]


def profiles(documents: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", ranks: int = RANKS, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """For each language its most frequent n-grams in order.

    A profile is fitted on a bounded sample: about train_docs whole documents of each language (all, if there are fewer),
    picked by a hash of doc_id. Rows with a null text or language are left out. The result is small: `ranks` numbers for
    each language.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) / (1 << 30)).alias("at")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sample = rows.join(F.broadcast(sizes), "lang").where(F.col("at") * F.col("n") < train_docs).select("lang", "text")

    def count(batches):
        gathered: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for name, one in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = gathered.setdefault(name, [])
                own.append(grams(one))
                if sum(map(len, own)) > GRAMS:
                    yield emitted(name, gathered.pop(name))
        for name, own in gathered.items():
            yield emitted(name, own)

    def emitted(name: str, own: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = counted(np.sort(np.concatenate(own)))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    total = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).toPandas()
    return {name: own.sort_values("rank")["gram"].to_numpy(np.int64).view(np.uint64) for name, own in sorted(top.groupby("lang"))}


def identify(documents: DataFrame, known: dict[str, np.ndarray], *, text: str = "text", ranks: int = RANKS) -> DataFrame:
    """documents with lang_pred and score (columns of these names are replaced), from whole texts alone and without a shuffle.

    A document's most frequent n-grams are ranked; each counts the places by which it is off in a language's profile, or
    `ranks` where it is absent. The language with the smallest sum wins, ties go to the first by name. score is 1 minus
    that sum as a share of the largest possible. lang_pred is `und`, with score 0, where the text is null or has no letter,
    or no language is known. Repeated rows are each judged; an empty table gives an empty one.
    """
    small_batches(documents.sparkSession)
    names = list(known)
    columns = [c for c in documents.columns if c not in ("lang_pred", "score")]
    codes = np.concatenate([known[n] for n in names]) if names else np.zeros(0, np.uint64)
    values = np.unique(codes)
    places = np.full((len(values) + 1, len(names)), -1, dtype=np.int64)
    for k, name in enumerate(names):
        places[np.searchsorted(values, known[name]), k] = np.arange(len(known[name]))

    def judge(one: str | None) -> tuple[str, float]:
        own = ranked(grams(one), ranks)
        if not len(own) or not names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        at[values[at] != own] = len(values)
        theirs = places[at]
        off = np.where(theirs < 0, ranks, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return names[best], max(0.0, 1.0 - float(off[best]) / (ranks * len(own)))

    def run(batches):
        for batch in batches:
            found = [judge(one) for one in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*columns, "lang_pred", "score"])

    kind = T.StructType([*(documents.schema[c] for c in columns), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.select(*columns).mapInArrow(run, kind)
