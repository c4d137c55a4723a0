"""How much a Python worker is handed at once, and holds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from pagemill.llm import arrays as A
from pagemill.llm.session import BATCH_BYTES, small_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limit(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "64m")
    yield
    spark.conf.set(LIMIT, before)


def largest(spark):
    """Bytes of the largest batch of a table of 2 kB texts."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    return spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 256).alias("text")).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_hand_on_small_batches(spark, limit, name):
    """Ten thousand rows at once, in the JVM and the worker of each running task, took the pipeline beyond an executor's memory."""
    docs = spark.createDataFrame([(1, "some words of a text", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(P.STAGES)[name](spark, docs, "/root/testdata/sf0.001").count() >= 1
    assert largest(spark) <= 1.1 * BATCH_BYTES


@pytest.mark.parametrize(("own", "then"), [("1m", "1m"), ("4096k", "4096k"), ("3000000", "3000000"), ("5m", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES))])
def test_a_smaller_limit_stays(spark, limit, own, then):
    spark.conf.set(LIMIT, own)
    small_batches(spark)
    assert spark.conf.get(LIMIT).removesuffix("b") == then


def test_hashes_by_stretches(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    cuts = np.sort(rng.choice(5000, 600, replace=False))
    start, end = cuts[::2], cuts[1::2]
    start[7], end[7] = end[6], end[6]  # an empty one
    whole = A.Rolling(data).ranges(start, end)
    for size in (1, 40, 700, 1 << 17):
        monkeypatch.setattr(A, "HASHED", size)
        assert (A.hashes(data, start, end) == whole).all()
    assert len(A.hashes(data, start[:0], end[:0])) == 0
