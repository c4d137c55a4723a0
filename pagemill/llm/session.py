"""Where lineage is cut, and how many partitions a shuffle has."""

from __future__ import annotations

import gc
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to a Python worker at once, one row at least.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session (tests) has one of its own, and a cluster is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder, without its lineage. Spark's cleaner removes it after use where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles of steps that are saved and done with, instead of waiting for the driver's next full collection.

    Python's and the JVM's garbage goes; a small job before takes the place of the last one, which the driver still holds. The
    JVM hears of Python's garbage a moment later.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(1)
        spark.range(2).repartition(1).count()
        spark._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of about BATCH_BYTES.

    By default 10,000 rows go at once, or 64 MB; both the JVM's buffer, which doubles as it grows, and the worker's copies follow that
    in each running task. A smaller limit of the session's own stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = {"b": 0, "k": 10, "m": 20, "g": 30}
    digits, unit = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(digits) << units[unit or "b"] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none clashes with a column."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
