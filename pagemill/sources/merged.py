"""Tables that keep one row for each key: batches of rows are added as they are, and the better row of a key wins when the table is read.

A table is a folder with `data`, Parquet folders that are never changed, and `log`, one small file for each version of the table that lists them. A batch is
written beside the others and counts once its version's file is there, which takes one rename; whatever ends before leaves
the table as it was. Folders are merged when the newer one has grown to half of the one before, so their number follows the logarithm of
the table's size and a row is written anew so many times at most.

Rows themselves are not moved. Which row of a key wins is found from keys, what they are ordered by, and where rows are (file and number); where
the others are goes to every reader as bitmaps, a bit for each row of a file that has any.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a file that merging makes, where there are as many, and those below which many files are made few.
FILE_BYTES, SMALL = 32 << 20, 1 << 20


class MergedTable:
    """A table at a path with the columns of its first batch.

    The row of a key that is largest by `order` (SQL expressions over its columns) wins. Of equal ones the row of the later batch wins, or
    that of the earlier batch where `first_stays`; within a batch the row whose hash over all columns is larger, so the winner is
    defined. Null keys are a key. A table has one writer at a time: two that would write the same version fail but for one of them.
    """

    #: Versions whose folders stay for those who still read them.
    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None, first_stays: bool = False, codec: str | None = None):
        """codec: what files are compressed by, if not by the session's own."""
        self.spark, self.path, self.keys, self.order, self.first_stays = spark, path, keys, order or [], first_stays
        self.codec = codec or spark.conf.get("spark.sql.parquet.compression.codec")
        self._log = posixpath.join(path, "log")

    # files
    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(*parts))

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        files, log = self._files(), self._at(self._log)
        names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[0] != ".")

    def _listed(self, version: int) -> dict:
        text = self._files().open(self._at(self._log, f"{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(text, "UTF-8"))
        finally:
            text.close()

    def state(self) -> dict:
        """runs (name, bytes; the oldest first), the last stream batch, and the schema as JSON, of the newest version."""
        versions = self._versions()
        return self._listed(versions[-1]) | {"version": versions[-1]} if versions else {"version": -1, "runs": [], "batch": -1, "schema": None}

    def _commit(self, state: dict, runs: list[dict], batch: int, schema: str) -> dict:
        """Makes runs the next version. The name is taken only if nobody else has it."""
        new = {"runs": runs, "batch": batch, "schema": schema}
        files, version = self._files(), state["version"] + 1
        hidden, final = self._at(self._log, f".{uuid.uuid4().hex}"), self._at(self._log, f"{version:020d}.json")
        out = files.create(hidden, False)
        out.write(bytearray(json.dumps(new), "utf-8"))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self.spark._jsc.hadoopConfiguration()).rename(hidden, final, none)
        return new | {"version": version}

    def _saved(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        path = posixpath.join(self.path, "data", name)
        rows.write.option("compression", self.codec).parquet(path)
        return {"name": name, "bytes": self._held(name).getLength()}

    def _held(self, name: str):
        return self._files().getContentSummary(self._at(self.path, "data", name))

    def _removed(self, run: dict) -> None:
        self._files().delete(self._at(self.path, "data", run["name"]), True)

    def _run(self, runs: list[dict], schema: str) -> DataFrame:
        """The rows of runs, and where they are: _file and, from 1 on, _row."""
        from pyspark.sql.types import StructType

        rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(posixpath.join(self.path, "data", r["name"]) for r in runs))
        return rows.select("*", F.col("_metadata.file_name").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_row"))

    # rows
    def _narrow(self, rows: DataFrame, turn: Column) -> DataFrame:
        """_key, _by, _file, _row; turn: what decides after the order."""
        return rows.select(F.struct(*self.keys).alias("_key"), F.struct(*(F.expr(x) for x in self.order), turn.alias("_turn")).alias("_by"), "_file", "_row")

    def _beaten(self, narrow: DataFrame) -> DataFrame:
        """_file, _block, _bits: where the rows are that another one of their key beats."""
        at = F.struct("_file", "_row")
        best = narrow.groupBy("_key").agg(F.max_by(at, F.struct("_by", at)).alias("_best"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_best")
        lost = narrow.join(best, "_key").where(at != F.col("_best"))
        return lost.groupBy("_file", F.bitmap_bucket_number("_row").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("_bits"))

    def _without(self, rows: DataFrame, beaten: DataFrame) -> DataFrame:
        """Rows of _run without those beaten."""
        bit = F.bitmap_bit_position("_row")
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        there = (F.col("r._file") == F.col("b._file")) & (F.bitmap_bucket_number("_row") == F.col("b._block")) & (F.getbit(byte, (bit % 8).cast("int")) == 1)
        return rows.alias("r").join(F.broadcast(beaten).alias("b"), there, "left_anti")

    def _merged(self, runs: list[dict], schema: str, within: DataFrame | None = None, columns: list[Column | str] | None = None) -> DataFrame:
        """Runs, the oldest first, as one. Only rows whose keys a later run has as well are looked at; rows come from their files as they are."""
        rows = self._run(runs, schema)
        if len(runs) > 1:
            turns = [self._narrow(self._run([r], schema), F.lit(-k if self.first_stays else k)) for k, r in enumerate(runs)]
            if within is not None:
                turns = [t.select("*", *(F.col(f"_key.{c}") for c in within.columns)).join(within, within.columns, "left_semi").drop(*within.columns) for t in turns]
            later = turns[1]
            for t in turns[2:]:
                later = later.unionByName(t)
            rows = self._without(rows, self._beaten(later.unionByName(turns[0].join(later.select("_key").distinct(), "_key", "left_semi"))))
        rows = rows.select(*(columns or [c["name"] for c in json.loads(schema)["fields"]]))
        return rows if within is None else rows.join(within, within.columns, "left_semi")

    def _tidied(self, run: dict, schema: str) -> dict:
        """A run just written, or, where a key comes twice in it or it is many files of less than SMALL, one in its place with the winners in few files. Nobody else knows of it yet."""
        rows = self._run([run], schema)
        own = [c for c in rows.columns if c not in ("_file", "_row")]
        beaten = self._beaten(self._narrow(rows, F.xxhash64(*own))).persist()
        try:
            if beaten.isEmpty() and self._held(run["name"]).getFileCount() <= 8 + run["bytes"] // SMALL:
                return run
            new = self._saved(self._without(rows, beaten).select(*own).coalesce(run["bytes"] // FILE_BYTES + 1))
        finally:
            beaten.unpersist()
        self._removed(run)
        return new

    def append(self, rows: DataFrame, batch: int | None = None) -> None:
        """Adds rows. A stream's batch that was added before (its number is not above the last one) is left out, so it may come again."""
        state = self.state()
        if batch is not None and batch <= state["batch"]:
            return
        schema = state["schema"] or rows.schema.json()
        own = self._saved(rows.select(*(c["name"] for c in json.loads(schema)["fields"])))
        state = self._commit(state, [*state["runs"], self._tidied(own, schema)], state["batch"] if batch is None else batch, schema)
        self._compact(state)

    def _compact(self, state: dict) -> None:
        """Merges the newest runs as long as the one before is less than twice as large."""
        runs, last = state["runs"], len(state["runs"]) - 1
        size = runs[last]["bytes"]
        while last and runs[last - 1]["bytes"] < 2 * size:
            last -= 1
            size += runs[last]["bytes"]
        if last < len(runs) - 1:
            rows = self._merged(runs[last:], state["schema"]).coalesce(size // FILE_BYTES + 1)
            state = self._commit(state, [*runs[:last], self._saved(rows)], state["batch"], state["schema"])
        self._tidy(state["version"])

    def _tidy(self, version: int) -> None:
        """Removes versions that are older than those kept, and what only they list. Folders of no version are left, as their writer may be at work."""
        kept = [v for v in self._versions() if v > version - self.KEPT]
        used = {r["name"] for v in kept for r in self._listed(v)["runs"]}
        for old in (v for v in self._versions() if v <= version - self.KEPT):
            for run in self._listed(old)["runs"]:
                if run["name"] not in used:
                    self._removed(run)
            self._files().delete(self._at(self._log, f"{old:020d}.json"), False)

    def read(self, within: DataFrame | None = None, columns: list[Column | str] | None = None) -> DataFrame:
        """The rows of the newest version; with `within` (some key columns) only those of its keys, and with `columns` only these (`within`'s among them), so
        that nothing else is moved to meet `within`. A table without any batch has no columns to read."""
        state = self.state()
        if not state["runs"]:
            raise ValueError(f"nothing was written to {self.path}")
        return self._merged(state["runs"], state["schema"], within, columns)
