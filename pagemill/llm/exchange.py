"""Blocks of documents, and what comes back to them.

A block is a bounded run of whole documents, compressed in one row. What tasks ask about a block's items (words, strings) are
plain rows with the block's number and the item's hash; Spark shuffles, sorts and joins these by key, so their number
follows the input and not the square of the blocks. Answers are rows of the same kind and are gathered by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemill.llm import arrays as A
from pagemill.llm.session import saved

ROWS_A_BATCH = 50_000


def write(table: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return squeezed(sink.getvalue())


def read(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueezed(block)).read_all().combine_chunks()


def squeezed(payload: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(payload)


def unsqueezed(payload: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload)


def blocks(rows: DataFrame, text: str, block_bytes: int = A.SLICE_BYTES, deal: str | None = None) -> DataFrame:
    """batch_id, block: all rows in blocks of about block_bytes of text; rows that differ in `deal` (few whole numbers), a column of the result, share no block.

    Saved, so that a block keeps its number.
    """
    names = ["batch_id", "block"] + ([deal] if deal else [])

    def run(batches):
        at, held, size = TaskContext.get().partitionId() << 32, {}, {}

        def closed(own):
            nonlocal at
            values = [pa.array([at]), pa.array([write(pa.Table.from_batches(held.pop(own)))], pa.binary())]
            at += 1
            return pa.RecordBatch.from_arrays([*values, *([pa.array([own], pa.int32())] if deal else [])], names)

        for batch in batches:
            kinds = np.unique(batch.column(deal).to_numpy()).tolist() if deal else [0]
            for own in kinds:
                rows = batch.filter(pa.array(batch.column(deal).to_numpy() == own)) if len(kinds) > 1 else batch
                for part in A.slices(rows, text, block_bytes):
                    more = int(A.utf8(part.column(text))[1][-1])
                    if own in held and size[own] + more > block_bytes:
                        yield closed(own)
                    if own not in held:
                        held[own], size[own] = [], 0
                    held[own].append(part)
                    size[own] += more
        for own in [*held]:
            yield closed(own)

    return saved(rows.mapInArrow(run, "batch_id long, block binary" + (f", `{deal}` int" if deal else "")))


def over_blocks(packed: DataFrame, work: Callable[..., Iterator], schema: str | T.StructType) -> DataFrame:
    """work(batch_id, table, *answers) yields record batches of the schema, for each block; an answer is bytes or None."""

    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("batch_id", "block")]
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield from work(one.column("batch_id")[0].as_py(), read(one.column("block")[0].as_py()), *(one.column(c)[0].as_py() for c in names))

    return packed.mapInArrow(run, schema)


def rows_of(schema: T.StructType | pa.Schema | list[str], columns: list[np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    """The columns in record batches of bounded length."""
    made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    for at in range(0, len(made[0]), ROWS_A_BATCH):
        yield pa.RecordBatch.from_arrays([c.slice(at, ROWS_A_BATCH) for c in made], schema)


def gathered(answers: DataFrame, name: str, kind: str) -> DataFrame:
    """(batch_id, name): the answers (batch_id, key long, value of a numpy kind) of each block in one row; a block's answers are no more than its items."""

    def run(number, own):
        return pa.table({"batch_id": pa.array([number[0].as_py()], pa.int64()), name: pa.array([squeezed(own.column("key").to_numpy().astype("<i8").tobytes() + own.column("value").to_numpy().astype(kind).tobytes())], pa.binary())})

    return answers.groupBy("batch_id").applyInArrow(run, f"batch_id long, `{name}` binary")


def answers_of(payload: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values that were gathered."""
    data = unsqueezed(payload)
    count = len(data) // (8 + np.dtype(kind).itemsize)
    return np.frombuffer(data, "<u8", count), np.frombuffer(data, kind, count, 8 * count)


def told(payload: bytes | None, keys: np.ndarray, kind: str) -> np.ndarray:
    """For each of a block's keys (sorted, distinct) the sum of the values that were gathered for it, 0 where there is none."""
    out = np.zeros(len(keys), dtype=kind)
    if payload is not None:
        key, value = answers_of(payload, kind)
        np.add.at(out, np.searchsorted(keys, key), value)
    return out
