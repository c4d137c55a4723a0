"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents. In every round a queue is given its share of a window of tokens, and sends packets (whole
documents, or `packet` tokens of a longer one) as long as what it was given covers them; the rest is its deficit and is carried to
the next round, across windows and partitions. So packet k of a queue goes in round ceil(tokens up to and with it / tokens a
round): deficits before any round have a closed form, and rounds are worked on apart. The packets of all rounds in order are
one stream, which is cut into windows; nothing is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.bpe import ByteBpe
from pagemill.llm.session import saved, small_batches

LENGTH, END = 2048, 1
#: Documents of a stretch of a queue, rounds of a stretch of the stream, and stretches that are summed together.
ROWS_A_STRETCH, ROUNDS_A_STRETCH, STRETCHES = 2048, 64, 4096
#: Tokens whose pieces a task hands on together, whole documents at least.
TOKENS_AT_ONCE = 1 << 18


def tail(rest: int) -> list[int]:
    """Offsets at which a last window of `rest` tokens is cut into powers of two, the largest first."""
    cuts, at = [], 0
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    return cuts


def _before(rows: DataFrame, keys: list[str], stretch: str, size: str, name: str) -> DataFrame:
    """(keys, stretch, name): the sum of size in all stretches before each one, in three levels so that no task has all rows of a key."""
    own = rows.groupBy(*keys, stretch).agg(F.sum(size).alias("_own")).withColumn("_coarse", F.floor(F.col(stretch) / STRETCHES))
    coarse = own.groupBy(*keys, "_coarse").agg(F.sum("_own").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_coarse")) - F.col("_sum")
    coarse = coarse.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_coarse").alias("_at"), upto.alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_coarse") == F.col("_at")]
    inner = F.sum("_own").over(Window.partitionBy(*keys, "_coarse").orderBy(stretch)) - F.col("_own")
    return own.withColumn("_inner", inner).join(coarse, same).select(*keys, stretch, (F.col("_inner") + F.col("_start")).alias(name))


def rounds_of(queued: DataFrame, weights: DataFrame | None, quantum: int, packet: int) -> DataFrame:
    """Packets (queue, at, row, part, size, round) of documents (queue, at: a random place in it, row, n), and `before`, the tokens of the queue before them.

    weights (source, weight) are shares of a round; without them, a source has its share of all tokens. Weights are scaled to a
    sum of 1 over the sources that there are; a source without one or with none above 0 goes with the least of the others.
    """
    totals = queued.groupBy("queue").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    if weights is None:
        share = totals.withColumn("weight", F.col("total").cast("double"))
    else:
        asked = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
        share = totals.join(asked, F.col("queue").eqNullSafe(F.col("_source")), "left")
        share = share.crossJoin(share.agg(F.coalesce(F.min("weight"), F.lit(1.0)).alias("_least"))).withColumn("weight", F.coalesce("weight", "_least"))  # one row
    share = share.crossJoin(share.agg(F.sum("weight").alias("_all"))).select("queue", "rows", (F.col("weight") / F.col("_all") * quantum).alias("a_round"))  # one row
    # where a document is in its queue: by stretches of places, whose number follows the queue's length
    sized = share.select(F.col("queue").alias("_queue"), "a_round", F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_A_STRETCH)).alias("_stretches"))
    placed = queued.join(sized, F.col("queue").eqNullSafe(F.col("_queue"))).drop("_queue").withColumn("stretch", F.floor(F.pmod("at", F.lit(1 << 40)) * F.col("_stretches") / float(1 << 40)))
    starts = _before(placed, ["queue"], "stretch", "n", "_start")
    starts = starts.select(F.col("queue").alias("_queue"), F.col("stretch").alias("_stretch"), "_start")
    order = Window.partitionBy("queue", "stretch").orderBy(F.pmod("at", F.lit(1 << 40)), "row")
    placed = placed.withColumn("_inner", F.sum("n").over(order) - F.col("n")).join(starts, F.col("queue").eqNullSafe(F.col("_queue")) & (F.col("stretch") == F.col("_stretch")))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / packet))
    packets = placed.select("queue", "row", "n", "a_round", (F.col("_inner") + F.col("_start")).alias("before"), F.explode(parts).alias("part"))
    packets = packets.select("queue", "row", "a_round", (F.col("before") + F.col("part") * packet).alias("before"), "part", F.least(F.lit(packet), F.col("n") - F.col("part") * packet).alias("size"))
    return packets.select("queue", "row", "part", "size", "before", F.ceil((F.col("before") + F.col("size")) / F.col("a_round")).cast("long").alias("round"))


def pack(documents: DataFrame, *, tokenizer: str, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: DataFrame | None = None, length: int = LENGTH, end: int | None = END, quantum: int | None = None, packet: int | None = None) -> DataFrame:
    """One row for each piece of a document: doc_id, source, start, length, ids, doc_tokens, sequence_id, offset.

    A document is its byte-level BPE ids and then `end`; ids are little-endian unsigned 32-bit numbers. Sources are mixed by
    `weights` (source, weight), or by their shares of all tokens: after every round of `quantum` tokens (a window) each queue that is
    not empty has sent its share, less than a packet aside, which stays its deficit. A queue whose weight is larger than its share ends
    earlier; the others go on. Pieces are cut where a packet (a window, if not given) or a window ends, so documents stay whole
    where that is possible. The last window is cut into sequences whose lengths are powers of two, so nothing is padded.

    Documents are queued in random order, by a hash of doc_id and their row. Queues and the stream are summed in stretches, so neither
    a large source nor many sources are one task's, and the driver sees one number. Ids cross one shuffle.

    Null texts are empty and yield `end` alone (nothing, if end is None, as does an empty text then). A null source is a
    queue of its own. Null and repeated doc_ids are packed like any others; other columns are left out. An empty table gives
    an empty result.
    """
    small_batches(documents.sparkSession)
    bpe = ByteBpe(tokenizer)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def tokenise(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, ids, first in bpe.encode(batch, "text", end):
                packed = [squeeze.compress(ids[first[i] : first[i + 1]].tobytes()) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(np.diff(first)), pa.array(packed, pa.binary())], ["doc_id", "source", "n", "ids"])

    doc_type = rows.schema["doc_id"].dataType.simpleString()
    made = saved(rows.mapInArrow(tokenise, f"doc_id {doc_type}, source string, n long, ids binary").where("n > 0")).withColumn("row", F.monotonically_increasing_id())
    queued = made.select(F.col("source").alias("queue"), "row", "n", F.xxhash64("doc_id", "row").alias("at"))
    packets = saved(rounds_of(queued, weights, quantum or length, packet or length).withColumn("stretch", F.floor(F.col("round") / ROUNDS_A_STRETCH)))
    total = packets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    starts = _before(packets, [], "stretch", "size", "_start")
    inner = F.sum("size").over(Window.partitionBy("stretch").orderBy("round", "queue", "before")) - F.col("size")
    at = packets.withColumn("_inner", inner).join(starts, "stretch").select("row", (F.col("part") * (packet or length)).alias("start"), "size", (F.col("_inner") + F.col("_start")).alias("at"))
    own = at.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "size", "at"))).alias("packets"))  # a document's packets
    full, rest = divmod(total, length)
    cuts = np.array(tail(rest) or [0])

    def gathered(batch, rows, ids, columns):
        """The pieces of some of a batch's rows as one batch; ids are laid end to end."""
        start, size, sequence, offset = (np.concatenate(x) for x in zip(*columns, strict=True))
        tokens = np.array([len(x) for x in ids])
        pieces = np.array([len(x[0]) for x in columns])
        ends = np.cumsum(tokens)
        at = np.append(start + np.repeat(ends - tokens, pieces), ends[-1]) * 4
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.concatenate(ids))]).cast(pa.binary())
        same = pa.array(np.repeat(rows, pieces))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(same), batch.column("source").take(same), pa.array(start), pa.array(size), data, pa.array(np.repeat(tokens, pieces)), pa.array(sequence), pa.array(offset)], ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def cut(batches):
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            packed, packets = batch.column("ids").to_pylist(), batch.column("packets")
            bound, inner = packets.offsets.to_numpy(), packets.values
            starts, sizes, places = (inner.field(x).to_numpy() for x in ("start", "size", "at"))
            rows, held, columns, waiting = [], [], [], 0
            for k in range(batch.num_rows):
                ids = np.frombuffer(squeeze.decompress(packed[k]), dtype=bpe.dtype).astype("<u4")
                own = slice(bound[k], bound[k + 1])
                start, size, at = starts[own], sizes[own], places[own]
                bounds = [np.stack([at, start])]
                for a, s, n in zip(at.tolist(), start.tolist(), size.tolist(), strict=True):  # where windows, and sequences of the last one, begin in it
                    if a // length == (a + n - 1) // length < full:
                        continue
                    inside = np.arange(a // length + 1, (a + n - 1) // length + 1) * length
                    if a + n > full * length:
                        inside = np.append(inside, full * length + cuts)
                        inside = np.unique(inside[(inside > a) & (inside < a + n)])
                    bounds.append(np.stack([inside, inside - a + s]))
                if len(bounds) > 1 or len(start) > 1:
                    at, start = np.concatenate(bounds, axis=1)
                    order = np.argsort(start)
                    at, start = at[order], start[order]
                    size = np.diff(np.append(start, len(ids)))
                    new = np.append(True, (at[1:] != at[:-1] + size[:-1]) | (at[1:] % length == 0))
                    if at[-1] > full * length:
                        new[1:] |= np.isin(at[1:], full * length + cuts)
                    at, start = at[new], start[new]  # packets that follow each other in a window are one piece
                    size = np.diff(np.append(start, len(ids)))
                sequence, offset = at // length, at % length
                last = sequence == full
                if last.any():
                    which = np.searchsorted(cuts, offset[last], side="right") - 1
                    sequence[last] += which
                    offset[last] -= cuts[which]
                rows.append(k)
                held.append(ids)
                columns.append((start, size, sequence, offset))
                waiting += len(ids)
                if waiting >= TOKENS_AT_ONCE or k == batch.num_rows - 1:
                    yield gathered(batch, rows, held, columns)
                    rows, held, columns, waiting = [], [], [], 0

    schema = f"doc_id {doc_type}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return made.join(own, "row").select("doc_id", "source", "ids", "packets").mapInArrow(cut, schema)
