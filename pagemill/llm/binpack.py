"""Best-fit packing by best-two-fit: bins are filled greedily, then a bin's smallest document gives way to two that fit better.

Which document of a length goes where does not matter, so the lengths are packed: a table of how many documents have each length, which has no more
entries than a sequence has tokens, however many documents there are. Equal bins are made at once. Documents then take the
places of their length by their rank among the documents of that length; ranks are counts in each partition of the encoded rows and their sums over partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import arrays as A
from pagemill.llm.bpe import ByteBpe
from pagemill.llm.packing import _before as stretches_before
from pagemill.llm.session import saved

LENGTH, END = 1024, 2


def best_two_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins) for documents of these lengths, each at most `length`.

    A bin takes the longest document that fits, again and again. If room is left, its shortest one is put back when two others
    fill more of the room that it leaves; of such pairs the one that fills most is taken, then the one with the longer document. The next bin comes out
    the same until one of its lengths runs short.
    """
    left = np.zeros(length + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    bins = []
    while left.any():
        used: list[int] = []
        room = length
        while room:
            size = int(np.flatnonzero(left[: room + 1])[-1]) if left[: room + 1].any() else 0
            if not size:
                break
            used.append(size)
            left[size] -= 1
            room -= size
        if room and len(used) > 1:
            small, room = used[-1], room + used[-1]
            sizes = np.flatnonzero(left[: room + 1])
            if len(sizes):
                longest = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))
                other = longest[room - sizes]
                pairs = np.where((other > sizes) | ((other == sizes) & (left[sizes] > 1)), sizes + other, 0)
                pairs[other == 0] = 0
                if pairs.max() > small:
                    best = int(np.lexsort((other, pairs))[-1])
                    left[small] += 1
                    used[-1:] = [int(other[best]), int(sizes[best])]
                    left[used[-2]] -= 1
                    left[used[-1]] -= 1
        need = {s: used.count(s) for s in set(used)}
        more = min(int(left[s]) // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= more * k
        bins.append((used, 1 + more))
    return bins


class Places:
    """For documents of a length by their rank among them: the bin and the place in it."""

    def __init__(self, bins: list[tuple[list[int], int]]):
        next_: dict[int, int] = {}
        rows, first = [], 0
        for used, times in bins:
            for size in dict.fromkeys(used):
                own = used.count(size)
                rows.append((size, next_.get(size, 0), first, own, sum(s for s in used[: used.index(size)])))
                next_[size] = next_.get(size, 0) + own * times
            first += times
        self.bins = first
        self.size, self.rank, self.bin, self.each, self.base = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
        self.key = self.size << 48 | self.rank

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, size << 48 | rank, side="right") - 1
        turn = rank - self.rank[at]
        return self.bin[at] + turn // self.each[at], self.base[at] + turn % self.each[at] * size


def pack_best_fit(documents: DataFrame, *, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end: int | None = END) -> DataFrame:
    """One row for each piece of a document: doc_id, piece (from 0), start, length, ids, doc_tokens, sequence_id, offset.

    A document is its byte-level BPE ids and then `end`; ids are little-endian unsigned 32-bit numbers. Documents of up to `length` tokens stay whole.
    Longer ones are cut into pieces of `length`, whose first one holds what is over; each full piece is a sequence of its own,
    with a negative number, and the first pieces are packed with the short documents by best-two-fit.

    Null texts are empty and yield `end` alone (nothing, if end is None, as does an empty text then). Null and repeated doc_ids are packed like any
    others, as each row is a document; other columns are left out. An empty table gives an empty result.

    The driver sees how many pieces have each length. Ids of pieces shorter than `length` cross one shuffle, by partition and length; Spark broadcasts
    the ranks instead where it measures them to be small.
    """
    bpe = ByteBpe(tokenizer)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def tokenise(batches):
        squeeze, seen, part = zstandard.ZstdCompressor(level=1), np.zeros(length + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for own, ids, first in bpe.encode(batch, "text", end):
                n = np.diff(first)
                pieces = -(-n // length)
                row, piece = np.repeat(np.arange(len(n)), pieces), A.spread(np.zeros(len(n), np.int64), pieces)
                over = (n - (pieces - 1) * length)[row]
                start, size = np.where(piece == 0, 0, over + (piece - 1) * length), np.where(piece == 0, over, length)
                order = np.argsort(size, kind="stable")
                turn = np.empty_like(order)
                turn[order] = np.arange(len(order)) - np.searchsorted(size[order], size[order])
                slot = seen[size] + turn
                seen += np.bincount(size, minlength=length + 1)
                at = first[row] + start
                packed = [squeeze.compress(ids[a:b].tobytes()) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("doc_id").take(pa.array(row)), *map(pa.array, (piece.astype(np.int32), start, size, n[row])), pa.array(packed, pa.binary()), pa.array(np.full(len(row), part)), pa.array(slot)], ["doc_id", "piece", "start", "length", "doc_tokens", "ids", "part", "slot"])

    doc_type = rows.schema["doc_id"].dataType.simpleString()
    pieces = saved(rows.mapInArrow(tokenise, f"doc_id {doc_type}, piece int, start long, length long, doc_tokens long, ids binary, part long, slot long"))
    short = pieces.where(F.col("length") < length)
    counted = saved(short.groupBy("length", "part").agg(F.count("*").alias("n")))
    places = Places(best_two_fit({r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length))  # a row for each length
    before = stretches_before(counted, ["length"], "part", "n", "before").select(F.col("length").alias("_length"), F.col("part").alias("_part"), "before")
    ranked = short.join(before, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))).withColumn("slot", F.col("slot") + F.col("before")).select(*pieces.columns)

    def place(batches, full: bool):
        squeeze = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                own = b.slice(at, 2048)
                part, slot, size = (own.column(c).to_numpy() for c in ("part", "slot", "length"))
                bin_, offset = (-1 - (part << 40 | slot), np.zeros(len(size), np.int64)) if full else places.of(size, slot)
                ids = [np.frombuffer(squeeze.decompress(x), dtype=bpe.dtype).astype("<u4").tobytes() for x in own.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(ids, pa.binary()), own.column("doc_tokens"), pa.array(bin_), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {doc_type}, piece int, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    whole = pieces.where(F.col("length") == length).mapInArrow(lambda x: place(x, True), schema)
    return ranked.mapInArrow(lambda x: place(x, False), schema).unionByName(whole)
