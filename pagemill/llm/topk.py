"""Exact top-k inner products: candidates by descending length, partial sums in a rotated basis, pruning by Cauchy-Schwarz.

The rotation comes from the singular vectors of all candidates (their d x d Gram matrix), so that the first coordinates hold
most of each vector. Candidates are cut into blocks of falling length, queries into blocks of like need: the length that a
candidate must have, at least, to reach the k-th score that the longest candidates give. Only blocks that can meet the need of a
block of queries are shipped to it. Within a block a query stops where length times length cannot reach
its k-th score; candidates before that are kept while head product plus the product of the residual lengths can. What is
left is scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.session import partitions, saved

K, HEAD, TILE, CLASSES = 10, 16, 1024, 64


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of a block (vectors as a matrix) in the smallest whole numbers that hold them."""
    both = np.column_stack([c.astype(np.int64) for c in columns])
    kind = next(k for k in ("<i2", "<i4", "<i8") if not both.size or (both.max() <= np.iinfo(k).max and both.min() >= np.iinfo(k).min))
    return kind.encode() + both.astype(kind).tobytes()


def _unpack(block: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and vectors."""
    both = np.frombuffer(block, dtype=block[:3].decode(), offset=3).reshape(-1, width + 2).astype(np.int64)
    return both[:, 0], both[:, 1], both[:, 2:]


def _better(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate([scores, more]), np.concatenate([ids, more_ids])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_block(query_rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, head: int = HEAD) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of each query's k best in a block, without its own row, leaving out what scores below floor."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    rows, ids, vectors, length = rows[order], ids[order], vectors[order], length[order]
    turned, asked = vectors @ rotation, queries @ rotation
    rest = np.sqrt(np.maximum((turned[:, head:] ** 2).sum(axis=1), 0))
    asked_rest = np.sqrt(np.maximum((asked[:, head:] ** 2).sum(axis=1), 0))
    asked_length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_rows]
    least = floor.astype(np.float64).copy()
    slack = 1e-9 * (1 + asked_length * (length[0] if len(length) else 0))
    for first in range(0, len(ids), TILE):
        live = np.flatnonzero(asked_length * length[first] + slack >= least)
        if not len(live):
            break
        tile = slice(first, first + TILE)
        bound = asked[live, :head] @ turned[tile, :head].T + asked_rest[live, None] * rest[tile][None, :]
        for q, may in zip(live, bound + slack[live, None] >= least[live, None], strict=True):
            at = first + np.flatnonzero(may)
            at = at[rows[at] != query_rows[q]]
            if len(at):
                best[q] = _better(*best[q], vectors[at] @ queries[q], ids[at], k)
                if len(best[q][0]) == k:
                    least[q] = max(least[q], best[q][0][-1])
    return best


def needed(queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The least length by which a candidate can reach a query's floor; never more than that."""
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    return np.where((floor > 0) & (length > 0), floor / np.maximum(length, 1e-300) * (1 - 1e-9), -np.inf)


def block_pairs(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qb, cb) of the blocks of queries (qb, need) and candidates (cb, longest) that can meet: longest >= need.

    Met by classes of length, of which there are 64, so that no pairs are made that cannot meet but those within one class.
    """
    cuts = blocks.agg(F.percentile_approx("longest", [i / CLASSES for i in range(1, CLASSES)], 10_000)).first()[0] or []
    edges = F.array(*map(F.lit, sorted(set(cuts))))
    # a class is how many edges are at or below a length
    by_class = lambda c: F.size(F.filter(edges, lambda e: e <= F.col(c)))
    last = len(set(cuts))
    wanted = asked.select("qb", "need", F.explode(F.sequence(by_class("need"), F.lit(last))).alias("class"))
    return wanted.join(blocks.select("cb", "longest", by_class("longest").alias("class")), "class").where("longest >= need").select("qb", "cb")


def top_k(vectors: DataFrame, *, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024, k: int = K, block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `queries` picks, the k others of highest inner product.

    Components become floor(scale * x). Ties go to the smaller vec_id; a query with fewer than k other rows gets them all.
    Rows with a null id, a null vector, or a null or non-finite component take no part; shorter vectors count as
    filled up with zeros, and an empty one scores 0. Rows that repeat a vec_id are rows of their own: each is a candidate for the others and, if picked,
    asks for itself. Whole numbers are exact while sums stay below 2**63. An empty table gives an empty result.

    What the driver sees is the Gram matrix, a block of the longest candidates and 63 lengths.
    """
    spark = vectors.sparkSession
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = saved(vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & whole).select(F.col(vec_id).cast("long").alias("id"), scaled.alias("v"), F.coalesce(queries, F.lit(False)).alias("q")))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    asked, width = rows.agg(F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def matrix(column) -> np.ndarray:
        out = np.zeros((len(column), width), dtype=np.int64)
        for i, x in enumerate(column):
            out[i, : len(x)] = x
        return out

    def gram(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = matrix(b.column("v").to_pylist()).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "g"])

    sums = rows.select("v").mapInArrow(gram, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    total = np.zeros((width, width))
    for r in sums:
        total[r.i, r.j] = r.g
    rotation = np.linalg.eigh(total)[1][:, ::-1].copy()

    def blocked(batches, size: int) -> Iterator[list[np.ndarray]]:
        """Columns of runs of `size` rows, vectors as a matrix."""
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                own = b.slice(0, size - n)
                held, n, b = [*held, own], n + own.num_rows, b.slice(own.num_rows)
                if n == size:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def candidates(batches):
        for t in blocked(batches, block_rows):
            packed = _pack(t.column("row").to_numpy(), t.column("id").to_numpy(), matrix(t.column("v").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt(t.column("n2").to_numpy().max()) * (1 + 1e-9))]), pa.array([packed], pa.binary())], ["longest", "block"])

    falling = rows.select("row", "id", "v", "n2").repartitionByRange(partitions(spark), F.desc("n2"), "row").sortWithinPartitions(F.desc("n2"), "row")
    blocks = saved(falling.mapInArrow(candidates, "longest double, block binary")).withColumn("cb", F.monotonically_increasing_id())
    longest = rows.orderBy(F.desc("n2"), "row").select("row", "id", "v").limit(4 * TILE).toArrow()
    head = spark.sparkContext.broadcast((longest.column("row").to_numpy(), longest.column("id").to_numpy(), matrix(longest.column("v").to_pylist()), rotation))

    def floors(batches):
        for b in batches:
            own, found = matrix(b.column("v").to_pylist()), []
            for at in range(0, len(own), query_rows):
                part = slice(at, at + query_rows)
                best = search_block(b.column("row").to_numpy()[part], own[part], np.full(len(own[part]), -np.inf), *head.value, k)
                found += [float(scores[-1]) if len(scores) == k else -np.inf for scores, _ in best]
            found = np.array(found, np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.array(needed(own, found))], [*b.schema.names, "floor", "need"])

    def query_blocks(batches):
        for t in blocked(batches, query_rows):
            packed = _pack(t.column("row").to_numpy(), t.column("id").to_numpy(), matrix(t.column("v").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([float(t.column("need").to_numpy().min())]), pa.array([packed], pa.binary()), pa.array([t.column("floor").to_numpy().tobytes()], pa.binary())], ["need", "asked", "floor"])

    known = rows.where("q").select("row", "id", "v").mapInArrow(floors, "row long, id long, v array<long>, floor double, need double")
    ready = known.repartitionByRange(max(1, min(partitions(spark), asked // query_rows)), "need", "row").sortWithinPartitions("need", "row")
    ready = saved(ready.mapInArrow(query_blocks, "need double, asked binary, floor binary")).withColumn("qb", F.monotonically_increasing_id())
    met = block_pairs(ready.select("qb", "need"), blocks.select("cb", "longest")).join(ready, "qb").join(blocks, "cb")

    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, own, floor = (b.column(c)[i].as_py() for c in ("block", "asked", "floor"))
                query, query_id, asked_for = _unpack(own, width)
                best = search_block(query, asked_for, np.frombuffer(floor, np.float64), *_unpack(block, width), head.value[3], k)
                n = [len(x) for x, _ in best]
                columns = [np.repeat(query, n), np.repeat(query_id, n), np.concatenate([x for _, x in best]), np.concatenate([x for x, _ in best])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["row", "query_id", "vec_id", "score"])

    found = met.select("block", "asked", "floor").mapInArrow(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
