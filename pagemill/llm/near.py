"""Jaccard join on word n-grams: a MinHash LSH forest finds what may be linked, shared shingles decide.

Each tree of the forest is one sorted run of all signatures, so that neighbours share prefixes, and the prefix that two neighbours
share is known from one pass. At first documents are candidates that share a prefix of full depth in some tree. Candidates that
are connected are compared exactly, all with all, in blocks. From the similarities of the links that are found follows how
many were missed: a link of similarity s shares a prefix of depth d in one of t trees with probability 1 - (1 - s^d)^t. While the
recall so estimated is below its target, the prefix is shortened by one, and components that grew are compared anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import arrays as A
from pagemill.llm.graph import components
from pagemill.llm.session import fresh, partitions, saved, small_batches, swept

WORDS, THRESHOLD, RECALL, TREES, DEPTH = 5, 0.8, 0.9999, 24, 8
#: Documents and bytes of text of a block of exact comparisons.
BLOCK, BLOCK_BYTES = 256, 2 << 20
#: Parts that a component of several blocks is dealt into where it meets its size.
PARTS = 64


def met(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that documents of that similarity share a prefix of that depth in one tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix by which even a link at the threshold is met with the recall; 1 if none is short enough."""
    while depth > 1 and met(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `words` words (of all its words, if it has fewer), and each row's first one (with a last entry)."""
    data, offsets = A.utf8(column)
    data = A.LOWER[data]
    starts, ends, first = A.tokens(data, offsets, A.WORD)
    roll = A.Rolling(A.hashes(data, starts, ends))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    begin = A.spread(first[:-1], count)
    return roll.ranges(begin, np.minimum(begin + words, np.repeat(first[1:], count))), np.append(0, np.cumsum(count))


def _signatures(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n 16-bit minimum hashes of each row that has shingles."""
    rows = np.flatnonzero(np.diff(first))
    out = np.zeros((len(rows), n), dtype=">u2")
    if len(rows):
        low, at = (hashes >> np.uint64(32)).astype(np.uint32), first[:-1][rows]
        rng = np.random.default_rng(7)
        for k, (a, b) in enumerate(rng.integers(0, 1 << 32, (n, 2), dtype=np.uint32)):
            x = low * (a | np.uint32(1))
            x += b
            x ^= x >> np.uint32(15)
            least = np.minimum.reduceat(x, at)
            out[:, k] = A.mix(least.astype(np.uint64)) & np.uint64(0xFFFF)
    return out


def _similarity(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets `left` to the sets `right`."""
    sizes = np.array([len(x) for x in sets])
    values, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = often > 1
    place = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, item = owner[use], place[inverse[use]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 8192
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(item, [a, a + step])
        grid = np.zeros((len(sets), step), dtype=np.float32)
        grid[owner[lo:hi], item[lo:hi] - a] = 1
        common += grid[left] @ grid[right].T
    return common / (sizes[left][:, None] + sizes[right][None, :] - common)


def forest(kinds: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(a, b, shared): neighbours in the sorted tries, and how many values of their signatures are alike from the first on, where that is at least `least`.

    Tries are cut by range, with the node as the last part of the key, so a prefix that very many documents share spreads over
    tasks like any other stretch; the ends of the cuts are neighbours too.
    """
    spark = kinds.sparkSession

    def plant(batches):
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(n * trees, 2 * depth)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * depth), n * trees, [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), flat, pa.array(np.repeat(batch.column("node").to_numpy(), trees))], ["tree", "key", "node"])

    def shared_by(tree, key):
        same = np.logical_and.accumulate(key[1:] == key[:-1], axis=1).sum(axis=1)
        return np.where(tree[1:] == tree[:-1], same, 0)

    def walk(batches):
        """Edges, and the first and last row of the partition (place 0 and 1)."""
        part, before, first = TaskContext.get().partitionId(), None, True

        def rows(a, b, shared, place, tree, key):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.asarray(shared, np.int32)), pa.array([part] * n, pa.int32()), pa.array([place] * n, pa.int32()), pa.array([tree] * n, pa.int32()), pa.array([key] * n, pa.binary())], ["a", "b", "shared", "part", "place", "tree", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=">u2").reshape(-1, depth)
            if first:
                yield rows(node[:1], node[:1], [0], 0, int(tree[0]), key[0].tobytes())
                first = False
            if before:
                tree, node, key = np.append(before[0], tree), np.append(before[1], node), np.concatenate([before[2], key])
            shared = shared_by(tree, key)
            some = np.flatnonzero(shared >= least)
            yield rows(node[some], node[some + 1], shared[some], -1, None, None)
            before = tree[-1:], node[-1:], key[-1:]
        if before:
            yield rows(before[1], before[1], [0], 1, int(before[0][0]), before[2][0].tobytes())

    planted = kinds.select("signature", "node").mapInArrow(plant, "tree int, key binary, node long")
    tries = planted.repartitionByRange(partitions(spark), "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    walked = saved(tries.mapInArrow(walk, "a long, b long, shared int, part int, place int, tree int, key binary"))
    ends = Window.orderBy("part", "place")  # two rows a partition
    cuts = walked.where("place >= 0").withColumn("next", F.lead(F.struct("place", "tree", "key", "a")).over(ends)).where("place = 1 and next.place = 0 and tree = next.tree")
    alike = lambda n: F.substring("key", 1, F.lit(2 * n)) == F.substring("next.key", 1, F.lit(2 * n))
    shared = sum((alike(n).cast("int") for n in range(1, depth + 1)), F.lit(0))
    cuts = cuts.select("a", F.col("next.a").alias("b"), shared.alias("shared")).where(F.col("shared") >= least)
    return walked.where("place < 0").select("a", "b", "shared").unionByName(cuts)


def _compared(near: DataFrame, kinds: DataFrame, texts: DataFrame, words: int, threshold: float, depths: list[int], trees: int) -> DataFrame:
    """node, links, root, found, expected over blocks of components: links counted with copies, the least place linked, and links between sets, found and, by depth, estimated."""
    rows = near.join(kinds.select("node", "h", "size", "bytes"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    large = rows.groupBy("component").agg(blocks.alias("blocks")).where("blocks > 1")
    large = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("part", F.pmod(F.hash("node"), F.lit(PARTS))).join(large, ["component", "part"], "left").drop("part").fillna(1, ["blocks"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = rows.select("node", "h", "size", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(texts, ["node", "h"])

    def compare(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        _, where = np.unique(np.stack([table.column("node").to_numpy(), table.column("h").to_numpy()]), axis=1, return_index=True)
        table = table.take(where)
        hashes, first = shingles(table.column("text"), words)
        sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        node, size, side = (table.column(c).to_numpy() for c in ("node", "size", "own"))
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        n = len(node)
        links, found, expected, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(depths))), np.arange(n)
        if len(left) and len(right):
            alike = _similarity(sets, left, right)
            similar = alike >= threshold - 1e-6
            if low == high:
                np.fill_diagonal(similar, False)
            for a, b, grid in ((left, right, similar), (right, left, similar.T))[: 1 + (low != high)]:
                links[a], found[a] = grid @ size[b], grid.sum(axis=1)
            i, j = np.nonzero(similar)
            for k, depth in enumerate(depths):
                odds = 1 / met(np.clip(alike[i, j].astype(np.float64), threshold, 1), depth, trees)
                expected[left, k] += np.bincount(i, odds, len(left))
                if low != high:
                    expected[right, k] += np.bincount(j, odds, len(right))
            while True:  # the least linked place spreads until nothing changes
                old = root.copy()
                for a, b, grid in ((left, right, similar), (right, left, similar.T)):
                    root[a] = np.minimum(root[a], np.where(grid, root[b][None, :], n).min(axis=1))
                if (old == root).all():
                    break
        return pa.table({"node": node, "links": links, "root": node[root], "found": found, "expected": pa.array(list(expected), pa.list_(pa.float64()))})

    return units.groupBy("component", "low", "high").applyInArrow(compare, "node long, links long, root long, found long, expected array<double>")


def ngram_jaccard_join(documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """documents' other columns with class_id, copy_of and n_links; columns of these names are replaced.

    Two documents are linked if the Jaccard similarity of their sets of runs of `words` words is at least the threshold.
    class_id is the smallest doc_id that a document is connected to by links (its own, if it has none), copy_of the smallest
    doc_id with an equal set, n_links the number of other documents that it is linked to, equal ones included. Words are
    runs of ASCII letters (lower-cased), digits and characters above ASCII; a text of fewer words than `words` is one run.

    Equal sets become one before anything is compared, and links between different sets are counted, not listed, so neither
    a large group of copies nor one of near copies makes rows in the square of its size. Prefixes are shortened from `depth` on until
    the estimated share of links that are met reaches `recall`, at the latest where even links at the threshold are met with that
    probability; what is met is decided by the sets themselves. Where no link is found at a depth, it is shortened on.

    Texts that are null or have no words have no links. Rows with a null doc_id have no links and a null class. Rows that
    repeat a doc_id are taken for one document that holds each of these sets. An empty table gives an empty one.
    """
    small_batches(documents.sparkSession)
    columns = [c for c in documents.columns if c not in ("class_id", "copy_of", "n_links", text)]
    own = fresh(["doc_id", "h", "digest", "signature", "text", "bytes"], *(f"own_{c}" for c in columns))
    shortest = depth_for(threshold, recall, trees, depth)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    carried = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), *(F.col(c).alias(n) for c, n in zip(columns, own, strict=True)), F.col(text).alias("text"))

    def sign(batches):
        for batch in batches:
            for part in A.slices(batch, "text"):
                hashes, first = shingles(part.column("text"), words)
                signed = iter(_signatures(hashes, first, trees * depth))
                digest, signature = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    digest.append(hashlib.blake2b(np.unique(hashes[a:b]).tobytes(), digest_size=16).digest() if b > a else None)
                    signature.append(next(signed).tobytes() if b > a else None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], [*(c for c in part.schema.names if c != "text"), "digest", "signature"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name != "text")
    signed = saved(carried.mapInArrow(sign, f"{fields}, digest binary, signature binary"))
    one = F.min(F.struct("doc_id", "h", "bytes")).alias("one")
    kinds = saved(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(one, F.count("*").alias("size"), F.min("signature").alias("signature")).select("digest", F.col("one.doc_id").alias("node"), F.col("one.h").alias("h"), F.col("one.bytes").alias("bytes"), "size", "signature"))
    texts = rows.where("doc_id is not null").withColumnRenamed("doc_id", "node")
    edges = saved(forest(kinds, trees, depth, shortest))
    swept(documents.sparkSession)

    near = compared = None
    depths = list(range(depth, shortest - 1, -1))
    for now in depths:
        if near is not None and edges.where(F.col("shared") == now).isEmpty():
            continue
        before = near
        met_now = edges.where(F.col("shared") == now).select("a", "b")  # beside what is connected already
        near = saved(components(met_now if before is None else met_now.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))))
        swept(documents.sparkSession)
        if before is None:
            grown = near
        else:  # a component of the same least node and size is the same one
            size = lambda df: df.groupBy("component").agg(F.count("*").alias("n"))
            grown = saved(near.join(size(near).join(size(before), ["component", "n"], "left_anti").select("component"), "component", "left_semi"))
        again = _compared(grown, kinds, texts, words, threshold, depths, trees)
        compared = saved(again if before is None else compared.join(grown.select("node").distinct(), "node", "left_anti").unionByName(again))
        found, expected = compared.agg(F.coalesce(F.sum("found"), F.lit(0)), F.coalesce(F.sum(F.get("expected", F.lit(depth - now))), F.lit(0.0))).first()
        if found and found >= recall * expected:
            break
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    # documents that repeat a doc_id tie their sets together
    repeated = signed.where("doc_id is not null").select("doc_id", "digest").join(kinds.select("digest", "node"), "digest").where("doc_id <> node").groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    ties = repeated.select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b"))
    classes = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(ties))
    known = kinds.select("digest", "node", "size").join(links, "node", "left").join(classes, "node", "left")
    known = known.select("digest", "node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    return signed.join(known, "digest", "left").select(
        *(F.col(n).alias(c) for c, n in zip(columns, own, strict=True)),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("copy_of"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )
