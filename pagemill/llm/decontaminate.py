"""Benchmark decontamination by winnowing.

Each run of six consecutive five-word hashes (ten words) keeps its minimum, in documents and benchmark alike, so two texts
that share ten words in a row share a fingerprint. Fingerprints of benchmark and documents are joined, hits are extended to whole
windows, whose hashes decide. Items shorter than a window are matched by their own length. A small benchmark is broadcast, and the
joins are lookups inside one scan of the documents; a larger one is joined by shuffles of fingerprints, then of windows under them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import arrays as A
from pagemill.llm.session import fresh, saved, small_batches

WINDOW, GRAM = 10, 5
#: Bytes of a benchmark that is broadcast; its tables take some four times as much in each worker.
MOST_BYTES = 8 << 20


def _words(column: pa.Array) -> tuple[A.Rolling, np.ndarray, np.ndarray]:
    """Rolling hashes over the words of a column, each row's first word, and the number of words left in the row from each word on."""
    data, offsets = A.utf8(column)
    data = A.LOWER[data]
    starts, ends, first = A.tokens(data, offsets, A.WORD)
    words = A.Rolling(data).ranges(starts, ends)
    return A.Rolling(words), first, np.repeat(first[1:], np.diff(first)) - np.arange(len(words))


def _winnowed(words: A.Rolling, window: int, gram: int) -> np.ndarray:
    """The fingerprint of each window of words, by its start."""
    return A.sliding_min(words.windows(gram), window - gram + 1)


class Benchmark:
    """Windows of a small benchmark, as sorted arrays."""

    def __init__(self, ids: list, texts: pa.Array, window: int, gram: int):
        self.window, self.gram = window, gram
        words, first, left = _words(texts)
        self.names = sorted({str(x) for x in ids})
        places = {x: i for i, x in enumerate(self.names)}
        owner = np.array([places[str(x)] for x in ids], dtype=np.int64)[A.row_of(first)] if len(left) else np.zeros(0, np.int64)
        length = np.repeat(np.diff(first), np.diff(first))
        full = np.flatnonzero(left >= window)
        self.prints = np.unique(_winnowed(words, window, gram)[full]) if len(full) else np.zeros(0, np.uint64)
        self.tables = {}
        for width in [window, *sorted(set(length[length < window].tolist()))]:
            at = full if width == window else first[:-1][np.diff(first) == width]
            if len(at):
                hashes = words.windows(width)[at]
                pairs = np.unique(np.rec.fromarrays([hashes, owner[at]], names="h,o"))
                values, start = np.unique(pairs.h, return_index=True)
                self.tables[width] = (values, np.append(start, len(pairs)), np.asarray(pairs.o))

    def hits(self, words: A.Rolling, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width of windows: it, the first words of windows that occur in the benchmark, and their places in its table."""
        for width, (values, _, _) in self.tables.items():
            at = np.flatnonzero(left >= width)
            if width == self.window and len(at):
                prints = _winnowed(words, self.window, self.gram)[at]
                new = np.append(True, prints[1:] != prints[:-1])
                found = A.lookup(self.prints, prints[new]) >= 0
                at = at[found[np.cumsum(new) - 1]]
            if len(at):
                place = A.lookup(values, words.windows(width)[at])
                yield width, at[place >= 0], place[place >= 0]


RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>", "items_sha256": "string", "contaminated": "boolean"}


def _result(rows: pa.RecordBatch | pa.Table, columns: list[str], n_words: np.ndarray, hit: list[np.ndarray], items: list[list[str]]) -> pa.RecordBatch:
    """The rows with their result, by words that are hit and sorted items."""
    n_hit = np.array([x.sum() for x in hit], dtype=np.int64)
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    own = [rows.column(c) for c in columns]
    made = [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(digests, pa.string()), pa.array(n_hit > 0)]
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own), *made], [*columns, *RESULT])


def _covered(n: int, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Of n words those in windows that start at the places."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return np.cumsum(change)[:n] > 0


def _scan(known, text: str, columns: list[str]):
    """Documents against a benchmark that is broadcast."""

    def run(batches):
        bench = known.value
        names = np.array(bench.names, dtype=object)
        for batch in batches:
            for rows in A.slices(batch, text):
                words, first, left = _words(rows.column(text))
                at, width, pairs = [], [], []
                for own, places, found in bench.hits(words, left):
                    at.append(places)
                    width.append(np.full(len(places), own))
                    _, start, owner = bench.tables[own]
                    count = start[found + 1] - start[found]
                    doc = np.searchsorted(first, places, side="right") - 1
                    pairs.append(np.stack([np.repeat(doc, count), owner[A.spread(start[found], count)]], axis=1))
                hit = _covered(len(left), np.concatenate(at), np.concatenate(width)) if at else np.zeros(len(left), dtype=bool)
                pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
                near = np.searchsorted(pairs[:, 0], np.arange(rows.num_rows + 1))
                items = [sorted(set(names[pairs[near[i] : near[i + 1], 1]])) for i in range(rows.num_rows)]
                yield _result(rows, columns, np.diff(first), [hit[first[i] : first[i + 1]] for i in range(rows.num_rows)], items)

    return run


def _joined(documents: DataFrame, items: DataFrame, text: str, columns: list[str], window: int, gram: int, schema: T.StructType) -> DataFrame:
    """Documents against a benchmark of any size: fingerprints meet, then windows under fingerprints that met."""
    row, prints, found = fresh(columns, "row", "prints", "found")
    docs = saved(documents.select(*columns)).withColumn(row, F.monotonically_increasing_id())

    def windows(words: A.Rolling, first: np.ndarray, left: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width the places of windows and their fingerprints (of shorter ones their hashes)."""
        for width in widths:
            at = np.flatnonzero(left >= width)
            if len(at):
                yield width, at, (_winnowed(words, window, gram) if width == window else words.windows(width))[at]

    def of_items(batches):
        """(width, print, hash, id) of the items' windows; an item of fewer words is one window."""
        for batch in batches:
            for own in A.slices(batch, "text"):
                words, first, left = _words(own.column("text"))
                length = np.diff(first)
                for width in [window, *sorted(set(length[(length > 0) & (length < window)].tolist()))]:
                    at = np.flatnonzero(left >= width) if width == window else first[:-1][length == width]
                    if len(at):
                        hashes = words.windows(width)[at]
                        printed = _winnowed(words, window, gram)[at] if width == window else hashes
                        ids = own.column("id").take(pa.array(np.searchsorted(first, at, side="right") - 1))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width, np.int32)), pa.array(printed.view(np.int64)), pa.array(hashes.view(np.int64)), ids], ["width", "print", "hash", "id"])

    bench = saved(items.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(of_items, "width int, print long, hash long, id string").distinct())
    widths = sorted({r.width for r in bench.select("width").distinct().collect()} | {window})  # at most `window`

    def ask(batches):
        for batch in batches:
            for own in A.slices(batch, text):
                words, first, left = _words(own.column(text))
                for width, at, printed in windows(words, first, left, widths):
                    doc = np.searchsorted(first, at, side="right") - 1
                    pairs = np.unique(np.rec.fromarrays([doc, printed], names="d,p"))
                    yield pa.RecordBatch.from_arrays([own.column(row).take(pa.array(np.asarray(pairs.d))), pa.array(np.full(len(pairs), width, np.int32)), pa.array(np.asarray(pairs.p).view(np.int64))], ["row", "width", "print"])

    asked = docs.select(F.col(text).alias(text), F.col(row).alias(row)).mapInArrow(ask, "row long, width int, print long")
    met = asked.join(bench.select("width", "print").distinct(), ["width", "print"]).groupBy("row").agg(F.collect_list(F.struct("width", "print")).alias(prints))

    def extend(batches):
        for batch in batches:
            for own in A.slices(batch, text):
                words, first, left = _words(own.column(text))
                lists = own.column(prints)
                wanted = {(d, *x.values()) for d in range(own.num_rows) for x in lists[d].as_py()}
                for width, at, printed in windows(words, first, left, widths):
                    doc = np.searchsorted(first, at, side="right") - 1
                    use = np.fromiter(((d, width, p) in wanted for d, p in zip(doc.tolist(), printed.view(np.int64).tolist(), strict=True)), dtype=bool, count=len(at))
                    at, doc = at[use], doc[use]
                    if len(at):
                        hashes = words.windows(width)[at]
                        yield pa.RecordBatch.from_arrays([own.column("row").take(pa.array(doc)), pa.array(np.full(len(at), width, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at - first[doc])], ["row", "width", "hash", "at"])

    texts = docs.select(F.col(row).alias("row"), F.col(text).alias(text))
    under = texts.join(met, "row").select("row", text, prints).mapInArrow(extend, "row long, width int, hash long, at long")
    hits = under.join(bench.select("width", "hash", "id"), ["width", "hash"])
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("items"), F.collect_set(F.struct("at", "width")).alias("places"))  # a document's own
    hits = hits.select(F.col("row").alias(row), F.struct("items", "places").alias(found))

    def judge(batches):
        for batch in batches:
            for own in A.slices(batch, text):
                _, first, _ = _words(own.column(text))
                hit, names = [], []
                for n, x in zip(np.diff(first), own.column(found).to_pylist(), strict=True):
                    places = x["places"] if x else []
                    hit.append(_covered(n, np.array([p["at"] for p in places], np.int64), np.array([p["width"] for p in places], np.int64)))
                    names.append(sorted(x["items"]) if x else [])
                yield _result(own, columns, np.diff(first), hit, names)

    return docs.join(hits, row, "left").select(*columns, found).mapInArrow(judge, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, most_bytes: int = MOST_BYTES) -> DataFrame:
    """documents with n_words, n_hit, n_items, items, items_sha256 and contaminated; columns of these names are replaced.

    Words are runs of ASCII letters (lower-cased), digits and characters above ASCII. A document word inside any occurrence
    of `window` consecutive words of an item (of the whole item, if it is shorter) is hit. Texts are scanned whole. A benchmark of up to
    most_bytes is broadcast and documents are not shuffled; a larger one is joined by fingerprint. Words and windows are told apart by
    64-bit hashes.

    Null texts have no words. Items without words, and those with a null id, match nothing. Rows repeated in the benchmark
    count once for each id; repeated documents are each judged. An empty benchmark leaves every document clean, and empty
    documents give an empty table.
    """
    spark = documents.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    columns = [c for c in documents.columns if c not in RESULT]
    schema = T.StructType([*(documents.schema[c] for c in columns), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in RESULT.items())])
    if total > most_bytes:
        return _joined(documents, items, text, columns, window, gram, schema)
    own = items.toArrow()
    known = spark.sparkContext.broadcast(Benchmark(own.column("id").to_pylist(), own.column("text"), window, gram))
    return documents.select(*columns).mapInArrow(_scan(known, text, columns), schema)
