"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(member | class, history) * P(word | member).

A word's class comes from its spelling, so unknown words have one as well: byte pairs have weights along the directions in which
the spelling of whole training documents varies most (principal components, which tell languages and kinds of text apart), and
the signs of a word's sums are the bits of its class. The most frequent words of a class are members of their own, and the
others share members by hash, in which they have smoothed shares.

Features are hashed: the word before, the word before that alone (skip), and both together; their classes; and the leaning of the
last eight words, by the signs of their sums (a skip feature over all of them). Counts under the last one are the start; then
weights are trained in rounds over disjoint folds of the documents: tasks sum observed and expected counts of each weight, the
sums meet in a tree, and a damped step of iterative scaling follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import arrays as A
from pagemill.llm import exchange as X
from pagemill.llm.session import fresh, saved, small_batches, swept

#: Directions of spelling, whose signs make a class; members of a class that are one word, and that are shared; rounds of training.
BITS, OWN, SHARED, ROUNDS = 5, 24, 8, 4
CLASSES, MEMBERS = 1 << BITS, OWN + SHARED
#: Hashed rows of weights follow the number of distinct words, between these powers of two (the model is broadcast).
LEAST_ROWS, MOST_ROWS = 1 << 10, 1 << 14
END = CLASSES  # the class of a text's end, and of what stands before a text
BEGIN = np.uint64(0x5851F42D4C957F2D)  # stands before a text
#: A step is divided by the weights that act together; pseudo-counts hold weights back; those of the start; the weight of members without a word.
ACTIVE, PRIOR, START, NEVER = 3, 4.0, 20.0, -30.0
#: Sums of weights within this of 0 have exponentials that float32 holds to full precision, sums of a row's included.
REACH = 60
#: Hashed byte pairs, and the words before that make the leaning.
PAIRS, BEFORE = 256, 8
#: Bytes of text of a block: a word is asked for once a block, so larger ones ask less.
BLOCK_BYTES = 4 << 20
#: Tokens scored at once, rows of an array whose sums travel together, sums that meet in a task, and documents whose spelling is counted at once.
TOKENS, STRETCH, FAN, TEXTS = 4096, 1024, 32, 1024
SALTS = [np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in (1, 2, 3)]


#: Hashes of any two bytes in a row.
_PAIR = (A.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(PAIRS)).astype(np.int64)


def _pairs(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of two bytes in a row."""
    return _PAIR.take(before.astype(np.uint16) << 8 | byte)


def spelled(sums: np.ndarray, column: pa.Array) -> None:
    """Adds texts to the moments of spelling: for roots of the shares of byte pairs, products with each other, then the sum, then the weight."""
    data, offsets = A.utf8(column)
    data = np.where(A.NONSPACE[data], A.LOWER[data], 32).astype(np.uint8)
    before = np.append(np.uint8(32), data[:-1]) if len(data) else data
    if len(data):
        before[offsets[:-1][offsets[:-1] < len(data)]] = 32
    for at in range(0, len(offsets) - 1, TEXTS):
        cut = offsets[at : at + TEXTS + 1]
        rows = len(cut) - 1
        own = slice(cut[0], cut[-1])
        count = np.bincount(np.repeat(np.arange(rows), np.diff(cut)) * PAIRS + _pairs(before[own], data[own]), minlength=rows * PAIRS).reshape(rows, PAIRS)
        size = count.sum(axis=1, keepdims=True)
        root, weight = np.sqrt(count / np.maximum(size, 1)), np.sqrt(size)
        sums[:PAIRS] += (root * weight).T @ root
        sums[PAIRS] += (root * weight).sum(axis=0)
        sums[PAIRS + 1, 0] += weight.sum()


def directions(sums: np.ndarray) -> np.ndarray:
    """Whole-number weights of byte pairs along each direction, so that sums of them are exact; an average text's is 0."""
    weight = sums[PAIRS + 1, 0]
    if not weight:
        return np.zeros((PAIRS, BITS), dtype=np.int64)
    mean = sums[PAIRS] / weight
    vectors = np.linalg.eigh(sums[:PAIRS] / weight - np.outer(mean, mean))[1][:, ::-1][:, :BITS]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(BITS)])
    along = vectors / (mean[:, None] + 0.01)
    along -= (mean**2) @ along / (mean**2).sum()
    return np.round(along * (1 << 20)).astype(np.int64)


def bits_of(leaning: np.ndarray) -> np.ndarray:
    return (leaning > 0) @ (1 << np.arange(BITS))


class Words:
    """The distinct words of a block (by hash), and which of them each token is; with directions, each one's leaning and class."""

    def __init__(self, column: pa.Array, along: np.ndarray | None = None):
        data, offsets = A.utf8(column)
        data = A.LOWER[data]
        start, end, self.first = A.tokens(data, offsets, A.NONSPACE)
        self.hash, seen, self.word = np.unique(A.hashes(data, start, end), return_index=True, return_inverse=True)
        if along is not None:
            start, size = start[seen], end[seen] - start[seen] + 1  # with the white space behind
            place, edge = A.spread(start, size), np.cumsum(size) - size
            byte = data[np.minimum(place, max(len(data) - 1, 0))]
            byte[edge + size - 1] = 32
            before = np.append(np.uint8(32), byte[:-1]) if len(byte) else byte
            before[edge] = 32
            pairs = _pairs(before, byte)
            self.leaning = np.stack([np.add.reduceat(along[pairs, k], edge) if len(edge) else np.zeros(0, np.int64) for k in range(BITS)], axis=1)
            self.kind = bits_of(self.leaning)


class Members:
    """Which words are members of their own: sorted hashes, and each one's place in its class."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], places[order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = A.lookup(self.hashes, hashes)
        shared = OWN + (A.mix(hashes) % np.uint64(SHARED)).astype(np.int64)
        return np.where(at >= 0, self.places[at], shared) if len(self.hashes) else shared


class Tokens:
    """Each token and each text's end: its row, class, member (0 for the end), the leaning before it and, if asked for, hashes of the two words before and their classes."""

    def __init__(self, words: Words, members: Members, history: bool = True):
        size = np.diff(words.first) + 1
        begin = np.cumsum(size) - size
        self.row = np.repeat(np.arange(len(size)), size)
        n = len(self.row)
        word = np.ones(n, dtype=bool)
        word[begin + size - 1] = False
        self.kind, self.member = np.full(n, END), np.zeros(n, np.int64)
        self.kind[word], self.member[word] = words.kind[words.word], members.of(words.hash)[words.word]
        at = np.arange(n)
        place = at - begin[self.row]

        def back(values, steps, nothing):
            return np.where(place >= steps, values[np.maximum(at - steps, 0)], nothing)

        if history:
            full = np.full(n, BEGIN)
            full[word] = words.hash[words.word]
            self.one, self.two = back(full, 1, BEGIN), back(full, 2, BEGIN)
            self.classes = back(self.kind, 1, END) * (CLASSES + 1) + back(self.kind, 2, END)
        upto, since, bits = at - self.row, np.maximum(at - BEFORE, begin[self.row]) - self.row, np.zeros(n, np.int64)  # words before a place: ends are none
        for k in range(BITS):
            sums = np.append(0, np.cumsum(words.leaning[:, k].take(words.word)))
            bits |= (sums.take(upto) > sums.take(since)).astype(np.int64) << k
        self.leaning = np.where(place > 0, bits, END)

    def where(self, chosen: np.ndarray) -> Tokens:
        """Those chosen."""
        out = object.__new__(Tokens)
        for name, values in vars(self).items():
            setattr(out, name, values[chosen])
        return out


class Model:
    """Weights of both softmaxes, of classes and of members; a row for each value of a feature."""

    def __init__(self, rows: int, kinds: np.ndarray, members: np.ndarray, empty: np.ndarray):
        """Starts at the shares of classes by leaning and of members by class and leaning, from their counts; `empty` members have no word."""
        self.rows = rows
        self.kinds = np.zeros((kinds.shape[0] * (1 + kinds.shape[1]) + rows, CLASSES + 1), dtype=np.float32)
        self.members = np.zeros((members.shape[0] + rows, MEMBERS), dtype=np.float32)
        share = (kinds.sum(axis=0) + 0.5) / (kinds.sum() + 0.5 * kinds.shape[1])
        self.kinds[: len(kinds)] = np.log((kinds + START * share) / (kinds.sum(axis=1, keepdims=True) + START))
        of = members.reshape(CLASSES, CLASSES + 1, MEMBERS).sum(axis=1) + 0.5 * ~empty
        share = np.repeat(of / of.sum(axis=1, keepdims=True), CLASSES + 1, axis=0)
        own = (members + START * share) / (members.sum(axis=1, keepdims=True) + START)
        self.members[: len(members)] = np.where(own > 0, np.log(np.maximum(own, 1e-30)), NEVER)

    def features(self, t: Tokens) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of weights of each token: of classes by leaning, classes before, word before, skipped word and both; of members, with the class, by leaning, word before and both."""
        n = np.uint64(self.rows)
        hashed = [t.one + SALTS[0], t.two + SALTS[1], A.mix(t.one) * SALTS[0] + t.two + SALTS[2]]
        fixed = len(self.kinds) - self.rows
        kind = np.minimum(t.kind, CLASSES - 1)
        own = kind.astype(np.uint64) * SALTS[1]
        kinds = [t.leaning, CLASSES + 1 + t.classes, *(fixed + (A.mix(h) % n).astype(np.int64) for h in hashed)]
        return kinds, [kind * (CLASSES + 1) + t.leaning, *((CLASSES + 1) * CLASSES + (A.mix(hashed[k] + own) % n).astype(np.int64) for k in (0, 2))]

    def parts(self, t: Tokens):
        """(weights, rows, what came) of the softmax over classes, of all tokens, and over members, of words."""
        kinds, members = self.features(t)
        word = np.flatnonzero(t.kind < CLASSES)
        return [(self.kinds, kinds, t.kind), (self.members, [r.take(word) for r in members], t.member.take(word))], word

    @staticmethod
    def scores(weights: np.ndarray, rows: list[np.ndarray], part: slice) -> np.ndarray:
        """Sums of the weights of each token, as they are where float32 holds the exponentials of all, else without their maximum."""
        out = weights.take(rows[0][part], axis=0, mode="clip")  # all are within; clipping saves a copy that checks ask for
        more = np.empty_like(out)
        for r in rows[1:]:
            out += weights.take(r[part], axis=0, out=more, mode="clip")
        if not -REACH < out.min() <= out.max() < REACH:
            out -= out.max(axis=1, keepdims=True)
        return out

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 of P(class) * P(member | class), in batches of tokens."""
        out = np.zeros(len(t.kind))
        parts, word = self.parts(t)
        for (weights, rows, own), where in zip(parts, (np.arange(len(out)), word), strict=True):
            for at in range(0, len(own), TOKENS):
                part = slice(at, at + TOKENS)
                x = self.scores(weights, rows, part)
                found = x[np.arange(len(x)), own[part]].astype(np.float64)
                found -= np.log(np.exp(x, out=x).astype(np.float64) @ np.ones(x.shape[1]))
                out[where[part]] += found / np.log(10)
        return out

    def count(self, sums: list[np.ndarray], t: Tokens) -> None:
        """Adds observed and expected counts of each weight: of classes, then of members.

        Expected shares are added two columns at a time, as the parts of complex numbers, so half as many places are looked up and nothing is sorted.
        """
        for (weights, rows, own), seen, expected in zip(self.parts(t)[0], sums[::2], sums[1::2], strict=True):
            width = weights.shape[1]
            for r in rows:
                cells = np.bincount(r * width + own)
                seen.reshape(-1)[: len(cells)] += cells
            total = np.zeros((len(weights), (width + 1) // 2), dtype=np.complex128)
            places, flat = np.arange(total.size).reshape(total.shape), total.reshape(-1)
            shares = np.zeros((min(TOKENS, len(own)), 2 * total.shape[1]))
            for at in range(0, len(own), TOKENS):
                part = slice(at, at + TOKENS)
                p = self.scores(weights, rows, part)
                np.exp(p, out=p)
                p *= (1 / (p @ np.ones(width, np.float32)))[:, None]
                shares[: len(p), :width] = p
                two = shares[: len(p)].view(np.complex128).ravel()
                for r in rows:
                    np.add.at(flat, places.take(r[part], axis=0, mode="clip").ravel(), two)
            expected += total.view(np.float64)[:, :width]

    def step(self, sums: list[np.ndarray]) -> None:
        """Weights rise where more was seen than expected."""
        for weights, seen, expected in zip((self.kinds, self.members), sums[::2], sums[1::2], strict=True):
            weights += np.log((seen + PRIOR) / (expected + PRIOR)) / ACTIVE


def _summed(packed: DataFrame, shapes: list[tuple[int, int]], work: Callable, kind: str) -> list[np.ndarray]:
    """Arrays of these shapes and kind of number, to which work(arrays, table) adds each block.

    Stretches of rows that are not 0 travel; FAN of them meet in a task, then FAN of these, so no group grows with the number
    of tasks. What comes to the driver is as large as the arrays.
    """
    made, schema = ["origin", "part", "payload"], "origin int, part int, payload binary"

    def payload(used, sums):
        return X.squeezed(used.astype("<i4").tobytes() + sums.astype(kind).tobytes())

    def unpacked(part, data):
        data, width = X.unsqueezed(data), shapes[part >> 20][1]
        n = len(data) // (4 + width * np.dtype(kind).itemsize)
        return np.frombuffer(data, "<i4", n), np.frombuffer(data, kind, offset=4 * n).reshape(n, width)

    def gather(batches):
        arrays, origin = [np.zeros(s, dtype=kind) for s in shapes], TaskContext.get().partitionId()
        for batch in batches:
            for block in batch.column("block"):
                work(arrays, X.read(block.as_py()))
        for which, sums in enumerate(arrays):
            for at in range(0, len(sums), STRETCH):
                used = np.flatnonzero(sums[at : at + STRETCH].any(axis=1))
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array([origin], pa.int32()), pa.array([which << 20 | at // STRETCH], pa.int32()), pa.array([payload(used, sums[at + used])], pa.binary())], made)

    def add(key, own):
        origin, part = (k.as_py() for k in key)
        total = np.zeros((STRETCH, shapes[part >> 20][1]))
        for data in own.column("payload"):
            used, sums = unpacked(part, data.as_py())
            total[used] += sums
        used = np.flatnonzero(total.any(axis=1))
        return pa.table([pa.array([origin], pa.int32()), pa.array([part], pa.int32()), pa.array([payload(used, total[used])], pa.binary())], made)

    sums, left = packed.select("block").mapInArrow(gather, schema), packed.rdd.getNumPartitions()
    while True:
        left = math.ceil(left / FAN)
        sums = sums.withColumn("origin", F.floor(F.col("origin") / FAN).cast("int")).groupBy("origin", "part").applyInArrow(add, schema)
        if left <= 1:
            break
    out = [np.zeros(s) for s in shapes]
    for row in sums.collect():
        used, found = unpacked(row.part, row.payload)
        out[row.part >> 20][(row.part & 0xFFFFF) * STRETCH + used] += found
    return out


def fitted(documents: DataFrame, *, train: Column, text: str = "text", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> tuple[Model, dict, DataFrame]:
    """The model, what it knows of words (directions, members of their own, counts and distinct words of each member), and lm_scores' rows."""
    spark = documents.sparkSession
    small_batches(spark)
    made = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    columns = [c for c in documents.columns if c not in made and c != text]
    (fold,) = fresh([*columns, text, "batch_id", "block"], "fold")
    told_apart = [c for c in (*columns, text) if "map<" not in documents.schema[c].dataType.simpleString()]
    dealt = F.when(F.coalesce(train, F.lit(False)), F.pmod(F.xxhash64(*told_apart), F.lit(max(rounds, 1)))).otherwise(-1).cast("int")
    packed = X.blocks(documents.select(*columns, text, dealt.alias(fold)), text, block_bytes, fold)
    taught, plain = packed.where(F.col(fold) >= 0), packed.select("batch_id", "block")
    (moments,) = _summed(taught, [(PAIRS + 2, PAIRS)], lambda sums, table: spelled(sums[0], table.column(text)), "<f8")
    along = directions(moments)

    def ask(batch_id, table):
        words = Words(table.column(text), along)
        learned = np.bincount(words.word, minlength=len(words.hash)) * (table.column(fold)[0].as_py() >= 0)
        yield from X.rows_of(["batch_id", "n", "key", "kind"], [np.full(len(words.hash), batch_id), learned.astype(np.int64), words.hash.view(np.int64), words.kind.astype(np.int8)])

    # one shuffle tells blocks the counts of their words, and one of a word's blocks, which is the word's own, that it counts the word
    same, asked = Window.partitionBy("key"), X.over_blocks(plain, ask, "batch_id long, n long, key long, kind byte")
    asked = asked.select("batch_id", "key", "kind", F.sum("n").over(same).alias("n"), (F.col("batch_id") == F.min("batch_id").over(same)).alias("own"))
    value = F.col("n") * (2 * CLASSES) + F.col("kind") * 2 + F.col("own").cast("int")
    counts = saved(X.gathered(asked.where("n > 0").select("batch_id", "key", value.alias("value")), "counts", "<i8"))
    swept(spark)

    def words_of(batches):
        """Hashes, counts and classes of the words of a task's blocks, each word in one block of all."""
        for batch in batches:
            for payload in batch.column("counts"):
                key, value = X.answers_of(payload.as_py(), "<i8")
                own = np.flatnonzero(value & 1)
                yield key[own].view(np.int64), value[own] // (2 * CLASSES), value[own] // 2 % CLASSES

    def frequent(batches):
        """A task's most frequent words of each class."""
        best = [np.zeros(0, np.int64)] * 3
        for found in words_of(batches):
            best = [np.concatenate([x, y[found[1] > 1]]) for x, y in zip(best, found, strict=True)]
            order = np.lexsort((best[0], -best[1], best[2]))
            kind = best[2][order]
            order = order[np.arange(len(order)) - np.searchsorted(kind, kind) < OWN]
            best = [x[order] for x in best]
        yield pa.RecordBatch.from_arrays([*map(pa.array, best)], ["key", "value", "kind"])

    ranked = counts.select("counts").mapInArrow(frequent, "key long, value long, kind long").withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "key")))
    top = ranked.where(F.col("place") <= OWN).select("key", "place").collect()  # CLASSES * OWN at most
    members = Members(np.array([r.key for r in top], dtype=np.int64).view(np.uint64), np.array([r.place - 1 for r in top], dtype=np.int64))

    def by_member(batches):
        """Counts and words of each member in a task."""
        sums = np.zeros((2, CLASSES * MEMBERS), dtype=np.int64)
        for key, n, kind in words_of(batches):
            own = kind * MEMBERS + members.of(key.view(np.uint64))
            np.add.at(sums[0], own, n)
            sums[1] += np.bincount(own, minlength=sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.shape[1], dtype=np.int32)), *map(pa.array, sums)], ["member", "n", "v"])

    number, types = np.zeros((CLASSES, MEMBERS), dtype=np.int64), np.zeros((CLASSES, MEMBERS), dtype=np.int64)
    for r in counts.select("counts").mapInArrow(by_member, "member int, n long, v long").groupBy("member").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # CLASSES * MEMBERS
        number[divmod(r.member, MEMBERS)], types[divmod(r.member, MEMBERS)] = r.n, r.v
    empty = (types == 0) & (np.arange(MEMBERS) < OWN)

    def start(sums, table):
        t = Tokens(Words(table.column(text), along), members, history=False)
        sums[0] += np.bincount(t.leaning * (CLASSES + 1) + t.kind, minlength=sums[0].size).reshape(sums[0].shape)
        t = t.where(t.kind < CLASSES)
        sums[1] += np.bincount((t.kind * (CLASSES + 1) + t.leaning) * MEMBERS + t.member, minlength=sums[1].size).reshape(sums[1].shape)

    by_leaning, by_class = _summed(taught, [(CLASSES + 1, CLASSES + 1), (CLASSES * (CLASSES + 1), MEMBERS)], start, "<f8")
    ends = int(by_leaning[:, END].sum())
    model = Model(min(max(LEAST_ROWS, 1 << int(types.sum()).bit_length()), MOST_ROWS), by_leaning, by_class, empty)
    shapes = [s for w in (model.kinds, model.members) for s in (w.shape, w.shape)]
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(model)
        model.step(_summed(packed.where(F.col(fold) == turn), shapes, lambda sums, table, now=now: now.value.count(sums, Tokens(Words(table.column(text), along), members)), "<f4"))
        now.unpersist()
    total, distinct = int(number.sum()) + ends, int(types.sum()) + (ends > 0)
    known = spark.sparkContext.broadcast(model)
    of_member = (number + 0.5 * types + 0.5 * (np.arange(MEMBERS) >= OWN)).ravel()  # a shared member has one unknown word
    base_total = total + 0.5 * (distinct + 1)

    def score(batch_id, table, counts):
        words = Words(table.column(text), along)
        seen = X.told(counts, words.hash, "<i8") // (2 * CLASSES)
        t, n, of = Tokens(words, members), len(words.first) - 1, A.row_of(words.first)
        share = np.log10((seen + 0.5) / of_member[words.kind * MEMBERS + members.of(words.hash)])
        base = np.log10((seen + 0.5) / base_total)
        add = lambda r, x: np.bincount(r, weights=x, minlength=n)
        yield pa.RecordBatch.from_arrays([
            *(c.combine_chunks() for c in table.select(columns).columns),
            pa.array(np.diff(words.first) + 1),
            pa.array(add(of, (seen > 0)[words.word].astype(float)).astype(np.int64) + (ends > 0)),
            pa.array([total] * n, pa.int64()),
            pa.array(add(of, base[words.word]) + np.log10((ends + 0.5) / base_total)),
            pa.array(add(t.row, known.value.log10(t)) + add(of, share[words.word])),
        ], [*columns, *made])

    schema = T.StructType([*(documents.schema[c] for c in columns), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in made.items())])
    known_words = {"along": along, "members": members, "number": number, "types": types}
    return model, known_words, X.over_blocks(plain.join(counts, "batch_id", "left"), score, schema)


def lm_scores(documents: DataFrame, *, train: Column, text: str = "text", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents without the text, with n_tokens, n_known, train_tokens, base_score and score; columns of these names are replaced.

    Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, and one end for each text. The model and the base
    (add-half unigrams with one unknown type) learn from the rows where `train` is true and score all rows, as log10 of the
    probability of the whole text. Probabilities of all known words, one unknown word for each shared member and the end sum to 1
    after every history. Word counts are exact; words are told apart by 64-bit hashes. Folds follow the rows' values, not how they are
    partitioned. What the driver holds is the model (its rows follow the number of distinct words up to a bound) and sums of bounded size.

    Null texts are empty: one token, the end. Without training rows every base factor is 1, and nothing but classes' and members'
    smoothed shares is known. Repeated rows count and score as often as they occur; an empty table gives an empty one. Long texts are read whole.
    """
    return fitted(documents, train=train, text=text, rounds=rounds, block_bytes=block_bytes)[2]
