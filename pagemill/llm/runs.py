"""Runs: stretches of words that repeat with a period, found by a suffix automaton whose suffix-link tree is kept as a link-cut tree.

Words are appended one by one. The path from a prefix's state to the root is the set of its suffixes; it is cut into segments of
suffixes that last ended at the same place. An access to the path recolours it with the new end. A segment up to length `most` that last ended
`d` words before is a square if d <= most: its stretch of most + d words has period d and cannot be longer to the left. A run is
such a square with the same start and period at each of its last ends, so extending it is remembering the newest end. Access recolours
O(log n) segments a word, amortised, and every square met so has its smallest period, as a suffix that repeats earlier would have ended later.

In a run of at least 12 words, twice its period at least, every word is in six words that the run has once more. So words
that are in no six words which their own stretch has twice are in no run, and stretches between them are worked on apart; this is
decided by hashes of numbers, where a collision only leaves more words in.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemill.llm import arrays as A

LEAST, GRAM = 12, 6
SLICE_BYTES = 4 << 20


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) of the maximal stretches of at least two periods, and the last word of each. About 0.6 kB for a word."""
    length, link, following = [0], [-1], [{}]
    left, right, above, colour = [0], [0], [0], [0]  # 0 is none: the root, which is the empty suffix, takes no part in paths
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        """Makes x the root of its segment's tree and gives it the segment's colour, which roots hold."""
        p = above[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            g = above[p]
            top = not g or (left[g] != p and right[g] != p)
            if top:
                a, b, c = x, p, g
                if left[b] == a:
                    m = right[a]
                    left[b], right[a] = m, b
                else:
                    m = left[a]
                    right[b], left[a] = m, b
                if m:
                    above[m] = b
                above[b], above[a] = a, c
                colour[x] = colour[p]
                return
            f = above[g]
            last = not f or (left[f] != g and right[f] != g)
            if left[g] == p:
                if left[p] == x:
                    m, n = right[p], right[x]
                    left[g], right[p], left[p], right[x] = m, g, n, p
                    if m:
                        above[m] = g
                    if n:
                        above[n] = p
                    above[g], above[p] = p, x
                else:
                    m, n = left[x], right[x]
                    right[p], left[g], left[x], right[x] = m, n, p, g
                    if m:
                        above[m] = p
                    if n:
                        above[n] = g
                    above[p] = above[g] = x
            elif right[p] == x:
                m, n = left[p], left[x]
                right[g], left[p], right[p], left[x] = m, g, n, p
                if m:
                    above[m] = g
                if n:
                    above[n] = p
                above[g], above[p] = p, x
            else:
                m, n = left[x], right[x]
                right[g], left[p], left[x], right[x] = m, n, g, p
                if m:
                    above[m] = g
                if n:
                    above[n] = p
                above[p] = above[g] = x
            above[x] = f
            if last:
                colour[x] = colour[g]
                return
            if left[f] == g:
                left[f] = x
            else:
                right[f] = x
            p = f

    newest = 0
    for i, w in enumerate(words):
        own = len(length)
        length.append(i + 1)
        link.append(0)
        following.append({})
        left.append(0)
        right.append(0)
        above.append(0)
        colour.append(i)
        p = newest
        while p >= 0 and w not in following[p]:
            following[p][w] = own
            p = link[p]
        if p >= 0:
            q = following[p][w]
            if length[p] + 1 != length[q]:  # what q holds up to this length gets a state of its own, between q and its parent
                part = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                following.append(following[q].copy())
                splay(q)
                shallower = left[q]
                left.append(shallower)
                right.append(0)
                above.append(q)
                colour.append(0)
                if shallower:
                    above[shallower] = part
                left[q] = part
                link[q] = part
                while p >= 0 and following[p].get(w) == q:
                    following[p][w] = part
                    p = link[p]
                q = part
            link[own] = above[own] = q
            below, at = own, q
            while at:
                splay(at)
                d, most = i - colour[at], length[at]
                if d <= most:
                    found[i - most - d + 1, d] = i
                deeper = right[at]
                if deeper:
                    colour[deeper] = colour[at]
                right[at] = below
                below, at = at, above[at]
            colour[below] = i
            splay(own)
        newest = own
    return found


def stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that can hold runs, see above."""
    out, open_ = [], [(0, len(numbers))]
    hashes = A.Rolling(numbers).windows(GRAM)
    while open_:
        start, end = open_.pop()
        if end - start < LEAST:
            continue
        own = hashes[start : end - GRAM + 1]
        order = np.argsort(own)
        same = own[order[1:]] == own[order[:-1]]
        twice = np.zeros(len(own) + 1, dtype=np.int64)
        at = np.concatenate([order[1:][same], order[:-1][same]])
        twice[at] = 1
        covered = np.zeros(end - start + 1, dtype=np.int64)
        covered[: len(own)] += twice[: len(own)]
        covered[GRAM : GRAM + len(own)] -= twice[: len(own)]
        inside = np.concatenate([[0], np.cumsum(covered[:-1]) > 0, [0]]).astype(np.int8)
        edge = np.diff(inside)
        found = list(zip((np.flatnonzero(edge == 1) + start).tolist(), (np.flatnonzero(edge == -1) + start).tolist(), strict=True))
        if found == [(start, end)]:
            out += found
        else:
            open_ += found
    return sorted(out)


def runs_of(words: list) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least 12 words and two periods, by start, then period."""
    seen: dict = {}
    numbers = np.fromiter(map(seen.setdefault, words, count()), dtype=np.int64, count=len(words))
    out = [(start + s, d, last - s + 1) for start, end in stretches(numbers) for (s, d), last in squares(numbers[start:end].tolist()).items() if last - s + 1 >= LEAST]
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def periodic_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with n_words, runs (array of start, length, period, by start, then period) and collapsed: the words that no run repeats, joined by single blanks.

    Words are what ASCII white space separates; a run is a stretch of consecutive words with smallest period q, of at least 12 words and 2 q, that
    cannot be longer. collapsed keeps of each run what its first period has, unless another run drops it. Null, empty and blank
    texts have no words, no runs and an empty collapsed text. Repeated rows are judged alike; an empty table stays empty. Columns
    named like the three new ones are replaced, others stay, and so does the text. Nothing is shuffled: a text is a row's own affair, and
    takes memory by its longest stretch that can hold a run.
    """
    made = ["n_words", "runs", "collapsed"]
    rows = documents.drop(*made)
    run = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run, False)), T.StructField("collapsed", T.StringType())])

    def judge(batches):
        for batch in batches:
            for part in A.slices(batch, text, SLICE_BYTES):
                sizes, found, texts = [], [], []
                for own in part.column(text).cast(pa.large_binary()).to_pylist():
                    words = (own or b"").split()
                    runs = runs_of(words)
                    sizes.append(len(words))
                    found.append(runs)
                    texts.append(b" ".join([w for w, k in zip(words, kept(len(words), runs).tolist(), strict=True) if k] if len(runs) else words))
                flat = np.concatenate(found)
                values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
                ends = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, *made])

    return rows.mapInArrow(judge, schema)
