"""Whitening, periodic runs and best-fit packing against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import queries as Q
from pagemill.llm.binpack import Places, best_two_fit, pack_best_fit
from pagemill.llm.runs import kept, periodic_runs, runs_of, squares
from pagemill.llm.whiten import cholesky, components, jacobi, whiten

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


# whitening
def spectrum(d, rank=None):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(300, d)) * np.exp(-np.arange(d) / 10)
    if rank:
        a = a[:, :rank] @ rng.normal(size=(rank, d))
    return a.T @ a / 300


@pytest.mark.parametrize("d,rank", [(1, None), (2, None), (3, None), (7, 4), (64, None), (33, 12)])
def test_factor_and_components(d, rank):
    v = spectrum(d, rank)
    factor, order = cholesky(v)
    assert factor.shape[1] == (rank or d) and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12 * v.max())
    assert np.all(np.diff(np.diag(factor)) <= 1e-12) and np.allclose(np.tril(factor), factor)
    turned = jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-13 * gram.max()
    e, c = components(v)
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-13 * e[0]) and np.abs(v @ c - c * e).max() < 1e-13 * e[0] and np.abs(c.T @ c - np.eye(len(e))).max() < 1e-12


def test_components_of_special_scatters():
    assert len(components(np.zeros((3, 3)))[0]) == 0
    assert components(np.eye(5))[0].tolist() == [1] * 5


VECTORS = [(i, [float(np.sin(i * k + k)) * 10 ** (k % 3) + 50_000 * (k == 2) for k in range(1, 7)], "x", 1) for i in range(60)]


def whitened(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n int").withColumn("component_", F.lit(1)).repartition(3)
    return whiten(frame, **more).collect()


def test_whitening_by_brute_force(spark):
    rows = [*VECTORS, VECTORS[5], (None, VECTORS[7][1], "x", 1), (90, None, "x", 1), (91, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x", 1), (92, [float("nan")] * 6, "x", 1), (93, [float("inf")] * 6, "x", 1)]
    got = whitened(spark, rows, keep=4)
    fit = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(1024 * c) + 100_000 for c in r[1]] for r in fit]
    n, d = len(x), 6
    total = [sum(r[k] for r in x) for k in range(d)]
    z = [[n * r[k] - total[k] for k in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:4], c[:, ::-1][:, :4]
    assert len(got) == 4 * n and {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((r[0], sum(q * q for q in y)) for r, y in zip(fit, z, strict=True))
    assert {r.component_ for r in got} == {1} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    want = (np.array(z, dtype=float) / n) @ c / np.sqrt(e)
    for k in range(4):
        own = np.array(sorted(r.whitened for r in got if r.component == k + 1))
        assert min(np.abs(own - np.sort(want[:, k] * s)).max() for s in (1, -1)) < 1e-9
        assert next(r.explained for r in got if r.component == k + 1) == pytest.approx(e[k] / np.trace(v), rel=1e-12)


def test_whitening_of_few_rows_and_odd_lengths(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None, "x", 1)]) == [] and whitened(spark, [(1, [1.0, 2.0], "x", 1)] * 3) == [] and whitened(spark, [(1, [], "x", 1)]) == []
    got = whitened(spark, [(1, [1.0], "x", 1), (2, [1.0, 0.0], "x", 1), (3, [], "x", 1), (4, [1.0, 2.0], "x", 1)])
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r.whitened
    assert set(by) == {1, 2, 3, 4} and by[1] == by[2] and len(by[1]) == 2
    one = whitened(spark, [(1, [1.0, 5.0], "x", 1), (2, [3.0, 5.0], "x", 1)])
    assert sorted((r.vec_id, r.component) for r in one) == [(1, 1), (2, 1)] and {round(abs(r.whitened), 9) for r in one} == {1.0} and one[0].explained == 1.0
    huge = whitened(spark, [(1, [1e9], "x", 1), (2, [-1e9], "x", 1), (3, [0.0], "x", 1)])
    assert len(huge) == 3 and all(r.deviation is None or r.deviation >= 0 for r in huge) and huge[0].identity_error < 1e-9


def test_whitening_does_not_depend_on_partitions(spark):
    frame = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, whitened string, n int")
    a, b = (sorted((r.vec_id, r.component, r.whitened) for r in whiten(frame.repartition(k)).collect()) for k in (1, 7))
    assert a == b


# periodic runs
def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(all(w[i + k] == w[i + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def repetitive(rng, n):
    letters, w = rng.choice([1, 2, 3, 6]), []
    while len(w) < n:
        if w and rng.random() < 0.5:
            a = rng.randrange(len(w))
            w += w[a : rng.randint(a + 1, len(w))] * rng.randint(1, 4)
        else:
            w += [rng.randrange(letters) for _ in range(rng.randint(1, 5))]
    return w[:n]


def test_runs_by_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        w = repetitive(rng, rng.randint(0, 110))
        assert [tuple(r) for r in runs_of(w).tolist()] == brute_runs(w), w


def test_squares_are_all_runs():
    rng = random.Random(5)
    for _ in range(200):
        w = repetitive(rng, rng.randint(0, 50))
        assert sorted((s, last - s + 1, d) for (s, d), last in squares(w).items()) == brute_runs(w, 2)


def test_long_runs():
    assert runs_of(["a"] * 30_000).tolist() == [[0, 30_000, 1]]
    words = [f"w{i % 7919}" for i in range(30_000)]
    assert runs_of(words).tolist() == [[0, 30_000, 7919]] and kept(30_000, runs_of(words)).sum() == 7919


def expected(words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "a b " * 3 + "é " * 30, "x y " * 6, " ".join("abc"[k] for k in repetitive(rng, 90) if k < 3), "\x0b".join(["a", "b", "c"] * 5)]
    rows = [(i, t, "n", [1]) for i, t in enumerate([*texts, *texts])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words array<int>").withColumn("collapsed", F.lit(0)).withColumn("own", F.lit("o")).repartition(3)
    got = periodic_runs(frame).collect()
    assert len(got) == len(rows) and {r.own for r in got} == {"o"}
    for r in got:
        assert r.text == rows[r.doc_id][1]
        words = [w.decode() for w in (r.text or "").encode().split()]
        runs, text = expected(words)
        assert r.n_words == len(words) and [(x.start, x.length, x.period) for x in r.runs] == runs and r.collapsed == text
    assert periodic_runs(frame.limit(0)).count() == 0


def test_query_of_runs(spark):
    """The query over a whole table: what it plants, and what it says of each document."""
    got = {r.doc_id: r for r in Q.op12_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    changed = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        r, runs = got[d.doc_id], [tuple(x) for x in runs_of(words).tolist()]
        if n < 250:
            assert runs == brute_runs(words)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert changed > 5 and sum(r.n_runs > 0 for r in got.values()) > 5


# best-fit packing
def plain_best_two_fit(sizes, length):
    """Bin by bin over single documents."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        own, room = [], length
        while fit := next((s for s in left if s <= room), None):
            left.remove(fit)
            own.append(fit)
            room -= fit
        if room and len(own) > 1:
            room += own[-1]
            pairs = [(left[i] + left[j], left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if own[-1] < left[i] + left[j] <= room]
            if pairs:
                _, a, b = max(pairs)
                left.append(own.pop())
                for s in (a, b):
                    left.remove(s)
                own += [a, b]
                left.sort(reverse=True)
        bins.append(own)
    return bins


def test_best_two_fit_bin_by_bin():
    rng = random.Random(7)
    for _ in range(150):
        length = rng.choice([10, 31, 64])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        assert [used for used, times in best_two_fit(dict(Counter(sizes)), length) for _ in range(times)] == plain_best_two_fit(sizes, length)


def test_places():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 400, 5000)
    bins = best_two_fit(dict(Counter(sizes.tolist())), 1024)
    places = Places(bins)
    rank = np.array([int((sizes[:i] == s).sum()) for i, s in enumerate(sizes)])
    which, offset = places.of(sizes, rank)
    by = defaultdict(list)
    for b, o, s in zip(which, offset, sizes, strict=True):
        by[b].append((o, s))
    assert set(by) == set(range(places.bins)) and places.bins <= -(-int(sizes.sum()) // 1024) + 2
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024


@pytest.mark.parametrize("end", [2, None])
def test_packing_round_trip(spark, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = False
    rng = random.Random(9)
    words = ["ab", "the", "Straße", "<|endoftext|>", "12", "\n", "xyzzy"]
    texts = [None, "", " ", "x", *(" ".join(rng.choices(words, k=rng.choice([1, 3, 60, 400, 900]))) for _ in range(120)), "word " * 40_000]
    texts += texts[:20]
    rows = [(i % 130 if i % 9 else None, t, 1, "x", 5) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part int, slot string, length long").repartition(5)
    got = pack_best_fit(frame, tokenizer=TOKENIZER, end=end).collect()
    want = Counter()
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end])
        first = len(ids) % 1024 or min(len(ids), 1024)
        starts = [0, *range(first, len(ids), 1024)] if ids else []
        want.update((d, k, s, tuple(ids[s:e]), len(ids)) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens) for r in got) == want
    assert all(r.length * 4 == len(r.ids) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024
    short = [r.length for r in got if r.length < 1024]
    assert len(by) == len(got) - len(short) + len(plain_best_two_fit(short, 1024))


def test_packing_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id string, text string")
    assert pack_best_fit(frame, tokenizer=TOKENIZER).count() == 0
    assert pack_best_fit(spark.createDataFrame([("a", None), ("b", "")], frame.schema), tokenizer=TOKENIZER, end=None).count() == 0


def test_query_of_packing(spark):
    got = Q.op13_best_fit_packing(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    tokens = sum(r.length for r in got)
    assert len({r.doc_id for r in got}) == docs and len({r.sequence_id for r in got}) <= -(-tokens // 1024) * 1.01 + 1
    assert all(r.length == 1024 for r in got if r.piece > 0)
