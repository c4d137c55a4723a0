"""The pipeline's stages against brute force, with null and repeated ids."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P
from pagemill.llm.language import identify, profiles
from pagemill.llm.queries import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    near = lambda t, k: " ".join([*t.split()[:k], "changed", *t.split()[k + 1 :]])
    a, b, c, shared = text(150), text(150), text(60), text(20)
    pairs = [(5, a), (3, near(a, 40)), (None, a), (None, a), (None, near(a, 9)), (None, None), (7, b), (7, b), (7, near(b, 70)), (7, c), (8, c), (8, ""), (8, ""), (9, None), (10, "!?")]
    pairs += [(20 + k, f"{text(30)} {shared} {text(30)}") for k in range(5)] + [(None, f"{text(9)} {shared} {text(9)}")]
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in pairs]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sets(text):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    named = [r for r in set(rows) if r[0] is not None]
    own = {r: sets(r[1]) for r in named}
    root = {r: r for r in named}

    def top(r):
        return r if root[r] == r else top(root[r])

    for x in named:
        for y in named:
            if own[x] and own[y] and len(own[x] & own[y]) >= 0.8 * len(own[x] | own[y]):
                root[top(x)] = top(y)
    groups = {}
    for r in named:
        groups.setdefault(top(r), []).append(r)
    return [(min(r[0] for r in group), group) for group in groups.values()]


def test_near_duplicates(spark, docs, rows):
    got = Counter(tuple(r) for r in P.near_duplicates(spark, docs, "").collect())
    assert Counter({r: n for r, n in got.items() if r[0] is None}) == Counter(r for r in rows if r[0] is None)
    named = Counter({r: n for r, n in got.items() if r[0] is not None})
    groups = kept_by_brute_force(rows)
    assert named.total() == len(groups)
    for smallest, group in groups:
        assert [(r[0], named[r]) for r in group if named[r]] == [(smallest, 1)]


def test_near_duplicates_with_unique_ids(spark, rows):
    own = [(i if r[0] is not None else None, *r[1:]) for i, r in enumerate(rows)]
    got = [tuple(r) for r in P.near_duplicates(spark, spark.createDataFrame(own, SCHEMA), "").collect()]
    expected = [next(r for r in group if r[0] == smallest) for smallest, group in kept_by_brute_force(own)]
    assert Counter(got) == Counter([*expected, *(r for r in own if r[0] is None)])


def test_repeated_strings(spark, docs, rows):
    owners = {}
    for i, t, *_ in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49 if i is not None else 0):
            owners[data[k : k + 50]] = min(i, owners.get(data[k : k + 50], i))
    got = P.repeated_strings(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    expected = Counter()
    for i, t, *_ in rows:
        if i is None:
            continue
        data, gone = (t or "").encode(), set()
        for k in range(len(data) - 49):
            if owners[data[k : k + 50]] < i:
                gone |= set(range(k, k + 50))
        expected[i, None if t is None else bytes(x for k, x in enumerate(data) if k not in gone).decode("utf-8", "replace")] += 1
    texts = Counter((r.doc_id, r.text) for r in got if r.doc_id is not None)
    ascii_only = lambda c: Counter({k: n for k, n in c.items() if k[1] is None or "�" not in k[1]})
    assert not ascii_only(expected) - texts
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_benchmark(spark, docs, rows, tmp_path):
    item = " ".join(rows[15][1].split()[5:25])
    spark.createDataFrame([(1, item), (None, rows[6][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = WORDS.findall(item)
    windows = {tuple(words[k : k + 10]) for k in range(len(words) - 9)}
    clean = [r for r in rows if not any(tuple(w[k : k + 10]) in windows for w in [WORDS.findall(r[1] or "")] for k in range(len(w) - 9))]
    got = Counter(tuple(r) for r in P.benchmark(spark, docs, str(tmp_path)).collect())
    assert got == Counter(clean) and len(clean) < len(rows)


def test_language(spark, docs, rows):
    judged = identify(docs, profiles(docs.where(fold() != 0))).collect()
    got = Counter(tuple(r) for r in P.language(spark, docs, "").collect())
    assert got == Counter((r.doc_id, r.text, r.lang_pred, r.source, r.n_chars) for r in judged if r.lang_pred != "und")
    assert sum(n for r, n in got.items() if r[0] is None) > 0
