import re

from pyspark.sql import functions as F

from pagemill.llm.near import BLOCK, THRESHOLD, forest, ngram_jaccard_join


def test_large_group_of_near_copies(spark):
    """A group of several blocks is one class, and every link in it is counted."""
    n, base = 2 * BLOCK + 60, [f"w{i}" for i in range(200)]
    docs = [(k, " ".join([*base[: k % 190], f"x{k}", *base[k % 190 + 1 :]])) for k in range(n)] + [(n + k, f"alone {k} " + " ".join(f"y{k}z{i}" for i in range(20))) for k in range(30)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: (0, n - 1) if k < n else (k, 0) for k in range(n + 30)}


def test_all_links_of_a_table(spark):
    """Every link between the texts of a table is found: all pairs, by brute force over an inverted index of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, places = {}, {}
    for doc_id, text in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for s in sets[doc_id]:
            places.setdefault(s, []).append(doc_id)
    links = dict.fromkeys(sets, 0)
    for a, own in sets.items():
        common = {}
        for s in own:
            for b in places[s]:
                common[b] = common.get(b, 0) + 1
        links[a] = sum(n >= THRESHOLD * (len(own) + len(sets[b]) - n) for b, n in common.items() if b != a)
    got = {r.doc_id: r.n_links for r in ngram_jaccard_join(docs).collect()}
    assert sum(links.values()) > 100 and sum(got[a] < n for a, n in links.items()) <= 0.01 * len(links) and all(got[a] <= n for a, n in links.items())
    assert sum(got.values()) >= 0.99 * sum(links.values())


def test_forest(spark):
    """Neighbours in the tries of two trees, also across the cuts between partitions."""
    values = [(k, bytes([0, k // 40, 0, k // 10, 0, k % 3, 0, 7])) for k in range(120)]
    kinds = spark.createDataFrame([(k, v) for k, v in values], "node long, signature binary").repartition(5)
    got = {(r.a, r.b, r.shared) for r in forest(kinds, 2, 2, 1).collect()}
    want = set()
    for tree in range(2):
        keys = sorted((v[4 * tree : 4 * tree + 4], k) for k, v in values)
        for (x, a), (y, b) in zip(keys, keys[1:], strict=False):
            shared = 2 if x == y else 1 if x[:2] == y[:2] else 0
            want |= {(a, b, shared)} if shared else set()
    assert got == want


def test_shortening_of_prefixes(spark):
    """Links at the threshold are met although full prefixes seldom meet them."""
    docs = []
    for k in range(60):
        words = [f"g{k}w{i}" for i in range(300)]
        docs.append((2 * k, " ".join(words)))
        docs.append((2 * k + 1, " ".join("x" if i in (40, 90, 140, 190, 240) else w for i, w in enumerate(words))))
    got = ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), recall=0.9999).agg(F.sum("n_links"), F.countDistinct("class_id")).first()
    assert tuple(got) == (120, 60)
