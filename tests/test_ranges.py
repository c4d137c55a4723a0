"""Work by ranges: numbers, sums, pauses and sentence ids of keys that are far larger than a task's share, against plain Python."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import lines as L
from pagemill.operators import ranges as G
from pagemill.sources.tables import expire_results


def test_range_of(spark):
    rows = spark.createDataFrame([(None,), (-5,), (0,), (3,), (4,), (9,), (10,), (11,)], "v long")
    assert [r[0] for r in rows.select(G.range_of(F.col("v"), [0, 4, 10])).collect()] == [-1, 0, 1, 1, 2, 2, 3, 3]
    assert [r[0] for r in rows.select(G.range_of(F.col("v"), [])).collect()] == [-1] + [0] * 7


def test_row_numbers_of_hot_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(50)]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = defaultdict(list)
    for r in G.row_numbers(frame, ["k"], F.col("v"), ["v", "i"], "n").collect():
        got[r.k].append((r.n, r.v, r.i))
    for k, own in got.items():
        want = sorted(((v is not None, v or 0, i), v, i) for key, v, i in rows if key == k)
        assert sorted(own, key=lambda x: x[0]) == [(n, v, i) for n, (_, v, i) in enumerate(want, 1)]
    assert sum(map(len, got.values())) == 3000 and G.row_numbers(frame.limit(0), ["k"], F.col("v"), ["v", "i"], "n").count() == 0


def test_a_hot_key_uses_all_ranges(spark):
    frame = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    sizes = [r["count"] for r in G.ranged(frame, ["k"], F.col("v")).groupBy("_at").count().collect()]
    assert len(sizes) == G.PARTS and max(sizes) < 2 * 100_000 / G.PARTS


def test_ids_of_a_long_document(spark):
    """Groups that are numbered together are as long as 64 pages, and ids have no gaps across them."""
    rng = random.Random(2)
    pages = [("long", p, ["s"] * rng.randint(0, 5)) for p in range(1, 1500)] + [("b", 7, ["x", "y"]), ("b", 900, ["z"]), (None, 3, ["n"]), (None, None, ["first"]), ("e", 1, [])]
    frame = spark.createDataFrame(pages, "doc_id string, page int, sentences array<string>").repartition(5)
    got = defaultdict(list)
    for r in L.numbered(frame).collect():
        got[r.doc_id].append((r.id, r.page, r.text))
    assert [i for i, *_ in sorted(got["long"])] == list(range(sum(len(s) for d, _, s in pages if d == "long")))
    assert [p for _, p, _ in sorted(got["long"])] == [p for d, p, s in pages if d == "long" for _ in s]
    assert sorted(got["b"]) == [(0, 7, "x"), (1, 7, "y"), (2, 900, "z")] and sorted(got[None]) == [(0, None, "first"), (1, 3, "n")] and "e" not in got
    groups = [r["count"] for r in frame.where("doc_id = 'long'").groupBy(L._stretch()).count().collect()]
    assert max(groups) <= L.PAGES_A_STRETCH and len(groups) > 20


def test_texts_are_shuffled_once_for_ids(spark):
    """Sums and numbers read one and the same shuffle."""
    frame = spark.createDataFrame([("d", p, [f"s{p}"]) for p in range(300)], "doc_id string, page int, sentences array<string>").repartition(3)
    rows = L.numbered(frame)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") == 1


def test_pages_with_line_rules(spark):
    """The rules together, as a page keeps its lines; a repeated line goes, and a block of footnotes ends at a question."""
    head = "A running head"
    pages = [("d", p, f"{head}\nline {p} of text\n{p}\nPage {p}\nhttps://x.org/a\n-----\n\nlast of {p}", "native") for p in range(1, 6)]
    pages += [("d", 6, "one\ntwo\nthree\nfour\n* see the editor's note\nmore\nQuestion two\nend", "native"), ("d", 7, "---- ----", "native"), ("d", 8, None, "ocr"), ("e", 1, head, "native"), (None, 1, "no document", "native"), ("f", None, "no page\n1", "native")]
    got = {(r.doc_id, r.page): r.text for r in L.clean_pages(spark.createDataFrame(pages, "doc_id string, page int, text string, source string")).collect()}
    want = {("d", p): f"line {p} of text\n\nlast of {p}" for p in range(1, 6)} | {("d", 6): "one two three four Question two end", ("d", 8): "", ("e", 1): head, (None, 1): "no document", ("f", None): "no page 1"}
    assert got == want


def test_compatibility_forms_of_all_code_points(spark):
    """As Python's own tables have them, alone and with marks that compose or change places; in the JVM."""
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = [*("".join(known[i : i + 1]) for i in range(0, len(known), 1)), *("a" + c + "̣́" for c in known[::11]), "plain", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.nfkc("t").alias("n"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    assert [t for t, n in frame.collect() if n != (None if t is None else unicodedata.normalize("NFKC", t))] == []


@pytest.mark.parametrize("seed", range(4))
def test_expired_results(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["h", "h", "g", None]), i, rng.choice([None, *range(0, 400)])) for i in range(300)]
    frame = spark.createDataFrame(rows, "content_hash string, page int, day int").withColumn("updated_at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)"))
    got = Counter((r.content_hash, r.page) for r in expire_results(frame, F.lit("2024-12-20").cast("timestamp"), 5).collect())
    want = Counter()
    for key in {r[0] for r in rows}:
        own = sorted((-(10**9) if d is None else d, p) for k, p, d in rows if k == key)
        start = max(i for i, (d, _) in enumerate(own) if i == 0 or d - own[i - 1][0] > 5)
        if 354 - own[-1][0] <= 5:
            want.update((key, p) for d, p in own if d >= own[start][0])
    assert got == want
