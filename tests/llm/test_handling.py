"""Extra columns with clashing names, repeated rows, nulls in every column and very long texts, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.llm.decontaminate import decontaminate
from pagemill.llm.html import extract
from pagemill.llm.language import LONGEST, grams, identify, profiles, ranked
from pagemill.llm.maxent import lm_scores
from pagemill.llm.near import ngram_jaccard_join
from pagemill.llm.packing import pack
from pagemill.llm.shard import shard
from pagemill.llm.suffix_dedup import suffix_dedup
from pagemill.llm.topk import top_k
from pagemill.llm.urls import filter_urls

CLASHING = ["batch_id", "block", "key", "value", "node", "h", "digest", "signature", "size", "row", "ids", "n", "learn", "range", "shard", "number", "score", "lang_pred", "class_id", "host", "tree", "wrapper", "salt", "deal", "_n", "found", "prints", "queue", "bytes", "own_doc_id"]
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(90_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a short text of some ten words to be read here twice", "en", "s"), (1, "a short text of some ten words to be read here twice", "en", "s"), (2, LONG, "en", "t"), (3, LONG + " end", "de", None), (None, "no id at all", None, "s"), (None, None, None, None), (4, None, "fr", "s"), (5, "", "fr", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING))).repartition(3)


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
OPERATORS = {
    "suffix_dedup": lambda d: suffix_dedup(d),
    "ngram_jaccard_join": lambda d: ngram_jaccard_join(d),
    "lm_scores": lambda d: lm_scores(d, train=F.col("doc_id") == 2, rounds=1),
    "shard": lambda d: shard(d, shards=3),
    "decontaminate": lambda d: decontaminate(d, d.where("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text")),
    "decontaminate by joins": lambda d: decontaminate(d, d.where("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text"), most_bytes=1),
    "identify": lambda d: identify(d, profiles(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_columns_stay(docs, name):
    """Each row comes back, with all columns but those that the operator makes or uses up."""
    got = OPERATORS[name](docs)
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1, 3: 1, None: 2, 4: 1, 5: 1}
    kept = [c for c in CLASHING if c in got.columns and {r[c] for r in rows} == {f"x{CLASHING.index(c)}"}]
    made = {"score", "lang_pred", "class_id", "shard", "size"}
    assert set(CLASHING) - set(kept) <= made
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    if name == "suffix_dedup":
        assert by[3].n_removed >= len(LONG) - 60_000 and by[2].n_bytes == len(LONG) and by[4].text is None
    if name == "ngram_jaccard_join":
        assert by[3].class_id == 2 and by[2].n_links == 1 and by[1].n_links == 1 and by[4].n_links == 0
    if name.startswith("decontaminate"):
        assert {d: r.contaminated for d, r in by.items()} == {1: True, 2: False, 3: False, 4: False, 5: False} and by[1].n_hit == 12
    if name == "lm_scores":
        assert by[2].n_tokens == 180_001 and by[4].n_tokens == 1 and by[5].score == by[4].score


def test_packing_of_clashing_columns(docs):
    got = pack(docs, tokenizer=TOKENIZER).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("want")).collect()
    assert len(got) == 6 and all(r.n == r.want for r in got)


def test_pages(spark):
    """Repeated pages, nulls and columns of the operators' own names."""
    rows = [(1, "http://a.net/x", "<article>One</article>"), (1, "http://a.net/x", "<article>One</article>"), (None, None, None), (2, None, "<p>Two"), (3, "x", ""), (4, "http://a.net/y", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)))
    got = extract(pages).collect()
    assert Counter((r.page_id, len(r.text)) for r in got) == {(1, 3): 2, (None, 0): 1, (2, 3): 1, (3, 0): 1, (4, len(LONG)): 1}
    assert all(r[c] == f"x{i}" for r in got for i, c in enumerate(CLASHING))
    judged = filter_urls(pages).collect()
    assert Counter((r.page_id, r.verdict) for r in judged) == {(1, "block"): 2, (None, "allow"): 1, (2, "allow"): 1, (3, "allow"): 1, (4, "block"): 1}
    assert all(r[c] == f"x{i}" for r in judged for i, c in enumerate(CLASHING) if c != "host")


def test_vectors_of_clashing_columns(spark):
    data = [(i, [float(i % 7), 1.0], *CLASHING) for i in range(40)]
    got = top_k(spark.createDataFrame(data, ["vec_id", "embedding", *CLASHING]), queries=F.col("vec_id") < 2).collect()
    assert len(got) == 20 and {r.query_id for r in got} == {0, 1}


def naive_grams(text):
    """Codes of all 1- to 5-grams of letters, each word between blanks (0)."""
    out, mask = Counter(), (1 << 64) - 1
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        points = [0, *map(ord, word), 0]
        for n in range(1, LONGEST + 1):
            for i in range(len(points) - n + 1):
                own = points[i : i + n]
                if n == 1 and own == [0]:
                    continue
                code = own[0] + 1
                for p in own[1:]:
                    code = (code * 0x9E3779B97F4A7C15 + p + 1) & mask
                out[code] += 1
    return out


def naive_ranks(counts, ranks):
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], signed(x[0])))][:ranks]


def test_language_by_brute_force(spark):
    """Profiles, distances and scores of a table, by counting in plain Python."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect() if r.text]
    for r in rows[:20]:
        assert Counter(grams(r.text).tolist()) == naive_grams(r.text) and ranked(grams(r.text), 300).tolist() == naive_ranks(naive_grams(r.text), 300)
    data = spark.createDataFrame(rows)
    totals = {}
    for r in rows:
        totals.setdefault(r.lang, Counter()).update(naive_grams(r.text))
    known = {lang: {c: i for i, c in enumerate(naive_ranks(counts, 300))} for lang, counts in sorted(totals.items())}
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(data, profiles(data)).collect()}
    for r in rows:
        own = naive_ranks(naive_grams(r.text), 300)
        if own:
            off = {lang: sum(abs(at[c] - i) if c in at else 300 for i, c in enumerate(own)) for lang, at in known.items()}
            best = min(off, key=off.get)
            assert got[r.doc_id] == (best, pytest.approx(1 - off[best] / (300 * len(own))))
