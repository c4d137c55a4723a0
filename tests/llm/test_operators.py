"""Operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm.bpe import ByteBpe
from pagemill.llm.decontaminate import decontaminate
from pagemill.llm.html import extract
from pagemill.llm.language import identify, profiles
from pagemill.llm.arrays import mix
from pagemill.llm.maxent import BEFORE, BEGIN, BITS, CLASSES, END, MEMBERS, OWN, PAIRS, SALTS, Members, Model, Tokens, Words, fitted, lm_scores
from pagemill.llm.near import ngram_jaccard_join
from pagemill.llm.packing import pack
from pagemill.llm.shard import shard
from pagemill.llm.suffix_dedup import suffix_dedup
from pagemill.llm.suffixes import collection
from pagemill.llm.topk import block_pairs, top_k
from pagemill.llm.urls import filter_urls

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, number string, hit_bits string, key string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdéß", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    shared = text(40)
    texts = [text(rng.randint(1, 120)) for _ in range(60)] + [None, None, "", " \n ", "x", "!?", "ha " * 500, text(3000)]
    texts += [t for t in texts[:6]] + [texts[0]] * 20 + [shared + " " + text(30) for _ in range(8)] + [text(20) + " " + shared for _ in range(8)]
    base = text(200).split()
    for k in range(12):
        near = list(base)
        near[k * 15] = "changed"
        texts.append(" ".join(near))
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "a"][i % 4], "n", "b", "k") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_collection_is_sorted():
    rng = random.Random(3)
    for _ in range(60):
        strings = [bytes(rng.choices(b"ab\xff c"[: rng.randint(1, 5)], k=rng.randint(0, 40))) for _ in range(rng.randint(1, 20))]
        length = np.array([len(s) for s in strings])
        which, offset, prefix = collection(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(length) - length, length)
        suffixes = [strings[a][b:] for a, b in zip(which, offset, strict=True)]
        assert suffixes == sorted(suffixes) and len(suffixes) == length.sum() + len(strings)
        for i in range(1, len(suffixes)):
            k = 0
            while suffixes[i][k : k + 1] and suffixes[i][k : k + 1] == suffixes[i - 1][k : k + 1]:
                k += 1
            assert prefix[i] == k


@pytest.mark.parametrize(("block_bytes", "hot"), [(2000, 2000), (1 << 20, 2000), (2000, 3), (500, 1)])
def test_suffix_dedup(docs, rows, block_bytes, hot):
    got = {r.doc_id: r for r in suffix_dedup(docs, block_bytes=block_bytes, hot=hot).collect()}
    first = {}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone, own = bytearray(len(data)), set()
        for i in range(len(data) - 49):
            piece = data[i : i + 50]
            if piece in first:
                gone[i : i + 50] = b"\1" * 50
            else:
                own.add(piece)
        for piece in own:
            first[piece] = doc_id
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
        assert (r.text is None) == (text is None) and r.number == "n"


def test_suffix_dedup_same_and_null_ids(spark):
    text = "one and the same long text that is repeated in each of these few rows, word for word"
    got = suffix_dedup(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id int, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, len(text))]


def test_ngram_jaccard_join(docs, rows):
    got = {r.doc_id: r for r in ngram_jaccard_join(docs).collect()}
    sets = {}
    for doc_id, text, *_ in rows:
        words = WORDS.findall(lower(text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    links = {a: [b for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8] for a in sets}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert (got[a].class_id, got[a].n_links) == (min(seen), len(links[a]))


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(TOKENIZER), random.Random(1)
    parts = [*"  \n\n\t'''sstmdrelvaABC123.,!?é漢 x-", "'s", "'ll", " <|endoftext|>", "²", "\r\n", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + [None, ""]
    for part, ids, first in ByteBpe(TOKENIZER).encode(pa.RecordBatch.from_pydict({"text": texts}), "text", 1):
        for i, text in enumerate(part.column("text").to_pylist()):
            assert ids[first[i] : first[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize(("weights", "packet"), [(None, None), ({"a": 1.0, "b": 6.0, None: 2.0}, 16)])
def test_packing(spark, docs, rows, weights, packet):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    asked = spark.createDataFrame(list(weights.items()), "source string, weight double") if weights else None
    twice = docs.unionByName(docs.where("doc_id in (3, 4)")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = pack(twice, tokenizer=TOKENIZER, length=64, weights=asked, packet=packet).toPandas()
    whole = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    times = {d: 2 if d in (3, 4) else 1 for d in whole}
    got["doc_id"] = got.doc_id.fillna(-1)
    whole[-1], times[-1] = whole[5], 1
    assert set(got.doc_id) == set(whole)
    for d, own in got.groupby("doc_id"):
        assert set(own.doc_tokens) == {len(whole[d])} and own.length.sum() == times[d] * len(whole[d])
        if times[d] == 1:
            assert [i for b in own.sort_values("start").ids for i in np.frombuffer(b, "<u4")] == whole[d]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.append(0, own.length.cumsum()[:-1]).tolist()
        assert own.length.sum() == 64 or bin(own.length.sum()).count("1") == 1
    # until a queue runs dry, it has its share of what was sent, but for a packet, and a round of each queue
    got["queue"] = got.source.fillna("")
    windows = got.groupby(["sequence_id", "queue"]).length.sum().unstack(fill_value=0)
    total = windows.sum()
    share = total / total.sum() if not weights else {k or "": v / sum(weights.values()) for k, v in weights.items()}
    sent, largest = windows.cumsum(), packet or 64
    dry = int((sent >= total).to_numpy().any(axis=1).argmax())
    for q in total.index:
        assert (sent[q] - sent.sum(axis=1) * share[q])[:dry].abs().max() <= 2 * 64 + 3 * largest


def test_pieces_stay_long(spark):
    """Mixing cuts a document only where windows end: two pieces more than documents and windows at most."""
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pack(data, tokenizer=TOKENIZER).agg(F.count("*"), F.countDistinct("sequence_id"), F.countDistinct("doc_id"), F.median("length")).first()
    assert got[0] <= got[1] * 2 + got[2] and got[3] > 250


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 12)) * rng.exponential(size=(400, 1))
    vectors[7] = vectors[9]
    vectors[20] = 0
    data = [(i, [float(x) for x in v], "s", 1) for i, v in enumerate(vectors)]
    data += [(40, data[3][1], "s", 1), (800, [], "s", 1), (802, [0.5], "s", 1), (500, None, "s", 1), (500, [1.0, None], "s", 1), (600, [float("nan")] * 12, "s", 1), (None, [1.0], "s", 1), (700, [float("inf")], "s", 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string, row int").repartition(3)
    got = top_k(table, queries=F.col("vec_id") % 20 == 0, block_rows=64, query_rows=5).collect()
    ids = np.array([*range(400), 40, 800, 802])
    whole = np.floor(1024 * np.concatenate([vectors, vectors[3:4], np.zeros((2, 12))])).astype(np.int64)
    whole[402, 0] = 512
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[q]
        best = [i for i in np.lexsort((ids, -scores)) if i != q][:10]
        want += [(ids[q], n + 1, ids[i], scores[i]) for n, i in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_pairs_of_blocks_are_pruned(spark):
    """Blocks of short candidates never meet queries that longer ones have satisfied."""
    asked = spark.createDataFrame([(k, float(k)) for k in range(10)] + [(99, float("-inf"))], "qb long, need double")
    blocks = spark.createDataFrame([(k, k / 10) for k in range(100)], "cb long, longest double")
    got = {tuple(r) for r in block_pairs(asked, blocks).collect()}
    assert got == {(q, c) for q in range(10) for c in range(100) if c / 10 >= q} | {(99, c) for c in range(100)}
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=4) * (100 if i < 50 else 0.1)]) for i in range(3000)]
    plan = top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), queries=F.col("vec_id") % 100 == 0, block_rows=64)
    assert plan.count() == 300


def test_lm_scores(docs, rows):
    train = F.col("doc_id") % 3 != 1
    model, counts, scored = fitted(docs, train=train, block_bytes=3000, rounds=3)
    got = {r.doc_id: r for r in scored.collect()}
    token = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None] for d, t, *_ in rows}
    counts_of = Counter(w for d, ws in token.items() if d % 3 != 1 for w in ws)
    n, v = sum(counts_of.values()), len(counts_of)
    for d, words in token.items():
        base = sum(np.log10((counts_of[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(words), sum(counts_of[w] > 0 for w in words), n)
        assert got[d].base_score == pytest.approx(base)
    along, members, number, types = (counts[k] for k in ("along", "members", "number", "types"))
    assert number.sum() == n - counts_of[None]
    assert types.sum() == v - 1

    def spelling(w):
        """Hash, class and leaning of a word, a byte pair at a time."""
        data = w.encode()
        pairs = [int(mix(np.array([x * 256 + y], np.uint64))[0] % PAIRS) for x, y in zip([32, *data], [*data, 32], strict=True)]
        leaning = along[pairs].sum(axis=0)
        return Words(pa.array([w])).hash[0], sum(int(x > 0) << k for k, x in enumerate(leaning)), leaning

    def rows_of(history, kind):
        """Rows of weights after a history (hash, class and leaning of each word), of classes and of members of a class."""
        one, two = (history[-k] if len(history) >= k else (BEGIN, END, None) for k in (1, 2))
        wrap = lambda x: np.array([int(x) & 0xFFFFFFFFFFFFFFFF], np.uint64)
        hashed = [int(one[0]) + int(SALTS[0]), int(two[0]) + int(SALTS[1]), int(mix(wrap(one[0]))[0]) * int(SALTS[0]) + int(two[0]) + int(SALTS[2])]
        bucket = lambda x: int(mix(wrap(x))[0] % model.rows)
        leaning = sum(int(x > 0) << k for k, x in enumerate(sum(x[2] for x in history[-BEFORE:]))) if history else END
        kinds = [leaning, CLASSES + 1 + one[1] * (CLASSES + 1) + two[1], *(len(model.kinds) - model.rows + bucket(h) for h in hashed)]
        own = [kind * (CLASSES + 1) + leaning, *(CLASSES * (CLASSES + 1) + bucket(hashed[k] + kind * int(SALTS[1])) for k in (0, 2))]
        return kinds, own

    def softmax(weights, rows):
        x = weights[rows].astype(float).sum(axis=0)
        return np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    at = {w: (h, k, int(members.of(np.array([h]))[0])) for w in counts_of if w is not None for h, k, _ in [spelling(w)]}
    share = lambda c, m, k: (k + 0.5) / (number[c, m] + 0.5 * (types[c, m] + (m >= OWN)))
    for d in (0, 1, 4, 60, 62):
        history, total = [], 0.0
        for w in token[d][:12]:
            kinds = softmax(model.kinds, rows_of(history, 0)[0])
            own = np.array([softmax(model.members, rows_of(history, c)[1]) for c in range(CLASSES)])
            known = sum(kinds[c] * own[c, m] * share(c, m, counts_of[x]) for x, (_, c, m) in at.items())
            unknown = sum(kinds[c] * own[c, m] * share(c, m, 0) for c in range(CLASSES) for m in range(OWN, MEMBERS))
            assert known + unknown + kinds[END] == pytest.approx(1, abs=1e-5)
            if w is None:
                total += np.log10(kinds[END])
            else:
                h, c, leaning = spelling(w)
                m = int(members.of(np.array([h]))[0])
                total += np.log10(kinds[c] * own[c, m] * share(c, m, counts_of[w]))
                history.append((h, c, leaning))
        if len(token[d]) <= 12:
            assert got[d].score == pytest.approx(total, rel=1e-5)


def test_lm_step_follows_the_gradient():
    """Observed less expected counts are the derivative of the likelihood by each weight, and a step raises it."""
    rng = np.random.default_rng(5)
    words = ["la", "le", "mot", "the", "word", "of", "an"]
    column = pa.array([" ".join(rng.choice(words, 30)) for _ in range(12)])
    along = rng.integers(-100, 100, (PAIRS, BITS))
    t = Tokens(Words(column, along), Members(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    model = Model(16, np.ones((CLASSES + 1, CLASSES + 1)), np.ones((CLASSES * (CLASSES + 1), MEMBERS)), np.zeros((CLASSES, MEMBERS), bool))
    sums = [np.zeros(w.shape) for w in (model.kinds, model.members) for _ in range(2)]
    model.count(sums, t)
    before = model.log10(t).sum()
    for weights, seen, expected in ((model.kinds, *sums[:2]), (model.members, *sums[2:])):
        for row in np.flatnonzero(seen.any(axis=1))[:6]:
            cell = (row, int(seen[row].argmax()))
            held = weights[cell]
            weights[cell] = held + 0.01
            up = model.log10(t).sum()
            weights[cell] = held - 0.01
            down = model.log10(t).sum()
            weights[cell] = held
            assert (up - down) / 0.02 * np.log(10) == pytest.approx(seen[cell] - expected[cell], rel=0.02, abs=0.05)
    model.step(sums)
    assert model.log10(t).sum() > before


def test_lm_beats_its_base(spark):
    """Nearly all held-out texts are likelier than by single words, also where input comes in other partitions."""
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scores(data.select("doc_id", "text"), train=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1).where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1").toPandas()
    assert (got.score > got.base_score).mean() >= 0.95
    assert got.score.sum() / got.n_tokens.sum() >= -3.7
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, other = (lm_scores(d, train=F.col("doc_id") % 5 != 1, rounds=2, block_bytes=b).orderBy("doc_id", "score").toPandas().score for d, b in ((small.coalesce(1), 1 << 20), (small.repartition(5), 20_000)))
    assert np.allclose(one, other, rtol=1e-4)


@pytest.mark.parametrize(("tolerance", "ranges"), [(0.02, None), (0.5, None), (0.02, 3), (0.3, 7)])
def test_shard(docs, rows, tolerance, ranges):
    many = docs.select("doc_id", "text", "key").unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"), "key"))
    many = many.unionByName(docs.where("doc_id < 9").select("doc_id", "text", "key"))
    got = shard(many, shards=5, tolerance=tolerance, ranges=ranges).toPandas()
    assert len(got) == 2 * len(rows) + 9 and set(got.law) == {"bytes"} and set(got.key) == {"k"}
    whole = got["size"].sum()
    sums = got.groupby("shard")["size"].sum()
    groups = got.groupby(["text_crc32", "size"])
    small = [g for _, g in groups if g["size"].sum() <= tolerance * whole / 5]
    assert all(g.shard.nunique() == 1 for g in small) and len(small) > 15
    largest = max(max(g["size"].sum() for g in small), got["size"].max())
    assert (sums - whole / 5).abs().max() <= largest
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    texts = {d: t for d, t, *_ in rows}
    for r in got[got.doc_id.notna()].itertuples():
        data = (texts[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))


@pytest.mark.parametrize("url", ["'http://a.nowhere/x'", "cast(null as string)", "'http://a.example.net/en/'"])
def test_urls_of_one_host_spread(spark, url):
    """A host with all pages, with a rule or without, and null urls use all tasks."""
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        judged = filter_urls(spark.range(20_000).select(F.col("id").alias("page_id"), F.expr(url).alias("url")), rows_a_task=100)
        sizes = [r["count"] for r in judged.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert sum(sizes) == 20_000
    assert max(sizes) < 2 * 20_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/de/", "https://X.org/fr/a?b", "http://org", "http://notexample.com/de/", "http://b.example.com/de/x#y", None, "nothing", "http://x.net"]
    data = [(i % 5, u, "s", 1, "t") for i, u in enumerate(urls * 30)]
    for rows_a_task in (7, 1000):
        all_ = filter_urls(spark.createDataFrame(data, "page_id int, url string, salt string, is_rule int, host string").repartition(3), rows_a_task=rows_a_task).collect()
        got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in all_}
        assert Counter((r.page_id, r.url, r.salt, r.is_rule) for r in all_) == Counter((*x[:2], "s", 1) for x in data) and len({(r.url, r.host, r.path, r.rule, r.verdict) for r in all_}) == 9
        assert got["http://a.example.net/en/1"] == ("a.example.net", "/en/1", "example.net/en/", "allow")
        assert got["http://example.net/de/"][2:] == ("net/", "block")
        assert got["https://X.org/fr/a?b"] == ("x.org", "/fr/a", "org/fr/", "allow")
        assert got["http://b.example.com/de/x#y"] == ("b.example.com", "/de/x", "example.com/de/", "block")
        assert got["http://notexample.com/de/"][2:] == (None, "allow") and got["http://x.net"] == ("x.net", "", None, "allow") and got[None] == ("", "", None, "allow") == got["nothing"]
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in filter_urls(spark.createDataFrame(data, "page_id int, url string, salt string, is_rule int, host string"), none).collect()} == {"allow"}


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One\n <b>two</b>.<br>three<p>Four<script>var x='</p>'</script><div class=comments>no</div></article><footer>F</footer>"
    plain = [f"<body><div class=x>Welcome all</div><div>Story {i} is {i * 7}<p>More {i}</div><div>Rights</div></body>" for i in range(10)]
    data = [(0, "http://a.b/1", page), (1, None, None), (2, "http://a.b/2", ""), (3, "http://a.b/3", "a < b <"), *((10 + i, "http://c.d/", p) for i, p in enumerate(plain))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(data, "page_id int, url string, html string")).collect()}
    assert got[0] == "A & B One two. three Four" and got[1] == "" == got[2] and got[3] == "a < b <" and got[13] == "Story 3 is 21 More 3"


def test_decontaminate(spark, docs, rows):
    items = [(1, " ".join(rows[5][1].split()[:30])), (2, rows[67][1][:400]), (2, "x"), (30, "x"), (None, "x"), (4, None), (5, "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        words = WORDS.findall(lower(t or ""))
        for k in range(max(1, len(words) - 9)) if words and i is not None else []:
            windows.setdefault(tuple(words[k : k + 10]), set()).add(str(i))
    for most_bytes in (1 << 20, 60):
        got = {r.doc_id: r for r in decontaminate(docs, bench, most_bytes=most_bytes).collect()}
        for d, t, *_ in rows:
            words, hit, found = WORDS.findall(lower(t or "")), set(), set()
            for n in {len(w) for w in windows}:
                for k in range(len(words) - n + 1):
                    if own := windows.get(tuple(words[k : k + n])):
                        found |= own
                        hit |= set(range(k, k + n))
            r = got[d]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.hit_bits) == (len(words), len(hit), len(found), bool(hit), "b")
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_language(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = profiles(data.where("doc_id % 2 = 0"))
    got = identify(data.where("doc_id % 2 = 1"), known).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = identify(spark.createDataFrame([(1, None), (2, "123 !?"), (3, "")], "doc_id int, text string"), known).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert suffix_dedup(empty).count() == 0
    assert ngram_jaccard_join(empty).count() == 0
    assert pack(empty, tokenizer=TOKENIZER).count() == 0
    assert lm_scores(empty, train=F.lit(True), rounds=1).count() == 0
    assert shard(empty).count() == 0
    assert decontaminate(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert identify(empty, profiles(empty)).count() == 0
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), queries=F.lit(True)).count() == 0


def test_expected_counts_take_little_more_than_scores():
    """Adding expected counts takes no sorting, so a step of training is not many times what scoring takes; sums are those by row."""
    rng = np.random.default_rng(1)
    n, rows = 60_000, 1 << 14
    t = object.__new__(Tokens)
    t.row, t.kind, t.member = np.zeros(n, np.int64), rng.integers(0, CLASSES + 1, n), rng.integers(0, MEMBERS, n)
    t.one, t.two = (rng.zipf(1.3, n).astype(np.uint64) for _ in range(2))
    t.classes, t.leaning = rng.integers(0, (CLASSES + 1) ** 2, n), rng.integers(0, CLASSES + 1, n)
    model = Model(rows, np.ones((CLASSES + 1, CLASSES + 1)), np.ones((CLASSES * (CLASSES + 1), MEMBERS)), np.zeros((CLASSES, MEMBERS), bool))
    model.kinds[:], model.members[:] = rng.normal(size=model.kinds.shape), rng.normal(size=model.members.shape)

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    sums = [np.zeros(w.shape, "<f4") for w in (model.kinds, model.members) for _ in range(2)]
    model.count(sums, t)
    for (weights, places, own), seen, expected in zip(model.parts(t)[0], sums[::2], sums[1::2], strict=True):
        x = sum(weights[r].astype(float) for r in places)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k in (0, 7, weights.shape[1] - 1):
            assert np.allclose(expected[:, k], sum(np.bincount(r, weights=p[:, k], minlength=len(weights)) for r in places), rtol=1e-4, atol=1e-4)
        assert seen.sum() == len(own) * len(places)
    model.kinds[:100] += 500  # beyond what float32's exponentials hold
    far, again = model.log10(t), [np.zeros_like(s) for s in sums]
    model.count(again, t)
    model.kinds[:100] -= 500
    assert np.isfinite(far).all() and all(np.allclose(a, b, rtol=1e-2, atol=1e-2) for a, b in zip(again[2:], sums[2:], strict=True)) and np.isfinite(again[1]).all()
    assert min(seconds(lambda: model.count(sums, t)) for _ in range(4)) < 3 * min(seconds(lambda: model.log10(t)) for _ in range(4))
