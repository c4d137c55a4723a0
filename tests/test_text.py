import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import lines as L
from pagemill.operators import reading as R
from pagemill.operators import usage as U
from pagemill.plans.catalog import QUERIES


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        (X.normalize_line, "  صفحه ۱۲ ", "صفحه 12"),
        (X.repair_script, "سلامA دنیا(cid:12)", "سلام دنیا"),
        (X.repair_latin_breaks, "The snip er saw the Ap ache helicop ter", "The sniper saw the Apache helicopter"),
        (X.repair_latin_breaks, "they are able to read", "they areable to read"),
        (X.repair_latin_breaks, "ébcd ing is split here", "ébcding is split here"),
        (L.clean_native, "exam-\nple text\nnext line", "example text next line"),
        (X.split_sentences, 'He said "Go." Then left! Ok', ['He said "Go."', "Then left!", "Ok"]),
        (lambda c: X.tidy_ocr(c, "fas"), "ك ي ة", "ک ی ه"),
        (lambda c: X.clean_rtl_line(c, F.lit(True)), "الھادئ", "الهادئ"),
        (X.speech_normalize, "Dr. Smith’s AI & PDF — 5%", "Doctor Smith's A I and P D F - 5 percent"),
        (lambda c: X.needs_ocr(c, F.lit("eng")), "", True),
        (lambda c: X.needs_ocr(c, F.lit("eng")), "short", True),
        (lambda c: X.needs_ocr(c, F.lit("eng")), "1234567890 1234567890", True),
        (lambda c: X.needs_ocr(c, F.lit("eng")), "Dies ist ein langer Satz mit Umlauten", False),
        (lambda c: X.looks_corrupted(c, F.lit("fas")), "سلام AA دنیا", True),
    ],
)
def test_golden(spark, rule, text, expected):
    assert one(spark, rule, text) == expected


def test_footnote_blocks(spark):
    page = [f"line {i}" for i in range(10)]
    page[6:9] = ["* see the editor's note", "more", "Question two"]
    pages = spark.createDataFrame([("d", 1, "\n".join(page), "native")], "doc_id string, page int, text string, source string")
    kept = {r.i for r in L.strip_footnote_blocks(L.split_lines(pages)).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 8, 9}


def test_paginate(spark):
    docs = spark.createDataFrame([(1, "a" * 1000 + "\n" + "b" * 800), (2, "a" * 1000 + "\n" + "b" * 801), (3, None)], "doc_id long, text string")
    sizes = {(r.doc_id, r.page): len(r.text) for r in L.paginate(docs).collect()}
    assert sizes == {(1, 1): 1801, (2, 1): 1000, (2, 2): 801}


def test_speech_chunks(spark):
    def chunks(*sizes):
        rows = spark.createDataFrame([("d", 1, i, "x" * n) for i, n in enumerate(sizes)], "doc_id string, page int, id long, text string")
        return [len(r.text) for r in R.speech_chunks(rows).orderBy("chunk_ix").collect()]

    assert chunks(200, 219) == [420]
    assert chunks(200, 220) == [200, 220]
    assert chunks(500, 10, 10, 10) == [500, 21, 10]


def test_quota_amount(spark):
    rows = spark.createDataFrame([("u", "2024-01", i, i, a) for i, a in enumerate([6, 5, 4])], "app_user_id string, month string, ts int, req_id long, amount long")
    got = U.quota_admit_amount(rows, 10).orderBy("req_id").collect()
    assert [r.admitted for r in got] == [True, False, True]


def test_quota_pages(spark):
    rows = spark.createDataFrame([("u", "2024-01", i, i, n) for i, n in enumerate([6, 6, 1])], "app_user_id string, month string, ts int, req_id long, n long")
    assert [r.granted for r in U.quota_trim_pages(rows, F.lit(10)).orderBy("req_id").collect()] == [6, 4, 0]


def test_plan_economics(spark):
    got = {r.key: r for r in U.plan_economics(U.tiers(spark)).collect()}
    assert round(got["ai_pro"].cost, 4) == 1.6275 and round(got["ai_pro"].budget, 3) == 1.680 and got["ai_pro"].ok
    assert round(got["power"].cost, 2) == 3.74 and got["power"].ok


def test_ttl(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-01 23:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00.001"])] + [("n", 9, None)], "key string, req_id long, ts string")
    got = U.ttl_dedupe(rows.withColumn("ts", F.to_timestamp("ts"))).orderBy("req_id").collect()
    assert [r.hit for r in got] == [False, True, True, False, False]


def test_layout_lines(spark):
    items = [("d", 1, 0, "world", None, 60.0, 100.0, 30.0, 10.0), ("d", 1, 1, "Hello", None, 20.0, 101.0, 35.0, 10.0), ("d", 1, 2, "", None, 0.0, 0.0, 0.0, 0.0), ("d", 1, 3, "lost", None, None, 5.0, 1.0, 1.0)]
    items += [("d", 1, 4, "!", None, 95.0, 100.0, 3.0, 10.0), ("d", 1, 5, "دنیا", "rtl", 10.0, 50.0, 20.0, 10.0), ("d", 1, 6, "سلام", "rtl", 40.0, 50.0, 20.0, 10.0), ("d", 1, 7, "x", None, 0.0, 20.0, 0.0, 0.0), ("d", 1, 8, "y", None, 9.0, 20.0, 0.0, 0.0), ("e", 2, 0, " ", None, 1.0, 1.0, 1.0, 1.0)]
    got = L.layout_lines(spark.createDataFrame(items, "doc_id string, page int, idx int, str string, dir string, x double, y double, width double, height double")).orderBy("line_no").collect()
    assert [(r.doc_id, r.line_no, r.text, r.rtl) for r in got] == [("d", 0, "Hello world!", False), ("d", 1, "سلام دنیا", True), ("d", 2, "x y", False)]


@pytest.mark.parametrize(("lang", "text", "expected"), [
    ("rus", "Это простое предложение на русском языке", False), ("rus", "123456789012345678 1", True), ("hin", "यह एक सरल हिंदी वाक्य है जो लंबा है", False), ("jpn", "これは日本語の簡単な文章です。とても短い", False), ("jpn", "an English line in place of it, short", True),
    ("kor", "이것은 한국어로 된 간단한 문장입니다 그렇죠", False), ("tha", "นี่คือประโยคภาษาไทยง่ายๆ ประโยคหนึ่ง", False), ("rus", "ПростоA текстB ещеC словоD и такE далееF", True),
])
def test_needs_ocr_in_scripts(spark, lang, text, expected):
    assert one(spark, lambda c: X.needs_ocr(c, F.lit(lang)), text) is expected


def test_norms_of_a_text_are_those_of_its_lines(spark):
    texts = ["", "\n", " A  b \n\tC\x0b", "ΣΑΣ\n ΣΑ  x y", "سلام ـ دنیا\n ۱۲ ٣", "K \n　z\u0085", " \n \n", "plain\nwide é  e\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", L._norms(F.col("text"), X.has_script("text")).alias("whole"), F.transform(F.split("text", "\n"), X.normalize_line).alias("each")).collect():
        assert r.whole == r.each, r.text


def test_breaks_next_to_single_letters_and_wide_ends(spark):
    assert one(spark, L.clean_native, "ab\nc\nde\n\nf\ng") == "ab c\nde\n\nf g"
    assert one(spark, X.trim, " 　é x ") == "é x" and one(spark, X.trim, "\té \u0085") == "é\u0085"
    assert one(spark, X.split_sentences, "  One. Two!　Three\u0001 four ") == ["One.", "Two!", "Three", "four"]


def test_words_of_a_long_text_take_time_in_proportion(spark):
    """A list that is copied for each word takes minutes here."""
    texts = [None, "", " 　", "a é​ 漢😀﻿z", "word\n" * 400_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.words_with_offsets("t").alias("w"))
    began = time.monotonic()
    few = rows.where("k < 4").select("k", F.transform("w", lambda x: F.concat_ws("@", x["word"], x["offset"])).alias("w")).orderBy("k").collect()
    assert [r.w for r in few] == [None, [], [], ["a@0", "é​@2", "漢😀@5", "z@8"]]
    last = rows.where("k = 4").select(F.size("w").alias("n"), F.element_at("w", -1).alias("last")).first()
    assert (last.n, last.last.word, last.last.offset) == (400_000, "word", 1_999_995) and time.monotonic() - began < 60


def test_kept_lines_are_those_of_the_line_rules(spark):
    """By whole pages, what is the same for skip_lines over strip_footnote_blocks, line by line."""
    page = ["* a note", "www.x.org", "", "same line", "......", "text\tb", "Question two", "after **", "page 3"]
    texts = ["\n".join(page[k:] + page[:k]) for k in range(len(page))] + ["plain\r\ntext", None, "", "same line"]
    pages = spark.createDataFrame([("d", k, t, "native") for k, t in enumerate(texts)], "doc_id string, page int, text string, source string")
    lines = L.split_lines(pages.drop("source"))
    want = L.skip_lines(L.strip_footnote_blocks(lines), L.repeated_lines(pages, lines))
    got = L.kept_lines(pages)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_costly_values_of_a_line_are_worked_out_once(spark):
    """Each use of a value that is not kept is its own chain of replacements in the plan."""
    line = F.regexp_replace("t", "needle", "x")
    for rule in (X.repair_script(line), X.needs_ocr(line, F.lit("eng")), X.mostly_latin(line), X.clean_rtl_line(line, F.lit(True))):
        plan = spark.createDataFrame([("a",)], "t string").select(rule.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("needle") == 1


def test_layout_lines_look_at_an_item_once(spark):
    """Neighbours and the check for blank lines take what was found of an item; nothing is sorted by an interpreted comparison, and items are listed once a line."""
    items = [("d", 1, k, w, None, 60.0 * k, 100.0, 6.0 * len(w), 10.0) for k, w in enumerate(["a", "(", "b", ")", "漢", "字", "é "])] + [("d", 1, 9, "ْ(cid:3)", "rtl", 0.0, 50.0, 5.0, 10.0), ("d", 1, 10, " ", None, 0.0, 20.0, 5.0, 10.0)]
    got = L.layout_lines(spark.createDataFrame(items, "doc_id string, page int, idx int, str string, dir string, x double, y double, width double, height double"))
    assert [(r.line_no, r.text) for r in got.where("line_no <> 1").collect()] == [(0, "a (b) 漢字 é")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and plan.count("collect_list(") == 3


def test_word_count(spark):
    """Words are counted by blanks, whatever white space there is."""
    texts = ["", " ", "one", " two words ", "a  b", "a\tb\nc\x0bd\x0ce\rf", "é b", "a b　c", "﻿", "a   b", "a\u0085b", "a​b c", " x ", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.word_count("t").alias("n"), F.size(F.regexp_extract_all("t", F.lit(f"([^{X.WS[1:-1]}]+)"))).alias("m"), "t").collect()
    assert len(rows) == len(texts) and all(r.n == (None if r.t is None else r.m) for r in rows)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_listening_time_needs_no_ids(spark):
    """Its sums go by page, so sentences are neither numbered nor moved; words are not listed to be counted."""
    plan = plan_of(QUERIES["listening_time"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "regexp_extract_all" not in plan


def test_voice_cost_needs_no_ids(spark):
    assert "Window" not in plan_of(QUERIES["voice_cost"](spark, "/root/testdata/sf0.001"))


def test_book_reading_report_needs_no_ids(spark):
    plan = plan_of(QUERIES["book_reading_report"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "regexp_extract_all" not in plan


def _pages_of_sentences(spark):
    rng = random.Random(5)
    some = lambda: "x" * rng.choice([1, 5, 200, 219, 220, 500]) if rng.random() < 0.9 else rng.choice(["", " ", "　 "])
    pages = [(d, p, [some() for _ in range(rng.randint(0, 12))]) for d in ("a", "b", None) for p in range(1, 70)]
    return spark.createDataFrame(pages, "doc_id string, page int, sentences array<string>")


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize(("mode", "cap"), [("local", None), ("local", 30), ("natural", None)])
def test_chunks_by_pages(spark, mode, cap):
    """Chunks made within a page's row are those of its sentences by windows, from wherever reading begins."""
    pages = _pages_of_sentences(spark)
    starts = spark.createDataFrame([("a", 3, 7), ("b", 40, None)], "doc_id string, start_id int, offset int")
    sentences = L.numbered(pages)
    assert rows_of(R.page_speech(L.numbered_pages(pages), mode=mode, page_cap=cap)) == rows_of(R.speech_chunks(sentences, mode=mode, page_cap=cap))
    assert rows_of(R.page_speech(L.numbered_pages(pages, starts), mode=mode, page_cap=cap)) == rows_of(R.speech_chunks(sentences, mode=mode, page_cap=cap, starts=starts))


def test_places_need_no_texts(spark):
    pages = _pages_of_sentences(spark)
    places = R.speech_places(L.numbered_pages(pages.withColumn("sentences", R.spoken_lengths(F.col("sentences")))))
    assert rows_of(places) == rows_of(R.speech_chunks(L.numbered(pages)).select("doc_id", "page", "chunk_ix", F.length("text").cast("long").alias("length"), "spans"))


@pytest.mark.parametrize("name", ["speech_chunks", "speech_chunks_from", "speech_chunks_natural"])
def test_chunks_move_texts_once(spark, name):
    """Texts cross the shuffle of their stretch alone: no window has the key (doc_id, page)."""
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"hashpartitioning\(doc_id#\d+, page", plan) and "Window [lag(" not in plan


@pytest.mark.parametrize("name", ["locate_span", "first_of_page"])
def test_places_and_firsts_move_numbers(spark, name):
    """What is joined by chunk or page was reduced to numbers before, and documents are numbered once."""
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "documents.parquet" not in plan and "Window [lag(" not in plan


ITEM = "struct<idx:int,str:string,dir:string,x:double,y:double,width:double,height:double>"


def _items_of_pages():
    rng = random.Random(11)
    words = ["a", "word", "(", ")", ".", "é", "漢", "字", "سلام", "دنیا", " x", "y　", "z\u0085", "(cid:3)", " ", "", None]
    place = lambda: rng.choice([None, float("nan"), float("inf"), 0.0, *(rng.randint(0, 900) / 8 for _ in range(20))])
    one = lambda k: (rng.choice([None, k, k % 5]), rng.choice(words), rng.choice([None, "ltr", "rtl"]), place(), rng.choice([place(), 12.0 * rng.randint(0, 5) + rng.randint(0, 3)]), rng.choice([None, 0.0, 3.0, -7.5, 30.0]), rng.choice([None, 0.0, 5.0, 9.0, 30.0]))
    return [(d, p, [one(k) for k in range(rng.choice([0, 1, 2, 9, 60]))]) for d in ("a", "b", None) for p in range(40)]


def test_lines_of_pages_that_hold_their_items(spark):
    """Whether items come as rows or as a list a page: the same lines."""
    pages = _items_of_pages()
    held = spark.createDataFrame([*pages, ("none", 1, None)], f"doc_id string, page int, items array<{ITEM}>")
    rows = held.select("doc_id", "page", F.explode("items").alias("z")).select("doc_id", "page", "z.*").repartition(3, "x")
    got = rows_of(L.layout_lines(held))
    assert got == rows_of(L.layout_lines(rows)) and len(got) > 400 and any("rtl=True" in r for r in got)


def test_layout_lines_moves_no_item(spark):
    """Documents are dealt out, and from there on each page is worked on where it is."""
    plan = plan_of(QUERIES["layout_lines"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning(") == 1 and "Aggregate" not in plan and "Exchange hashpartitioning(doc_id" in plan


def test_line_numbers_by_heights_are_those_by_items():
    """A step for all items at one height gives what one item after the other gives."""
    rng = random.Random(2)
    for _ in range(300):
        y = sorted((rng.choice([rng.random() * 20, rng.randint(0, 40) / 4]) for _ in range(rng.randint(0, 40)) for _ in range(rng.choice([1, 1, 5]))), reverse=True)
        tolerance, heights = rng.choice([1.5, 2.0, 4.0]), sorted(set(y), reverse=True)
        by_height = L._line_numbers(heights, [y.count(h) for h in heights], tolerance)
        means, sizes, want = [], [], []
        for at in y:
            k = next((k for k in range(len(means)) if abs(means[k] - at) <= tolerance), len(means))
            if k == len(means):
                means.append(at)
                sizes.append(1)
            else:
                sizes[k] += 1
                means[k] = (means[k] * (sizes[k] - 1) + at) / sizes[k]
            want.append(k)
        place = {k: i for i, k in enumerate(sorted(range(len(means)), key=lambda k: -means[k]))}
        assert [n for n, h in zip(by_height, heights, strict=True) for _ in range(y.count(h))] == [place[k] for k in want]


def test_words_of_lines(spark):
    lines = [["one  two", "", "é x"], [], None, ["a"], [None, " b"]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, l array<string>").coalesce(1).select("k", X.words_of_lines("l").alias("w")).orderBy("k").collect()
    assert [r.w and [tuple(w) for w in r.w] for r in rows] == [[(0, 0, "one", 0), (0, 1, "two", 5), (2, 0, "é", 0), (2, 1, "x", 2)], [], None, [(0, 0, "a", 0)], [(1, 0, "b", 1)]]


def test_lines_of_words_that_stand_apart(spark):
    """Words of a line with a wide gap before each are joined at once; blanks are missing at the same places as for words with narrow gaps, which are looked at one by one."""
    rng = random.Random(4)
    words = ["a", "word", "(", ")", ".", ",b", "c(", "é", "漢", "字", "「", "»", "”", "x«y", "[", "]"]
    lines = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12]))] for _ in range(120)]
    bound = lambda a, b: a[-1] in L.NO_BLANK_AFTER or b[0] in L.NO_BLANK_BEFORE or bool(re.match(f"[{L.CJK}]{{2}}$", a[-1] + b[0]))
    want = {k: own[0] + "".join(b if bound(a, b) else " " + b for a, b in zip(own[:-1], own[1:], strict=True)) for k, own in enumerate(lines)}
    for gap in (50.0, 3.0):
        at = lambda own, k, gap=gap: sum((len(w) + gap for w in own[:k]), 0.0)
        pages = spark.createDataFrame([("d", k, [(i, w, "ltr", at(own, i), 5.0, float(len(w)), 9.0) for i, w in enumerate(own)]) for k, own in enumerate(lines)], f"doc_id string, page int, items array<{ITEM}>")
        assert {r.page: r.text for r in L.layout_lines(pages).collect()} == want


def test_trim_at_both_ends(spark):
    texts = [None, "", " ", "a", " a", "a ", "\ta b\n", "é", " é", "é\u0085", "　é　", "\x0b\x0c\r x", "x\n\n", "﻿x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.trim("t").alias("got")).collect()
    assert [r.got for r in rows] == [None if t is None else re.sub(f"^{X.WS}+|{X.WS}+\\Z", "", t) for t in texts]
