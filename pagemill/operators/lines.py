"""From pages to clean sentences: (doc_id, page, text, source) in, lines and sentences out."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.sources.tables import scratch, small_batches

PAGE = ["doc_id", "page"]


def split_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, i, n, line: the lines of each page, counted from 0; other columns of pages stay."""
    own = [c for c in pages.columns if c not in (*PAGE, "text")]
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    rows = pages.select(*PAGE, *own, text.alias("text"))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select(*PAGE, *own, n.alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "line"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.select(*PAGE, X.normalize_line("line").alias("norm")).distinct()


def _enough(share: float, least: int) -> Column:
    """Whether a line is `on` enough of the document's `pages`."""
    return F.col("on") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * F.lit(share)))


def repeated_lines(pages: DataFrame, lines: DataFrame, share: float = 0.18, least: int = 3) -> DataFrame:
    """doc_id, norm: normalized lines of 4 to 90 characters on at least that share of the document's pages.

    Lines are reduced to distinct ones for each page before they are counted, and counts combine before the shuffle.
    """
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    counts = distinct_lines(lines).where(_counted(F.col("norm"))).groupBy("doc_id", "norm").agg(F.count("*").alias("on"))
    return counts.join(sizes, "doc_id").where(_enough(share, least)).select("doc_id", "norm")


def _opens(line: Column, i: Column, n: Column) -> Column:
    """Whether a line begins a block of footnotes: a star before it, or one behind it in the lower part of a page."""
    t = X.trim(line)
    place = i / F.greatest(F.lit(1), n)
    marked = rf"^{X.STARS}{{1,4}}{X.WS}*(.+)$"
    rest = X.trim(F.regexp_extract(t, marked, 1))
    found = F.when(t.rlike(marked), (rest != "") & ((place > 0.45) | (F.length(rest) > 80))).otherwise((place > 0.45) & t.rlike(rf"{X.STARS}{X.WS}*$") & X.mostly_latin(t))
    return starred(line) & found


def starred(line: Column) -> Column:
    return line.contains("*") | (X.wide(line) & line.rlike(X.STARS))


def _closes(line: Column) -> Column:
    """Whether a line is a question or an answer, which ends such a block."""
    return X.trim(line).rlike(rf"^(سوال|جواب)({X.WS}|-)|^(?i:question|answer)(?![A-Za-z0-9_])")


def strip_footnote_blocks(lines: DataFrame) -> DataFrame:
    """Lines without blocks that a starred line opens, up to the line before a question or answer."""
    order = Window.partitionBy(*PAGE).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.last(F.when(_opens(F.col("line"), F.col("i"), F.col("n")), True).when(_closes(F.col("line")), False), ignorenulls=True).over(order)
    return lines.withColumn("inside", F.coalesce(inside, F.lit(False))).where(~F.col("inside")).drop("inside")


def _blank(line: Column) -> Column:
    return ~line.rlike(f"[^{X.WS[1:-1]}]")


def _skipped(line: Column, norm: Column, page: Column) -> Column:
    """Whether a line that is not blank is a footnote mark alone, the page's number, an address or stamp, or a rule."""
    ruled = rf"^{X.WS}*[{RULE}][{RULE}{X.WS[1:-1]}]{{2,}}[{RULE}]{X.WS}*$"
    drop = line.rlike(f"^{X.WS}*{X.STARS}{{1,4}}{X.WS}*$") | ((norm != "") & (norm.isin(*_numbers(page)) | X.stamped(norm) | line.rlike(ruled)))
    return F.coalesce(drop, F.lit(False))


def skip_lines(lines: DataFrame, skip: DataFrame) -> DataFrame:
    """Lines without footnote marks alone, repeated lines, page numbers, addresses and stamps, and rules. Blank lines stay."""
    rows = lines.withColumn("norm", X.normalize_line("line"))
    kept = rows.where(_blank(F.col("line")) | ~_skipped(F.col("line"), F.col("norm"), F.col("page")))
    return kept.join(skip, ["doc_id", "norm"], "left_anti").drop("norm")


def _unhyphenated(text: Column) -> Column:
    joined = lambda x: F.when(x.contains("-\n"), F.regexp_replace(x, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")).otherwise(x)
    return X.once(F.replace(text, F.lit("\r"), F.lit("")), joined)


def _single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t][ \t]++", " ")


def clean_native(text: Column) -> Column:
    """Wrapped lines become paragraphs."""

    def joined(x: Column) -> Column:
        # a line of one letter is joined to the line before and no more to the one behind
        return F.when(x.rlike(r"\n[^\n]\n"), F.regexp_replace(x, r"([^\n])\n([^\n])", "$1 $2")).otherwise(F.regexp_replace(x, r"\n(?<=[^\n]\n)(?=[^\n])", " "))

    return X.trim(_single_blanks(X.once(_unhyphenated(text), joined)))


def clean_ocr(text: Column) -> Column:
    """Line breaks stay; split words are joined."""
    out = _single_blanks(_unhyphenated(X.repair_latin_breaks(text)))
    return X.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


#: Rows of a document's line counts are dealt by this many salts where they meet its number of pages.
SALTS = 16
#: What a line is ruled with.
RULE = r"._=\-*~•·"


def _norms(text: Column, scripted: Column) -> Column:
    """normalize_line of each line of a text without carriage returns, worked out on the text at once: no rule but trimming looks beyond one run of white space.

    Digits to be replaced and tatweel are letters of SCRIPTS; few texts without these have anything to replace at all.
    """
    blanks = X.WS[1:-1].replace(r"\t-\r", r"\t\x0b\f")
    single = lambda x: F.regexp_replace(x, f"[{blanks}]+", " ")
    foreign = F.replace(single(F.translate(text, X.PERSIAN_ARABIC_DIGITS, "01234567890123456789")), F.lit("ـ"), F.lit(""))
    rare = text.contains("\t") | text.contains("\x0b") | text.contains("\f")
    some = text.contains("  ") | rare | (X.wide(text) & text.rlike(f"[{blanks.replace(' ', '')}]"))
    low = F.lower(F.when(scripted, foreign).when(some, single(text)).otherwise(text))
    trimmed = X.once(low, lambda x: F.when(x.contains(" \n") | x.contains("\n "), F.regexp_replace(x, " *\n *", "\n")).otherwise(x))
    return F.split(F.trim(trimmed), "\n")


def _counted(norm: Column) -> Column:
    """Whether a line is one that may be dropped for being repeated."""
    return F.length(norm).between(4, 90)


def _numbers(page: Column) -> list[Column]:
    number = page.cast("string")
    return [number, F.concat(F.lit("page "), number), F.concat(F.lit("صفحه "), number)]


def _prepared(pages: DataFrame) -> DataFrame:
    """doc_id, page, source, text, _seen, _odd: hashes of a page's distinct lines that may be repeated ones, and whether any other line rule can change the page."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(""))
    rows = pages.select(*PAGE, "source", text.alias("text")).withColumn("_scripted", X.has_script("text"))
    rows = rows.select("*", _norms(F.col("text"), F.col("_scripted")).alias("_norms"), F.lower("text").alias("_low"))
    ruled = F.col("text").rlike(rf"(?:^|\n){X.WS}*[{RULE}][{RULE}{X.WS[1:-1]}]{{2,}}[{RULE}]")
    odd = starred(F.col("text")) | F.col("_scripted") | F.arrays_overlap("_norms", F.array(*_numbers(F.col("page")))) | X.stamped(F.col("_low")) | ruled
    seen = F.array_distinct(F.transform(F.filter("_norms", _counted), lambda x: F.xxhash64(x)))
    return rows.select(*PAGE, "source", "text", seen.alias("_seen"), F.coalesce(odd, F.lit(True)).alias("_odd"))


def often_repeated(prepared: DataFrame, share: float = 0.18, least: int = 3) -> DataFrame:
    """_at, _often: hashes of the repeated lines (see repeated_lines) of a document, for each stretch of its pages.

    Lines travel as 64-bit hashes; that another line of the document has the hash of one of its few repeated ones is ruled out in practice.
    A line on 18 % of the pages is one of less than six times those of a page, so a list is as short as pages are.
    """
    counts = prepared.select("doc_id", F.explode("_seen").alias("norm")).groupBy("doc_id", "norm").agg(F.count("*").alias("on")).where(F.col("on") >= least)
    stretches = prepared.groupBy("doc_id", _stretch().alias("_at")).agg(F.count("*").alias("pages"))
    sizes = stretches.groupBy("doc_id").agg(F.sum("pages").alias("pages"))
    salted = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    often = counts.withColumn("_salt", F.pmod("norm", F.lit(SALTS)).cast("int")).join(salted, ["doc_id", "_salt"]).where(_enough(share, least))
    return stretches.join(often.groupBy("doc_id").agg(F.collect_list("norm").alias("_often")), "doc_id").select("_at", "_often")


def _judged(pages: DataFrame, share: float, least: int) -> DataFrame:
    """doc_id, page, source, text, kept: the lines (line, norm, i) that footnote blocks, repeats and skipped lines leave of a page; null if no rule can change it.

    Pages are read once and written to the shared folder with the hashes of their lines, of which what repeats is found; this is written as well, so that
    Spark knows how large it is: it broadcasts what is small, and else joins by stretches of a document's pages. Only pages that
    a line rule can change are taken apart.
    """
    spark, path = pages.sparkSession, scratch(pages.sparkSession)
    _prepared(pages).write.parquet(path + "/pages")
    prepared = spark.read.parquet(path + "/pages")
    often_repeated(prepared, share, least).write.parquet(path + "/often")
    met = prepared.withColumn("_at", _stretch()).join(spark.read.parquet(path + "/often"), "_at", "left")
    own = F.zip_with(F.split("text", "\n"), _norms(F.col("text"), X.has_script("text")), lambda line, norm: F.struct(line.alias("line"), norm.alias("norm")))
    lines = F.transform(own, lambda x, i: F.struct(x["line"].alias("line"), x["norm"].alias("norm"), i.alias("i")))
    touched = F.col("_odd") | F.coalesce(F.arrays_overlap("_seen", "_often"), F.lit(False))
    read = met.select(*PAGE, "source", "text", "_often", F.when(touched, lines).alias("lines"))
    # blocks are found among all lines of the page, and what repeats opens and closes them as well
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<line:string,norm:string,i:int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        inside = F.when(_opens(x["line"], x["i"], F.size("lines")), True).when(_closes(x["line"]), False).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.when(inside, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"))

    outside = F.when(starred(F.col("text")), F.aggregate("lines", start, step, lambda acc: acc["kept"])).otherwise(F.col("lines"))
    often = lambda x: _counted(x["norm"]) & F.coalesce(F.array_contains("_often", F.xxhash64(x["norm"])), F.lit(False))
    kept = F.filter(outside, lambda x: ~often(x) & (_blank(x["line"]) | ~_skipped(x["line"], x["norm"], F.col("page"))))
    return read.select(*PAGE, "source", "text", F.when(F.col("lines").isNotNull(), kept).alias("kept"))


def kept_lines(pages: DataFrame, share: float = 0.18, least: int = 3) -> DataFrame:
    """doc_id, page, n, i, line: what strip_footnote_blocks and skip_lines leave of split_lines, by whole pages; a line's own rules are worked out only on pages that they can change."""
    rows = _judged(pages, share, least)
    one = lambda line, i: F.struct(line.alias("line"), i.alias("i"))
    lines = F.when(F.col("kept").isNull(), F.transform(F.split("text", "\n"), one)).otherwise(F.transform("kept", lambda x: one(x["line"], x["i"])))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select(*PAGE, n.alias("n"), F.explode(lines).alias("x")).select(*PAGE, "n", "x.i", "x.line")


def clean_pages(pages: DataFrame, share: float = 0.18, least: int = 3) -> DataFrame:
    """doc_id, page, source, text: pages after all line rules; pages of no line left are gone."""
    read = _judged(pages, share, least)
    joined = F.array_join(F.transform("kept", lambda x: F.concat(F.lit("\n"), X.repair_script(x["line"]))), "")
    whole = F.when(F.col("kept").isNull(), F.concat(F.lit("\n"), "text")).otherwise(joined)
    # as a generator, so that the text is made once and not for the condition as well
    text = read.select(*PAGE, "source", F.explode(F.filter(F.array(whole), lambda x: x != "")).alias("text")).withColumn("text", F.substring("text", 2, 1 << 30))
    return text.withColumn("text", F.when(F.col("source") == "ocr", clean_ocr(F.col("text"))).otherwise(clean_native(F.col("text"))))


def _sentences() -> Column:
    """A recognised page's lines are split each for itself."""
    by_line = F.flatten(F.transform(F.split("text", "\n+"), X.split_sentences))
    return F.when(F.col("source") == "ocr", by_line).otherwise(X.split_sentences("text"))


def page_sentences(cleaned: DataFrame) -> DataFrame:
    """doc_id, page, sentences of a page."""
    return cleaned.select(*PAGE, _sentences().alias("sentences"))


def page_units(cleaned: DataFrame) -> DataFrame:
    """doc_id, page, pos, text: the sentences of each page, counted from 0."""
    # not by a column of its own, which Spark would work out once more to leave out empty ones
    return cleaned.select(*PAGE, F.posexplode(_sentences()).alias("pos", "text"))


#: Pages of a document that are numbered together.
PAGES_A_STRETCH = 64


def _stretch() -> Column:
    """Where a page belongs: its document and the stretch of the document that it is in."""
    return F.struct(F.col("doc_id").alias("doc_id"), F.floor(F.col("page") / PAGES_A_STRETCH).alias("stretch"))


def numbered_pages(sentences: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """doc_id, first, page, sentences: pages with their sentences and the id of the first one; ids count from 0 in each document.

    Prefix sums over stretches of pages: a stretch is one group, however long its document is, and only sums are looked at by document. Texts
    cross one shuffle, which sums and numbers share. What is told of documents beside (one row a doc_id) comes with the sums, as more columns.
    Anything may stand for the sentences, an item for each.
    """
    placed = sentences.withColumn("_at", _stretch()).repartition("_at")
    # all columns are looked at here too, so that this is the same shuffle
    sums = placed.groupBy("_at").agg(F.sum(F.size("sentences")).alias("n"), F.max(F.struct("doc_id", "page")).alias("_last"))
    before_it = Window.partitionBy("_at.doc_id").orderBy("_at.stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.where(F.col("_last").isNotNull()).select("_at", F.coalesce(F.sum("n").over(before_it), F.lit(0)).alias("_before"))
    told = [c for c in beside.columns if c != "doc_id"] if beside is not None else []
    if told:
        before = before.join(beside.withColumnRenamed("doc_id", "_doc"), F.col("_at.doc_id") == F.col("_doc"), "left").drop("_doc")
    inner = Window.partitionBy("_at").orderBy("page", "sentences").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_inner", F.coalesce(F.sum(F.size("sentences")).over(inner), F.lit(0))).join(before, "_at")
    return rows.select("doc_id", (F.col("_before") + F.col("_inner")).cast("long").alias("first"), "page", "sentences", *told)


def numbered(sentences: DataFrame) -> DataFrame:
    """doc_id, id, page, text: ids from 0 in each document, for pages with their sentences."""
    rows = numbered_pages(sentences).select("doc_id", "first", "page", F.posexplode("sentences").alias("pos", "text"))
    return rows.select("doc_id", (F.col("first") + F.col("pos")).cast("long").alias("id"), "page", "text")


def build_sentences(pages: DataFrame) -> DataFrame:
    """doc_id, id, page, text: the sentences of documents after all line rules, numbered from 0 in each document."""
    return numbered(page_sentences(clean_pages(pages)))


def paginate(documents: DataFrame, max_chars: int = 1800) -> DataFrame:
    """doc_id, page, text, source: paragraphs packed greedily into pages, in one pass over each text and without a shuffle.

    A page is closed before a paragraph that would take it over max_chars; separators count once they are in.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n+"), X.trim), lambda x: x != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("pages"))

    def add(acc: Column, x: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(x) > max_chars)
        now = F.when(full | (acc["now"] == ""), x).otherwise(F.concat(acc["now"], F.lit("\n"), x))
        return F.struct(now.alias("now"), F.when(full, F.array_append(acc["pages"], acc["now"])).otherwise(acc["pages"]).alias("pages"))

    pages = F.aggregate(paragraphs, start, add, lambda acc: F.when(acc["now"] == "", acc["pages"]).otherwise(F.array_append(acc["pages"], acc["now"])))
    rows = documents.select("doc_id", F.posexplode(pages).alias("at", "text"))
    return rows.select("doc_id", (F.col("at") + 1).alias("page"), "text", F.lit("native").alias("source"))


#: Letters of scripts from right to left, of scripts without blanks, and signs that take no blank before or after them; fixed values.
RTL = r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF"
CJK = r"\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF"
NO_BLANK_BEFORE, NO_BLANK_AFTER = ",.;:!?،؛؟)]}”’\"»٪%", "([{“‘\"«"
#: A blank that such signs, or letters of scripts without blanks on both sides, do not allow.
BOUND = rf" (?:(?<=[{NO_BLANK_AFTER.replace('[', chr(92) + '[')}] )|(?=[{NO_BLANK_BEFORE.replace(']', chr(92) + ']')}])|(?<=[{CJK}] )(?=[{CJK}]))"
#: What a tolerance is, at least and at most.
LEAST, MOST = 1.5, 4.0


def _line_numbers(y: list[float], sizes: list[int], tolerance: float) -> list[int]:
    """The line of items at each height, heights being ordered from the top, with how many items each has: the first one whose mean height is within the tolerance, or a new one.

    A line that took an item only comes nearer to those at the same height, and no earlier one does, so these are one step.
    """
    out, means, counts, open_ = [], [], [], []
    for at, size in zip(y, sizes, strict=True):
        open_ = [k for k in open_ if means[k] - at <= tolerance]  # what is higher meets no later item
        k = next((k for k in open_ if abs(means[k] - at) <= tolerance), None)
        if k is None:
            k, size = len(means), size - 1
            means.append(at)
            counts.append(1)
            open_.append(k)
        n, mean = counts[k], means[k]
        for n in range(n + 1, n + size + 1):
            mean = (mean * (n - 1) + at) / n
        counts[k], means[k] = n, mean
        out.append(k)
    order = sorted(range(len(means)), key=lambda k: -means[k])
    place = {k: i for i, k in enumerate(order)}
    return [place[k] for k in out]


def _walked(down: pa.Array, tolerance: pa.Array) -> pa.Array:
    """The line of each item of a page, and, line by line, how many items are in those above it and in itself."""
    edges = down.offsets.to_numpy() - down.offsets[0].as_py()
    y = -down.flatten().to_numpy(zero_copy_only=False)
    new = np.append(True, y[1:] != y[:-1])[: len(y)]
    new[edges[:-1][edges[:-1] < len(y)]] = True
    runs = np.flatnonzero(new)
    sizes, at = np.diff(np.append(runs, len(y))), np.searchsorted(runs, edges)
    numbers = [_line_numbers(y[runs[a:b]].tolist(), sizes[a:b].tolist(), t) for a, b, t in zip(at[:-1], at[1:], tolerance.to_pylist(), strict=True)]
    lines = np.repeat(np.array([k for own in numbers for k in own], np.int32), sizes)
    own = [np.bincount(lines[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    upto = np.cumsum([0, *map(len, own)]).astype(np.int32)
    listed = lambda edges, values: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))
    joined = lambda arrays: np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)
    return pa.StructArray.from_arrays([listed(edges, lines), listed(upto, joined(np.cumsum(x) - x for x in own)), listed(upto, joined(own))], ["lines", "first", "size"])


def _held(c: Column) -> Column:
    """A height or width of signs as a tolerance."""
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.when(c * 0.35 > 0, c * 0.35).otherwise(2.5)))


def _number(c: Column) -> Column:
    return F.coalesce(F.abs(c.cast("double")), F.lit(0.0))


def _shown(x: Callable[[str], Column]) -> Column:
    """Whether an item has text and a place."""
    finite = lambda c: F.abs(c.cast("double")) < float("inf")
    return (F.coalesce(x("str"), F.lit("")) != "") & finite(x("x")) & finite(x("y"))


def _gathered(items: DataFrame) -> DataFrame:
    """doc_id, page, walk, high: the items of pages, from the top, and their heights, from rows of one item in any order."""
    rows = items.where(_shown(F.col)).select(*PAGE, "idx", "str", "dir", F.col("x").cast("double").alias("x"), (-F.col("y").cast("double")).alias("down"), _number(F.col("width")).alias("width"), _number(F.col("height")).alias("height"))
    # numbers apart from texts, as they travel in fewer bytes so
    lists = rows.groupBy(*PAGE).agg(F.collect_list(F.when(F.col("height") > 0, F.col("height"))).alias("high"), F.collect_list(F.struct("down", "x", "idx", "width")).alias("places"), F.collect_list(F.struct("str", "dir")).alias("words"))
    both = F.zip_with("places", "words", lambda p, w: F.struct(p["down"].alias("down"), p["x"].alias("x"), p["idx"].alias("idx"), w["str"].alias("str"), w["dir"].alias("dir"), p["width"].alias("width")))
    return lists.select(*PAGE, "high", _made(F.sort_array(both), "walk"))


def _listed(pages: DataFrame) -> DataFrame:
    """What _gathered gives, from pages that hold their items; null is no items."""
    double = lambda name: F.col("items")[name].cast("array<double>")
    shown = pages.select(*PAGE, _made(F.filter("items", lambda x: _shown(lambda c: x[c])), "items"))
    # lists of widths without nulls or signs, and of one height, are as they should be
    plain = F.coalesce(~F.array_contains(double("width"), -1.0) & (F.array_min(double("width")) >= 0), F.lit(False))
    width = F.when(plain, double("width")).otherwise(F.transform(double("width"), _number))
    one, most = F.array_min(double("height")), F.array_max(double("height"))
    high = F.when((one > 0) & (one == most), F.array(one)).otherwise(F.filter(F.transform(double("height"), _number), lambda h: h > 0))
    lists = shown.select(*PAGE, F.transform(double("y"), lambda y: -y).alias("down"), double("x").alias("x"), F.col("items.idx"), F.col("items.str"), F.col("items.dir"), width.alias("width"), high.alias("high"))
    # lists are zipped, and not items made one by one, as that is compiled
    return lists.select(*PAGE, "high", _made(F.sort_array(F.arrays_zip("down", "x", "idx", "str", "dir", "width")), "walk"))


def _made(value: Column, name: str) -> Column:
    """As a generator, so that a list is made once, and not for each use."""
    return F.explode(F.array(value)).alias(name)


def layout_lines(items: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text, rtl: positioned items (idx, str, dir, x, y, width, height) of a page as lines of text, from the top.

    Items come as rows (doc_id, page and these), in any order, or as one list a page (doc_id, page, items): then no item is moved. Either way all
    that follows is worked out within a page's row. Items without text or place are left out. The tolerance of a line's height follows the upper median of
    the page's item heights. Only the walk from the top, which depends on order, is done in Python, a page at a time; direction, order in the line,
    gaps and clean-up are columns. A page without items has no lines, and lines that are blank in the end are left out.
    """
    small_batches(items.sparkSession)
    pages = _listed(items) if "items" in items.columns else _gathered(items)
    median = F.get(F.sort_array("high"), F.floor(F.size("high") / 2).cast("int"))
    lines_of = F.arrow_udf(_walked, "struct<lines:array<int>,first:array<int>,size:array<int>>")
    walked = pages.select(*PAGE, "walk", lines_of(F.col("walk")["down"], _held(F.coalesce(median, F.lit(0.0)))).alias("at"))
    edges = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    lists = walked.select(*PAGE, "at.first", "at.size", F.col("at.lines").alias("line"), "walk.x", "walk.idx", "walk.str", "walk.width", "walk.dir")
    by_line = lists.select(*PAGE, "first", "size", _made(F.sort_array(F.arrays_zip("line", "x", "idx", "str", "width", "dir")), "walk"))
    lines = by_line.select(*PAGE, F.posexplode(F.zip_with("first", "size", lambda a, n: F.slice("walk", a + 1, n))).alias("line_no", "own"))
    # what no item of a line has is found once a line, and not for each item and neighbour
    lines = lines.withColumn("whole", F.array_join("own.str", "")).withColumn("foreign", X.wide("whole"))
    ascii_ = functools.reduce(Column.__or__, (F.col("whole").contains(sign) for sign in X.ASCII_WS))
    lines = lines.withColumn("spaced", F.when(F.col("foreign"), F.col("whole").rlike(f"[{X.WS[1:-1]}\u0085]")).otherwise(ascii_))
    lines = lines.withColumn("letters", F.when(F.col("foreign"), X.count_of("whole", f"[{RTL}]")).otherwise(0))
    right = F.size(F.filter("own", lambda x: (x["dir"] == "rtl") | (X.wide(x["str"]) & x["str"].rlike(f"[{RTL}]"))))
    share = F.col("letters") / F.greatest(F.lit(1), F.length(F.regexp_replace("whole", X.WS, "")))
    rtl = F.when(F.col("letters") > 0, (right >= F.size("own") / 2) | (share > 0.25)).otherwise(False)
    lines = lines.select(*PAGE, "line_no", "own", "foreign", "spaced", rtl.alias("rtl"))
    turned = lambda items: F.transform(items, lambda x: x.withField("x", -x["x"]))
    ordered = F.when(F.col("rtl"), turned(F.sort_array(turned(F.col("own"))))).otherwise(F.col("own"))
    blanks = "".join(map(chr, X.BLANK_SIGNS.tolist()))
    signs = lambda x: F.greatest(F.lit(1), F.length(F.when(F.col("spaced"), X.trim(x)).otherwise(x)))
    unit = lambda x: F.when(x["width"] > 0, x["width"] / signs(x["str"]))

    def wide_gap(a: Column, b: Column) -> Column:
        """Whether a gap is one of a blank; only gaps within what a tolerance can be are held against it."""
        gap = F.when(F.col("rtl"), a["x"] - (b["x"] + b["width"])).otherwise(b["x"] - (a["x"] + a["width"]))
        mean = F.coalesce((unit(a) + unit(b)) / 2, unit(a), unit(b), F.lit(0.0))
        return F.when(gap > MOST, True).when(gap <= LEAST, False).otherwise(gap > _held(mean))

    def blank(a: Column, b: Column) -> Column:
        """Whether a blank goes between an item and the next one."""
        last, next_ = F.substring(a["str"], -1, 1), F.substring(b["str"], 1, 1)
        held = F.lit(NO_BLANK_AFTER).contains(last) | F.lit(NO_BLANK_BEFORE).contains(next_) | (F.col("spaced") & (F.lit(blanks).contains(last) | F.lit(blanks).contains(next_)))
        return ~(held | (F.col("foreign") & last.rlike(f"[{CJK}]") & next_.rlike(f"[{CJK}]"))) & wide_gap(a, b)

    def joined(items: Column) -> Column:
        before = F.concat(F.slice(items, 1, 1), F.slice(items, F.lit(1), F.size(items) - 1))  # the first one before itself, which takes no blank
        return F.array_join(F.zip_with(items, before, lambda x, y: F.when(blank(y, x), F.concat(F.lit(" "), x["str"])).otherwise(x["str"])), "")

    # most lines are of words from left to right that all stand apart: these are joined at once, and blanks next to bound signs taken out again
    gaps = F.zip_with(F.slice("own.x", F.lit(2), F.size("own")), F.zip_with("own.x", "own.width", lambda x, width: x + width), lambda start, end: start - end)
    apart = ~F.col("rtl") & ~F.col("spaced") & F.coalesce(F.array_min(gaps) > MOST, F.lit(True))
    lines = lines.withColumn("spread", F.when(apart, F.array_join("own.str", " ")))
    unbound = F.when(F.col("spread").rlike(BOUND), F.regexp_replace("spread", BOUND, "")).otherwise(F.col("spread"))
    lines = lines.select(*PAGE, "line_no", "rtl", F.when(F.col("spread").isNotNull(), unbound).otherwise(X.once(ordered, joined)).alias("text"))
    # as a generator, so that a line is made once and not for the condition as well
    return lines.select(*PAGE, "line_no", F.explode(F.filter(F.array(X.clean_rtl_line("text", F.col("rtl"))), lambda x: x != "")).alias("text"), "rtl")
