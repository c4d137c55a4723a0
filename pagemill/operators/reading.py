"""Chunks of pages, places in a text, and the state of a reader's library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.ranges import PARTS, earlier, later, ranged, row_numbers, within


def within_page(sentences: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "page").orderBy("id")
    return sentences.withColumn("within", F.row_number().over(order) - 1)


def page_chunks(pages: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, chunk_ix, start_page, end_page: each n page rows, by place and not by number; only page numbers are moved."""
    rows = row_numbers(pages.select("doc_id", "page"), ["doc_id"], F.col("page"), ["page"], "_row").select("doc_id", "page", F.floor((F.col("_row") - 1) / n).cast("int").alias("chunk_ix"))
    return rows.groupBy("doc_id", "chunk_ix").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))


def chunk_sentences(chunks: DataFrame, sentences: DataFrame) -> DataFrame:
    """chunks with their sentences, an array of (id, page, text) in order; empty where a chunk has none."""
    placed = chunk_of_page(sentences.select("doc_id", "page").distinct(), chunks)
    own = sentences.join(placed, ["doc_id", "page"]).groupBy("doc_id", "chunk_ix").agg(F.sort_array(F.collect_list(F.struct("id", "page", "text"))).alias("sentences"))
    none = F.array().cast("array<struct<id:bigint,page:int,text:string>>")
    return chunks.join(own, ["doc_id", "chunk_ix"], "left").withColumn("sentences", F.coalesce(F.col("sentences").cast("array<struct<id:bigint,page:int,text:string>>"), none))


#: Page numbers that are looked through together.
PAGES_A_STRETCH = 4096


def chunk_of_page(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, page, chunk_ix of the chunk around each page, -1 if there is none.

    A sweep, not a join: pages and ends of chunks are one table in order, and the next end at or behind a page is the only chunk
    that can be around it. Stretches of page numbers are swept apart, and the first end of each is carried to those before. Of chunks
    that overlap, the one that ends first counts; what page_chunks makes never does. Null documents are one document, a null page has no chunk.
    """
    stretch = lambda c: F.floor(F.col(c) / PAGES_A_STRETCH)
    ends = chunks.select("doc_id", F.col("end_page").alias("_place"), F.struct("start_page", "chunk_ix").alias("_chunk"), F.lit(1).alias("_kind"), stretch("end_page").alias("_range"), F.lit(None).cast(refs.schema["page"].dataType).alias("page")).where("_place is not null")
    asked = refs.select("doc_id", F.col("page").alias("_place"), F.lit(None).cast(ends.schema["_chunk"].dataType).alias("_chunk"), F.lit(0).alias("_kind"), stretch("page").alias("_range"), "page")
    both = asked.unionByName(ends).withColumn("_key", F.struct("doc_id")).withColumn("_at", F.struct("_key", "_range"))
    ahead = Window.partitionBy("_at").orderBy("_place", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = both.groupBy("_at", "_key", "_range").agg(F.min(F.when(F.col("_kind") == 1, F.struct("_place", "_chunk"))).alias("_first"))
    firsts = firsts.select("_at", F.first("_first", ignorenulls=True).over(later())["_chunk"].alias("_carried"))
    found = both.withColumn("_next", F.first("_chunk", ignorenulls=True).over(ahead)).where("_kind = 0").join(firsts, "_at").withColumn("_next", F.coalesce("_next", "_carried"))
    return found.select("doc_id", "page", F.when(F.col("_next.start_page") <= F.col("page"), F.col("_next.chunk_ix")).otherwise(-1).alias("chunk_ix"))


def chunk_text(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    placed = chunk_of_page(sentences.select("doc_id", "page").distinct(), chunks)
    return sentences.join(placed, ["doc_id", "page"]).groupBy("doc_id", "chunk_ix").agg(_texts().alias("text"))


def _texts() -> Column:
    """The sentences of a group in order, as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ")


#: Page numbers whose contexts are put together in one group.
CONTEXTS_A_STRETCH = 64


def context_text(sentences: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, page, context: the sentences of the pages around each page. Stretches of page numbers stand apart, and pages near a border go to both sides, so a document of very many pages is no task's alone."""
    stretch = lambda c: F.floor(c / CONTEXTS_A_STRETCH)
    pages = sentences.groupBy("doc_id", "page").agg(_texts().alias("text"))
    reached = F.sequence(stretch(F.col("page") - radius), stretch(F.col("page") + radius))
    placed = pages.select("doc_id", "page", "text", F.explode_outer(reached).alias("_stretch"))
    near = Window.partitionBy("doc_id", "_stretch").orderBy("page").rangeBetween(-radius, radius)
    around = placed.withColumn("context", F.array_join(F.collect_list("text").over(near), " "))
    return around.where(F.col("_stretch").eqNullSafe(stretch(F.col("page")))).select("doc_id", "page", "context")


def first_of_page(refs: DataFrame, sentences: DataFrame) -> DataFrame:
    first = sentences.groupBy("doc_id", "page").agg(F.min("id").alias("id"))
    return refs.join(first, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("id", F.lit(-1)).alias("id"))


def reanchor(anchors: DataFrame, sentences: DataFrame) -> DataFrame:
    """Anchors (k-th sentence of a page) with the id that they have in another table of sentences; the last one, if it has fewer."""
    ids = sentences.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    clamped = anchors.join(ids, ["doc_id", "page"]).withColumn("_at", F.least(F.col("k"), F.size("_ids") - 1).cast("int")).where("_at >= 0")
    return clamped.select("doc_id", "page", "k", F.get("_ids", F.col("_at")).alias("id"))


def speech_chunks(sentences: DataFrame, mode: str = "local", cap: int = 420, page_cap: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """doc_id, page, chunk_ix, text, spans: what is spoken at once, with a span (start, end, source_start, sentence_id) for each sentence.

    In mode local two sentences of a page go together if they and the blank between them have at most `cap` characters; in other
    modes each stands alone. Blank sentences and pages beyond page_cap are left out. starts (doc_id, start_id, offset) tells
    where reading begins: sentences before it are left out, and the first one is read from the offset on, held to its text.

    Sentences that fit their neighbours make runs, and a run is taken in pairs, so windows by page suffice.
    """
    rows = sentences.select("doc_id", "page", "id", "text", F.lit(0).alias("source_start"))
    if starts is not None:
        rows = rows.drop("source_start").join(starts.select("doc_id", "start_id", "offset"), "doc_id", "left").where(F.col("start_id").isNull() | (F.col("id") >= F.col("start_id")))
        rows = rows.withColumn("source_start", F.when(F.col("id") == F.col("start_id"), F.greatest(F.lit(0), F.least(F.length("text"), F.coalesce("offset", F.lit(0))))).otherwise(0).cast("int"))
        rows = rows.withColumn("text", F.substring("text", F.col("source_start") + 1, F.length("text")))
    if page_cap is not None:
        rows = rows.where(F.col("page") <= page_cap)
    rows = rows.where(X.trim("text") != "").withColumn("n", F.length("text"))
    order = Window.partitionBy("doc_id", "page").orderBy("id")
    fits = F.coalesce(F.lag("n").over(order) + 1 + F.col("n") <= cap, F.lit(False)) if mode == "local" else F.lit(False)
    # every window has the same order: where the run began, and whether an odd number of sentences lies between
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("fits", fits).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("second", (F.col("place") - F.last(F.when(~F.col("fits"), F.col("place")), ignorenulls=True).over(upto)) % 2 == 1)
    rows = rows.withColumn("chunk_ix", F.sum((~F.col("second")).cast("int")).over(order) - 1).withColumn("start", F.when(F.col("second"), F.lag("n").over(order) + 1).otherwise(0))
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("end"), F.col("source_start").cast("long").alias("source_start"), F.col("id").alias("sentence_id"), "text")
    chunks = rows.groupBy("doc_id", "page", "chunk_ix").agg(F.sort_array(F.collect_list(span)).alias("all"))  # of two at most
    spans = F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["source_start"].alias("source_start"), x["sentence_id"].alias("sentence_id")))
    return chunks.select("doc_id", "page", F.col("chunk_ix").cast("int").alias("chunk_ix"), F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("text"), spans.alias("spans"))


def _begun(x: Column) -> Column:
    """A sentence (id, text) as it is read: what lies before the place where reading begins is left out."""
    skipped = F.when(x["id"] == F.col("start_id"), F.greatest(F.lit(0), F.least(F.length(x["text"]), F.coalesce("offset", F.lit(0))))).otherwise(0).cast("int")
    return X.once(skipped, lambda k: F.struct(x["id"].alias("id"), k.alias("source_start"), F.substring(x["text"], k + 1, F.length(x["text"])).alias("text")))


def _paired(spoken: Column, mode: str, cap: int) -> Column:
    """What is spoken at once, of a page's sentences (id, source_start, n and whatever else): pairs (a, b) in order, b null where a stands alone."""
    alone = lambda x: F.struct(x.alias("a"), F.when(F.lit(False), x).alias("b"))
    if mode != "local":
        return F.transform(spoken, alone)

    def taken(s: Column) -> Column:
        # a run begins where a sentence does not fit the one before, and its sentences go by twos
        begins = F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), (F.coalesce(F.get(s, i - 1)["n"] + 1 + x["n"] <= cap, F.lit(False))).alias("fits"))), lambda x: ~x["fits"])

        def run(all_: Column, x: Column, k: Column) -> Column:
            end = F.coalesce(F.get(all_, k + 1)["i"], F.size(s))
            two = lambda at, upto: F.struct(F.get(s, at).alias("a"), F.when(at + 1 < upto, F.get(s, at + 1)).alias("b"))
            return X.once(end, lambda upto: F.transform(F.sequence(x["i"], upto - 1, F.lit(2)), lambda at: two(at, upto)))

        return X.once(begins, lambda all_: F.flatten(F.transform(all_, lambda x, k: run(all_, x, k))))

    return X.once(spoken, taken)


def _spans_of(x: Column) -> Column:
    span = lambda s, start: F.struct(start.cast("long").alias("start"), (start + s["n"]).cast("long").alias("end"), s["source_start"].cast("long").alias("source_start"), s["id"].cast("long").alias("sentence_id"))
    first = span(x["a"], F.lit(0))
    return F.when(x["b"].isNull(), F.array(first)).otherwise(F.array(first, span(x["b"], x["a"]["n"] + 1)))


def page_speech(pages: DataFrame, mode: str = "local", cap: int = 420, page_cap: int | None = None) -> DataFrame:
    """doc_id, page, chunk_ix, text, spans: speech_chunks of pages, one row each, with the first sentence's id and their sentences, as numbered_pages makes them.

    A page's chunks are made within its row, so texts are neither sorted nor moved. start_id and offset, where pages have them, tell where reading begins.
    """
    rows = pages if page_cap is None else pages.where(F.col("page") <= page_cap)
    own = F.transform("sentences", lambda x, i: F.struct((F.col("first") + i).alias("id"), x.alias("text")))
    if "start_id" in rows.columns:
        own = F.transform(F.filter(own, lambda x: F.col("start_id").isNull() | (x["id"] >= F.col("start_id"))), _begun)
    else:
        own = F.transform(own, lambda x: x.withField("source_start", F.lit(0)))
    spoken = F.transform(F.filter(own, lambda x: _heard(x["text"])), lambda x: F.struct(x["id"].alias("id"), x["source_start"].alias("source_start"), F.length(x["text"]).alias("n"), x["text"].alias("text")))
    text = lambda x: F.when(x["b"].isNull(), x["a"]["text"]).otherwise(F.concat(x["a"]["text"], F.lit(" "), x["b"]["text"]))
    chunks = F.transform(_paired(spoken, mode, cap), lambda x: F.struct(text(x).alias("text"), _spans_of(x).alias("spans")))
    return rows.select("doc_id", "page", F.posexplode(chunks).alias("chunk_ix", "_chunk")).select("doc_id", "page", "chunk_ix", "_chunk.text", "_chunk.spans")


def _heard(text: Column) -> Column:
    return text.rlike(f"[^{X.WS[1:-1]}]")


def spoken_lengths(text: Column) -> Column:
    """What speech_places needs of a page's sentences: their lengths, null for blank ones."""
    return F.transform(text, lambda x: F.when(_heard(x), F.length(x)))


def speech_places(pages: DataFrame, cap: int = 420) -> DataFrame:
    """doc_id, page, chunk_ix, length, spans of the chunks of speech_chunks in mode local, for pages with the spoken_lengths of their sentences in place of these."""
    own = F.transform("sentences", lambda n, i: F.struct((F.col("first") + i).alias("id"), F.lit(0).alias("source_start"), n.alias("n")))
    length = lambda x: x["a"]["n"] + F.coalesce(x["b"]["n"] + 1, F.lit(0))
    chunks = F.transform(_paired(F.filter(own, lambda x: x["n"].isNotNull()), "local", cap), lambda x: F.struct(length(x).cast("long").alias("length"), _spans_of(x).alias("spans")))
    return pages.select("doc_id", "page", F.posexplode(chunks).alias("chunk_ix", "_chunk")).select("doc_id", "page", "chunk_ix", "_chunk.length", "_chunk.spans")


def bookmarks_latest(events: DataFrame) -> DataFrame:
    """The last write for each document and tag (trimmed, in any case); removals take it away."""
    order = Window.partitionBy("doc_id", F.lower(F.trim("tag"))).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("at", F.row_number().over(order)).where("at = 1 and not removed").select("doc_id", F.trim("tag").alias("tag"), "page", "ts")


def bookmark_list(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks of each document, the newest first; ties go to the tag."""
    return bookmarks.orderBy("doc_id", F.desc("ts"), "tag")


def library_list(library: DataFrame) -> DataFrame:
    """Documents, the one opened or read last first; ties go to the doc_id."""
    return library.orderBy(F.desc("updated_at"), "doc_id")


def _given(number: Column) -> Column:
    """null for 0, which counts as not given."""
    return F.nullif(number, F.lit(0))


def position(page: Column, sentence: Column, total: Column, page_count: Column) -> list[Column]:
    """last_page (from 1), last_sentence (from 0) and progress from 0 to 1: the page as it was given, over the total that was given, else the document's pages, else 1."""
    pages = F.greatest(F.lit(1), F.coalesce(_given(total), _given(page_count), F.lit(1)))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(page, F.lit(0)) / pages))
    return [F.greatest(F.lit(1), F.coalesce(page, F.lit(1))).alias("last_page"), F.greatest(F.lit(0), F.coalesce(sentence, F.lit(0))).alias("last_sentence"), progress.alias("progress")]


def library_latest(events: DataFrame, parts: int = PARTS) -> DataFrame:
    """doc_id, title, page_count, added_at, updated_at, last_page, last_sentence, progress of documents that were not removed.

    events: doc_id, event_id, ts, kind (open, progress, remove), and title and page_count of an opening, page, sentence and total of progress. A document lives from
    its first opening to its removal; one that is opened again starts afresh, at page 1 and with a new added_at. Title and pages are of
    the newest opening. Progress counts from the first opening on; its total falls back to the pages that the document had by
    then. Events of a document are in order of (ts, event_id), those without ts first.

    A fold over ranges of time: each range of a document is folded apart to what it has of each life, and these few rows are put together by document.
    """
    when, kind = F.struct("ts", "event_id"), F.col("kind")
    rows = ranged(events.select("doc_id", "event_id", "ts", "kind", "title", "page_count", "page", "sentence", "total"), ["doc_id"], F.unix_micros(F.col("ts").cast("timestamp")), parts)
    rows = rows.withColumn("_when", when).withColumn("_life", F.sum((kind == "remove").cast("long")).over(within("ts", "event_id")))
    order = Window.partitionBy("_at", "_life").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_pages", F.last(F.when(kind == "open", F.struct("page_count")), ignorenulls=True).over(order))
    read = F.struct("page", "sentence", "total", "_pages")
    lives = rows.groupBy("_at", "_key", "_range", "_life").agg(
        F.min(F.when(kind == "open", F.col("_when"))).alias("first"), F.max(F.when(kind == "open", F.col("_when"))).alias("last"), F.max_by(F.struct("title", "page_count"), F.when(kind == "open", F.col("_when"))).alias("header"),
        F.max(F.when(kind == "progress", F.col("_when"))).alias("read_at"), F.max_by(read, F.when(kind == "progress", F.col("_when"))).alias("read"), F.count_if(kind == "remove").alias("removed"),
    )
    # a life is numbered by the removals before it; only the one behind the last removal is looked at further
    removed = lives.groupBy("_at", "_key", "_range").agg(F.sum("removed").alias("n"))
    removed = removed.select("_at", F.coalesce(F.sum("n").over(earlier()), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("_key")).alias("all"))
    lives = lives.join(removed, "_at").where(F.col("before") + F.col("_life") == F.col("all"))
    lives = lives.withColumn("known", F.last(F.when(F.col("last").isNotNull(), F.struct("header.page_count")), ignorenulls=True).over(earlier()))
    now = lives.groupBy("_key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("header", "last").alias("header"), F.max("read_at").alias("read_at"), F.max_by(F.struct("read", "known"), "read_at").alias("x"))
    now = now.where("first is not null").withColumn("x", F.when(F.col("read_at") > F.col("first"), F.col("x")))
    pages = F.coalesce("x.read._pages", "x.known")["page_count"]
    at = position(F.col("x.read.page"), F.col("x.read.sentence"), F.col("x.read.total"), pages)
    newest = F.greatest("last", F.when(F.col("x").isNotNull(), F.col("read_at")))["ts"]
    return now.select("_key.doc_id", "header.title", "header.page_count", F.col("first.ts").alias("added_at"), newest.alias("updated_at"), *at)


def reading_progress(events: DataFrame, headers: DataFrame) -> DataFrame:
    """events (doc_id, page, sentence, total) with last_page, last_sentence and progress; headers (doc_id, page_count, a row a document) give totals that are missing or 0.

    A document without a header has one page.
    """
    known = headers.select(F.col("doc_id").alias("_doc"), F.col("page_count").alias("_count"))
    rows = events.join(known, F.col("doc_id") == F.col("_doc"), "left")
    return rows.select(*events.columns, *position(F.col("page"), F.col("sentence"), F.col("total"), F.col("_count")))


def requested_pages(requests: DataFrame, n: int = 12) -> DataFrame:
    """Of each request the first n distinct positive pages in the order of first mention."""
    first = requests.where("page > 0").groupBy("req_id", "page").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("req_id").orderBy("pos")
    return first.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).select("req_id", "page", "turn")


def missing_products(expected: DataFrame, offered: DataFrame) -> DataFrame:
    """Expected product ids that are not offered, as they are or with anything behind a colon. Null ids are not offered.

    An offer is taken apart into all that ends at one of its colons, so this is a plain anti join.
    """
    parts = F.split("offered", ":")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ":"))
    base = offered.where("offered is not null").select(F.explode(upto).alias("expected")).distinct()
    return expected.join(base, "expected", "left_anti")


def locate_span(offsets: DataFrame, chunks: DataFrame) -> DataFrame:
    """offsets (chunk, at) with sentence_id and char_offset: the first span of the chunk that ends at or after the place, else the last.

    chunks: chunk, length, spans (array of start, end, source_start, sentence_id in order). Places are held to the text; a
    chunk without spans gives nulls.
    """
    at = F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), F.col("length") - 1), F.col("at")))
    span = F.coalesce(F.get(F.filter("spans", lambda s: F.col("_at") <= s["end"]), F.lit(0)), F.try_element_at("spans", F.lit(-1)))
    rows = offsets.join(chunks, "chunk").withColumn("_at", at).withColumn("_span", span)
    return rows.select(*offsets.columns, F.col("_span.sentence_id").alias("sentence_id"), F.greatest(F.lit(0), F.col("_span.source_start") + F.col("_at") - F.col("_span.start")).alias("char_offset"))


def locate_line(offsets: DataFrame, sentences: DataFrame) -> DataFrame:
    """offsets (sentence_id, at) with line_ix: the first of the sentence's lines (array of start, end) that holds the place, else the last, 0 if none."""
    at = F.greatest(F.lit(0), F.col("at"))
    hit = F.array_position(F.transform("lines", lambda r: (F.col("_at") >= r["start"]) & (F.col("_at") <= r["end"])), True) - 1
    rows = offsets.join(sentences, "sentence_id", "left").withColumn("_at", at)
    line = F.when(F.coalesce(F.size("lines"), F.lit(0)) <= 0, 0).when(hit >= 0, hit).otherwise(F.size("lines") - 1)
    return rows.select(*offsets.columns, line.cast("int").alias("line_ix"))
