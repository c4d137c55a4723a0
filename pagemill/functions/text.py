"""Column expressions on lines and texts. White space and word boundaries are spelled out, as Java's own classes differ from those of the web."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web clients have it.
WS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
LATIN = r"A-Za-z\u00C0-\u024F"
#: Cyrillic, Arabic, Devanagari, Thai, Japanese and Chinese, Korean; fixed values.
SCRIPTS = r"\u0400-\u04FF\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF\u0900-\u097F\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF\u1100-\u11FF"
STARS = r"[∗*＊﹡]"
ARTIFACTS = r"[AÂÃÄÅÆØÙÚÛÜÝÞÐÑ\uFFFD\u0466\u0467]{1,4}"
#: Marks, and what may stand behind a word, in repairs; fixed values.
FOOTNOTE_MARKS, SCRIPT_ENDS = "[∗*＊﹡¥￥]", r"[،؛؟,.!?\-]"
#: Word endings that scanned text splits off, and words that it splits; fixed values.
ENDINGS = "er|ers|est|ing|ed|ly|ment|ness|tion|tions|sion|ter|der|per|able|ible|ally|ive|ous"
LONG_WORD_ENDINGS = "al|ic|ical|ity|ies"
SPLIT_WORDS = ["apache", "helicopter", "sniper", "overwatch", "south-central"]
#: Sites that stamp pages, and ends of addresses; fixed values.
SITES = "ketabfarsi|takbook|veyq|ebook|persianblog|golshan"
DOMAINS = "com|ir|org|net"
STAMPS = rf"https?://|(?<![A-Za-z0-9_])www\.|\.({DOMAINS})(?![A-Za-z0-9_])|{SITES}"
#: What any of these stamps has in it.
STAMPED = ["://", "www.", *(f".{x}" for x in DOMAINS.split("|")), *SITES.split("|")]
PERSIAN_ARABIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space of ASCII.
ASCII_WS = "\t\n\x0b\f\r "


def wide(c: Column | str) -> Column:
    """Whether a text has letters beyond ASCII; most of the rules below are much shorter for others."""
    return F.octet_length(col(c)) > F.length(col(c))


def once(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """use(value) with a value that is worked out once, however often it is used. Spark shares what stands twice in a row, but not within branches."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))


def trim(c: Column | str) -> Column:
    """Without white space at both ends. Letters beyond ASCII matter at the ends only, so others take Spark's own trim."""

    def ends(x: Column) -> Column:
        # Spark's trim looks at the whole text, so it is kept for those that have something to trim
        some = F.lit(ASCII_WS).contains(F.substring(x, 1, 1)) | F.lit(ASCII_WS).contains(F.substring(x, -1, 1))
        plain = F.when(some, F.btrim(x, F.lit(ASCII_WS))).otherwise(x)
        blank = F.concat(F.left(plain, F.lit(1)), F.right(plain, F.lit(1))).rlike(f"[{WS[1:-1]}\u0085]")  # $ stands before a last \u0085 as well
        return F.when(wide(x) & blank, F.regexp_replace(plain, f"^{WS}+|(?<!{WS}){WS}+$", "")).otherwise(plain)

    return once(c, ends)


def stamped(norm: Column) -> Column:
    """Whether a normalized line has an address or the stamp of a site; plain searches come first, as few have."""
    some = F.lit(False)
    for part in STAMPED:
        some = some | norm.contains(part)
    return some & norm.rlike(STAMPS)


def letters_of(c: Column | str, letters: str) -> Column:
    """How many letters of a class a text has, a run of them at a time."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), f"[{letters}]+", ""))


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def word_count(c: Column | str) -> Column:
    """How many runs without white space a text has, by its single blanks; only texts with other white space are rewritten for it."""

    def blanks(x: Column) -> Column:
        rare = x.contains("  ")
        for sign in ASCII_WS.replace(" ", ""):
            rare = rare | x.contains(sign)
        return F.trim(F.when(rare | (wide(x) & x.rlike(f"[{WS[1:-1].replace(' ', '')}]")), F.regexp_replace(x, f"{WS}+", " ")).otherwise(x))

    return once(once(c, blanks), lambda x: F.when(x == "", 0).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1))


def normalize_line(line: Column | str) -> Column:
    """Digits to ASCII, white space to single blanks, tatweel away, trimmed, lower case."""
    digits = F.translate(col(line), PERSIAN_ARABIC_DIGITS, "01234567890123456789")
    all_ = F.replace(F.regexp_replace(digits, f"{WS}+", " "), F.lit("ـ"), F.lit(""))
    plain = F.when(col(line).rlike(r"[\t-\r]|  "), F.regexp_replace(col(line), r"[\t-\r ]+", " ")).otherwise(col(line))
    return F.lower(F.trim(F.when(wide(line), all_).otherwise(plain)))


def mostly_latin(line: Column | str, letters: str = LATIN, least: int = 6, times: int = 2) -> Column:
    def judged(x: Column) -> Column:
        ascii_ = letters.replace(r"\u00C0-\u024F", "")
        some = F.when(wide(x), x.rlike(f"(?:[{letters}][^{letters}]*+){{{least}}}")).otherwise(x.rlike(f"(?:[{ascii_}][^{ascii_}]*+){{{least}}}"))
        return some & (~has_script(x) | (letters_of(x, letters) > times * letters_of(x, SCRIPTS)))  # only next to other scripts are letters counted

    return once(line, judged)


def mostly_latin_ocr(line: Column | str) -> Column:
    return mostly_latin(line, "A-Za-z", 8, 3)


def _bounded(pattern: str) -> str:
    return rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def _split_somewhere(word: str) -> str:
    """A pattern for a word with white space behind its second or a later letter, as far as two letters behind that."""
    rest = ""
    for i in range(len(word) - 2, 1, -1):
        rest = rf"(?:{WS}+{word[i : i + 2]}" + (f"|{word[i]}{rest}" if rest else "") + ")"
    return word[:2] + rest


def joined_words(line: Column) -> Column:
    """Words that scanning split are joined again; real words with such endings are joined as well."""
    out = F.regexp_replace(line, _bounded(rf"([A-Za-z]{{3,}}+){WS}++({ENDINGS})"), "$1$2")
    out = F.regexp_replace(out, _bounded(rf"([A-Za-z]{{5,}}+){WS}++({LONG_WORD_ENDINGS})"), "$1$2")
    halves = [(word[:i], word[i:]) for word in SPLIT_WORDS for i in range(2, len(word) - 1)]
    whole = out
    for a, b in halves:
        whole = F.regexp_replace(whole, _bounded(rf"(?i:({a}){WS}+({b}))"), "$1$2")
    # few lines have one; it is looked for in the line as it was, where a second half may still lack its own ending
    return F.when(line.rlike(SPLIT_SOMEWHERE), whole).otherwise(out)


#: What a line has that joined_words changes; a split word begins where a word does, as joining begins no words.
SPLIT_SOMEWHERE = "(?<![A-Za-z0-9_])(?i:" + "|".join(map(_split_somewhere, SPLIT_WORDS)) + ")"
SPLIT_ENDING = rf"{WS}(?:{ENDINGS}|{LONG_WORD_ENDINGS})(?![A-Za-z0-9_])"


def repair_latin_breaks(text: Column | str, latin=mostly_latin) -> Column:
    """joined_words on each mostly Latin line. Texts and lines that have nothing to join are left alone, as most have."""
    split = lambda x: x.rlike(SPLIT_ENDING) | x.rlike(SPLIT_SOMEWHERE)
    lines = lambda t: F.transform(F.split(t, "\n"), lambda x: F.when(split(x) & latin(x), joined_words(x)).otherwise(x))
    return once(text, lambda t: F.when(split(t), F.array_join(lines(t), "\n")).otherwise(t))


def nfkc(text: Column | str) -> Column:
    """Unicode's compatibility form with composition, by the library for it that Spark brings along; ASCII is left as it is, null stays null."""
    made = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return once(text, lambda x: F.when(wide(x), made(x)).otherwise(x))


def has_script(line: Column | str) -> Column:
    # two wide ranges around them are looked for first, which is much faster and leaves few
    return F.coalesce(wide(line) & col(line).rlike(r"[\u0400-\u1FFF\u3000-\uFEFF]") & col(line).rlike(f"[{SCRIPTS}]"), F.lit(False))


def repair_script(line: Column | str) -> Column:
    """On lines with a letter of SCRIPTS: NFKC, leftovers of broken fonts away, doubled runs once."""
    ends = SCRIPT_ENDS

    def repaired(x: Column) -> Column:
        out = F.regexp_replace(nfkc(x), r"\(cid:\d+\)", "")
        out = F.regexp_replace(out, f"{FOOTNOTE_MARKS}{{1,4}}", " ")
        out = F.regexp_replace(out, rf"([{SCRIPTS}]){ARTIFACTS}(?=[{SCRIPTS}])", "$1")
        out = F.regexp_replace(out, rf"([{SCRIPTS}]){ARTIFACTS}(?={WS}|$|{ends})", "$1")
        out = F.regexp_replace(out, rf"(^|{WS}|{ends}){ARTIFACTS}(?=[{SCRIPTS}])", "$1")
        return F.regexp_replace(out, rf"([{SCRIPTS}]{{3,}})\1", "$1")

    return once(line, lambda x: F.when(has_script(x), repaired(x)).otherwise(x))


def split_sentences(text: Column | str) -> Column:
    """After . ! or ? and one closing quote or bracket, if white space follows; trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(trim(text), rf"([.!?][\"”’)]?){WS}++", "$1\u0001"), "\u0001")
    # what is cut has no white space at its ends, but where the text has the mark itself
    return F.filter(F.when(col(text).contains("\u0001"), F.transform(parts, trim)).otherwise(parts), lambda x: x != "")


#: Bytes of text that words are looked for in at once, whole texts at least.
WORDS_AT_ONCE = 4 << 20
BLANK_SIGNS = np.array(sorted({*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF}), np.uint32)


def _words_of(texts: list[str | None]) -> pa.ListArray:
    """(word, offset) of each text's runs without white space, all texts at once: one look at each sign, however long a text is."""
    signs = np.frombuffer("\n".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    first = np.cumsum(lengths + 1) - lengths  # a break stands before each text and behind the last one
    blank = (signs >= 0x80) & np.isin(signs, BLANK_SIGNS[BLANK_SIGNS >= 0x80]) if signs.max() >= 0x80 else np.zeros(len(signs), bool)
    blank |= (signs == 0x20) | ((signs >= 0x09) & (signs <= 0x0D))
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    size = 1 + (signs >= 0x80).astype(np.int8) + (signs >= 0x800) + (signs >= 0x10000)  # bytes of a sign
    size[blank] = 0
    ends_at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends]
    kept = signs[~blank].tobytes().decode("utf-32-le").encode()
    words = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.append(0, ends_at).astype(np.int32)), pa.py_buffer(kept)])
    of = np.searchsorted(first, starts, "right") - 1
    bounds = np.searchsorted(starts, np.append(first, len(signs))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([words, pa.array((starts - first[of]).astype(np.int32))], ["word", "offset"])
    nulls = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs, mask=nulls)


def _words_by_bytes(texts: pa.Array) -> pa.Array:
    """_words_of all texts, in slices by bytes, so that long texts take no more memory than they need."""
    upto = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    out, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + WORDS_AT_ONCE, "right")) - 1)
        out.append(_words_of(texts.slice(at, end - at).to_pylist()))
        at = end
    return pa.concat_arrays(out) if out else _words_of([])


def words_with_offsets(text: Column | str) -> Column:
    """(word, offset) of the runs without white space."""

    @F.arrow_udf("array<struct<word:string,offset:int>>")
    def found(texts: pa.Array) -> pa.Array:
        return _words_by_bytes(texts)

    return found(col(text))


def words_of_lines(lines: Column | str) -> Column:
    """(line, place, word, offset): words_with_offsets of the lines of a list, as one list; lines, and words of a line, are counted from 0."""

    @F.arrow_udf("array<struct<line:int,place:int,word:string,offset:int>>")
    def found(lines: pa.Array) -> pa.Array:
        words = _words_by_bytes(lines.flatten())
        first, edges = words.offsets.to_numpy(), lines.offsets.to_numpy() - lines.offsets[0].as_py()
        sizes = np.diff(first)
        line = np.arange(len(sizes)) - np.repeat(edges[:-1], np.diff(edges))
        pairs, place = words.flatten(), np.arange(first[-1]) - np.repeat(first[:-1], sizes)
        rows = pa.StructArray.from_arrays([pa.array(np.repeat(line, sizes).astype(np.int32)), pa.array(place.astype(np.int32)), *pairs.flatten()], ["line", "place", "word", "offset"])
        return pa.ListArray.from_arrays(pa.array(first[edges], pa.int32()), rows, mask=lines.is_null())

    return found(col(lines))


def tidy_ocr(text: Column | str, lang: str) -> Column:
    """Recognised text: tatweel away, letters of Persian unified, stray line numbers away, split words joined, large gaps closed."""
    out = F.regexp_replace(F.regexp_replace(col(text), "ـ", ""), "\r", "")
    if lang == "fas":
        out = F.translate(out, "كيىة", "کییه")
    digits = rf"[{WS[1:-1]}\d۰-۹٠-٩]{{1,8}}"

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, f"{WS}+$", "")
        if lang in ("fas", "ara"):
            x = F.when(x.rlike(f"^{digits}$"), F.lit("")).otherwise(F.regexp_replace(x, rf"^{digits}(?=[\u0600-\u06FF])", ""))
        if lang not in SCRIPT_OF:
            x = F.when(mostly_latin_ocr(x), joined_words(x)).otherwise(x)
        return x

    return trim(F.regexp_replace(F.array_join(F.transform(F.split(out, "\n"), line), "\n"), "\n{3,}", "\n\n"))


def clean_rtl_line(line: Column | str, rtl: Column) -> Column:
    # plain searches come first, as few lines have any of these
    out = once(nfkc(line), lambda x: F.when(wide(x), F.regexp_replace(x, "[Ѧѧ]", "")).otherwise(x))
    out = once(out, lambda x: F.when(x.contains("(cid:"), F.regexp_replace(x, r"\(cid:\d+\)", "")).otherwise(x))
    out = trim(once(out, lambda x: F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, r"[ \t]+", " ")).otherwise(x)))
    right = lambda x: F.regexp_replace(F.translate(x, "ھ", "ه"), rf"([{SCRIPTS}]{{3,}})\1", "$1")
    return once(out, lambda x: F.when(rtl, right(x)).otherwise(x))


def speech_normalize(text: Column | str) -> Column:
    """Spellings that a voice reads well."""
    out = nfkc(text)
    for pattern, to in [
        (r"\u00AD", ""), ("[“”„]", '"'), ("[‘’]", "'"), ("[–—]", " - "), ("…", "..."), ("&", " and "), ("%", " percent"),
        (_bounded("AI"), "A I"), (_bounded("OCR"), "O C R"), (_bounded("PDF"), "P D F"),
        (r"(?<![A-Za-z0-9_])Dr\.", "Doctor"), (r"(?<![A-Za-z0-9_])Mrs\.", "Missus"), (r"(?<![A-Za-z0-9_])Mr\.", "Mister"), (r"(?<![A-Za-z0-9_])Ms\.", "Miss"), (r"(?<![A-Za-z0-9_])Prof\.", "Professor"),
        (f"{WS}+", " "), (" ([,.;:!?])", "$1"),
    ]:
        out = F.regexp_replace(out, pattern, to)
    return trim(out)


def document_key(name: Column | str, page_count: Column | str) -> Column:
    """name:pages; a file without a name is a document."""
    return F.concat_ws(":", F.coalesce(F.nullif(col(name), F.lit("")), F.lit("document")), col(page_count).cast("string"))


def filename_title(name: Column | str) -> Column:
    title = trim(F.regexp_replace(col(name), r"(?i)\.(pdf|docx)$", ""))
    return F.when(title == "", col(name)).otherwise(title)


#: Languages for recognition, and letters of the scripts of some of them with the least share and number of these; fixed values.
OCR_LANGS = "eng deu fra spa ita por nld swe nor dan fin tur ind vie jpn kor chi_sim hin rus ara fas tha".split()
_ARABIC = r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF"
SCRIPT_OF = {
    "ara": (_ARABIC, 0.45), "fas": (_ARABIC, 0.45), "rus": (r"\u0400-\u04FF", 0.45), "hin": (r"\u0900-\u097F", 0.45), "jpn": (r"\u3040-\u30FF\u4E00-\u9FFF", 0.35),
    "kor": (r"\uAC00-\uD7AF\u1100-\u11FF", 0.45), "chi_sim": (r"\u4E00-\u9FFF", 0.35), "tha": (r"\u0E00-\u0E7F", 0.45),
}
GLUED_IS_BROKEN = ["ara", "fas", "rus", "hin", "tha", "kor"]


def resolve_ocr_lang(lang: Column | str, default: str = "eng") -> Column:
    one = F.lower(trim(lang))
    return F.when(one.isin(OCR_LANGS), one).otherwise(default)


def _by_script(lang: Column, found) -> Column:
    """found(letters, least share) for the language's script; null where it has none."""
    out = F.lit(None)
    for letters, share in dict.fromkeys(SCRIPT_OF.values()):
        out = F.when(lang.isin([k for k, v in SCRIPT_OF.items() if v == (letters, share)]), found(letters, share)).otherwise(out)
    return out


#: Single letters and pairs that a wrong decoding leaves, and what a Latin text may hold; fixed values.
MOJIBAKE = "[ÂÃÄÅÆØÙÛÜÝÞÐÑâãäåæðñøùûüýþÿ]"
MOJIBAKE_PAIRS = r"(?:Ã.|Â.|Ð.|Ñ.|Ø.|Ù.|Ú.|Û.|â[€\u0080-\u00BF]?)"
FOREIGN = rf"[^\u0000-\u024F{WS[1:-1]}\d.,;:!?'\"()\[\]{{}}\-–—/\\]"


def looks_corrupted(text: Column | str, lang: Column) -> Column:
    """Traces of a broken text layer, more of them for languages with a script of their own."""
    text = col(text)
    n = F.greatest(F.lit(1), F.length(text))
    # ASCII has none of these, and few other texts have a letter that begins a pair
    lost = F.length(text) - F.length(F.replace(text, F.lit("\uFFFD"), F.lit("")))
    single = count_of(text, MOJIBAKE)
    pairs = F.when(wide(text) & text.rlike("[ÃÂÐÑØÙÚÛâ]"), count_of(text, MOJIBAKE_PAIRS)).otherwise(0)
    foreign = wide(text) & text.rlike(FOREIGN)
    runs = F.when(foreign, count_of(text, "A{2,}")).otherwise(0)

    def in_script(letters: str, _) -> Column:
        own = count_of(text, f"[{letters}]")
        glued = count_of(text, f"(?:[{letters}][A-Za-z]+|[A-Za-z]+[{letters}])")
        arabic = lang.isin("ara", "fas") & (own >= 40) & (count_of(text, "A") >= 3) & (count_of(text, "A") / F.greatest(F.lit(1), own) > 0.015)
        return (own > 0) & ((runs > 0) | (lang.isin(GLUED_IS_BROKEN) & (glued >= 2)) | arabic | ((lost + single + pairs) / n > 0.012))

    scripted = _by_script(lang, in_script)
    bad = lost + pairs * 2 + F.when(scripted.isNotNull(), single).otherwise(0) + runs * 2
    return F.coalesce(scripted, F.lit(False)) | (bad / n > 0.018)


def needs_ocr(text: Column | str, lang: Column) -> Column:
    """Whether a page's own text is too poor to read."""
    lang = resolve_ocr_lang(lang)

    def judged(t: Column) -> Column:
        n = F.greatest(F.lit(1), F.length(t))
        latin = letters_of(t, LATIN)

        def in_script(letters: str, share: float) -> Column:
            own = letters_of(t, letters)
            return F.when(own >= 12, False).when(((own + latin) / n > 0.45) & (n >= 80), False).otherwise(own / n < share)

        few = F.when(n < 200, latin / n < 0.35).otherwise(False)
        return F.when(F.length(t) < 16, True).when(looks_corrupted(t, lang), True).otherwise(F.coalesce(_by_script(lang, in_script), few))

    return once(trim(F.coalesce(col(text), F.lit(""))), judged)


def content_key(*parts: Column | str, sha: int = 256) -> Column:
    """Hash of the parts that are not empty, joined by bars."""
    whole = F.concat_ws("|", *(F.nullif(col(p), F.lit("")) for p in parts))
    return F.sha1(whole) if sha == 1 else F.sha2(whole, sha)
