"""Main texts by the counts of a host's wrapper, over more pages than its shape is taken from."""

import random

import pytest

from pagemill.llm.html import Matching, Slots, extract, judged, main_text, parse

SCHEMA = "page_id int, url string, html string"


def texts(spark, pages, **options):
    rows = [(i, "http://a.b/", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()}


def test_constant_blocks_of_articles(spark):
    """A block that all articles of a host share is template, whatever its class; copies of titles are not."""
    pages = [f"<body><article><h1>Title {i // 2}</h1><div class=x9>Read us daily</div><p>Story {i} <a href=/>link {i}</a></article><div>Out {i}</div></body>" for i in range(40)]
    got = texts(spark, pages, sample=4, pages_a_task=7)
    assert got == {i: f"Title {i // 2} Story {i} link {i}" for i in range(40)}


def test_articles_of_template_only(spark):
    """Articles that would be empty are kept whole."""
    pages = [f"<body><article><p>One and the same</article><div>Out {i}</div></body>" for i in range(12)]
    assert set(texts(spark, pages).values()) == {"One and the same"}


def test_counts_are_of_all_pages(spark):
    """The pages of the sample are too few to judge a slot; all pages of the host are not."""
    pages = [f"<body><div class=x>Welcome all</div><div class=y>Story {i}</div></body>" for i in range(30)]
    assert texts(spark, pages, sample=2, pages_a_task=8) == {i: f"Story {i}" for i in range(30)}


def test_names_of_whole_pages_and_articles(spark):
    """State words in class names lose no main text; names of minor blocks mark boilerplate; hidden and mathematical text stays."""
    pages = [
        "<body class='has-sidebar'><article>One</article></body>",
        "<body class='no-sidebar'><p>Two</body>",
        "<body><article class='post comments-open'>Three<div class='comments'>no</div></article></body>",
        "<html class=sidebar><body class=menu><main class=search>Four<div id=related>no</div></main></body></html>",
        "<body><div class='widget'><div id=sidebar><article>Five<div class=x><article class=comment>no</article></div></article></div></div><div class=ad>no</div></body>",
        "<body><div class='post-header'>Six</div><div class='banner x'>no</div></body>",
        "<body><article>Seven <span hidden>a</span><div hidden>b</div><math>c</math></article></body>",
    ]
    got = texts(spark, pages)
    assert [got[i].split()[0] for i in range(7)] == "One Two Three Four Five Six Seven".split()
    assert got[6] == "Seven a b c" and all(len(got[i].split()) == 1 for i in range(6))


def test_names_alone_lose_no_text(spark):
    """A block that has most of the text is content, whatever its name."""
    pages = [f"<body><article><h1>T{i}</h1><section class='related work'>{'This is what the article says. ' * 9}{i}</section><p>And {i}</article></body>" for i in range(9)]
    got = texts(spark, pages)
    assert all(got[i].endswith(f"{i} And {i}") and "article says" in got[i] for i in range(9))


def test_counts_confirm_parts_of_names(spark):
    """A name of which only a part hints at boilerplate is template where its texts are few."""
    pages = [f"<body><article><div class='post-notice'>Notice {i % 8}</div><div class='comment-text'>Story {i}</div></article></body>" for i in range(20)]
    assert texts(spark, pages) == {i: f"Story {i}" for i in range(20)}


def test_region_without_hints(spark):
    """Nothing marks the article but the text that varies there; menus are links, and lines beside it are short."""
    pages = [f"<body><div class=q><ul><li><a>Page {i}</a><li><a>Other {i}</a></ul></div><div class=z><h2>Head {i}</h2><p>{f'Words of story {i}. ' * 20}</p></div><div class=w>Seen {i} times</div></body>" for i in range(12)]
    got = texts(spark, pages)
    assert all(got[i] == f"Head {i} " + (f"Words of story {i}. " * 20).strip() for i in range(12))


def test_wrapper_decides(spark):
    """Other verdicts on a wrapper's slots give another text."""
    own = Slots.of(parse("<body><article><h1>T</h1><p>Text</article><footer>F</footer>"))
    shape = Slots.read(own.write())
    keep = judged(shape, {k: (1, 1, shape.chars[k], 0) for k in range(len(shape.label))})
    page = "<body><article><h1>A</h1><p>B</article><footer>F</footer>"
    assert main_text(page, shape, keep) == "A B"
    h1 = shape.label.index("h1") + 1
    assert main_text(page, shape, [x and k != h1 for k, x in enumerate(keep)]) == "B"


def test_deep_and_wide_pages(spark):
    """Nesting has no bound, and wide lists are matched in bounded time."""
    deep = ["<div class=a>" * 10_000 + f"deep {i}" + "</div>" * 10_000 for i in range(3)]
    ladder = ["".join(f"<div>t{k}" for k in range(3000)) + f"<p>{i}" for i in range(2)]
    wide = ["<article>" + "".join(f"<p>x{i}{k}</p><div><b>y</b>{k}</div>" for k in range(5000 + i)) + "</article>" for i in range(3)]
    got = texts(spark, [*deep, *ladder, *wide])
    assert [got[i] for i in range(3)] == [f"deep {i}" for i in range(3)]
    assert got[4] == " ".join([*(f"t{k}" for k in range(3000)), "1"]) and len(got[7].split()) == 2 * 5002 and got[7].startswith("x20 y0 x21 y1")


def brute_force(a, b, x, y):
    """The most slots of two trees that pair up, by trying all pairs of children."""
    if a.label[x] != b.label[y]:
        return 0
    p, q = a.kids[x], b.kids[y]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(q) + 1):
            w = brute_force(a, b, p[i - 1], q[j - 1])
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w if w else 0)
    return 1 + best[-1][-1]


@pytest.mark.parametrize("seed", range(60))
def test_matching(seed):
    rng = random.Random(seed)

    def tree():
        out = Slots()
        out.new("")
        for _ in range(rng.randint(0, 14)):
            above = rng.randrange(len(out.label))
            out.kids[above].append(out.new(rng.choice("pqr")))
        return out

    a, b = tree(), tree()
    found = Matching(a, b).all()
    assert len(found) == brute_force(a, b, 0, 0) and len(set(found.values())) == len(found)
    above = lambda t: {k: i for i, own in enumerate(t.kids) for k in own}
    up_a, up_b = above(a), above(b)
    for y, x in found.items():
        assert a.label[x] == b.label[y] and (not y or found[up_b[y]] == up_a[x])
    for y, x in found.items():
        pairs = [found[k] for k in b.kids[y] if k in found]
        assert pairs == sorted(pairs, key=a.kids[x].index)


def test_slots_that_few_pages_have_are_judged_by_all_pages(spark):
    """400 shapes of a host, of which some hold one more template block; a wrapper of some of the shapes lacks it and keeps its text."""
    def page(k: int) -> str:
        marks = "".join(f"<div class='{'xy'[k >> b & 1]}'><p>Part {b} of story {k}</p></div>" for b in range(9))
        extra = "<section class='offer'><p>Buy our hats now</p></section>" if k % 40 == 0 else ""
        return f"<html><body><article><h1>Story {k}</h1>{marks}{extra}</article></body></html>"

    got = texts(spark, [page(k) for k in range(400)], sample=4, pages_a_task=64)
    assert got == {k: " ".join([f"Story {k}", *(f"Part {b} of story {k}" for b in range(9))]) for k in range(400)}
