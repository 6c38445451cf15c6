"""Main text of pages and WARC archives."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import pytest

from haulmark.llm.common import new_folder
from haulmark.llm.html_text import extract, main_text
from haulmark.llm.warc import BadRecord, member, members, parse, read_archives, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, digest string, first long, payload string"
LONG = "<p>" + "long enough to be stored once " * 5 + "</p>"
PAGES = [
    (3, "u3", LONG), (1, None, LONG), (2, "http://x/%0A?a=1\nb", LONG), (9, "u9", "<p>short</p>"), (4, "u4", "<p>short</p>"),
    (5, "u5", None), (6, "u6", ""), (None, None, LONG), (1, "again", LONG), (8, "u8", "é" * 50 + "\r\n\r\nWARC/1.1\r\n\r\n"),
    (7, "u7", "x" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "d", 1, "p") for p in PAGES], SCHEMA).repartition(3)


def test_round_trip(pages, same):
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        equal = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        again = len(data) >= 100 and page_id != min(equal)
        row_type, refers = ("revisit", min(equal)) if again else ("response", None)
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), row_type, refers))
    got = round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same(got.collect(), want)


def test_payloads_and_urls_come_back(spark, pages):
    folder = new_folder(spark, "warc")
    rows = read_archives(write_archives(pages, folder), folder).collect()
    assert sorted(map(repr, [r.url for r in rows])) == sorted(repr(u) for _, u, _ in PAGES)
    assert {bytes(r.payload) for r in rows if r.payload is not None} == {(h or "").encode() for _, _, h in PAGES}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)


def test_records_are_single_gzip_members():
    made = [member(i, f"u{i}", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None, False) for i in range(5)]
    read = [parse(d) for d in members(io.BytesIO(b"".join(made)))]
    assert [r["payload"] for r in read] == [b"x" * i for i in range(5)]


def test_damage_is_noticed():
    data = zlib.decompress(member(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False), 31)
    for broken in (data.replace(b"payload\r\n", b"paylord\r\n"), data[:-4], data[:-9] + data[-4:], b"junk" + data):
        with pytest.raises(BadRecord):
            parse(broken)
    with pytest.raises(BadRecord):
        list(members(io.BytesIO(member(1, "u", b"p", "d", None, False)[:-12])))


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert round_trip(none).count() == 0
    assert extract(none).count() == 0


ARTICLE = "<h1>Title &amp; more</h1><p><b>First  para<br><p>Second\n para &lt;x&gt; &#233;</p><p>End.</p>"
EXPECTED = "Title & more\nFirst para\nSecond para <x> é\nEnd."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; x</footer>",
        f"<article>{ARTICLE}",
        f"<div class='ad'>Buy this now</div><article>{ARTICLE}<aside>{'side ' * 200}</aside></article>",
        f"<div id='page'><div class='site-header'>Top {'x ' * 400}</div><div class='content'>{ARTICLE}</div>"
        f"<section id='comments'><p>{'reader comment ' * 300}</p></section></div>",
        f"<script>var a = '<article>no</article>';</script><style>p{{}}</style><div>{ARTICLE}</div><!-- <p>no</p> -->",
        f"<form><label>Name</label><input name=x><p>Fill in {'y ' * 300}</p></form><main>{ARTICLE}</main>",
        f"<div role='complementary'>{'z ' * 300}</div><div>{ARTICLE}</div><div class='cookie-notice'>We use cookies</div>",
        f"<article>{ARTICLE}<p hidden>secret</p><div class=\"share\">Share</div></article>",
    ],
)
def test_main_text(page):
    assert main_text(page) == EXPECTED


A, B, C = (f"{w} paragraph " + "with enough words to read on " * 5 + "." for w in ("First", "Second", "Third"))
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Page number {i}</a></li>" for i in range(9)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<main><section><p>{A}</section><section><h2>Next</h2><p>{B}</section></main>", [A, "Next", B]),
        (f"<div role=main><div><p>{A}</div><div><p>{B}</div></div><div><p>{C}</div>", [A, B]),
        (f"<div class=content><p>{A}</p><div><p>{B}</p></div><p>{C}</p></div>", [A, B, C]),
        (f"<div><div><p>{A}</p></div><div><p>{B}</p></div><div><p>{C}</p></div></div>", [A, B, C]),
        (f"<div class=content><p>{A}</p><p>{B}</p><div class=box>{MENU}</div><p>{C}</p></div>", [A, B, C]),
        (f"<div class=content>{MENU}<p>{A}</p><p>{B}</p></div>", [A, B]),
        (f"<article><p>{A}</p><div class=box>{MENU}</div><p>{B}</p></article>", [A, B]),
        (f"<article><p>By X</p><ul><li>1</li><li>2</li><li>3</li><li>4</li></ul><p>{A}</p></article>", ["By X", *"1234", A]),
        (f"<body><div class=box>{MENU}</div><div><h1><a href=/>Name</a></h1><div><p>{A}</p></div></div></body>", ["Name", A]),
    ],
)
def test_runs_of_text_are_joined_and_blocks_of_links_are_not(page, expected):
    assert main_text(page) == "\n".join(expected)


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f"<article><h2 id=related-work>Work</h2><p id=legal-history>{A}<ul><li id=search-engines>{B}</ul></article>", ["Work", A, B]),
        (f"<article><div class=print-body><p>{A}</p><p>{B}</p></div></article>", [A, B]),
        (f"<div class=print-body>{ARTICLE}</div>", EXPECTED.split("\n")),
        (f"<div class='has-sidebar comments-open'><p>{A}</p></div>", [A]),
        (f"<div class=sidebar-left><article><p>{A}</p></article></div><div class=sidebar><p>{B}</p></div>", [A]),
        (f"<article class=post><p>{A}</p><article class=comment><p>{B}</p></article></article>", [A]),
        (f"<article><p>{A}</p></article><article class='comment odd'><p>{B}</p></article>", [A]),
        (f"<article><p>{A}</p><div id=related>{MENU}</div><div id=comments><p>{B}</p></div><p>{C}</p></article>", [A, C]),
        (f"<div><p>{A}</p><ul class=comments><li>{B}<ul><li>{B}</ul></ul><p>{C}</p></div>", [A, C]),
        (f"<div class=header><h1>Name</h1><p>{A}</p></div><p>{B}</p>", ["Name", A, B]),
    ],
)
def test_names_are_judged_on_containers_and_by_their_text(page, expected):
    assert main_text(page) == "\n".join(expected)


TEXT = "A sentence of some length stands here, so that it counts as text. " * 3
BROKEN = {
    "head without its end tag": f"<html><head><title>x</title><meta charset=utf-8><body><p>{TEXT}</p><p>{TEXT}</p></body></html>",
    "script in such a head": f"<head><script>if (a<b) document.write('<div>')</script><body><p>{TEXT}</p><p>{TEXT}</p>",
    "form around the page": f"<body><form action=x><div><p>{TEXT}</p><p>{TEXT}</p><input name=q></div></form></body>",
    "nav without its end tag": f"<body><nav><a href=/>Home</a> <a href=/b>More</a><article><p>{TEXT}</p><p>{TEXT}</p></article></body>",
    "nav that ends with its parent": f"<body><div><nav><a href=/>Home</a></div><div><p>{TEXT}</p><p>{TEXT}</p></div></body>",
    "apostrophe in an unquoted attribute": f"<body><p><b class=x'y></b>{TEXT}</p><p>{TEXT}</p></body>",
    "quotes among attributes": f"<body><p><b title='a > b' \" class=\"x>y\"></b>{TEXT}</p><p>{TEXT}</p></body>",
    "svg without its end tag": f"<body><div><svg viewBox='0 0 1 1'><path d=M0></div><p>{TEXT}</p><p>{TEXT}</p></body>",
    "svg never ended": f"<body><svg><path d=M0><article><p>{TEXT}</p><p>{TEXT}</p></article>",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_markup_loses_no_article(name):
    assert main_text(BROKEN[name]) == "\n".join([TEXT.strip()] * 2)


def test_header_of_an_article_gives_its_headings():
    page = f"<article><header><p>By someone</p><h1>The <i>title</i></h1><h2>More</h2><nav>x</nav></header><p>{TEXT}</p></article>"
    assert main_text(page) == "\n".join(["The title", "More", TEXT.strip()])


@pytest.mark.parametrize(
    "page",
    [
        "<body><form><label>Name</label><input><p>Send us a message and we will answer soon.</p></form></body>",
        f"<body><nav><p>{TEXT}</p></nav></body>",
        f"<body><footer><p>{TEXT}</p></footer><header><p>{TEXT}</p></header></body>",
    ],
)
def test_forms_and_closed_menus_stay_out(page):
    assert main_text(page) == ""


def test_generated_pages_give_their_article(spark):
    """Pages put together from an article whose text is known, and everything that stands beside one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgehilmnoprstu") for _ in range(rng.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))

    def block():
        kind, text = rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote"]), words(rng.randrange(25, 60))
        if kind == "h2":
            text = words(4)
            return f"<h2>{text}</h2>", text
        marked = text.replace(" ", rng.choice([" ", "\n  ", " <b>x</b> "]), 1)
        text = " ".join(marked.replace("<b>", "").replace("</b>", "").split())
        return {"li": f"<ul><li>{marked}</li></ul>", "blockquote": f"<blockquote><p>{marked}</p></blockquote>"}.get(kind, f"<p>{marked}</p>"), text

    links = lambda n: "".join(f"<li><a href=/{word()}>{words(2)}</a></li>" for _ in range(n))
    rows, want = [], {}
    for i in range(150):
        blocks = [("<h1>Some title here</h1>", "Some title here"), (f"<p>{(t := words(50))}</p>", t), *(block() for _ in range(rng.randrange(2, 8)))]
        body, texts = "".join(b for b, _ in blocks), [t for _, t in blocks]
        body = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class=content>{}</div>"]).format(body)
        before = rng.choice(["", f"<nav><ul>{links(6)}</ul></nav>", f"<header><p>{words(9)}</p></header>", f"<div class=menu><ul>{links(9)}</ul></div>"])
        after = rng.choice(["", f"<footer><p>{words(30)}</p></footer>", f"<aside><p>{words(40)}</p></aside>", f"<form><p>{words(8)}</p></form>"])
        after += rng.choice(["", "<script>var a = '<p>no</p>';</script>", f"<style>p {{}} /* {words(20)} */</style>"])
        head = rng.choice(["<head><title>t</title></head>", "<head><title>t</title>", ""])
        rows.append((i, f"http://x/{i}", f"<!doctype html><html>{head}<body>{before}{body}{after}</body></html>"))
        want[i] = "\n".join(texts)
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == want


def test_an_empty_table_of_pages(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("page", ["", "   ", "<html></html>", "<nav>only a menu</nav>", "<!-- x", "<p", "</div></div>"])
def test_pages_without_text(page):
    assert main_text(page) == ""


def test_extract_keeps_every_page(spark, same):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (None, None, None), (2, "v", ""), (1, "u", f"<article>{ARTICLE}</article>")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    one = (1, "u", EXPECTED, len(EXPECTED))
    same(extract(frame).collect(), [one, one, (None, None, "", 0), (2, "v", "", 0)])


def test_long_pages_are_not_cut():
    body = "".join(f"<p>paragraph {i} of many</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n") == 19_999
