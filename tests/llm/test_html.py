from __future__ import annotations

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import html
from millrace.llm.html import extract, main_text

SF = "/root/testdata/sf0.01"
TEXT = [f"{'A long line of running text about something. ' * 6}{i}" for i in range(10)]
PARAS = "".join(f"<p>{t}</p>" for t in TEXT)
BODY = "\n".join(TEXT)

PAGES = {
    "a form around the page": (f"<body><form><h1>T</h1>{PARAS}</form></body>", "T\n" + BODY),
    "a furniture word in a wrapper's class": (f'<body><nav><a>x</a></nav><div class="content has-sidebar"><h1>T</h1>{PARAS}</div><footer>f</footer></body>', "T\n" + BODY),
    "a furniture word in the article's class": (f'<body><article class="post with-comments"><h1>T</h1>{PARAS}</article></body>', "T\n" + BODY),
    "an unclosed nav before an article": (f"<body><nav><ul><li><a>x</a></li></ul><article><h1>T</h1>{PARAS}</article><footer>foot</footer></body>", "T\n" + BODY),
    "an unclosed nav without an article": (f"<body><nav><ul><li><a>x</a></li></ul><div><h1>T</h1>{PARAS}</div></body>", "T\n" + BODY),
    "a teaser's article beside the text": (f"<body><article><a>Teaser</a></article><div>{PARAS}</div></body>", BODY),
    "a menu between paragraphs": (f"<body><div>{PARAS}<ul><li><a>l1</a></li><li><a>l2</a></li></ul>{PARAS}</div></body>", BODY + "\n" + BODY),
    "furniture words in other names": (f'<body><article><h1>T</h1>{PARAS}<p class="share-price notice-period">short one</p></article></body>', f"T\n{BODY}\nshort one"),
    "long comments under a short article": (f'<body><article><h1>T</h1><p>Short text.</p></article><section class="comments">{PARAS * 3}</section></body>', "T\nShort text."),
    "a long notice over a short article": (f'<body><div class="cookie-notice"><p>{TEXT[0] * 4}</p></div><article><p>One.</p><p>Two.</p></article></body>', "One.\nTwo."),
    "no article but short lines": (f"<body><div><div>Site name</div><div><h1>T</h1>{PARAS}<p>a</p><p>b</p><p>c</p><p>d</p></div><div>Copyright</div></div></body>", f"T\n{BODY}\na\nb\nc\nd"),
    "a heading before the article": (f'<body><header><h1>Site</h1></header><main><h1>Title</h1><article>{PARAS}</article><div class="related">{PARAS}</div></main></body>', "Title\n" + BODY),
    "an article without text": ('<body><nav><a>x</a></nav><div class="ad">Buy this thing now</div><article></article><footer>me</footer></body>', ""),
    "only furniture": ('<body><nav><a>x</a></nav><div class="ad">Buy this thing now</div><footer>me</footer></body>', ""),
    "a paragraph that is a link": (f"<article>{PARAS}<p><a href=x>Read on</a></p>{PARAS}</article>", f"{BODY}\nRead on\n{BODY}"),
    "an unclosed head": (f"<head><title>t</title><p>{TEXT[0]}<p>{TEXT[1]}", f"{TEXT[0]}\n{TEXT[1]}"),
    "a notice without a name": (f"<body><div>We use cookies to improve your experience on this site, and so do others.</div><div><h1>T</h1>{PARAS}</div></body>", "T\n" + BODY),
    "reader comments without a name": (f"<body><div><h1>T</h1>{PARAS}</div><div><h3>3 Comments</h3><p>Anna: {TEXT[0]}</p><p>Ben: {TEXT[1]}</p></div></body>", "T\n" + BODY),
    "a column of other pages": (f'<body><div><h1>T</h1>{PARAS}</div><div id="col2"><h3>Most read</h3><p>{TEXT[2]}</p><p>{TEXT[3]}</p></div></body>', "T\n" + BODY),
    "all three around a title and its text": (
        f"<body><div>We use cookies to improve your experience.</div><div><h1>T</h1><div>{PARAS}</div><div><h3>2 Comments</h3><p>Anna: {TEXT[0]}</p></div></div>"
        f'<div id="col2"><h3>Most read</h3><p>{TEXT[2]}</p></div></body>',
        "T\n" + BODY,
    ),
    "sections under headings of one level": (f"<body><div><h2>A</h2>{PARAS}</div><div><h2>B</h2><p>{TEXT[0]}</p><p>{TEXT[1]}</p></div></body>", f"A\n{BODY}\nB\n{TEXT[0]}\n{TEXT[1]}"),
    "an introduction under the heading": (f"<body><div><h1>T</h1><div>{TEXT[0]}</div><div>{PARAS}</div></div></body>", f"T\n{TEXT[0]}\n{BODY}"),
    "inline tags across blocks": (f"<article><p><b>{TEXT[0]}<br><p>x &amp; y</b></p><p>z</p></article>", f"{TEXT[0]}\nx & y\nz"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert main_text(page) == want


def test_clusters_decide(monkeypatch):
    menu = "".join(f"<div>Item {i}</div>" for i in range(12))
    page = f"<body><div>{menu}</div><div>{PARAS}</div><div>{menu}</div></body>"
    assert main_text(page) == BODY
    monkeypatch.setattr(html, "content_lines", lambda ratios, masses, groups: np.ones(len(ratios), bool))
    assert "Item 3" in main_text(page)
    monkeypatch.setattr(html, "content_lines", lambda ratios, masses, groups: np.zeros(len(ratios), bool))
    assert main_text(page) == ""


def test_smoothing_lifts_short_lines_within_a_group_only():
    ratios, masses = np.array([300.0, 2, 300, 2, 2, 2]), np.array([300.0, 2, 300, 2, 2, 2])
    assert html.content_lines(ratios, masses, np.zeros(6, int)).tolist() == [True, True, True, True, True, False]
    assert html.content_lines(ratios, masses, np.array([0, 1, 0, 2, 2, 2])).tolist() == [True, False, True, False, False, False]


def test_extract(spark):
    rows = [(1, "u", PAGES["a form around the page"][0]), (1, "u", PAGES["a form around the page"][0]), (2, None, None), (None, "v", ""), (3, "w", f"<article>{PARAS * 3000}</article>"), (4, "x", "<<p <>&#xZ;")]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extract(pages).collect()), key=str)
    assert [g[:2] for g in got] == [(0, "v"), (1, "u"), (1, "u"), (2, None), (3, "w"), (4, "x")]
    assert got[0][2] == got[3][2] == "" and got[1][2] == got[2][2] == "T\n" + BODY and got[4][2].count("\n") == 29_999
    assert all(n == len(t) for *_, t, n in got)
    assert extract(pages.limit(0)).count() == 0


def right_pages(pages: list[str]) -> int:
    """How many pages give their heading and the text of their source document."""
    flat = lambda t: "\n".join(x for x in (" ".join(line.split()) for line in (t or "").split("\n")) if x)
    sources = {flat(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()}
    parts = [main_text(p).partition("\n") for p in pages]
    return sum(rest in sources and rest.startswith(heading[:20]) for heading, _, rest in parts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_method_without_lists_and_lists_without_method(monkeypatch):
    pages = [r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    plain = [p.replace("<article", "<div").replace("</article", "</div") for p in pages]
    assert right_pages(pages) == right_pages(plain) == len(pages)
    with monkeypatch.context() as m:
        m.setattr(html, "content_lines", lambda ratios, masses, groups: np.ones(len(ratios), bool))
        assert right_pages(pages) == 0  # only the clusters leave out what stands beside the text
    for words in ("FURNITURE_TAGS", "FRAMES", "FURNITURE", "OUTER"):
        monkeypatch.setattr(html, words, frozenset())
    monkeypatch.setattr(html, "names_furniture", lambda *_: False)
    assert right_pages(pages) >= 0.95 * len(pages) and right_pages(plain) >= 0.95 * len(pages)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_give_their_source_documents():
    flat = lambda t: "\n".join(x for x in (" ".join(line.split()) for line in (t or "").split("\n")) if x)
    sources = {flat(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist()}
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        heading, _, rest = main_text(r["html"]).partition("\n")
        assert rest in sources and rest.startswith(heading[:20]), r["page_id"]
