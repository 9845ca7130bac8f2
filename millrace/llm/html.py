"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters.

Each block of a page is a line. Its ratio is its text outside links over its tags; a tag or class word
of page furniture around it, and a place outside the page's articles where it has any, only lower the
ratio, a thousandfold each. Ratios are smoothed along the page, not across the edges of furniture or of
an article, and lines over a share of the page's text-weighted mean form content clusters. The regions
are the articles, else the element that holds most of the clusters: there the clusters are kept, with
short lines among them whose ratio is not lowered. Beside articles what the clusters hold is kept too.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches

#: Width of the smoothing in lines, and the share of the page's text-weighted mean ratio from which a line is content.
SIGMA, SHARE = 1.5, 0.2
#: What an element of page furniture leaves of a line's ratio.
FURNITURE_FACTOR = 1e-3
#: Share of a page's text that must be outside furniture; with less, furniture that holds most of the rest is the page's frame.
OUTSIDE = 0.02
#: Share of the clusters' text that a region holds whatever stands beside it, and that it must hold anyhow.
REGION, MOST = 0.95, 0.5
#: Share of the text that articles together must hold, and of the largest article's that any other must.
ARTICLES, NEXT_ARTICLE = 0.5, 0.1
#: Level of text without a heading.
NO_HEADING = 7
#: Share of a line's text inside links from which it is a link.
LINK = 0.8

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no region is narrowed to, and paragraphs that may be one link.
PARAGRAPHS = frozenset("p li dt dd blockquote pre td th caption figcaption ul ol dl".split()) | HEADINGS
SINGLE_LINKS = frozenset("p blockquote dd td".split()) | HEADINGS
#: Elements whose content is never text of the page.
NEVER = frozenset("audio button canvas datalist head iframe map noscript object script select style svg template textarea title video".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements of furniture (a header only outside an article); an article inside an unclosed or page-wide one of the second list is no part of it.
FURNITURE_TAGS = frozenset("aside dialog footer form header menu nav".split())
FRAMES = frozenset("form header menu nav".split())
#: Words of furniture in class, id or role, and words that may stand beside one in a compound name.
FURNITURE = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr "
    "login menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset(
    "area articles bar block bottom box button buttons column container content fixed form global group header holder inner items left line links list main message module news page panel "
    "policy post posts primary right row secondary section site slot stories text thread top unit wrap wrapper".split()
)
OUTER = frozenset("header masthead".split())
PLAIN = frozenset("html body main".split())
_token = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An open element of the first kind is closed by a start tag of it, unless one of the second is open inside.
_CLOSED_BY_NEXT = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select",))} | {
    t: frozenset(("table",)) for t in ("tr", "td", "th")
}


def names_furniture(value: str, words: frozenset[str] = FURNITURE) -> bool:
    """Whether one of the names in a class, id or role attribute is a word of furniture, or a compound of one with plain words."""
    for name in value.split():
        parts = [p.lower() for p in _token.findall(name)]
        if any(p in words for p in parts) and all(p in words or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


class Lines(HTMLParser):
    """Collects the lines of a page and its tree of blocks.

    ``lines``: text, characters in links, tags since the last line, element, smoothing group, marks around it.
    ``elements``: tag, parent, number of marks, whether it is a mark itself, by number from 0, the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.elements: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self._text: list[str] = []
        self._linked = self._tags = self._groups = 0
        # tag, element, marks, smoothing group, inside an article, marks are of FRAMES only, inside NEVER, block or mark
        self._open: list[tuple[str, int, int, int, bool, bool, bool, bool]] = [("", 0, 0, 0, False, True, False, True)]
        self._counts: dict[str, int] = {}

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            _, element, _, group, *_ = self._open[-1]
            self.lines.append((text, self._linked, self._tags, element, group))
            self._tags = 0
        self._text, self._linked = [], 0

    def _is_furniture(self, tag: str, attrs: list, inside: bool) -> bool:
        if tag in FURNITURE_TAGS and not (tag == "header" and inside):
            return True
        if tag in PLAIN or not attrs:
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _hidden.search(value):
                return True
            if value and name in ("class", "id", "role") and (names_furniture(value) or not inside and names_furniture(value, OUTER)):
                return True
        return False

    def _close_implied(self, tag: str) -> None:
        """Closes what a start tag ends: a head, an open paragraph before a block, the cell or item before."""
        if self._counts.get("head") and tag not in IN_HEAD and tag != "head":
            self._close("head")
        if tag in BLOCKS and self._counts.get("p"):
            for entry in reversed(self._open):
                if entry[0] == "p":
                    self._close("p")
                    break
                if entry[0] in BLOCKS or not entry[0]:
                    break
        same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
        if tag in _CLOSED_BY_NEXT and any(self._counts.get(t) for t in same):
            for entry in reversed(self._open):
                if entry[0] in same:
                    self._close(entry[0])
                    break
                if entry[0] in _CLOSED_BY_NEXT[tag] or not entry[0]:
                    break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        block = tag in BLOCKS
        if block or tag in NEVER:
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        self._close_implied(tag)
        _, element, marks, group, inside, framed, never, _ = self._open[-1]
        mark = self._is_furniture(tag, attrs, inside)
        if mark and not block:
            self._flush()  # marked inline text is a line of its own
        if mark:
            framed = framed and tag in FRAMES
            marks += 1
        elif tag == "main" or tag == "article" and framed:
            marks, framed = 0, True
        if tag in ("article", "main"):
            inside = True
        if mark or tag in ("article", "main"):
            self._groups += 1
            group = self._groups
        if block or mark:
            self.elements.append((tag, element, marks, mark))
            element = len(self.elements) - 1
        self._open.append((tag, element, marks, group, inside, framed, never or tag in NEVER, block or mark))
        self._counts[tag] = self._counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "svg"):
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Closes the innermost open ``tag``, which there is, and what is open inside it; an inline one leaves the blocks inside it open."""
        if tag not in BLOCKS and tag not in NEVER:
            at = len(self._open) - 1
            while self._open[at][0] != tag:
                at -= 1
            if any(e[7] for e in self._open[at + 1 :]) and not self._open[at][7]:
                del self._open[at]
                self._counts[tag] -= 1
                return
        self._flush_if_edge()
        while True:
            name = self._open.pop()[0]
            self._counts[name] -= 1
            if name == tag:
                return

    def _flush_if_edge(self) -> None:
        if self._open[-1][7] or self._open[-1][6]:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
        if self._counts.get(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._open[-1][6]:
            self._text.append(data)
            if self._counts.get("a"):
                self._linked += len("".join(data.split()))

    def close(self) -> None:
        super().close()
        self._flush()


def content_lines(ratios: np.ndarray, masses: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which lines belong to content clusters: ratios smoothed within their group, over a share of the text-weighted mean."""
    total, weight = ratios.copy(), np.ones(len(ratios))
    for step in range(1, min(int(3 * SIGMA), len(ratios) - 1) + 1):
        k = np.exp(-0.5 * (step / SIGMA) ** 2)
        same = k * (groups[step:] == groups[:-step])
        total[step:] += same * ratios[:-step]
        weight[step:] += same
        total[:-step] += same * ratios[step:]
        weight[:-step] += same
    smooth = total / weight
    return smooth >= SHARE * (smooth * masses).sum() / masses.sum()


def _marks(page: Lines, plain: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks that count, by element: without those of a frame, furniture around nearly all text of a page that looks like an article."""
    tags, parents, marks, own = (list(x) for x in zip(*page.elements, strict=True))
    marks = np.array(marks)
    n = len(marks)
    while True:
        outside = plain[marks[at] == 0].sum()
        if outside >= OUTSIDE * plain.sum() or any(t in ("article", "main") and not m for t, m in zip(tags, marks, strict=True)):
            return marks
        text, heads, paragraphs = np.zeros(n), np.zeros(n, int), np.zeros(n, int)
        np.add.at(text, at, plain)
        for e in set(at[plain > 0].tolist()):
            heads[e], paragraphs[e] = tags[e] in HEADINGS, tags[e] == "p"
        for e in range(n - 1, 0, -1):
            for x in (text, heads, paragraphs):
                x[parents[e]] += x[e]
        frames = [e for e in range(1, n) if own[e] and marks[e] == 1 and (paragraphs[e] >= 3 or heads[e] and paragraphs[e])]
        frame = max(frames, key=lambda e: text[e], default=0)
        if not frame or text[frame] < 0.5 * plain.sum():
            return marks
        within = np.zeros(n, bool)
        for e in range(frame, n):
            within[e] = e == frame or within[parents[e]]
        marks = np.where(within & (marks > 0), marks - 1, marks)
        own[frame] = False


def _articles(page: Lines, plain: np.ndarray, at: np.ndarray, marks: np.ndarray) -> list[int]:
    """Outermost article elements (else main ones) outside furniture, if together they hold most of the text outside furniture; without those far shorter than the longest."""
    tags, parents = [e[0] for e in page.elements], [e[1] for e in page.elements]
    held = np.bincount(at, plain, len(tags))
    for e in range(len(tags) - 1, 0, -1):
        held[parents[e]] += held[e]
    for tag in ("article", "main"):
        inner = np.zeros(len(tags), bool)
        for e in range(1, len(tags)):
            inner[e] = inner[parents[e]] or tags[parents[e]] == tag and marks[parents[e]] == 0
        found = [e for e in range(1, len(tags)) if tags[e] == tag and not inner[e] and marks[e] == 0 and held[e] > 0]
        if found and sum(held[e] for e in found) >= ARTICLES * held[0]:
            return [e for e in found if held[e] >= NEXT_ARTICLE * max(held[f] for f in found)]
    return []


def _region(page: Lines, masses: np.ndarray, at: np.ndarray) -> int:
    """The element that holds the clusters, narrowed from the page while one child holds nearly all of their text, or most of it and the others stand beside the text.

    Beside the text are blocks of one line (notices, credits) and blocks under lower headings than the child's (comments, lists of other pages);
    paragraphs, and lines between a heading and the child, are not.
    """
    tags, parents = [e[0] for e in page.elements], [e[1] for e in page.elements]
    n = len(tags)
    held, count = np.bincount(at, masses, n), np.bincount(at, minlength=n)
    top, own = np.full(n, NO_HEADING), held.copy()  # level of the highest heading, text that is in no child
    for e in range(n - 1, 0, -1):
        if tags[e] in HEADINGS and count[e]:
            top[e] = int(tags[e][1])
        held[parents[e]] += held[e]
        count[parents[e]] += count[e]
        top[parents[e]] = min(top[parents[e]], top[e])
    children: list[list[int]] = [[] for _ in range(n)]
    for e in range(1, n):
        children[parents[e]].append(e)
    region = 0
    while True:
        blocks = [e for e in children[region] if count[e] > 1 and tags[e] not in PARAGRAPHS]
        best = max(blocks, key=lambda e: held[e], default=0)
        if not best or held[best] < MOST * held[region]:
            return region
        if held[best] < REGION * held[0]:
            before = [e for e in children[region] if e < best and count[e]]
            titles = [i for i, e in enumerate(before) if tags[e] in HEADINGS]
            titled = set(before[titles[-1] :]) if titles else set()  # lines from the last heading before the child on
            level = min([top[best], *(top[e] for e in titled)])
            for e in children[region]:
                lone = count[e] == 1 and tags[e] not in PARAGRAPHS
                beside = held[e] == 0 or tags[e] in HEADINGS or e not in titled and (lone or level < top[e] and tags[e] not in PARAGRAPHS)
                if e != best and not beside:
                    return region
            if own[region]:
                return region
        region = best


def main_text(html: str | None) -> str:
    """Main text of one page: the lines of its content regions, by one newline."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    if not page.lines:
        return ""
    texts, *columns = zip(*page.lines, strict=True)
    lengths, linked, tag_counts, at, groups = (np.array(x) for x in ([len(t) for t in texts], *columns))
    plain = np.maximum(lengths - linked, 0).astype(float)
    links = linked >= LINK * lengths
    plain[links] = 0
    if not plain.any():  # nothing but links: then they are the text
        plain, links = lengths.astype(float), np.zeros(len(lengths), bool)
    tags, parents = [e[0] for e in page.elements], [e[1] for e in page.elements]
    by_element = _marks(page, plain, at)
    marks = by_element[at]
    if not plain[marks == 0].any():
        return ""  # nothing but furniture
    articles = _articles(page, plain * (marks == 0), at, by_element)
    within = np.zeros(len(tags), bool)
    within[articles] = True
    for e in range(1, len(tags)):
        within[e] |= within[parents[e]]
    outside = ~within[at] if articles else np.zeros(len(at), bool)
    evidence = FURNITURE_FACTOR ** (marks + outside).astype(float)
    masses = plain * evidence
    content = content_lines(masses / np.maximum(tag_counts, 1), masses, groups)
    if not content.any():
        return ""
    regions = articles or [_region(page, np.where(content, masses, 0), at)]
    of = np.zeros(len(tags), int)  # region by element, 0 for none; numbers from 1
    of[regions] = np.arange(1, len(regions) + 1)
    for e in range(1, len(tags)):
        of[e] = of[e] or of[parents[e]]
    mine = of[at]
    # a link stands alone, between content; a run of links is a menu
    alone = ~links | ~(np.append(links[1:], False) | np.insert(links[:-1], 0, False)) & np.isin([tags[e] for e in at], list(SINGLE_LINKS))
    fit = (marks == 0) & alone
    keep = content & outside  # what the clusters hold beside the articles
    for r in range(1, len(regions) + 1):
        inside = np.flatnonzero(mine == r)
        core = inside[content[inside] & ((marks[inside] > 0) | fit[inside])]
        if not len(core):
            continue
        first, last = core[0], core[-1]
        keep[core] = True
        between = inside[(inside >= first) & (inside <= last) & fit[inside]]
        keep[between] = True
        if articles:  # short lines between and around them
            keep[inside[fit[inside] & ~links[inside]]] = True
        else:  # lines like those of the clusters go on, and headings
            like = {(parents[at[i]], tags[at[i]]) for i in core}
            goes_on = lambda i: fit[i] and not links[i] and (tags[at[i]] in HEADINGS or (parents[at[i]], tags[at[i]]) in like)
            for run in (inside[inside < first][::-1], inside[inside > last]):
                for i in run:
                    if not goes_on(i):
                        break
                    keep[i] = True
        start = np.flatnonzero(keep & (mine == r))[0]
        while start > 0 and mine[start - 1] != r and tags[at[start - 1]] in HEADINGS and fit[start - 1]:
            start -= 1
            keep[start] = True
    return "\n".join(texts[i] for i in np.flatnonzero(keep))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole html.

    A null or empty html, or one without content, gives an empty text; a page without any article or
    main element is read by its clusters alone; broken markup is read as far as the parser makes events
    of it; a very long page is read whole; repeated rows are read each; an empty table gives no rows.
    Other columns are ignored.
    """
    bound_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`extract` over the whole table."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
