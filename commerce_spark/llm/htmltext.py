"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. Block elements cut the page into lines; a line's value is the logarithm of the
ratio of its text outside links to the tags in it. Values are smoothed with a Gaussian along the page and split in two
clusters; the lines of the upper one are content, and content decides on regions:

- Elements that say what they are (menus, footers, adverts, comments and so on) count zero and never come out. A name
  alone doesn't count against an element that holds over half of the page's text, so that a layout's name
  doesn't take the article with it, nor does a form around the page. Names of headings, paragraphs, lists and tables, and the
  ids of sections, don't count at all.
- Of the elements marked as article or main text, all with content come out, if together they hold half of the content.
- Else the search goes down from the page to the innermost element with four fifths of the content, and that comes out; where
  that is the page itself, the content lines and the headings before them.

In a region everything comes out but runs of three or more lines of links below the border, paragraphs of a marked element
aside: menus without a name. Parsing and choosing take time in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Elements by their role in a page, and the words by which containers are named.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul head".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SILENT = set("head title style script noscript template iframe object svg canvas audio video annotation annotation-xml select button textarea datalist map".split())
OUTSIDE = set("nav header footer aside form dialog menu search".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist status".split())
FLOW = HEADINGS | set("p li dt dd pre address caption figcaption legend summary hr tr td th thead tbody tfoot table ul ol dl option optgroup".split())
CLOSES_P = BLOCK - {"body", "html", "head", "title", "option", "optgroup", "legend", "summary", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
OUTER_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer footers topbar masthead siteheader pageheader pagination pager popup modal overlay widget "
    "widgets toolbar skiplink paywall disclaimer copyright".split()
)
COMMENT_WORDS = set("comment comments commentlist respond responses disqus replies".split())
ADVERT_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo".split())
CONTENT_WORDS = set("article articlebody postcontent entrycontent maincontent articlecontent story storybody".split())
NOT_NAMES = {"has", "no", "not", "with", "without", "is", "hide", "show"}


def names(value: str) -> tuple[set[str], set[str]]:
    """The words of a class or id, and its tokens as one word each; tokens such as has-sidebar name nothing."""
    words, whole = set(), set()
    for token in value.split():
        parts = [w.lower() for w in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", token) if w]
        if parts and parts[0] not in NOT_NAMES:
            words.update(parts)
            whole.add("".join(parts))
    return words, whole


class Element:
    """A block element, or an inline one that never counts."""

    __slots__ = ("flow", "hidden", "marked", "named", "outer", "parent", "strict", "tag")

    def __init__(self, tag: str, attrs: list, parent: int):
        given = {k: v or "" for k, v in attrs}
        flow = tag in FLOW
        # a heading's or paragraph's name says how it looks, and a section's id is a link's target, made of its heading
        told = "" if flow else given.get("class", "") if tag == "section" else f"{given.get('class', '')} {given.get('id', '')}"
        words, whole = names(told)
        role = given.get("role", "").lower()
        page = tag in ("html", "body")
        self.tag, self.parent, self.flow = tag, parent, flow
        self.hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        self.outer = tag in OUTSIDE or role in ROLES
        self.strict = not page and tag not in ("main", "article") and bool(words & COMMENT_WORDS) or tag == "article" and bool({"comment", "comments"} & words)
        self.named = not page and bool((words | whole) & OUTER_WORDS)
        self.marked = tag in ("article", "main") or role in ("main", "article") or not page and not self.flow and bool(whole & CONTENT_WORDS)


class Page(HTMLParser):
    """Collects elements, and lines as (text, tags, characters in links, element, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.elements = [Element("html", [], -1)]
        self.open: list[tuple[str, int, bool]] = []  # (tag, element, whether its text is left out)
        self.where: dict[str, list[int]] = {}  # the places of each tag in `open`
        self.blocks: list[int] = []  # those of block elements
        self.parts: list[str] = []
        self.tags = self.links = self.anchors = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def _at(self) -> int:
        return self.open[-1][1] if self.open else 0

    def cut(self) -> None:
        """End a line."""
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            heading = any(t in HEADINGS for t, _, _ in self.open[-3:])
            self.lines.append((text, self.tags, self.links, self._at(), heading))
            self.tags = self.links = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCK
        if block:
            if tag in CLOSES_P:
                self._close("p", BLOCK - {"p"})
            if tag == "li":
                self._close("li", {"ul", "ol", "menu", "dir"})
            self.cut()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        at, silent = self._at(), bool(self.open) and self.open[-1][2] or tag in SILENT
        if block:
            self.elements.append(Element(tag, attrs, at))
            at = len(self.elements) - 1
        elif attrs and tag != "a":
            inline = Element(tag, attrs, at)
            given = names(" ".join(v or "" for k, v in attrs if k in ("class", "id")))[0]
            silent = silent or inline.hidden or bool(given & ADVERT_WORDS)
        self.anchors += tag == "a"
        self.where.setdefault(tag, []).append(len(self.open))
        if block:
            self.blocks.append(len(self.open))
        self.open.append((tag, at, silent))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _drop(self, i: int) -> None:
        for tag, _, _ in reversed(self.open[i:]):
            self.where[tag].pop()
            self.anchors -= tag == "a"
        del self.open[i:]
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, -1 without one."""
        at = self.where.get(tag)
        return at[-1] if at else -1

    def _close(self, tag: str, stop: set[str]) -> None:
        i = self._last(tag)
        if i >= 0 and all(self._last(t) < i for t in stop):
            self.cut()
            self._drop(i)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCK:
            self.cut()
        i = self._last(tag)
        if i >= 0 and (tag in BLOCK or not self.blocks or i > self.blocks[-1]):  # an inline end tag doesn't close blocks
            self._drop(i)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        self.parts.append(data)
        if self.anchors:
            self.links += len(data.strip())


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """A Gaussian moving mean; at the ends the kernel keeps to the page."""
    r = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        k = kernel[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(k, values[lo:hi], strict=True)) / sum(k))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of numbers (2-means)."""
    if not values:
        return 0.0
    t = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2 if low and high else t
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _left_out(page: Page, own: list[int]) -> list[bool]:
    """For each element whether its text never counts. own: characters outside links, with those of inner elements."""
    marks = [False] * len(page.elements)
    for i in range(len(page.elements) - 1, 0, -1):
        e = page.elements[i]
        marks[e.parent] |= marks[i] or e.tag in ("article", "main")
    out, under, most = [False] * len(page.elements), [False] * len(page.elements), own[0] / 2
    for i, e in enumerate(page.elements):
        inside = i > 0 and out[e.parent]
        under[i] = i > 0 and (under[e.parent] or page.elements[e.parent].marked)
        header = e.tag == "header" and under[i]  # an article's own header holds its heading
        kept = own[i] > most and (marks[i] or not e.outer or e.tag == "form")  # what holds most of the text isn't at the side of it
        out[i] = inside or e.hidden or e.strict or (e.outer and not header or e.named) and not kept
    return out


def _pick(page: Page, sigma: float = 1.0) -> list[str]:
    lines, n = page.lines, len(page.elements)
    plain = [max(0, len(x[0]) - x[2]) for x in lines]
    own = _sums(page, plain)
    gone = _left_out(page, own)
    usable = [not gone[x[3]] for x in lines]
    values = smooth([math.log1p(p / max(1, x[1])) if u else 0.0 for x, p, u in zip(lines, plain, usable, strict=True)], sigma)
    border = threshold([v if u else 0.0 for v, u in zip(values, usable, strict=True)] + [0.0])  # what is left out has no text
    content = [u and v >= border and p > 0 for v, u, p in zip(values, usable, plain, strict=True)]
    weight = _sums(page, [len(x[0]) if c else 0 for x, c in zip(lines, content, strict=True)])
    # the outermost marked element of every line that has content
    region = [-1] * n
    for i, e in enumerate(page.elements):
        region[i] = region[e.parent] if i and region[e.parent] >= 0 else i if e.marked and not gone[i] else -1
    marked = [r for r in dict.fromkeys(region) if r >= 0 and weight[r]]
    if marked and 2 * sum(weight[r] for r in marked) >= weight[0]:
        wanted = set(marked)
        chosen = [u and region[x[3]] in wanted for x, u in zip(lines, usable, strict=True)]
        article = [False] * n
        for i, e in enumerate(page.elements):
            article[i] = e.tag == "article" or i > 0 and article[e.parent]
        inner = [article[x[3]] for x in lines]
        of: dict[int, list[int]] = {}
        for i, x in enumerate(lines):
            of.setdefault(region[x[3]], []).append(i)
        for r in marked:  # of main text around articles, the lines of the content and headings
            mine = of.get(r, [])
            if page.elements[r].tag != "article" and any(inner[i] for i in mine):
                for i in mine:
                    chosen[i] = chosen[i] and (inner[i] or content[i] or lines[i][4])
    else:
        root, heavy = 0, {}  # of each element the first child with most of its content
        for i, e in enumerate(page.elements[1:], 1):
            if not e.flow and weight[i] * 5 >= weight[e.parent] * 4 > 0:
                heavy.setdefault(e.parent, i)
        while root in heavy:
            root = heavy[root]
        if page.elements[root].tag in ("html", "body"):
            chosen = list(content)
            for i in range(len(lines) - 2, -1, -1):
                chosen[i] = chosen[i] or usable[i] and lines[i][4] and chosen[i + 1]
        else:
            inside = [False] * n
            for i, e in enumerate(page.elements):
                inside[i] = i == root or i > 0 and inside[e.parent]
            chosen = [u and inside[x[3]] for x, u in zip(lines, usable, strict=True)]
    links = [x[2] * 2 > len(x[0]) and v < border and not (region[x[3]] >= 0 and page.elements[x[3]].tag == "p") for x, v in zip(lines, values, strict=True)]
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and links[end]:
            end += 1
        if end - at >= 3:
            chosen[at:end] = [False] * (end - at)
        at = max(end, at + 1)
    return [x[0] for x, c in zip(lines, chosen, strict=True) if c]


def _sums(page: Page, values: list[int]) -> list[int]:
    """What the lines in each element have together."""
    out = [0] * len(page.elements)
    for x, v in zip(page.lines, values, strict=True):
        out[x[3]] += v
    for i in range(len(out) - 1, 0, -1):
        out[page.elements[i].parent] += out[i]
    return out


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, white space in a block as one space, two line feeds between blocks.

    Null, empty and text-free pages give the empty text. Broken markup is read as far as it goes: tags left open are closed
    by what holds them. Character references are decoded; comments and declarations are no text.
    """
    if not html:
        return ""
    page = Page()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # the parser's answer to some broken declarations: keep what came before
        pass
    page.cut()
    return "\n\n".join(_pick(page))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. A page is read whole, whatever its size; a null html, url
    or page_id stays a row; repeated rows give repeated rows, and an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
