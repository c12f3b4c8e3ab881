"""Operator 9: main text of web pages by text-to-tag ratio over streamed parser events."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passlake.llm.common import arrow_map

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td template tfoot th thead title tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
SKIPPED = frozenset(
    "script style template noscript head title nav header footer aside form button select option textarea input iframe "
    "object embed svg canvas math audio video dialog menu".split()
)
#: Of these, elements that may still surround the article.
AROUND = frozenset("header form".split())
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split()
)
#: Elements that may hold the article.
REGIONS = frozenset("article main section div td body".split())
SIGMA = 2.0
#: A line is content when its smoothed ratio is at least this share of the deviation of all ratios.
DEVIATIONS = 0.5
#: An open element on the left ends where one on the right begins.
ENDS = {
    "p": BLOCKS - {"br", "body", "html", "option", "legend"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Words beside "header" in a class or id that make it the heading of an article.
HEADED = frozenset("article content entry page post section story title".split())
#: Share of the text of the main clusters that an element must hold to be the region.
REGION_SHARE = 0.8
#: A cluster with less text than this share of the largest one's says nothing about the region.
CLUSTER_SHARE = 0.2
#: End tags of other elements do not close these.
SCOPES = frozenset("article main nav aside footer table".split())
#: Marks that also stand in the names of layouts around an article ("with-sidebar"), so an element of these alone may hold it.
LAYOUT = frozenset("breadcrumb breadcrumbs complementary header masthead menu nav navbar navigation notice notices pagination search sidebar toolbar widget".split())
#: Marks of what readers and lawyers write, which an article is last looked for in.
OTHERS = frozenset("comment comments consent cookie cookies disqus gdpr replies reply respond".split())
#: Headings, which are no content of their own.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup legend caption".split())
#: A line of so many characters, or a sentence of so many words, is content.
CONTENT_CHARS, SENTENCE_WORDS = 40, 4
_WORDS = re.compile(r"[a-z0-9]+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_RIGHTS = re.compile(r"^\W*(©|copyright\b)|\ball rights reserved\b", re.IGNORECASE)


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """The marks in an element's names."""
    marks: set[str] = set()
    if tag in ("html", "body", "main"):
        return marks
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for part in value.lower().split():
                words = set(_WORDS.findall(part))
                if found := words & MARKS:
                    if found != {"header"} or words.isdisjoint(HEADED):
                        marks |= found
    return marks


def _unseen(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether no text of the element is main text, wherever the page's text is."""
    if tag in SKIPPED:
        return tag not in AROUND
    if tag in ("html", "body", "article", "main"):
        return False
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)


class Line(NamedTuple):
    """A block of text: its tags, its innermost region, whether it is unseen, its characters in links, its innermost mark, whether it is a heading."""

    text: str
    tags: int
    region: int
    unseen: bool
    linked: int
    mark: int
    heading: bool


class Open(NamedTuple):
    """An open element with the state of the text in it, and the place in the stack of the block around it."""

    tag: str
    region: int
    unseen: bool
    mark: int
    block: int


class Lines(HTMLParser):
    """Collects the lines of a page. Regions and marks are trees, as lists of parents; work and memory follow the page's length, whatever its depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.kinds = [-1], ["root"]
        self.marks, self.layout, self.others = [-1], [True], [False]
        self.stack = [Open("root", 0, False, 0, 0)]
        self.open: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, top.region, top.unseen, self.linked, top.mark, self.stack[top.block].tag in HEADINGS or top.tag in HEADINGS))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _push(self, entry: Open) -> None:
        self.stack.append(entry)
        self.open[entry.tag] += 1
        self.scopes[-1][entry.tag] += 1
        if entry.tag in SCOPES:
            self.scopes.append(Counter())

    def _pop_to(self, tag: str) -> None:
        """Ends the innermost open element of the tag, and those in it."""
        while True:
            top, around = self.stack[-1], self.stack[-2]
            if top.tag in BLOCKS or top[1:4] != around[1:4]:
                self._flush()
            self.stack.pop()
            self.open[top.tag] -= 1
            if top.tag in SCOPES:
                self.scopes.pop()
            self.scopes[-1][top.tag] -= 1
            if top.tag == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        while tag in ENDS.get(self.stack[-1].tag, ()):
            self._pop_to(self.stack[-1].tag)
        if tag in BLOCKS:
            block = self.stack[self.stack[-1].block]
            if tag != "br" and block.tag == "p" and tag in ENDS["p"]:  # an open p ends below inline elements too
                self._pop_to("p")
            self._flush()
        if tag in VOID:
            return
        top = self.stack[-1]
        region, mark = top.region, top.mark
        skip = _unseen(tag, attrs)
        names = _marked(tag, attrs)
        marked = bool(names) or tag == "form" or (tag == "header" and not self.open["article"])
        if (skip or marked) and not top.unseen:
            self._flush()
        if marked and not skip and not top.unseen:
            self.marks.append(mark)
            self.layout.append(names <= LAYOUT)
            self.others.append(not names.isdisjoint(OTHERS))
            mark = len(self.marks) - 1
        if tag in REGIONS and not top.unseen and not skip:
            self.parents.append(region)
            self.kinds.append(tag)
            region = len(self.kinds) - 1
        self._push(Open(tag, region, top.unseen or skip, mark, len(self.stack) if tag in BLOCKS else top.block))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
        within = self.scopes[-1][tag] > 0
        ends_scope = tag in SCOPES and len(self.scopes) > 1 and self._scope() == tag
        if within or ends_scope or (tag in ("article", "main", "body", "html") and self.open[tag] > 0):
            self._pop_to(tag)

    def _scope(self) -> str:
        """The tag that opened the innermost scope."""
        return next(x for x, n in self.scopes[-2].items() if x in SCOPES and n > 0)

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag in ("script", "style"):
            return
        self.parts.append(data)
        if self.open["a"] > 0:
            self.linked += len(data.strip())

    def end(self) -> None:
        self.close()
        self._flush()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """values under a Gaussian window of three deviations, with weights that sum to 1 at the ends too."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    long = np.convolve(np.pad(values, reach), weights, "valid")
    return long / np.convolve(np.pad(np.ones_like(values), reach), weights, "valid")


def clusters(smoothed: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(start, end, size) of the runs of neighbouring lines whose smoothed ratio is at least `least`."""
    high = np.concatenate([[False], smoothed >= least, [False]])
    at = np.flatnonzero(high[1:] != high[:-1])
    return [(int(i), int(k), int(sizes[i:k].sum())) for i, k in zip(at[::2], at[1::2], strict=True)]


def _summed(parents: list[int], own: dict[int, int]) -> list[int]:
    """The sum of each node of a tree and all below it; parents come before their children."""
    out = [own.get(k, 0) for k in range(len(parents))]
    for k in range(len(parents) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def _region(parser: Lines, weight: list[int]) -> list[bool]:
    """For each region, whether it lies in the article.

    Down from the root while one region holds REGION_SHARE of the text of the main clusters. Article elements (or main
    ones) below are taken instead where they hold as much together.
    """
    parents, kinds = parser.parents, parser.kinds
    at = 0
    for k in range(1, len(parents)):  # children come after their parents
        if parents[k] == at and weight[k] >= REGION_SHARE * weight[0]:
            at = k
    chosen = [k == at for k in range(len(parents))]
    for kind in ("article", "main"):
        outer = [False] * len(parents)  # below an element of the kind
        found = []
        for k in range(1, len(parents)):
            outer[k] = outer[parents[k]] or kinds[parents[k]] == kind
            if kinds[k] == kind and not outer[k] and weight[k] > 0:
                found.append(k)
        if found and sum(weight[k] for k in found) >= REGION_SHARE * weight[0]:
            chosen = [False] * len(parents)
            for k in found:
                chosen[k] = True
            break
    for k in range(1, len(parents)):
        chosen[k] = chosen[k] or chosen[parents[k]]
    return chosen


def _content(line: Line) -> bool:
    """Whether a line is text of its own: long or a sentence, no heading, not mostly links, no notice of rights."""
    if line.unseen or line.heading or 2 * line.linked > len(line.text) or _RIGHTS.search(line.text):
        return False
    return len(line.text) >= CONTENT_CHARS or (len(line.text.split()) >= SENTENCE_WORDS and bool(_SENTENCE_END.search(line.text)))


def _opened(parser: Lines) -> list[bool]:
    """For each marked element, whether it is opened, that is treated as if it had no mark. Others are dropped.

    While no content stands outside of dropped elements, the one that holds most of it is opened (comments and consent only where there is no other), then one within it. If content stands outside, but none of
    it in an article or main element, layouts around such an element are opened, since they hold the article.
    """
    held: Counter[int] = Counter()
    in_article: Counter[int] = Counter()
    kinds, parents = parser.kinds, parser.parents
    article = [False] * len(kinds)
    for k in range(1, len(kinds)):
        article[k] = article[parents[k]] or kinds[k] in ("article", "main")
    for x in parser.lines:
        if _content(x):
            held[x.mark] += len(x.text)
            if article[x.region]:
                in_article[x.mark] += len(x.text)
    marks = parser.marks
    below, opened = _summed(marks, held), [k == 0 for k in range(len(marks))]
    children: dict[int, list[int]] = {}
    for m in range(1, len(marks)):
        children.setdefault(marks[m], []).append(m)
    at = 0
    while not held[at]:
        at = max(children.get(at, ()), key=lambda m: (below[m] > 0 and not parser.others[m], below[m]), default=0)
        if not at or not below[at]:
            break
        opened[at] = True
    if not any(in_article[m] for m in range(len(marks)) if opened[m]):
        around = [True] * len(marks)  # all marks down to here are layouts
        for m in range(1, len(marks)):
            around[m] = around[marks[m]] and (parser.layout[m] or opened[m])
        for m in range(len(marks) - 1, 0, -1):
            if around[m] and in_article[m]:
                while not opened[m]:
                    opened[m] = True
                    m = marks[m]
    return opened


def main_text(html: str | None, sigma: float = SIGMA, deviations: float = DEVIATIONS) -> str:
    """The main text of one whole page; empty for null, empty and text-free pages.

    A line's ratio is its characters over its tags, 0 where it is unseen. Elements that their tag or names mark as boilerplate are dropped, however long they
    are; one is kept only where no content stands outside of such elements, or where it is a layout around an article element (`_opened`). Ratios of what is left
    are smoothed, and runs of lines over the threshold are clusters. The region is the smallest element that holds nearly all text
    of the main clusters, or the article (else main) elements that do together. All its lines are
    returned, short ones too, but lines under the threshold that are mostly links go. Time and memory are in proportion to the page's length.
    """
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.end()
    lines = parser.lines
    if not lines:
        return ""
    sizes = np.array([len(x.text) for x in lines])
    opened = _opened(parser)
    bad = np.array([x.unseen or not opened[x.mark] for x in lines])
    if bad.all():
        return ""
    ratios = np.where(bad, 0.0, sizes / np.maximum(1, [x.tags for x in lines]))
    smoothed = smooth(ratios, sigma)
    low = deviations * ratios.std()
    found = clusters(smoothed, np.where(bad, 0, sizes), low)
    most = max((n for *_, n in found), default=0)
    own: Counter[int] = Counter()
    for start, end, n in found:
        if n >= CLUSTER_SHARE * most:
            for k in range(start, end):
                if not bad[k]:
                    own[lines[k].region] += int(sizes[k])
    if not own:  # no line is over the threshold
        for k in np.flatnonzero(~bad):
            own[lines[k].region] += int(sizes[k])
    inside = _region(parser, _summed(parser.parents, own))
    links = (smoothed < low) & (2 * np.array([x.linked for x in lines]) > sizes)
    return " ".join(x.text for k, x in enumerate(lines) if not bad[k] and not links[k] and inside[x.region])


_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _texts(rows: dict[str, list]) -> dict[str, list]:
    texts = [main_text(x) for x in rows["html"]]
    return {"text": texts, "n_chars": [len(x) for x in texts]}


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, in one pass over rows and without a shuffle.

    Null and empty pages have an empty text. Repeated rows are extracted one by one, urls and null ids pass
    through, very long and deeply nested pages take time in proportion to their length, an empty table gives an empty result, and
    other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(arrow_map(_texts, ["html"], _PAGES), "page_id long, url string, text string, n_chars long")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
