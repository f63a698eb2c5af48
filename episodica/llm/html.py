r"""Main text of web pages from the events of the standard library's streaming parser.

A page becomes a list of lines, one per block of text, each with the number of tags that led to it.
A line's text-to-tag ratio is its length over those tags; menus (mostly link text) and boilerplate
elements count as 0. Ratios are smoothed with a Gaussian, and a threshold at their standard
deviation clusters lines into content and the rest. Content lines select the regions they lie in,
an ``article`` or ``main`` element or a box named as an article where these hold the page's text, else
their enclosing block and what lies between the first and the last of them, and every line of a
selected region that is not boilerplate is kept, however short; a paragraph may be one link, and so
may a list's item among prose. Regions with less than a third of the text outside of them are teasers
and select nothing. A class or id name counts as boilerplate only if all its words are words of
boilerplate or of layout. Such names do not drop an article or main element, nor the one container
that holds most of the page's text, unless they name a block of comments, advertisements or the like,
or, for the container, a notice. A menu, sidebar or footer that is never closed drops its links only,
not the prose behind them.

Every event costs the same, however many elements are open.

Null and empty pages give an empty text; repeated rows are extracted each; other columns are left
alone by ``main_text``; an empty table gives an empty result. Pages are used whole, one at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import in_small_batches
from episodica.sources.tables import table

#: Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas audio video"
    " dialog menu search map datalist".split()
)
REGIONS = frozenset(("article", "main"))
LEFT_OPEN = frozenset(("nav", "aside", "footer", "header", "menu", "form", "div", "section", "ul"))
CONTAINERS = frozenset("article main section div td body html blockquote".split())
BARRIERS = frozenset(("article", "main", "table"))
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption caption".split())
CLOSED_BY = {"p": BREAKING, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: Words of class and id names, and roles, that mark what is not the article.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " disclaimer discussion discussions disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo"
    " promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that only say where in a layout something is, or of what kind its box is.
LAYOUT_WORDS = frozenset(
    "a an and area article bar big block body bottom box btn button buttons card col column container content dark desktop end fixed form"
    " global google group head header holder icon icons info inline inner item items large left light link links list lg main md mid middle mobile"
    " nofollow on outer page panel position post posts primary reader readers right row secondary section side site slot sm small sticky strip"
    " success tags the thread title tools top unit user users visitor visitors warning wide wrap wrapper xl xs".split()
)
#: Of the words of boilerplate, those of blocks whose articles are not the page's, and class names that only say what a
#: container has or lacks.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments commentlist discussion discussions disqus footer nav navbar navigation promo promotion"
    " related replies respond sidebar sponsor sponsored".split()
)
#: Of the words of boilerplate, those of notices, whose boxes stay out however much text they hold.
NOTICE_WORDS = frozenset("alert alerts consent cookie cookies disclaimer gdpr login modal newsletter notice notices popup signup subscribe subscription".split())
#: Words by which a box is an article; with a word of layout beside it or alone.
ARTICLE_WORDS = frozenset("article entry post story".split())
MODIFIER = re.compile(r"(has|no|with|without)[-_].*|.*[-_](open|opened|closed|enabled|disabled)")
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())

#: Regions with less than such a share of the text outside of them are not the article.
TEASER = 1 / 3
#: Characters from which a line of an unclosed menu is prose though it is no paragraph.
PROSE = 80
SIGMA = 1.0
LINK_SHARE = 0.6


@dataclass
class Line:
    """A block of text: its pieces, the tags before it, and where it lies."""

    text: str
    tags: int
    link_chars: int
    dropped: int
    region: int
    container: int
    paragraph: bool

    @property
    def linked(self) -> bool:
        """Is most of it links?"""
        return self.link_chars > LINK_SHARE * len(self.text)


def class_words(value: str) -> set[str]:
    """Words of boilerplate in class and id names; modifiers and names that have words of their own give none."""
    found: set[str] = set()
    for name in value.split():
        words = {w for w in re.split(r"[^a-z]+", name) if len(w) > 1}
        if not MODIFIER.fullmatch(name) and words <= BOILERPLATE_WORDS | LAYOUT_WORDS:
            found |= words & BOILERPLATE_WORDS
    return found


def names_article(attrs: list[tuple[str, str | None]]) -> bool:
    """Is a box named as an article, such as ``post`` or ``article-body``?"""
    names = [n for k, v in attrs if k in ("class", "id") for n in (v or "").lower().split()]
    parts = [{w for w in re.split(r"[^a-z]+", n) if w} for n in names]
    return any(ARTICLE_WORDS & words and words <= ARTICLE_WORDS | {"body", "content", "text", "main"} for words in parts)


def names_notice(attrs: list[tuple[str, str | None]]) -> bool:
    """Do its names say that a box is a notice?"""
    return any(NOTICE_WORDS & class_words((v or "").lower()) for k, v in attrs if k in ("class", "id"))


def is_foreign(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Is an element that is boilerplate so with any article in it? Not if only its name or a form says so."""
    if tag in DROPPED and tag != "form":
        return True
    given = {k: (v or "").lower() for k, v in attrs}
    words = class_words(given.get("class", "")) | class_words(given.get("id", ""))
    return bool(FOREIGN_WORDS & words) or not (tag == "form" or BOILERPLATE_WORDS & words)  # else by role or hidden


def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> bool:
    """Does an element hold something else than the article?"""
    if tag in DROPPED or (tag == "header" and not in_region):
        return True
    if tag in ("html", "body", "article", "main"):
        names = [v for k, v in attrs if k in ("class", "id") and v and tag == "article"]
        return any({"comment", "comments", "ad", "advert", "related"} & set(re.split(r"[^a-z]+", v.lower())) for v in names)
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id") and BOILERPLATE_WORDS & class_words(value):
            return True
        if (name == "role" and value in BOILERPLATE_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class LineParser(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: Tag, number of the element that drops its text (negative if with any article in it), region, container.
        self.open: list[tuple[str, int, int, int]] = []
        self.notices: set[int] = set()
        self.unclosed: set[int] = set()
        self.scopes: list[Counter] = [Counter()]  # open tags by name, since each barrier
        self.all_open: Counter = Counter()
        self.block = ""
        self.pieces: list[str] = []
        self.tags = self.link_chars = self.n_elements = 0

    def _top(self) -> tuple[str, int, int, int]:
        return self.open[-1] if self.open else ("", 0, 0, 0)

    def _push(self, entry: tuple[str, int, int, int]) -> None:
        if entry[0] in BARRIERS:
            self.scopes.append(Counter())
        self.scopes[-1][entry[0]] += 1
        self.all_open[entry[0]] += 1
        self.open.append(entry)

    def _pop(self) -> str:
        tag = self.open.pop()[0]
        self.scopes[-1][tag] -= 1
        self.all_open[tag] -= 1
        if tag in BARRIERS:
            self.scopes.pop()
        return tag

    def flush(self) -> None:
        """End the block of text."""
        text = " ".join("".join(self.pieces).split())
        if text:
            _, dropped, region, container = self._top()
            self.lines.append(Line(text, max(1, self.tags), self.link_chars, dropped, region, container, self.block in PARAGRAPHS))
            self.tags = 0
        self.pieces, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        breaks = tag in BREAKING
        if breaks or tag in DROPPED:
            self.flush()
        self.tags += 1
        if breaks:
            self.block = tag
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                self.pieces.append("" if tag == "wbr" else " ")
            return
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._pop()
        if tag in REGIONS:  # an article ends what was left open around a menu
            while self.open and self.open[-1][1] and self.open[-1][0] in ("a", "li", "ul", "ol", "nav", "header"):
                self._pop()
        _, dropped, region, container = self._top()
        self.n_elements += 1
        if tag in REGIONS and dropped > 0:  # the page's article, whatever its containers are named
            dropped = 0
        if is_boilerplate(tag, attrs, region > 0):
            if dropped < 0 or tag in REGIONS or is_foreign(tag, attrs):
                dropped = -self.n_elements
            elif not dropped:
                dropped = self.n_elements
                if names_notice(attrs):
                    self.notices.add(dropped)
        begins = tag in REGIONS or (tag in ("div", "section") and names_article(attrs))
        self._push((tag, dropped, self.n_elements if begins and not region else region, self.n_elements if tag in CONTAINERS else container))

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKING or tag in DROPPED:
            self.flush()
        self.tags += 1
        if tag in BREAKING:
            self.block = ""
        # An end tag closes up to its element, but none beyond a barrier; the page's own ends may.
        if self.scopes[-1][tag] or (tag in ("body", "html") and self.all_open[tag]):
            if tag in ("body", "html"):
                self._leave_open()
            while self._pop() != tag:
                pass

    def _leave_open(self) -> None:
        """Note the elements that the page's end closes."""
        self.unclosed |= {dropped for tag, dropped, _, _ in self.open if dropped < 0 and tag in LEFT_OPEN}

    def close(self) -> None:
        """End the page."""
        super().close()
        self.flush()
        self._leave_open()
        for x in self.lines:
            if x.dropped in self.unclosed and not x.linked and (x.paragraph or len(x.text) >= PROSE):
                x.dropped = 0

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if any(entry[0] == "a" for entry in self.open[-3:]):
            self.link_chars += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios under a Gaussian of ``sigma`` lines, renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def content_lines(lines: list[Line], notices: set[int] = frozenset()) -> list[Line]:
    """The lines of the selected regions; ``notices`` are elements that stay out whatever they hold."""
    sizes: Counter = Counter()
    for x in lines:
        sizes[max(0, x.dropped) if x.dropped >= 0 else -1] += len(x.text) - x.link_chars
    named = {x.dropped for x in lines if x.dropped > 0} - notices
    in_regions = sum(len(x.text) - x.link_chars for x in lines if x.region and not x.dropped)
    total = sizes[0] + sum(sizes[n] for n in named)
    most = {n for n in named if 2 * sizes[n] > total} if in_regions < TEASER * (total - in_regions) else set()  # its text overrules its name
    good = [x.dropped == 0 or x.dropped in most for x in lines]
    if not any(good):
        return []
    ratios = np.array([len(x.text) / x.tags if ok and (x.paragraph or not x.linked) else 0.0 for x, ok in zip(lines, good, strict=True)])
    smooth = smoothed(ratios)
    threshold = min(smooth.std(), smooth.max())
    content = [ok and s >= threshold and r > 0 for ok, s, r in zip(good, smooth, ratios, strict=True)]
    prose: Counter = Counter()
    for x, ok in zip(lines, good, strict=True):
        if ok:
            prose[x.region] += len(x.text) - x.link_chars * (not x.paragraph)
    outside = prose.pop(0, 0)
    hits = [n for n, (x, hit) in enumerate(zip(lines, content, strict=True)) if hit and not x.region]
    if prose and (prose.total() >= TEASER * outside or not hits):
        chosen = {x.region for x, hit in zip(lines, content, strict=True) if hit and x.region} or {max(prose, key=prose.__getitem__)}
        return [x for x, ok in zip(lines, good, strict=True) if ok and x.region in chosen]
    chosen = {lines[n].container for n in hits}
    own: Counter = Counter()  # prose less links of each container
    for x, ok in zip(lines, good, strict=True):
        if ok:
            own[x.container] += len(x.text) - 2 * x.link_chars * (not x.paragraph)
    listed = {c for c in chosen if own[c] > 0}

    def kept(n: int, x: Line) -> bool:
        among = bool(hits) and hits[0] < n < hits[-1]
        if x.linked and not x.paragraph:
            return x.container in listed and among
        if x.region:
            return among
        return x.container in chosen or among

    return [x for n, (x, ok) in enumerate(zip(lines, good, strict=True)) if ok and kept(n, x)]


def extract(html: str | None) -> str:
    """Main text of a page: blocks in page order, joined by an empty line."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    return "\n\n".join(x.text for x in content_lines(parser.lines, parser.notices))


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([extract(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*batch.schema.names[:-1], "text"])


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text``. A column ``text`` of the pages is replaced."""
    others = [c for c in pages.columns if c not in (html, "text")]
    narrow = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html}`").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__html")
    return in_small_batches(narrow).mapInArrow(_extract_batches, f"{schema}, text string" if schema else "text string")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
