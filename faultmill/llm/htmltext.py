"""Main text of a page: parser events, text-to-tag ratios, smoothing, threshold clusters."""

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, add_columns, in_batches, texts_of, widened

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup"
    " option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video map select"
                   " textarea button datalist".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
#: Parts of a class or id name of page furniture, and words that make it content after all.
ROLES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|login|"
    r"masthead|menu|modal|nav\w*|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|responses|"
    r"search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|tags|toolbar|widget)(?:$|[-_ ])")
LANDMARKS = frozenset("navigation banner contentinfo complementary search form dialog alert menu toolbar".split())
#: An open element of the left set ends where one of the right begins.
CLOSES = {
    "p": BLOCKS - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option", "optgroup"}), "head": frozenset({"body"}),
}

#: Width of the smoothing in lines, and the share of the mean ratio that a content line exceeds.
SIGMA, SHARE = 1.0, 0.5
#: How much more a line weighs inside an element that declares content.
DECLARED = 4.0


class Lines(HTMLParser):
    """Collects the text lines of a page with the tags in each and what surrounds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []  # name, silent, furniture, outermost content element
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []
        self.places: list[tuple[bool, int]] = []  # furniture, number of the content element or 0
        self.paths: list[tuple[int, ...]] = []  # numbers of the open blocks, outermost first
        self._numbers: list[int] = []  # as ``open``
        self._elements = 0
        self._contents = 0
        self._held: list[str] = []
        self._tags = self._linked = 0

    def _flag(self, k: int) -> bool:
        return any(entry[k] for entry in self.open)

    def _end_line(self) -> None:
        text = " ".join("".join(self._held).split())
        if text:
            self.texts.append(text)
            self.tags.append(self._tags)
            self.links.append(min(self._linked, len(text)))
            self.places.append((self._flag(2), self.open[-1][3] if self.open else 0))
            self.paths.append(tuple(n for n, e in zip(self._numbers, self.open, strict=True) if e[0] in BLOCKS))
        if text or self._held:
            self._tags = self._linked = 0
        self._held = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._end_line()
        while self.open and tag in CLOSES.get(self.open[-1][0], ()):
            self._pop()
        if tag in VOID:
            return
        given = {k: (v or "").lower() for k, v in attrs}
        inside = self.open[-1][3] if self.open else 0
        if not inside and (tag in CONTENT or given.get("role") == "main"):
            self._contents += 1
            inside = self._contents
        named = " ".join((given.get("class", ""), given.get("id", "")))
        # a header or footer inside an article is still no part of its text
        furniture = (tag in FURNITURE or given.get("role", "") in LANDMARKS or "hidden" in given
                     or given.get("aria-hidden") == "true" or (tag not in CONTENT | {"body", "html"}
                                                               and bool(ROLES.search(named))))
        self.open.append((tag, tag in SILENT, furniture, inside))
        self._elements += 1
        self._numbers.append(self._elements)

    def _pop(self) -> None:
        self.open.pop()
        self._numbers.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in VOID:
            return
        if tag in ("svg", "math", "path") and self.open and self.open[-1][0] == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:], self._numbers[k:]
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown section is a comment, up to its >
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if self._flag(1):
            return
        self._held.append(data)
        if any(entry[0] == "a" for entry in self.open):
            self._linked += len(" ".join(data.split()))

    def finish(self) -> None:
        self.close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines, weights renewed at both ends."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = np.convolve(ratios, weights)[reach:reach + ratios.size]
    return over / np.convolve(np.ones(ratios.size), weights)[reach:reach + ratios.size]


def main_text(html: str) -> str:
    """The blocks of the article, one to a line.

    Lines are what stands between block tags.  A line's ratio is its letters outside links per tag;
    lines of menus, forms, notices and the like, by element, role or class, have none, and lines in
    an element that declares content weigh more.  Ratios are smoothed, and lines above a share of
    the mean form clusters.  A cluster in a declared element selects all its lines but furniture; a
    cluster elsewhere selects its lines, and clusters that are not far apart or have lines in one
    parent element what lies between.
    """
    page = Lines()
    try:
        page.feed(html)
        page.finish()
    except AssertionError:  # a malformed declaration ends the parser; what was read counts
        page._end_line()
    n = len(page.texts)
    if not n:
        return ""
    furniture = np.array([f for f, _ in page.places])
    content = np.array([c for _, c in page.places])
    whole = np.array([len(t) for t in page.texts])
    sizes = np.where(content > 0, whole, whole - np.array(page.links))
    usable = ~furniture & (sizes > 0)
    if not usable.any():
        return ""
    weights = np.where(content > 0, DECLARED, 1.0)
    ratios = np.where(usable, weights * sizes / np.maximum(np.array(page.tags), 1), 0.0)
    level = smoothed(ratios)
    high = usable & (level >= SHARE * level[usable].mean())
    declared = np.unique(content[high])
    declared = declared[declared > 0]
    if declared.size:
        chosen = usable & np.isin(content, declared)
    else:
        places = np.flatnonzero(high)
        chosen = np.zeros(n, bool)
        chosen[places[0]:places[-1] + 1] = True
        for at in np.flatnonzero(np.diff(places) > 6):  # far apart: what lies between is no content
            chosen[places[at] + 1:places[at + 1]] = False
        ends: dict[tuple[int, ...], list[int]] = {}
        for at in places.tolist():  # unless one element holds both
            path = page.paths[at]
            for parent in {path, path[:-1]}:
                ends.setdefault(parent, [at, at])[1] = at
        for first, last in ends.values():
            chosen[first:last + 1] = True
        chosen &= usable
    return "\n".join(page.texts[i] for i in np.flatnonzero(chosen).tolist())


def extract(pages: DataFrame, html: str = "html", text: str = "text", size: str = "n_chars") -> DataFrame:
    """Add ``text`` (the main text, empty if none) and ``size`` (its code points); ``html`` is dropped.

    Each page is read whole and by itself; null html is empty.  Columns with these names are
    replaced, the others stay; repeated rows give equal results.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [main_text(page) for page in texts_of(batch, html)]
            yield add_columns(batch.drop_columns([html]), {
                text: pa.array(found, pa.string()), size: pa.array([len(t) for t in found], pa.int64())})

    return in_batches(pages, run, widened(pages, f"`{text}` string, `{size}` long", (html,)))
