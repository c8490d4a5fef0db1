"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page once. Block elements cut it into lines; a
line knows its text, its tags, whether it stands in boilerplate (by element, role,
class or id), and its region: the article or main element it is in, else the element
around it. Boilerplate is decided for each piece of text: what stands in a script, a button or
a marked span inside a paragraph is left out of its line, and the rest of the line stays. The text-to-tag ratio of all lines is smoothed with a Gaussian kernel; lines above
the standard deviation of the smoothed ratios are content, and a region that holds one is taken
whole, so that short paragraphs stay. Where a page has articles, only they are regions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import ROW, boxed, field, unboxed
from .words import in_slices

SIGMA, RADIUS = 1.0, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " tbody td tfoot th thead tr ul".split()
)
# Elements that never hold main text, and roles, class and id words that mark them.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input label iframe object svg canvas"
    " audio video dialog menu map math datalist".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager"
    " masthead topbar banner footer foot colophon copyright"
    " sidebar sidebars aside widget widgets"
    " cookie cookies consent gdpr notification notifications alert alerts popup modal overlay newsletter subscribe signup login paywall disclaimer"
    " comment comments commentlist disqus respond"
    " share sharing social".split()
)
# Class and id words that boilerplate and articles share: elements of them go only if their text is mostly links or,
# outside an article, if it is thin. A header inside an article belongs to it, and headings are never doubted.
DOUBTED_WORDS = frozenset(
    "header toc related recommended recommendations trending popular notice notices replies reply discussion form search hidden".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
THIN = 25  # characters per tag
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup"}
CLOSED_BY_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Dropped elements that may hold blocks without ending the paragraph around them, and that only their own end tag closes.
ENCLOSED = frozenset("button template noscript select textarea iframe object svg math canvas audio video".split())
UNSEEN = frozenset("script style noscript template datalist".split())  # nothing is drawn between the words around them
FENCES = ENCLOSED | frozenset("ul ol menu dl table tbody thead tfoot select article main section div body nav aside footer header form blockquote".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(name: str, value: str, tag: str, article: bool) -> bool:
    """Whether a class or id names boilerplate.

    Inside an article ids are often made from titles and classes from subjects: there an id counts only as a whole,
    a paragraph's class only where one of its names is such a word, and a heading's not at all.
    """
    if article and tag in HEADINGS:
        return False
    if article and (name == "id" or tag == "p"):
        found = value.lower().split() if name == "class" else [value.strip().lower()]
        return not (tag == "p" and name == "id") and not DROPPED_WORDS.isdisjoint(found)
    return not DROPPED_WORDS.isdisjoint(p.lower() for p in _PART.findall(value))


def _of_readers(attrs) -> bool:
    """Whether an article element is a reader's comment."""
    return any(n in ("class", "id") and v and any(x in ("comment", "comments") or x.startswith("comment-") for x in v.lower().split()) for n, v in attrs)


def _marked(attrs, tag: str, article: bool) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in DROPPED_ROLES:
            return True
        if name in ("class", "id") and _named(name, value, tag, article):
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _doubted(attrs, article: bool) -> bool:
    words = {p.lower() for name, value in attrs if name in ("class", "id") and value for p in _PART.findall(value)}
    return not DOUBTED_WORDS.isdisjoint(words - {"header"} if article else words)


class Lines(HTMLParser):
    """Collects lines (region, whether the region is an article, boilerplate, text, tags)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, bool, bool, str, int]] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, boilerplate, region, in an article
        self.doubts: list[list] = []  # of each doubted element: the one around it, in an article, characters, of links, tags
        self.forms: set[int] = set()  # doubted elements that are forms outside articles
        self.held: Counter[str] = Counter()  # open elements by tag
        self.inside: list[tuple[int, bool]] = []  # of each open element: the doubted element it is in or -1, in a link
        self.doubt = -1  # of the line's first kept word
        self.of_line: list[int] = []  # of each line
        self.text: list[str] = []  # the pieces of the line that are kept
        self.place: tuple[int, bool] | None = None  # region and article of the line's first kept word
        self.hidden = False  # the line has words that are dropped
        self.tags = 0
        self.count = 0

    def _state(self):
        return self.open[-1] if self.open else ("", False, 0, False)

    def cut(self):
        if self.place:
            self.lines.append((*self.place, False, " ".join("".join(self.text).split()), self.tags))
            self.of_line.append(self.doubt)
            if self.doubt >= 0:
                self.doubts[self.doubt][4] += self.tags
        elif self.hidden:
            _, _, region, article = self._state()
            self.lines.append((region, article, True, "", self.tags))
            self.of_line.append(-1)
        self.text.clear()
        self.place, self.hidden, self.tags = None, False, 0

    def _edge(self, dropped):
        """A block's edge ends the line, unless the block is dropped and stands inside the line."""
        if not (dropped and self.place):
            self.cut()

    def _pop(self, names, fences=frozenset()):
        if not any(self.held[n] for n in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                blocks = [x[1] for x in self.open[i:] if x[0] in BLOCK]
                if blocks:
                    self._edge(all(blocks))
                self.held.subtract(x[0] for x in self.open[i:])
                del self.open[i:], self.inside[i:]
                return
            if self.open[i][0] in fences:
                return

    def handle_starttag(self, tag, attrs):
        self.count += 1
        if tag == "br":
            self.text.append(" ")
            self.tags += not self._state()[1]
            return
        if tag in BLOCK:
            if tag in CLOSES_P:
                self._pop({"p"}, FENCES)
            if tag in CLOSED_BY_ITSELF:
                self._pop(CLOSED_BY_ITSELF[tag], FENCES)
            self._edge(self._state()[1])
        _, dropped, region, article = self._state()
        self.tags += not dropped
        if tag in VOID:
            return
        main = tag in ("article", "main") or any(n == "role" and v in ("main", "article") for n, v in attrs)
        # Some pages stand in one form: one outside an article is judged by how much of the page it holds.
        form = tag == "form" and not article and not dropped and not self.held["form"]
        drops = tag in DROPPED and not form or (tag == "header" and not article) or (tag == "article" and _of_readers(attrs))
        drops = drops or (tag not in ("html", "body") and not main and _marked(attrs, tag, article))
        if drops and tag in DROPPED - UNSEEN:
            self.text.append(" ")
        if main and not article and not drops:
            region, article = self.count, True
        elif tag in BLOCK and not article and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "ul", "ol", "td", "th", "tr", "dt", "dd", "dl"):
            region = self.count
        doubt, link = self.inside[-1] if self.inside else (-1, False)
        if tag in BLOCK and not (dropped or drops or main or tag in HEADINGS or tag in ("html", "body")) and (form or _doubted(attrs, article)):
            self.doubts.append([doubt, article, 0, 0, 0])
            doubt = len(self.doubts) - 1
            if form:
                self.forms.add(doubt)
        self.open.append((tag, dropped or drops, region, article))
        self.held[tag] += 1
        self.inside.append((doubt, link or tag == "a"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self.tags += not self._state()[1]
        self._pop({tag}, frozenset() if tag in BLOCK or tag in ENCLOSED else BLOCK)

    def handle_data(self, data):
        _, dropped, region, article = self._state()
        if not dropped:
            self.text.append(data)
        if data.strip():
            if dropped:
                self.hidden = True
            else:
                doubt, link = self.inside[-1] if self.inside else (-1, False)
                if not self.place:
                    self.place, self.doubt = (region, article), doubt
                if doubt >= 0:
                    n = len(data.strip())
                    self.doubts[doubt][2] += n
                    self.doubts[doubt][3] += n * link

    def judged(self):
        """The lines, with those of doubted elements that are mostly links or thin, and of forms with half of the text or less, as boilerplate."""
        for around, _, *sums in reversed(self.doubts):  # an element comes after the one around it
            if around >= 0:
                for i, n in enumerate(sums, 2):
                    self.doubts[around][i] += n
        bad: list[bool] = []
        total = sum(len(text) for _, _, dropped, text, _ in self.lines if not dropped)
        for k, (around, article, n, linked, tags) in enumerate(self.doubts):
            small = 2 * n <= total if k in self.forms else not article and n < THIN * tags
            bad.append((around >= 0 and bad[around]) or 2 * linked > n or small)
        return [(r, a, d or (k >= 0 and bad[k]), t, g) for (r, a, d, t, g), k in zip(self.lines, self.of_line)]


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and scaled up."""
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        part = [(ratios[i + d], kernel[d + RADIUS]) for d in range(-RADIUS, RADIUS + 1) if 0 <= i + d < len(ratios)]
        out.append(sum(r * k for r, k in part) / sum(k for _, k in part))
    return out


def main_text(html: str | None) -> str:
    """The page's main text, one line per block; empty if there is none."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    lines = parser.judged()
    ratios = smoothed([0.0 if dropped else len(text) / max(1, tags) for _, _, dropped, text, tags in lines])
    good = [i for i, x in enumerate(lines) if not x[2]]
    if any(lines[i][1] for i in good):
        good = [i for i in good if lines[i][1]]
    if not good:
        return ""
    mean = sum(ratios) / len(ratios)
    limit = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    best = max(ratios[i] for i in good)
    regions = {lines[i][0] for i in good if ratios[i] >= min(limit, best)}
    return "\n".join(lines[i][3] for i in good if lines[i][0] in regions)


def _extract(column, schema):
    def run(batches):
        for batch in in_slices(batches, [column]):
            texts = [main_text(h) for h in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(texts, pa.string())], schema=schema)

    return run


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``text`` and ``n_chars`` (its code points); null, empty or text-free pages have empty text.

    Every row is handled by itself and whole, so nulls elsewhere, ties and repeated rows
    change nothing. Columns named ``text`` or ``n_chars`` are replaced.
    """
    rows = boxed(pages)
    made = T.StructType([rows.schema[0], T.StructField("text", T.StringType())])
    out = rows.select(ROW, field(html).cast("string").alias("html")).mapInArrow(_extract("html", to_arrow_schema(made)), made)
    return unboxed(out, pages.columns, {"text": F.col("text"), "n_chars": F.length("text").cast("long")})
