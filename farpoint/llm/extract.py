"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing and clustering."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by what they mean.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("script style noscript template head title svg math iframe object canvas audio video nav footer aside button select textarea input menu dialog option".split())
CONTENT = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
#: Elements that are text: an id there is an anchor, and a compound class says little.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption".split())
#: Words in class, id or role that name what is not the article.
BOILER = re.compile(
    r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|menu|nav\w*|breadcrumbs?|sidebar|side|footer|foot|header|masthead|cookies?|consent|notices?|popup|modal|newsletter|subscribe|social|share|sharing|related|recommend\w*|comments?|reply|replies|respond|disqus|widget|login|signup|search|toolbar|pager|pagination|copyright|skip)"
)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|main|content|body)(?:$|[\s_-])")

# How sure a mark is: a whole name of BOILER words or a form, a part of a compound name, such a part on a section in an article.
SURE, PART, SECTION = 3, 2, 1


def mark(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    """What the names of an element say against it, 0 if nothing."""
    best = SURE if tag == "form" else 0
    if tag in ("html", "body", "article", "main"):
        return best
    for k, v in attrs:
        if k not in ("class", "id", "role") or not v or (k == "id" and tag in PROSE):
            continue
        for name in v.lower().split():
            parts = [bool(BOILER.fullmatch(x)) for x in re.split("[_-]+", name) if x]
            if not any(parts):
                continue
            sure = all(parts) and not (k == "id" and tag == "section" and inside)
            if sure or tag not in PROSE:
                best = max(best, SURE if sure else SECTION if tag == "section" and inside else PART)
    return best


@dataclass(frozen=True)
class ExtractParams:
    sigma: float = 1.0  # of the smoothing, in lines
    threshold: float = 1.0  # lines above so many deviations of the smoothed ratio are content
    length: int = 80  # characters that stand for one line of a longer block
    sure_share: float = 0.5  # of the page's unlinked text: a form or a named element with more is no boilerplate
    part_share: float = 0.3  # the same for an element with such a word in a compound name


@dataclass
class Line:
    """A block of text: what it says, where it stands, and its tags."""

    text: str
    path: tuple[int, ...]  # numbers of the open elements
    boiler: bool
    tags: int
    linked: int  # characters inside links


@dataclass
class Page(HTMLParser):
    """Collects the lines of a page from parser events. Nothing but the stack of open elements
    and the lines is kept."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # name, number, boilerplate
        self.kinds: dict[int, str] = {}
        self.inline: set[int] = set()
        self.marks: dict[int, tuple[int, bool]] = {}  # number: how sure, inside an article
        self.count = 0
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            boiler = bool(self.stack) and self.stack[-1][2]
            self.lines.append(Line(text, tuple(n for _, n, _ in self.stack), boiler, self.tags, self.linked))
        self.tags = self.linked = 0

    def _pop(self, size: int) -> None:
        for name, _, _ in self.stack[size:]:
            self.links -= name == "a"
        del self.stack[size:]

    def handle_starttag(self, tag, attrs) -> None:
        if tag not in INLINE:
            self._flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append("\n")
            return
        names = [n for n, _, _ in self.stack]
        for closes, until in (("p", ()), ("li", ("ul", "ol"))):
            if (closes == "p" and tag in CLOSES_P) or (closes == tag == "li"):
                for i in range(len(names) - 1, -1, -1):
                    if names[i] == closes:
                        self._pop(i)
                        break
                    if names[i] not in INLINE or names[i] in until:
                        break
        said = " ".join((v or "") for k, v in attrs if k in ("class", "id", "role")).lower()
        inside = any(self.kinds.get(n) == "content" for _, n, _ in self.stack)
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in (v or "").replace(" ", "")) for k, v in attrs)
        bad = tag in NEVER or (tag == "header" and not inside) or hidden
        against = mark(tag, attrs, inside) if said or tag == "form" else 0
        if against and tag != "form" and not inside and ARTICLE.search(said):
            against = 0
        if self.stack and self.stack[-1][2]:
            bad = True
        self.count += 1
        if against and not bad:
            self.marks[self.count] = (against, inside)
        if tag in INLINE:
            self.inline.add(self.count)
        if tag in CONTENT:
            self.kinds[self.count] = "content"
        elif said and ARTICLE.search(said) and not bad and not against:
            self.kinds[self.count] = "named"
        self.stack.append((tag, self.count, bad))
        self.links += tag == "a"

    def handle_endtag(self, tag) -> None:
        if tag not in INLINE:
            self._flush()
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in INLINE and any(n not in INLINE for n, _, _ in self.stack[i:]):
                    return  # a stray end does not close the blocks around it
                self._pop(i)
                return

    def handle_data(self, data) -> None:
        if self.stack and self.stack[-1][2] and self.stack[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def settle(page: Page, p: ExtractParams) -> None:
    """Makes boilerplate of the lines in marked elements, where the text does not outweigh the mark."""
    lines = [x for x in page.lines if not x.boiler]
    free = [max(len(x.text) - x.linked, 0) for x in lines]
    held: dict[int, float] = dict.fromkeys(page.marks, 0.0)  # unlinked text in the element,
    within = dict.fromkeys(page.marks, 0.0)  # in an article in it,
    around = dict.fromkeys(page.marks, 0.0)  # in all articles, with it
    longest = dict.fromkeys(page.marks, 0)
    every = dict.fromkeys(page.marks, 0)
    articles = 0.0
    for x, w in zip(lines, free, strict=True):
        first = next((n for n in x.path if page.kinds.get(n) == "content"), None)
        last = next((n for n in reversed(x.path) if page.kinds.get(n) == "content"), 0)
        articles += w if first else 0
        for n in x.path:
            if n in held:
                held[n] += w
                every[n] += len(x.text)
                longest[n] = max(longest[n], w)
                within[n] += w if last > n else 0
                around[n] += w if first else 0
    total = sum(free)
    gone = set()
    for n, (sure, inside) in page.marks.items():
        outside = articles - around[n]
        linked = 2 * held[n] <= every[n]
        if within[n] > outside * (1 if sure == SURE else 0.25):
            continue  # the article is in it
        if sure == SURE:
            small = held[n] <= p.sure_share * total or outside >= 0.2 * total
        elif inside:
            small = linked or (sure == PART and longest[n] < p.length)
        else:
            small = linked or held[n] <= p.part_share * total
        if small:
            gone.add(n)
    for x in lines:
        x.boiler = not gone.isdisjoint(x.path)


def _own(lines: list[Line], p: ExtractParams) -> np.ndarray:
    """Text-to-tag ratio of each line, text in links left out."""
    ratio = np.array([0.0 if x.boiler else max(len(x.text) - x.linked, 0) / (1 + x.tags) for x in lines])
    return np.minimum(ratio, p.length * 4)


def _ratios(lines: list[Line], p: ExtractParams) -> np.ndarray:
    """The ratios, smoothed by a Gaussian."""
    ratio = _own(lines, p)
    reach = max(1, int(3 * p.sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / p.sigma) ** 2)
    padded = np.concatenate([np.full(reach, 0.0), ratio, np.full(reach, 0.0)])
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def main_text(html: str, params: ExtractParams | None = None) -> str:
    """Text of the content region of one page.

    Lines whose smoothed ratio lies above the threshold are content. All of them are kept that
    lie above it themselves, not by their neighbours' weight alone, with the short blocks beside
    them in their element. Every article or main element with content is kept with all its
    blocks, and so is the element that holds most of the content: one named as such, or else the
    smallest with nearly all of it. Menus, forms and the like are never kept.
    """
    p = params or ExtractParams()
    page = Page()
    page.feed(html)
    page.close()
    page._flush()
    if page.marks:
        settle(page, p)
    lines = page.lines
    if not any(not x.boiler for x in lines):
        return ""
    smooth = _ratios(lines, p)
    clear = np.array([not x.boiler for x in lines])
    least = min(p.threshold * smooth.std(), smooth[clear].max())
    content = clear & (smooth >= least)
    weight = np.array([len(x.text) - x.linked for x in lines], float) * content
    mass: dict[int, float] = {}
    for x, w in zip(lines, weight, strict=True):
        for n in x.path:
            mass[n] = mass.get(n, 0.0) + w
    regions = _regions(page, lines, mass, weight.sum())
    taken = clear & np.array([not regions or not regions.isdisjoint(x.path) for x in lines])
    own = _own(lines, p)
    for i in np.flatnonzero(content & ~taken & (own >= least)):
        _grow(page, lines, int(i), clear, taken)
    return " ".join(x.text for x, t in zip(lines, taken, strict=True) if t)


def _regions(page: Page, lines: list[Line], mass: dict[int, float], total: float) -> set[int]:
    """Elements that are kept whole; none stands for the page."""
    found = {n for n in mass if page.kinds.get(n) == "content" and mass[n] > 0}
    if found:
        return found
    named = [n for n in mass if page.kinds.get(n) == "named" and mass[n] >= 0.5 * total and mass[n] > 0]
    if named:
        return {max(named, key=lambda n: (round(mass[n], 6), n))}
    best = max((n for n in mass if mass[n] >= 0.8 * total), default=None)  # the innermost: numbers grow inwards
    path = next((x.path[: x.path.index(best) + 1] for x in lines if best in x.path), ())
    if len(path) > 1 and all(x.path[-1] == best for x in lines if best in x.path):
        siblings = path[-2]  # a lone block: its neighbours belong to it
        best = siblings if mass.get(siblings, 0) >= 0.8 * total else best
    return set() if best is None else {best}


def _grow(page: Page, lines: list[Line], i: int, clear: np.ndarray, taken: np.ndarray) -> None:
    """Takes line ``i`` and, on both sides, the blocks of its parent element that follow each
    other without a block from elsewhere, up to one that is mostly links."""
    blocks = [n for n in lines[i].path if n not in page.inline]
    parent = tuple(blocks[:-1])
    taken[i] = True
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(lines):
            path = tuple(n for n in lines[j].path if n not in page.inline)
            if not clear[j] or taken[j] or path[: len(parent)] != parent or 2 * lines[j].linked > len(lines[j].text):
                break
            taken[j] = True
            j += step


def extract_pages(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), params: ExtractParams | None = None) -> DataFrame:
    """One row per page: ``page_id``, the ``keep`` columns, ``text`` and ``n_chars``.

    Null or empty html gives empty text. Broken markup is read as far as it goes. Repeated rows
    are answered one by one; other columns are ignored.
    """
    p = params or ExtractParams()
    pages = df.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                text = [main_text(h, p) if h else "" for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    names=[*part.schema.names[:-1], "text", "n_chars"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    return pages.mapInArrow(run, f"{schema}, text string, n_chars long")
