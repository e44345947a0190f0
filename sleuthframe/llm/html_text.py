"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, and with it what is no text (scripts,
styles, form controls) or is named as menu, footer or the like. The text lengths of the lines,
links not counted, are summed over a sliding window; where the sums rise above a share of
their maximum is the surge point, where they fall below it again the dive point, and of all
such stretches the one with the most text holds the text. Distribution alone would cut the
short paragraphs at either end, so the stretch is widened over the neighbouring lines as long
as these are text by their density, most of their characters being outside links; up to
``window`` - 1 lines of links are passed if text follows. So menus and lists of links before
the surge and after the dive go, marked or not.

Two signs from the markup help. The stretch is clipped to, and widened within, the article or
main element (or the table cell that holds most of a page) with the larger part of its text,
if there is one. And a marked element takes no part: one with a class, id or role that is a
word of MARKED, or a compound with one that tells no layout or state ('site-footer', not
'has-sidebar'; weak words beside words of layout alone: 'related-posts', not 'related-work').
A marked element is kept all the same if it holds the page's main text: a <main>, the longest
article, or, on pages without an article or main element, most of the text outside links.
<aside> and <header> are kept for an article alone, readers' words also if a page has nothing
else.

A page is read once, in time proportional to its length however deep or broken its markup is.

Defined cases: null, empty or tagless html is one run of lines of body text (empty: the empty
text); unclosed tags, comments and scripts run to their implied end or the end of the page;
character references are decoded once; <br> is white space; the words of a button or label
count where they stand within other text; a page without any text outside links, or only
menus, headers, footers and asides, gives the empty text; repeated rows are extracted each; an
empty table gives no rows; columns of the input other than those returned are not read."""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer select option dialog menu object canvas audio video map".split())
#: Their content is no markup.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea iframe svg math title".split()}
#: Those that can hold the main text, as a form around the whole page does.
SOFT = frozenset(("form", "aside"))
#: Words that are text only among other text.
CONTROLS = frozenset(("button", "label", "legend"))
#: Words of class, id or role that mark what is not the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars aside menu menus nav navbar navigation navi breadcrumb breadcrumbs footer header masthead toolbar topbar comment comments respond reply replies discussion disqus share sharing social "
    "related recommended recommendations widget widgets login signin signup search pagination pager skip complementary contentinfo alert form".split()
)
#: Words that mark by themselves or beside one of BESIDE only: 'related-posts', not 'related-work'.
WEAK = frozenset(
    "notice notices promotion subscribe subscription aside comment reply replies respond discussion share sharing social related recommended recommendations login signin signup search skip alert form "
    "complementary overlay".split()
)
BESIDE = frozenset(
    "site page global main top bottom post posts article articles story stories news item items link links content list thread box bar block area section container wrapper wrap inner outer button buttons icons "
    "form field input widget title text body meta count author you more".split()
)
#: Words beside which 'header' is that of the site and not that of a text.
SITE = frozenset("header masthead site global main top nav navbar menu bar".split())
#: Words of a compound that tell how a page is laid out, or its state.
STATES = frozenset("has have no not non with without is open opened closed enabled disabled on off layout full hide show single supports".split())
#: Words that, as the id of a section within an article, name a part of the text.
CHAPTERS = WEAK | frozenset(("notification", "notifications", "advertising", "advertisement", "navigation", "consent", "search", "menu"))
#: Marked for what readers wrote: kept only if a page holds nothing else.
READERS = frozenset("comment comments respond reply replies disqus".split())
#: Elements whose class says how the page is laid out, not what they hold.
ROOTS = frozenset(("html", "body", "article", "main"))
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:\s|^)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[^a-z0-9]+")


def _is_mark(token: str, inside: bool) -> bool:
    words = [w for w in WORD.split(token) if w]
    found = MARKED.intersection(words)
    if not found or len(words) > 1 and not STATES.isdisjoint(words):
        return False
    if found <= {"header", "masthead"}:
        return not inside and SITE.issuperset(words)
    if len(words) == 1:
        return True
    return not found <= WEAK or all(w in MARKED or w in BESIDE or w.isdigit() for w in words)


@functools.lru_cache(maxsize=4096)
def _marks(attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Of an element's attributes: whether they mark it, whether anything but an id that can
    name a chapter does, and whether they mark what readers wrote."""
    marked = firm = readers = False
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            if _is_mark(token, inside):
                words = set(WORD.split(token))
                marked = True
                firm |= m[1].lower() != "id" or not MARKED & words <= CHAPTERS
                readers |= bool(READERS & words)
    return marked, firm, readers


class _Mark:
    """A marked element. ``tag``: its name alone marks it; ``readers``: readers wrote it;
    ``apart``: that or the former holds for it or one around it. ``every`` counts its
    characters outside links, ``plain`` those outside such elements, ``article`` those of its
    longest article."""

    __slots__ = ("up", "tag", "readers", "apart", "every", "plain", "main", "article", "gone")

    def __init__(self, up: _Mark | None, tag: bool, readers: bool):
        self.up, self.tag, self.readers = up, tag, readers
        self.apart = tag or readers or bool(up and up.apart)
        self.every = self.plain = self.article = 0
        self.main = self.gone = False


class _Zone:
    """An article, a main element or a table cell, and the characters outside links within."""

    __slots__ = ("up", "tag", "mark", "free")

    def __init__(self, up: _Zone | None, tag: str, mark: _Mark | None):
        self.up, self.tag, self.mark, self.free = up, tag, mark, 0


class _Open:
    __slots__ = ("tag", "drop", "mark", "zone", "control")

    def __init__(self, tag: str, drop: bool, mark: _Mark | None, zone: _Zone | None, control: bool):
        self.tag, self.drop, self.mark, self.zone, self.control = tag, drop, mark, zone, control


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, attributes): the text before each tag, a '/' before the name of a closing
    one. Comments, declarations and raw elements end where they close, or with the page."""
    at, text, end = 0, 0, html.rfind(">")
    last = {q: html.rfind(q) for q in "\"'"}
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            close, name = html.find("-->", at + 4), None
            after = len(html) if close < 0 else close + 3
        elif html.startswith("<![CDATA[", at):
            close = html.find("]]>", at)
            close = len(html) if close < 0 else close
            yield html[text:at] + html[at + 9 : close], "", ""
            at = text = close + 3
            continue
        elif html.startswith(("<!", "<?"), at):
            close, name = html.find(">", at), None
            after = len(html) if close < 0 else close + 1
        else:
            name = NAME.match(html, at + 1)
            if not name:
                at += 1
                continue
            if at > end:  # nothing closes a tag from here on
                break
            place = name.end()
            while (m := STOP.search(html, place)) and m[1]:
                if last[m[1]] < m.end():  # a quote that nothing closes
                    place = m.end()
                else:
                    place = html.find(m[1], m.end()) + 1
            if not m:
                break
            after = m.end()
        if name is None:
            yield html[text:at], "", ""
        else:
            tag, attributes = name[0].lower(), html[name.end() : after - 1]
            if tag in RAW:
                close = RAW[tag].search(html, after)
                after = close.end() if close else len(html)
                tag = ""
            yield html[text:at], tag, attributes
        at = text = after
    yield html[text:], "", ""


class Lines:
    """The lines of a page: texts, their characters outside links, and their zones."""

    def __init__(self, html: str):
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.marks: list[_Mark] = []
        self.zones: list[_Zone] = []
        self.held: list[tuple[str, int, _Mark | None, bool]] = []
        self.raw: list[tuple[list, _Zone | None]] = []
        self.dropped = self.controls = self.links = self.inside = 0
        self.own = self.bare = self.total = 0
        for text, tag, attributes in tokens(html):
            if text:
                self._words(text)
            if tag:
                self._close(tag[1:]) if tag[0] == "/" else self._open(tag, attributes.strip())
        self._pop(0)
        self._flush()
        self._judge()
        self.texts, self.sizes, self.dense, self.of = [], [], [], []
        for parts, zone in self.raw:
            parts = [p for p in parts if not (p[2] and p[2].gone)]
            text = " ".join("".join([p[0] for p in parts]).split())
            if text and any(p[3] and not p[0].isspace() for p in parts):
                self.texts.append(text)
                self.sizes.append(sum(p[1] for p in parts))
                self.dense.append(2 * self.sizes[-1] >= len(text))
                self.of.append(zone)

    def _mark(self) -> _Mark | None:
        return self.stack[-1].mark if self.stack else None

    def _zone(self) -> _Zone | None:
        return self.stack[-1].zone if self.stack else None

    def _flush(self) -> None:
        if self.held:
            self.raw.append((self.held, self._zone()))
            self.held = []

    def _words(self, raw: str) -> None:
        if self.dropped:
            return
        text, mark = unescape(raw), self._mark()
        self.held.append((text, 0 if self.links or self.controls else len(text), mark, not self.controls))
        size = 0 if self.links or self.controls else len(text.strip())
        self.total += size
        if mark:
            mark.every += size
        else:
            self.bare += size
        if not mark or not mark.apart:
            self.own += size
            if mark:
                mark.plain += size
        if zone := self._zone():
            zone.free += size

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            self.dropped -= gone.drop
            self.controls -= gone.control
            self.inside -= gone.tag in ("article", "main")

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in BLOCKS:
            self._flush()
            self.links = 0
        if self.places[tag]:
            depth = self.places[tag][-1]
            if self.stack[depth].drop:
                self._flush()
            self._pop(depth)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links = 1
        elif tag == "br":
            self._words(" ")
        block = tag in BLOCKS
        if block:
            self._flush()
            self.links = 0
            top = self.stack[-1].tag if self.stack else ""
            if top == "p" or top == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._pop(len(self.stack) - 1)
            if tag == "body" and self.places["head"]:
                self._pop(self.places["head"][0])
        if tag in VOID or attributes.endswith("/") and not block:
            return
        marked = firm = readers = False
        if attributes and tag not in ROOTS:
            marked, firm, readers = _marks(attributes, self.inside > 0)
            if self.inside and tag == "section":
                marked = firm
        named = tag in SOFT or tag == "header" and not self.inside
        drop = tag in DROPPED or tag not in ROOTS and bool(attributes) and bool(HIDDEN.search(attributes))
        control = tag in CONTROLS
        if not (block or drop or marked or control):
            return
        mark, zone = self._mark(), self._zone()
        if (marked or named) and not drop:
            if not block:
                self.held.append((" ", 0, mark, False))
            mark = _Mark(mark, tag in ("aside", "header"), readers)
            self.marks.append(mark)
        elif drop and not block:
            self.held.append((" ", 0, mark, False))
        if tag in ("article", "main", "td") and not self.dropped:
            zone = _Zone(zone, tag, mark)
            self.zones.append(zone)
        self.places[tag].append(len(self.stack))
        self.stack.append(_Open(tag, drop, mark, zone, control))
        self.dropped += drop
        self.controls += control
        self.inside += tag in ("article", "main")

    def _judge(self) -> None:
        """Sums of nested elements, and which marked ones go."""
        for zone in reversed(self.zones):
            if zone.up:
                zone.up.free += zone.free
        outside = 0
        for zone in self.zones:
            if zone.tag != "td":
                if zone.mark:
                    zone.mark.article = max(zone.mark.article, zone.free)
                    zone.mark.main |= zone.tag == "main" and zone.free > 0
                else:
                    outside = max(outside, zone.free)
        for mark in reversed(self.marks):
            if up := mark.up:
                up.every, up.plain = up.every + mark.every, up.plain + mark.plain
                up.article, up.main = max(up.article, mark.article), up.main or mark.main
        held = [m for m in self.marks if m.main or m.article > (max(outside, self.bare) if m.readers else outside)]
        if not held and not outside:
            held = [m for m in self.marks if not m.tag and (m.every == self.total > 0 if m.readers else 2 * m.plain > self.own)]
        kept = set(held)
        for mark in self.marks:
            mark.gone = mark not in kept or bool(mark.up and mark.up.gone)


def bounds(lengths: list[int], window: int = 3, share: float = 0.3) -> tuple[int, int] | None:
    """First and last line of the stretch between a surge and a dive that has the most text."""
    if not any(lengths):
        return None
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    floor = share * max(sums)
    best, start = (0, 0, 0), None
    for i, s in enumerate([*sums, -1]):
        if s >= floor and s > 0:
            start = i if start is None else start
        elif start is not None:
            last = min(len(lengths), i - 1 + window)
            best = max(best, (sum(lengths[start:last]), -start, last - 1))
            start = None
    first, last = -best[1], best[2]
    level = floor / window  # a window also covers short lines beside the text
    while first < last and lengths[first] < level:
        first += 1
    while last > first and lengths[last] < level:
        last -= 1
    return first, last


def zone_of(lines: Lines, first: int, last: int) -> tuple[int, int]:
    """The lines (from, to) within which a stretch is the text: those of the innermost zone
    with more than half of the stretch's text. A cell is one only with most of the page's
    text in more than one line."""
    held: dict[_Zone, int] = {}
    for zone, size in zip(lines.of[first : last + 1], lines.sizes[first : last + 1], strict=True):
        if zone:
            held[zone] = held.get(zone, 0) + size
    for zone in reversed(lines.zones):  # those within are later
        if zone.up and zone in held:
            held[zone.up] = held.get(zone.up, 0) + held[zone]
    spans: dict[_Zone, list[int]] = {}
    for k, zone in enumerate(lines.of):
        if zone:
            spans.setdefault(zone, [k, k])[1] = k
    for zone in reversed(lines.zones):
        if zone.up and zone in spans:
            a, b = spans[zone]
            have = spans.setdefault(zone.up, [a, b])
            have[0], have[1] = min(have[0], a), max(have[1], b)
    total, whole = sum(lines.sizes), sum(lines.sizes[first : last + 1])
    for zone in reversed(lines.zones):
        if 2 * held.get(zone, 0) > whole and zone in spans:
            a, b = spans[zone]
            if zone.tag != "td" or 2 * zone.free > total and b > a:
                return a, b
    return 0, len(lines.texts) - 1


def widened(dense: list[bool], first: int, last: int, low: int, high: int, gap: int) -> tuple[int, int]:
    """The stretch with the lines of text beside it, over at most ``gap`` lines of links."""
    for step in (-1, 1):
        at = first if step < 0 else last
        while True:
            near = next((k for k in range(at + step, at + step * (gap + 2), step) if low <= k <= high and dense[k]), None)
            if near is None:
                break
            at = near
        first, last = (at, last) if step < 0 else (first, at)
    return first, last


def main_text(html: str | None, window: int = 3, share: float = 0.3) -> str:
    lines = Lines(html or "")
    found = bounds(lines.sizes, window, share)
    if found is None:
        return ""
    low, high = zone_of(lines, *found)
    first, last = widened(lines.dense, max(low, found[0]), min(high, found[1]), low, high, window - 1)
    return "\n\n".join(lines.texts[first : last + 1])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, share: float = 0.3) -> DataFrame:
    """(page_id, url, text) of every row."""

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = pa.array([main_text(h, window, share) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["page_id", "url", "text"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(texts, "page_id long, url string, text string")


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


QUERIES = {"op6_html_text": op6_html_text}
ORACLE_SQL: dict[str, str] = {}
