"""Main text of web pages by maximum-scoring subsequence.

A page is scanned once into words and tags. Each word scores by where it stands, each tag below zero, and a
linear scan finds the contiguous region of greatest sum. All weights are log-odds of lying in the main text,
counted over the pages of labelled_pages: of a container by its tag, its class and id words and its role, in
the page's article or outside; of a section by the words of its heading; of a block that is one link; of
single words; and of all other words by whether the page has an article and they are in it. A container's
weight comes from all it has; one that holds the article itself, or nearly all of the page, tells nothing. A
container or section below zero inside the region is left out of its text, and weighs as a gap.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import labelled_pages
from skein.llm.worker import lean, small_batches

#: A quoted value may hold anything if it ends before a space or the tag's end; a quote that doesn't is a mark like
#: others. A tag that another one follows before its end, ends there.
TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>"'<]*)((?:[^<>"']++|"[^"]{0,2000}+"(?=[\s/>])|'[^']{0,2000}+'(?=[\s/>])|["'])*+)(?:>|(?=<)|\Z)|!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
#: Elements whose content is no markup; a closing tag ends them.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img label nobr input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that opens ends an open one of these kinds directly around it.
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[^\W\d_]+|©")
#: Weight of a container from which its text is left out; of a heading's words on average; of a left-out word as a gap; share of a page's words that tells nothing.
OUT, HEAD_OUT, GAP, NEARLY_ALL = -0.6, -1.0, -0.1, 0.9
#: Weight of a short block's single words, on average, against that of its place.
TELLING = 2.7


@dataclass
class Page:
    """Elements (0 is the page) and items in page order: (text, element, linked, section) or (None, tag, 0, 0)."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    parents: list[int] = field(default_factory=lambda: [-1])
    items: list[tuple] = field(default_factory=list)
    places: list[int] = field(default_factory=list)  # where each item is in the markup

    def totals(self) -> tuple[list[int], list[int]]:
        """Words in each element, and those of them in links."""
        words, linked = [0] * len(self.tags), [0] * len(self.tags)
        for text, at, link, _ in self.items:
            if text is not None:
                n = len(text.split())
                words[at] += n
                linked[at] += n * link
        for e in range(len(self.tags) - 1, 0, -1):  # children come after their parents
            words[self.parents[e]] += words[e]
            linked[self.parents[e]] += linked[e]
        return words, linked

    def zones(self, words: list[int], linked: list[int]) -> tuple[list[str], int]:
        """Of each element: in (the article), main (what else its main element holds), beside, or none if the page has no article; and the article."""
        best, article = 0, 0
        for e, tag in enumerate(self.tags):
            if tag in ("article", "main") or "role=main" in self.names[e] or "role=article" in self.names[e]:
                plain = words[e] - linked[e]
                if plain * 4 < words[0] - linked[0]:
                    continue  # a card, say, on a page whose text lies elsewhere
                if plain > best or (article and self._within(e, article) and words[e] * 5 >= words[article] * 3):
                    best, article = max(best, plain), e
        if not article:
            return ["none"] * len(self.tags), 0
        zones, around = ["beside"] * len(self.tags), set()
        e = self.parents[article]
        while e > 0:
            if self.tags[e] in ("article", "main") or "role=main" in self.names[e]:
                around.add(e)
            e = self.parents[e]
        for e in range(1, len(self.tags)):
            above = zones[self.parents[e]]
            zones[e] = "in" if e == article or above == "in" else "main" if e in around or above == "main" else "beside"
        return zones, article

    def _within(self, e: int, outer: int) -> bool:
        return self.ends[outer] >= e > outer

    ends: list[int] = field(default_factory=lambda: [1 << 60])  # the last element inside each one


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role":
            out.append("role=" + value.lower())
        elif key == "hidden" or (key == "style" and HIDDEN.search(value)):
            out.append("hidden")
        elif key in ("class", "id"):
            out += [w.lower() for w in SPLIT_NAME.split(value) if w]
    return tuple(dict.fromkeys(out))


def parse(page: str, heading=lambda words: False) -> Page:
    """The elements and items of a page, in linear time. heading(words) tells whether a heading's section is no main text."""
    out, stack, count = Page(), [0], Counter()
    sections: dict[int, int] = {}  # open element -> level of the heading that its rest stands under
    fresh: set[int] = set()  # of these, those with nothing but the heading so far
    link = -1  # the element in which a link is open
    title: list[str] | None = None
    at = titled = 0

    def pop() -> None:
        nonlocal link
        e = stack.pop()
        count[out.tags[e]] -= 1
        out.ends[e] = len(out.tags) - 1
        if link == e:
            link = -1
        level = sections.pop(e, None)
        if level is not None and e in fresh and len(stack) > 1:  # a heading in a wrapper of its own
            sections[stack[-1]] = level
            fresh.add(stack[-1])
        fresh.discard(e)

    def text(value: str, where: int) -> None:
        if not value:
            return
        if title is not None:
            title.append(value)
        elif fresh and not value.isspace():
            fresh.clear()
        out.items.append((value, stack[-1], link >= 0, bool(sections) and title is None))
        out.places.append(where)

    for found in TAG.finditer(page):
        start = found.start()
        if start < at:  # inside what a raw element held
            continue
        text(page[at:start], at)
        at = found.end()
        tag = (found.group(2) or "").lower()
        if not tag:
            if found.group(4):
                text(html.escape(found.group(4)), start)
            continue
        if found.group(1):
            if tag in RAW or tag in VOID:
                continue
            if tag == "a":
                link = -1
            elif tag not in INLINE and count[tag]:
                if tag in HEADINGS and title is not None:
                    said = "".join(title)
                    title = None
                    level, parent = int(tag[1]), out.parents[stack[-1]] if out.tags[stack[-1]] == tag else stack[-1]
                    if level > 1 and heading(WORD.findall(html.unescape(said).lower())):
                        for i in range(titled, len(out.items)):
                            if out.items[i][0] is not None:
                                out.items[i] = (*out.items[i][:3], True)
                        if parent > 0:
                            sections[parent] = level
                            fresh.add(parent)
                    elif sections.get(parent, 0) >= level:
                        del sections[parent]
                        fresh.discard(parent)
                while True:
                    last = out.tags[stack[-1]]
                    pop()
                    if last == tag:
                        break
            out.items.append((None, tag, 0, 0))
            out.places.append(start)
            continue
        attributes = found.group(3)
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = stack[-1]
        elif tag not in INLINE and tag not in VOID:
            top = out.tags[stack[-1]]
            for ended in ENDS.get(tag, ("p",)):
                if top == ended:
                    pop()
                    top = out.tags[stack[-1]]
            if tag in HEADINGS:
                title, titled = [], len(out.items)
            out.tags.append(tag)
            out.names.append(_names(attributes) if attributes.strip() else ())
            out.parents.append(stack[-1])
            out.ends.append(1 << 60)
            stack.append(len(out.tags) - 1)
            count[tag] += 1
        out.items.append((None, tag, 0, 0))
        out.places.append(start)
    text(page[at:], at)
    while len(stack) > 1:
        pop()
    return out


def _blocks(page: Page) -> Iterator[list[int]]:
    """The text items of each block: what stands between two tags that aren't inline."""
    now: list[int] = []
    for i, (text, tag, _, _) in enumerate(page.items):
        if text is not None:
            now.append(i)
        elif tag not in INLINE and now:
            yield now
            now = []
    if now:
        yield now


@dataclass
class Weights:
    container: dict[tuple, float] = field(default_factory=dict)
    heading: dict[str, float] = field(default_factory=dict)
    word: dict[str, float] = field(default_factory=dict)
    zone: dict[str, float] = field(default_factory=dict)
    linked: float = 0.0
    tag: dict[str, float] = field(default_factory=dict)

    def is_out(self, words: list[str]) -> bool:
        """Whether a section under a heading of these words is no main text."""
        return 0 < len(words) <= 6 and sum(self.heading.get(w, 0.0) for w in words) / len(words) < HEAD_OUT

    def containers(self, page: Page, zones: list[str]) -> list[float]:
        out = []
        for e, (tag, names) in enumerate(zip(page.tags, page.names)):
            inside = zones[e] == "in" if e == 0 or zones[page.parents[e]] == "in" else False
            total = self.container.get((inside, "tag", tag), 0.0)
            for n in names:
                known = self.container.get((inside, n))
                if known is None:
                    known = self.container.get((not inside, n))
                if known is None and len(n) > 6 and "=" not in n:  # another ending
                    known = self.container.get((inside, n[:6] + "*"), 0.0)
                total += known or 0.0
            out.append(total)
        return out


def _odds(inside: float, outside: float, of: float = 1, others: float = 1) -> float:
    return math.log((inside + 0.1) / (of + 0.2)) - math.log((outside + 0.1) / (others + 0.2))


@lru_cache
def weights() -> Weights:
    """Log-odds of lying in the main text over the labelled pages: first of containers and headings, then, in what these leave, of blocks and words."""
    pages = []
    for marked in labelled_pages.PAGES:
        parts = marked.split("@@")
        spans, at = [], 0
        for i, part in enumerate(parts):
            if i % 2:
                spans.append((at, at + len(part)))
            at += len(part)
        pages.append((parse("".join(parts)), spans))
    w = Weights()

    def marks(page: Page, spans: list[tuple[int, int]]) -> list[bool]:
        return [any(a <= p < b for a, b in spans) for p in page.places]

    box: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
    heads: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for page, spans in pages:
        words, linked = page.totals()
        zones, _ = page.zones(words, linked)
        main, title = [0] * len(page.tags), defaultdict(str)
        for (text, e, _, _), mark in zip(page.items, marks(page, spans)):
            if text is not None:
                main[e] += len(text.split()) * mark
                title[e] += text
        for e in range(len(page.tags) - 1, 0, -1):
            main[page.parents[e]] += main[e]
        for e in range(1, len(page.tags)):
            if not words[e] or words[e] * 5 > words[0] * 4:
                continue
            side = 0 if main[e] * 2 >= words[e] else 1
            inside = zones[page.parents[e]] == "in"
            box[inside, "tag", page.tags[e]][side] += 1
            for n in page.names[e]:
                box[inside, n][side] += 1
                if len(n) > 6 and "=" not in n:
                    box[inside, n[:6] + "*"][side] += 1
            if page.tags[e] in HEADINGS and page.tags[page.parents[e]] != "article" or main[e]:
                follows = any(main[x] * 2 < words[x] for x in range(e + 1, len(page.tags)) if page.parents[x] == page.parents[e] and words[x])
                for n in set(WORD.findall(html.unescape(title[e]).lower())):
                    heads[n][1 if follows and not main[e] else 0].add(title[e].lower())
    # A tag tells something only if it never holds main text; names tell as they are found.
    w.container = {k: _odds(a, b) for k, (a, b) in box.items() if k[1] != "tag" or not a}
    w.heading = {k: min(0.0, _odds(len(a), len(b))) for k, (a, b) in heads.items() if b}
    zone: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    link, single, tags, sums = [0.0, 0.0], defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0]), [0.0, 0.0]
    for page, spans in ((parse("".join(m.split("@@")), w.is_out), s) for m, (_, s) in zip(labelled_pages.PAGES, pages)):
        mark, (_, zones, left_out) = marks(page, spans), _judged(page, w)
        for (text, tag, _, _), m in zip(page.items, mark):
            if text is None:
                tags[tag][not m] += 1
        for block in _blocks(page):
            e, side = page.items[block[0]][1], 0 if mark[block[0]] else 1
            said = "".join(page.items[i][0] for i in block)
            if not said.strip():
                continue
            for n in set(WORD.findall(html.unescape(said).lower())):
                single[n][side] += 1
            sums[side] += 1
            if left_out[e] or page.items[block[0]][3]:
                continue
            whole_link = all(page.items[i][2] or page.items[i][0].isspace() for i in block)
            if zones[e] != "in":
                link[side] += whole_link
            if not whole_link:
                zone[zones[e]][side] += len(said.split())
    w.linked = min(-1.0, _odds(*link))
    w.word = {k: _odds(a, b, *sums) for k, (a, b) in single.items() if not a and b >= 3}
    w.zone = {k: _odds(a, b) for k, (a, b) in zone.items()}
    total = [sum(v[i] for v in tags.values()) for i in (0, 1)]
    w.tag = {k: min(-0.01, _odds(a, b, *total) - 0.5) * 0.2 for k, (a, b) in tags.items()}
    return w


def _judged(page: Page, w: Weights) -> tuple[list[int], list[str], list[bool]]:
    """(words, zone, whether it is left out) of each element."""
    words, linked = page.totals()
    zones, article = page.zones(words, linked)
    score = w.containers(page, zones)
    holds = set()
    e = article
    while e > 0:
        holds.add(e)
        e = page.parents[e]
    own = [0] * len(page.tags)  # words below zero at the outermost, by which nearly all is measured
    for e in range(1, len(page.tags)):
        if score[e] < OUT and e not in holds and not own[page.parents[e]]:
            own[e] = 1
        elif own[page.parents[e]]:
            own[e] = 2
    below = sum(words[e] for e in range(1, len(page.tags)) if own[e] == 1)
    out = [False] * len(page.tags)
    for e in range(1, len(page.tags)):
        if out[page.parents[e]]:
            out[e] = True
        elif score[e] < OUT and e not in holds and page.tags[e] not in ("html", "body"):
            rest = words[0] - (below - words[e] if own[e] == 1 else 0)
            out[e] = bool(article) or words[e] < NEARLY_ALL * rest
    return words, zones, out


def region(scores: list[float]) -> tuple[int, int]:
    """(start, stop) of the contiguous run of greatest sum, the first of equals; (0, 0) if none is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None) -> str:
    """The text of the best region: references decoded, white space in a block one space, blocks joined by newlines."""
    if not page:
        return ""
    w = weights()
    parsed = parse(page, w.is_out)
    _, zones, left_out = _judged(parsed, w)
    scores = [0.0] * len(parsed.items)
    gone = [False] * len(parsed.items)
    for i, (text, tag, _, _) in enumerate(parsed.items):
        if text is None:
            scores[i] = -0.001 if tag in INLINE else w.tag.get(tag, -0.02)
    for block in _blocks(parsed):
        e = parsed.items[block[0]][1]
        sizes = [len(parsed.items[i][0].split()) for i in block]
        if not any(sizes):
            continue
        zone = w.zone.get(zones[e], 1.0)
        drop = left_out[e] or parsed.items[block[0]][3]
        if not drop and zones[e] != "in":
            if all(parsed.items[i][2] or not n for i, n in zip(block, sizes)):
                zone, drop = w.linked, True
            else:
                said = WORD.findall(html.unescape("".join(parsed.items[i][0] for i in block)).lower()) if sum(sizes) <= 40 else ()
                telling = sum(w.word.get(n, 0.0) for n in said)
                if telling and zone + TELLING * telling / max(1, len(said)) < 0:
                    zone = telling / len(said)
        for i, n in zip(block, sizes):
            gone[i] = drop
            scores[i] = n * (GAP if drop and zone > 0 else zone)
    start, stop = region(scores)
    blocks, now = [], []
    for i in range(start, stop):
        text, tag, _, _ = parsed.items[i]
        if text is not None:
            if not gone[i]:
                now.append(text)
        elif tag not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages (page_id, url, html).

    A null, empty or all-boilerplate page gives the empty text. Null and repeated page_ids and urls pass
    through; other columns aren't read; an empty table gives no rows.
    """

    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
