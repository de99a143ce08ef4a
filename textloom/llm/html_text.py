"""Main text of web pages (operator 7): parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's streaming parser turns a page into lines, one a block: text, number of tags, characters in links and
the elements that hold it. Elements such as script and style have no text. Areas that are not article text are dropped: nav,
header, footer, aside and form, hidden elements, and elements of which a whole class or id token or the role says advert,
sidebar, notice or comments. An area stays, without the areas inside it, where it holds an article or main element (but for
nav, aside, footer, hidden and comment areas, which have articles of their own) or most of the text of the cluster (see below);
a header inside an article or main element holds its headline and is no area;
those areas, and areas of one block, must hold nine tenths of it. An open head ends at the body or the first other element.
Each line's ratio of text to tags is smoothed along the page; lines above the threshold are the content cluster. Article
and main elements whose own ratio is below the threshold are teasers and go, unless they hold half of the cluster's text.
The region is then chosen: the article or main elements left, where they hold most of the cluster's text, else the smallest
element of two lines or more that holds nine tenths of it. Link lists inside the region go; all its other lines are the text, also short ones,
which a threshold alone would lose.

Defined results: a null or empty page gives an empty text; broken markup is read as far as the parser's events go, with
unclosed elements ending where an outer one ends; a page without any cluster gives the lines it has; character references
are decoded; white space within a line becomes one space, and lines are joined by one; nothing is cut short; repeated rows
give equal results; an empty table gives an empty result; other columns pass through, whatever their names
(but for ``__ht_text`` itself, which is replaced). A page costs time in proportion to its length, however deep it nests.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements without article text, and elements that are dropped unless they turn out to hold it.
NO_TEXT = frozenset("head title script style noscript template button select option textarea input iframe object svg math canvas audio video".split())
AREAS = frozenset("nav header footer aside form menu dialog".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
WORD = r"(?:ads?|advert[^\W_]*|adsense|sponsor[^\W_]*|promo[^\W_]*|banner|side-?bar|comments?|reply|replies|respond|disqus|notice|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend[^\W_]*|menu|nav[^\W_]*|breadcrumbs?|pagination|pager|header|footer|masthead|toolbar|widgets?|skip)"
#: A whole class token: labels, with words of place before them and words of kind behind them; not has-sidebar or no-header.
LABEL = re.compile(rf"(?:(?:site|page|global|top|bottom|left|right|reader|user|visitor)[_-])*{WORD}(?:[_-](?:{WORD}|area|section|list|box|bar|block|container|wrapper|wrap|slot|unit|column|links?|buttons?|items?|top|bottom|left|right))*", re.I)
#: Areas that often outweigh their article, or hold articles of their own.
OTHERS = re.compile(r"comments?|reply|replies|respond|disqus|related|recommend\w*|consent|cookies?|gdpr|modal|popup|overlay", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
MAIN = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Tree:
    """Numbers of nested things, in the order in which they open: a parent's number is smaller. 0 holds all."""

    def __init__(self):
        self.parent = [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        return len(self.parent) - 1

    def up(self, values: dict[int, int]) -> list[int]:
        """Sums of each node and all below it."""
        out = [0] * len(self.parent)
        for k, v in values.items():
            out[k] += v
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def spread(self, values: dict[int, set[int]]) -> list[int]:
        """How many of the given numbers, two at most, lie in each node or below it."""
        low, high = [1 << 62] * len(self.parent), [-1] * len(self.parent)
        for k, v in values.items():
            low[k], high[k] = min(v), max(v)
        for k in range(len(low) - 1, 0, -1):
            p = self.parent[k]
            low[p], high[p] = min(low[p], low[k]), max(high[p], high[k])
        return [0 if h < 0 else 1 + (h > l) for l, h in zip(low, high)]

    def down(self, marked) -> list[bool]:
        """Whether each node is marked or lies in one that is."""
        out = [False] * len(self.parent)
        for k in range(1, len(out)):
            out[k] = k in marked or out[self.parent[k]]
        return out


class Lines(HTMLParser):
    """Lines of a page as (pieces, tags, innermost element, innermost main element).

    A piece is (text, in a link, innermost area that may be dropped), and a tag stands as its area: which areas go is known only
    when the whole page has been read. Elements, areas and main elements point to those around them, so that the time a page
    takes grows with its length, however deep it nests.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int, int]] = []  # name, element, no text, main element, area
        self.names: Counter = Counter()  # of the open elements
        self.lines: list[tuple[list, list, int, int]] = []
        self.pieces: list[tuple[str, bool, int]] = []
        self.tags: list[int] = []
        self.elements, self.areas, self.mains = Tree(), Tree(), Tree()
        self.others: set[int] = set()  # areas of other people's text
        self.asides: set[int] = set()  # areas that hold articles of their own
        self.holders: set[int] = set()  # areas around a main element

    def flush(self):
        if any(not x[0].isspace() for x in self.pieces):
            self.lines.append((self.pieces, self.tags, self.open[-1][1] if self.open else 0, self.open[-1][3] if self.open else 0))
        self.pieces, self.tags = [], []

    def handle_starttag(self, tag, attrs):
        if self.names["head"] and (tag == "body" or self.open[-1][0] == "head" and tag not in IN_HEAD):
            self.close_to("head")
        if tag in CLOSES_P:
            self.close_to("p")
        elif tag in ("li", "tr", "td", "th", "dt", "dd", "option") and self.open and self.open[-1][0] == tag:
            self.close_to(tag)
        _, element, empty, main, area = self.open[-1] if self.open else ("", 0, False, 0, 0)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.pieces.append((" ", False, area))
            if not empty:
                self.tags.append(area)
            return
        if tag not in INLINE:
            self.flush()
        if not empty:
            self.tags.append(area)
        own = dict(attrs)
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "").lower()
        tokens = () if tag in ("html", "body", *MAIN) else [x for k in ("class", "id") for x in (own.get(k) or "").split() if LABEL.fullmatch(x)]
        titles = tag == "header" and main and not hidden  # an article's own header holds its headline
        if (tag in AREAS and not titles) or hidden or tokens or (own.get("role") or "").lower() in ROLES:
            area = self.areas.add(area)
            if hidden or tag == "dialog" or any(OTHERS.search(x) for x in tokens):
                self.others.add(area)
            if tag in ("nav", "aside", "footer"):
                self.asides.add(area)
        if tag in MAIN or own.get("role") == "main":
            main = self.mains.add(main)
            around = area
            while around and around not in self.holders:
                self.holders.add(around)
                around = self.areas.parent[around]
        self.open.append((tag, self.elements.add(element), empty or tag in NO_TEXT, main, area))
        self.names[tag] += 1

    def close_to(self, tag):
        if not self.names[tag]:
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        if any(x[0] not in INLINE for x in self.open[i:]):
            self.flush()
        for x in self.open[i:]:
            self.names[x[0]] -= 1
        del self.open[i:]

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.close_to(tag)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.close_to("head")
        if self.open and self.open[-1][2]:
            return
        self.pieces.append((data, self.names["a"] > 0, self.open[-1][4] if self.open else 0))

    def without(self, areas: set[int]) -> list[tuple]:
        """Lines as (text, tags, characters in links, element, main element), without the text of ``areas``."""
        gone = self.areas.down(areas)
        out = []
        for pieces, tags, element, main in self.lines:
            left = [x for x in pieces if not gone[x[2]]]
            text = " ".join("".join(x[0] for x in left).split())
            if text:
                out.append((text, sum(not gone[x] for x in tags), sum(len(x[0]) for x in left if x[1]), element, main))
        return out

    def dropped(self) -> set[int]:
        """The areas that go: not those around a main element, nor those with most of the cluster's text."""
        areas = set(range(1, len(self.areas.parent)))
        lines = self.without(set())
        if not areas or not lines:
            return areas
        sizes, where, total = Counter(), {}, 0
        for i in chosen_cluster(lines)[1]:
            for data, linked, area in self.lines[i][0]:
                n = 0 if linked else len(data.strip())
                total += n
                sizes[area] += n
                where.setdefault(area, set()).add(i)
        held, blocks = self.areas.up(sizes), self.areas.spread(where)
        # a lone block, a footer or comments can outweigh a short article: they must hold nearly all
        nearly = lambda a: a in self.others or a in self.asides or blocks[a] < 2
        most = {a for a in areas if held[a] * 10 > total * (9 if nearly(a) else 5)}
        return areas - most - (self.holders - self.others - self.asides)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def chosen_cluster(lines: list[tuple]) -> tuple[float, list[int]]:
    """The threshold, and the lines whose smoothed text-to-tag ratio reaches it."""
    ratios = smoothed([max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _, _ in lines])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    threshold = min(deviation, mean)
    return threshold, [i for i, r in enumerate(ratios) if r >= threshold] or list(range(len(lines)))


def without_teasers(lines: list[tuple], mains: Tree, cluster: list[int], threshold: float) -> list[int]:
    """Lines outside main elements that are below the threshold as wholes and hold less than half of the cluster's text."""
    text, tags, held = Counter(), Counter(), Counter()
    chosen, total = set(cluster), sum(len(lines[i][0]) for i in cluster)
    for i, (words, n, linked, _, m) in enumerate(lines):
        text[m] += max(0, len(words) - linked)
        tags[m] += n
        held[m] += len(words) if i in chosen else 0
    text, tags, held = mains.up(text), mains.up(tags), mains.up(held)
    teasers = mains.down({m for m in range(1, len(held)) if text[m] / max(1, tags[m]) < threshold and held[m] * 2 < total})
    return [i for i, x in enumerate(lines) if not teasers[x[4]]]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.without(parser.dropped())
    if not lines:
        return ""
    threshold, cluster = chosen_cluster(lines)
    kept = without_teasers(lines, parser.mains, cluster, threshold)
    if any(i in set(cluster) for i in kept):
        number = {old: new for new, old in enumerate(kept)}
        lines, cluster = [lines[i] for i in kept], [number[i] for i in cluster if i in number]
    total = sum(len(lines[i][0]) for i in cluster)
    by_main = sum(len(lines[i][0]) for i in cluster if lines[i][4])
    if by_main * 2 > total:
        inside = [i for i, x in enumerate(lines) if x[4]]
    else:
        sizes, blocks = Counter(), Counter(x[3] for x in lines)
        for i in cluster:
            sizes[lines[i][3]] += len(lines[i][0])
        sizes, blocks = parser.elements.up(sizes), parser.elements.up(blocks)  # a lone block would leave its headline outside
        region = next((e for e in range(len(sizes) - 1, 0, -1) if sizes[e] * 10 >= total * 9 and blocks[e] > 1), None)
        under = parser.elements.down({region})
        inside = [i for i, x in enumerate(lines) if region is None or under[x[3]]]
    chosen = set(cluster)
    links = lambda i: lines[i][2] * 2 > len(lines[i][0])
    # link lists: runs of links, of which the cluster holds at most the line at each end that smoothing lends it
    gone: set[int] = set()
    for _, run in itertools.groupby(inside, links):
        run = list(run)
        if len(run) > 1 and links(run[0]) and (len(run) > 2 or not chosen.issuperset(run)) and not chosen.intersection(run[1:-1]):
            gone.update(run)
    inside = [i for i in inside if i not in gone]
    first, last = 0, len(inside)
    while first < last and inside[first] not in chosen and links(inside[first]):  # single links at the region's ends
        first += 1
    while first < last and inside[last - 1] not in chosen and links(inside[last - 1]):
        last -= 1
    return " ".join(lines[i][0] for i in inside[first:last])


def _extract(names: list[str], html_col: str):
    def run(batches):
        for batch in batches:
            text = pa.array([main_text(h) if h else "" for h in batch.column(html_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text], names=[*names, "__ht_text"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html column, with ``__ht_text``, the main text."""
    rest = [c for c in pages.columns if c not in (html_col, "__ht_text")]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("__ht_text", T.StringType())])
    return pages.select(*rest, F.col(html_col).cast("string").alias(html_col)).mapInArrow(_extract(rest, html_col), schema)


def op7(spark, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__ht_text").alias("text"), F.length("__ht_text").cast("long").alias("n_chars"))


OP7_SQL = None
