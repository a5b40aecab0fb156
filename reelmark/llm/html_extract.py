"""Main-text extraction by wrapper induction.

Pages of a host are dealt into groups of about GROUP_PAGES. In a group every page's tree of block elements is aligned with a pivot page's
by simple tree matching: nodes match if their labels (tag, id and class words) do, and children are matched in order so that most nodes
of the two trees match. A text that stands at the same place in nearly all different articles of the group belongs to the template; varying
slots are content.

Slots that serve the site rather than the article (menus, page headers, footers, sidebars, notices, adverts, forms, comments, scripts)
vary as well; they are told by element, role and class names. A name only counts whole: `comments` or `ad-slot`, all of whose words speak of
what isn't the article or of a box for it. In a name with any other word (`comments-open`, `cookie-recipe`) the word is a hint, which only
counts against blocks made of links; so it does in paragraphs and headings of an article, if it isn't an advert's. Some words are weak, as
they name parts of articles too: inside an article they only count against blocks made of links, elsewhere only if they don't name most
of the page. If articles or a main part are marked, only their slots count; else lists and runs of links are dropped. A form is left out
unless it holds most of the text, as where a framework wraps the page in one; then its labels and controls are.

Defined cases: null or empty html gives empty text; broken or unclosed markup is read as far as it goes, at any depth; a lone page of a
host has no template and is judged by its slots alone; pages of one article count once as evidence, whatever surrounds it; null urls share
a host; repeated rows are extracted alike, those of one page_id and url beyond GROUP_PAGES once for all; an empty table gives an empty
result; page_id and url pass through, other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import stored
from reelmark.llm.url_filter import url_host

GROUP_PAGES, GROUP_BYTES = 128, 32 << 20
#: A list of more hosts is joined by shuffling, not broadcast.
BROADCAST_HOSTS = 100_000
#: Part of the different articles at which a text must stand to be template, the least number of them, and the least for a place inside a
#: marked article, where a few may well open or end alike. Headings of an article are never template.
TEMPLATE_SHARE, TEMPLATE_PAGES, TEMPLATE_ARTICLES = 0.8, 6, 10
#: Pairs of children up to which the table of scores is kept; longer lists are matched by halves, to as good a matching, in memory of one row.
TABLE_PAIRS = 4096

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg select".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCKS - frozenset("head html body td th tr tbody thead tfoot li dd dt caption legend summary figcaption".split())
_SIBLINGS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPES = frozenset("table ul ol dl div section article main aside nav body html form td th blockquote".split())
_ASIDE_TAGS = frozenset("nav footer aside head button dialog menu fieldset search".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
# Class words of what isn't the article, of page layout that may enclose it, and of what may as well be a part of it.
_ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts adsense adslot breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr menu nav navbar navigation newsletter "
    "notice notices outbrain pager pagination popup promo promoted promotion replies respond signup sponsored subscribe subscription taboola".split()
)
_LAYOUT_WORDS = frozenset("masthead modal overlay sidebar toolbar topbar".split())
_WEAK_WORDS = frozenset(
    "banner byline copyright disclaimer header meta reader recommended recommendations related share sharing skip social sponsor tags teaser widget widgets".split()
)
# Words of names that only say where or how a box stands, or what kind of box it is.
_BOX_WORDS = frozenset(
    "accept area bar base block body bottom box button buttons card center child close col column container content cta depth desktop element even fixed flex floating foot form forms frame global google "
    "grid group head holder icon info inline inner item items label large law layer leaderboard left level line link links list main message mid middle mobile mpu msg native new odd outer page panel parent "
    "place placeholder policy position post primary reader readers rectangle responsive right row secondary section side site skyscraper slot small space spot static sticky strip sub tertiary text thread "
    "toggle top unit user users view warning wide wrap wrapper x zone".split()
)
_ADVERT_WORDS = frozenset("ad ads adv advert advertisement adverts adsense adslot outbrain promo promoted sponsored taboola".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd li td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTED = frozenset("li ul ol dd dt td th".split())
_FRAME_WORDS = frozenset(["has", "no", "with", "without"])
_ARTICLE_WORDS = frozenset("articlebody entrycontent postcontent storybody articlecontent".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


#: How surely a slot is no content: it is, a word of its name hints so, a weak name says so, its layout does, it serves the site.
CONTENT, HINT, WEAK, LAYOUT, ASIDE = range(5)


@dataclass
class Run:
    """Text between the bounds of blocks: its node and place among the runs there, characters in links and number of links, in an article, one of CONTENT to ASIDE, in a form."""

    node: int
    place: int
    text: str
    link_chars: int
    links: int
    article: bool
    aside: int
    form: bool

    def linked(self) -> bool:
        return 2 * self.link_chars > len(self.text)


class Page:
    """Block elements in order of opening (parent, label, children) and runs of text."""

    __slots__ = ("parents", "labels", "children", "runs")

    def __init__(self, source: str) -> None:
        self.parents: list[int] = [-1]
        self.labels: list[str] = ["#"]
        self.children: list[list[int]] = [[]]
        self.runs: list[Run] = []
        self._read(source)

    def _read(self, source: str) -> None:
        # An open element: tag, node, aside, in article, in a link, in a form, a block.
        stack: list[tuple[str, int, int, bool, bool, bool, bool]] = [("#", 0, CONTENT, False, False, False, True)]
        pieces: list[str] = []
        link_chars, links, counts = 0, 0, Counter()

        def flush() -> None:
            nonlocal link_chars, links
            if pieces:
                if text := " ".join(html.unescape("".join(pieces)).split()):
                    _, node, aside, article, link, form, _ = stack[-1]
                    self.runs.append(Run(node, counts[node], text, link_chars, max(links, int(link)), article, aside, form))
                    counts[node] += 1
                pieces.clear()
            link_chars = links = 0

        def close(depth: int) -> None:
            if any(element[-1] for element in stack[depth:]):
                flush()
            del stack[depth:]

        at, n = 0, len(source)
        while at < n:
            opened = source.find("<", at)
            if opened < 0:
                opened = n
            if opened > at:
                pieces.append(source[at:opened])
                if stack[-1][4]:
                    link_chars += opened - at
            if opened == n:
                break
            m = _TOKEN.match(source, opened)
            if not m:
                pieces.append("<")
                at = opened + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not any(s[0] == "p" for s in stack):
                    flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                    if stack[depth][0] in _SCOPES and tag not in _BLOCKS:
                        break
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag in _VOID:
                pieces.append(" ")
                continue
            if tag in _CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][0] in _SCOPES:
                        break
            if tag in _SIBLINGS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in _SIBLINGS[tag]:
                        close(depth)
                        if tag != "tr":
                            break
                    elif stack[depth][0] in _SCOPES:
                        break
            _, node, aside, article, link, form, _ = stack[-1]
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
            named = f"{attributes.get('id', '')} {attributes.get('class', '')}" if attributes else ""
            words = [w.lower() for w in _WORDS.findall(named)] if named.strip() else []
            if tag in ("article", "main") and aside <= LAYOUT:
                aside, form = CONTENT, False
            form = form or tag == "form"
            aside = max(aside, self._aside(tag, attributes, named, article, form))
            article = article or tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody" or bool(words) and "".join(words) in _ARTICLE_WORDS
            block = tag in _BLOCKS or form and tag in ("label", "button")
            if block:
                flush()
                new = len(self.parents)
                self.parents.append(node)
                self.labels.append(f"{tag} {' '.join(w for w in words if not w.isdigit())}")
                self.children.append([])
                self.children[node].append(new)
                node = new
            links += tag == "a"
            if not m[3].endswith("/"):
                stack.append((tag, node, aside, article, link or tag == "a", form, block))
        flush()

    def tag(self, run: Run) -> str:
        return self.labels[run.node].split(" ", 1)[0]

    @staticmethod
    def _aside(tag: str, attributes: dict, named: str, article: bool, form: bool) -> int:
        if tag in _ASIDE_TAGS or tag == "header" and not article or form and tag in ("label", "legend"):
            return ASIDE
        if attributes and (attributes.get("role") in _ASIDE_ROLES or attributes.get("aria-hidden") == "true" or "hidden" in attributes):
            return ASIDE
        if tag in ("html", "body", "main"):
            return CONTENT
        return max((Page._named(name, article and tag in _TEXT_TAGS) for name in named.split()), default=CONTENT)

    @staticmethod
    def _named(name: str, article_text: bool) -> int:
        """What one class name or id says; article_text: of a paragraph or the like in an article."""
        words = {w.lower() for w in _WORDS.findall(name) if not w.isdigit()}
        # A frame that has or lacks a sidebar isn't one.
        if not words or not _FRAME_WORDS.isdisjoint(words):
            return CONTENT
        for kind, names in ((ASIDE, _ASIDE_WORDS), (LAYOUT, _LAYOUT_WORDS), (WEAK, _WEAK_WORDS)):
            if not names.isdisjoint(words):
                whole = words <= _ASIDE_WORDS | _LAYOUT_WORDS | _WEAK_WORDS | _BOX_WORDS
                return kind if whole and not (article_text and _ADVERT_WORDS.isdisjoint(words)) else HINT
        return CONTENT


class Matcher:
    """Simple tree matching of pages, whose equal subtrees are one shape, so what pages share is matched once.

    Two trees of equal root labels match in 1 node and the best ordered matching of their children. Equal shapes match whole, and where
    lists of children begin or end with equal shapes these belong together in some best matching, so only what lies between is tried.
    """

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def shapes(self, page: Page) -> list[int]:
        """The shape of each node's subtree."""
        out = [0] * len(page.parents)
        for node in range(len(out) - 1, -1, -1):
            key = (page.labels[node], tuple(out[c] for c in page.children[node]))
            if (number := self.numbers.get(key)) is None:
                number = self.numbers[key] = len(self.sizes)
                self.labels.append(key[0])
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
            out[node] = number
        return out

    def matching(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Number of nodes that two shapes of equal labels match in, and which children match."""
        if a == b:
            return self.sizes[a], [(k, k) for k in range(len(self.kids[a]))]
        waiting = [(a, b)]
        while waiting:
            pair = waiting[-1]
            if pair in self.found:
                waiting.pop()
                continue
            missing, ends = self._missing(*pair)
            if missing:
                waiting += missing
            else:
                self.found[pair] = self._match(*pair, *ends)
                waiting.pop()
        return self.found[a, b]

    def weight(self, a: int, b: int) -> int:
        return self.sizes[a] if a == b else self.found[a, b][0]

    def _missing(self, a: int, b: int) -> tuple[list[tuple[int, int]], tuple[int, int, int]]:
        one, two = self.kids[a], self.kids[b]
        lo, hi_a, hi_b = 0, len(one), len(two)
        while lo < hi_a and lo < hi_b and one[lo] == two[lo]:
            lo += 1
        while hi_a > lo and hi_b > lo and one[hi_a - 1] == two[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
        tried = {(x, y) for x in set(one[lo:hi_a]) for y in set(two[lo:hi_b]) if self.labels[x] == self.labels[y]}
        return [p for p in tried if p[0] != p[1] and p not in self.found], (lo, hi_a, hi_b)

    def _scores(self, one: tuple[int, ...], two: tuple[int, ...]) -> np.ndarray:
        """What the best ordered matching of all of `one` with each beginning of `two` gives, row by row of the table of scores."""
        weights: dict[int, np.ndarray] = {}
        kinds = {y: self.labels[y] for y in set(two)}
        row = np.zeros(len(two) + 1, np.int64)
        for x in one:
            if x not in weights:
                weights[x] = np.array([self.weight(x, y) if kinds[y] == self.labels[x] else 0 for y in two], np.int64)
            row[1:] = np.maximum(row[1:], row[:-1] + weights[x])
            np.maximum.accumulate(row, out=row)
        return row

    def _by_halves(self, one: tuple[int, ...], two: tuple[int, ...]) -> list[tuple[int, int]]:
        """A best ordered matching of long lists: where the first half of one ends best in the other, both halves are matched on their own."""
        pairs, waiting = [], [(0, len(one), 0, len(two))]
        while waiting:
            a, b, c, d = waiting.pop()
            if a == b or c == d:
                continue
            if b - a == 1 or (b - a) * (d - c) <= TABLE_PAIRS:
                pairs += self._by_table(one, two, a, b, c, d)
                continue
            middle = (a + b) // 2
            total = self._scores(one[a:middle], two[c:d]) + self._scores(one[middle:b][::-1], two[c:d][::-1])[::-1]
            cut = c + int(total.argmax())
            waiting += [(a, middle, c, cut), (middle, b, cut, d)]
        return sorted(pairs)

    def _by_table(self, one: tuple[int, ...], two: tuple[int, ...], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
        best = [[0] * (d - c + 1) for _ in range(b - a + 1)]
        for i in range(b - 1, a - 1, -1):
            label, row, below = self.labels[one[i]], best[i - a], best[i - a + 1]
            for j in range(d - 1, c - 1, -1):
                score = max(below[j - c], row[j - c + 1])
                if label == self.labels[two[j]]:
                    score = max(score, below[j - c + 1] + self.weight(one[i], two[j]))
                row[j - c] = score
        pairs, i, j = [], a, c
        while i < b and j < d:
            if best[i - a][j - c] == best[i - a + 1][j - c]:
                i += 1
            elif best[i - a][j - c] == best[i - a][j - c + 1]:
                j += 1
            else:
                pairs.append((i, j))
                i, j = i + 1, j + 1
        return pairs

    def _match(self, a: int, b: int, lo: int, hi_a: int, hi_b: int) -> tuple[int, list[tuple[int, int]]]:
        one, two = self.kids[a], self.kids[b]
        pairs = [(k, k) for k in range(lo)] + [(hi_a + k, hi_b + k) for k in range(len(one) - hi_a)]
        pairs += [(lo + i, lo + j) for i, j in self._by_halves(one[lo:hi_a], two[lo:hi_b])]
        return 1 + sum(self.weight(one[i], two[j]) for i, j in pairs), pairs

    def align(self, a: Page, b: Page) -> dict[int, int]:
        """Nodes of a by the nodes of b that they match."""
        shapes_a, shapes_b = self.shapes(a), self.shapes(b)
        matched = {0: 0}
        queue = [(0, 0)]
        while queue:
            x, y = queue.pop()
            for i, j in self.matching(shapes_a[x], shapes_b[y])[1]:
                pair = a.children[x][i], b.children[y][j]
                matched[pair[0]] = pair[1]
                queue.append(pair)
        return matched


def induce(pages: list[Page]) -> list[set[int]]:
    """For each page the numbers of its runs that belong to the template."""
    # Menus, adverts and footers of an article's copies may differ; they make it no other article.
    different: dict[tuple, int] = {}
    for k, page in enumerate(pages):
        different.setdefault(tuple(content(page, set())), k)
    if len(different) < TEMPLATE_PAGES:
        return [set() for _ in pages]
    evidence = set(different.values())
    pivot = max(sorted(evidence), key=lambda k: len(pages[k].parents))
    places, texts, matcher = [], defaultdict(Counter), Matcher()
    for k, page in enumerate(pages):
        at = matcher.align(page, pages[pivot])
        places.append([(at[r.node], r.place) if r.node in at else None for r in page.runs])
        if k in evidence:
            for place, run in zip(places[-1], page.runs, strict=True):
                if place is not None:
                    texts[place][run.text] += 1
    fixed = {(place, text) for place, own in texts.items() for text, m in own.most_common(1) if m >= TEMPLATE_SHARE * len(evidence)}
    cut = lambda page, run: not run.article or len(evidence) >= TEMPLATE_ARTICLES and page.tag(run) not in _HEADINGS
    return [{k for k, (place, run) in enumerate(zip(own, page.runs, strict=True)) if place is not None and (place, run.text) in fixed and cut(page, run)} for own, page in zip(places, pages, strict=True)]


def content(page: Page, template: set[int]) -> list[str]:
    """The texts of the content slots, in page order."""
    slots = [r for k, r in enumerate(page.runs) if k not in template and r.aside < LAYOUT]
    slots = [r for r in slots if r.article] or slots
    size = lambda runs: sum(len(r.text) - r.link_chars for r in runs)
    outside = [r for r in slots if not r.form]
    if 2 * size(outside) >= size(slots) and outside:
        slots = outside
    if any(r.article for r in slots):
        return [r.text for r in slots if r.aside == CONTENT or not r.linked()]
    weak = [r for r in slots if r.aside == WEAK]
    if 2 * size(weak) <= size(slots):
        slots = [r for r in slots if r.aside < WEAK]
    slots = [r for r in slots if r.aside != HINT or not r.linked()]
    # One block that is a link may be a sentence; several side by side, or in a list, are a menu.
    linked = [False, *(r.linked() for r in slots), False]
    in_list = lambda r: page.tag(r) in _LISTED
    return [r.text for k, r in enumerate(slots, 1) if not linked[k] or not (r.links > 1 or linked[k - 1] or linked[k + 1] or in_list(r))]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, template_slots) for every row of pages."""
    keyed = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host")).withColumn("key", F.xxhash64("page_id", "url"))
    # Only hosts of several groups are listed: at most one for GROUP_PAGES pages. The pages themselves move once, by host and group.
    many = F.greatest(F.ceil(F.count("*") / GROUP_PAGES), F.ceil(F.sum(F.octet_length("html")) / GROUP_BYTES)).cast("int")
    hosts = stored(keyed.groupBy("host").agg(many.alias("groups"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes")))
    groups = hosts.filter("groups > 1").select("host", "groups")
    size = hosts.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * GROUP_BYTES)))
    listed = F.broadcast(groups) if groups.count() <= BROADCAST_HOSTS else groups
    # Rows of one page by the hundred would be one group however many a host has: each different one goes once, with its number.
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_PAGES))
    once = keyed.withColumn("copies", F.lit(1).cast("long"))
    if not hot.isEmpty():
        counted = keyed.join(hot, "key", "left_semi").groupBy("page_id", "url", "html", "host", "key").agg(F.count("*").alias("copies"))
        once = once.join(hot, "key", "left_anti").unionByName(counted)
    part = F.pmod(F.col("key"), F.coalesce("groups", F.lit(1)))
    dealt = once.join(listed, "host", "left").withColumn("part", part).drop("groups", "key").repartition(tasks, "host", "part")

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page_id", kind="stable", ignore_index=True)
        parsed = [Page(x if isinstance(x, str) else "") for x in rows["html"]]
        templates = induce(parsed)
        texts = ["\n".join(content(p, t)) for p, t in zip(parsed, templates, strict=True)]
        return pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts], "template_slots": [len(t) for t in templates], "copies": rows["copies"]})

    read_once = dealt.groupBy("host", "part").applyInPandas(read, "page_id long, url string, text string, n_chars long, template_slots long, copies long")
    if hot.isEmpty():
        return read_once.drop("copies")
    return read_once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
