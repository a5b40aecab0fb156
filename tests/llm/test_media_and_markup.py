"""WebP, HTML extraction, chat formatting, URL filters and fingerprints on small tables against brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmark.llm import chat_format, fingerprint, html_extract, media, queries, url_filter, webp
from tests.compare import differences

# WebP ------------------------------------------------------------------------------------------------------------------------------------


class Writer:
    """Bits from the lowest up."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


class RandomPicture:
    """A random valid stream: what is written is chosen at random, and a decoder that follows the format step by step says what it means."""

    def __init__(self, rng: random.Random, width: int, height: int, transforms: list[int], cache_bits: int, meta: bool) -> None:
        self.rng, self.w, w = rng, Writer(), width
        self.w.put(0x2F, 8)
        self.w.put(width - 1, 14)
        self.w.put(height - 1, 14)
        self.w.put(1, 1)
        self.w.put(0, 3)
        undo = []
        for kind in transforms:
            self.w.put(1, 1)
            self.w.put(kind, 2)
            if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
                self.w.put(0, 3)
                across, down = (w + 3) // 4, (height + 3) // 4
                undo.append((kind, w, self.image(across, down, 0, False, top=False), across))
            elif kind == webp.SUBTRACT_GREEN:
                undo.append((kind, w, None, 0))
            else:
                n = rng.choice((2, 3, 9, 40))
                self.w.put(n - 1, 8)
                table = self.image(n, 1, 0, False, top=False)
                for k in range(1, n):
                    table[k] = sum((((table[k] >> s) + (table[k - 1] >> s)) & 255) << s for s in (0, 8, 16, 24))
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                undo.append((kind, w, table, pack))
                w = (w + (1 << pack) - 1) >> pack
        self.w.put(0, 1)
        pixels = self.image(w, height, cache_bits, meta, top=True)
        for kind, width_then, data, extra in reversed(undo):
            pixels = self.undo(kind, pixels, width_then, height, data, extra)
        self.pixels = pixels
        self.data = self.w.bytes()

    def code(self, alphabet: int, few: int, below: int = 0) -> list[tuple[int, int, int]]:
        """A random complete code as (symbol, bits, length), written to the stream."""
        rng = self.rng
        symbols = sorted(rng.sample(range(below or alphabet), min(below or alphabet, few)))
        if few <= 2 and max(symbols) < 256 and rng.random() < 0.7:
            self.w.put(1, 1)
            self.w.put(len(symbols) - 1, 1)
            self.w.put(1, 1)
            self.w.put(symbols[0], 8)
            if len(symbols) == 2:
                self.w.put(symbols[1], 8)
                return [(symbols[0], 0, 1), (symbols[1], 1, 1)]
            return [(symbols[0], 0, 0)]
        depths = [0]
        while len(depths) < len(symbols):
            k = rng.choice([i for i, d in enumerate(depths) if d < 13])
            depths[k : k + 1] = [depths[k] + 1] * 2
        if len(symbols) == 1:
            depths = [1]
        rng.shuffle(depths)
        lengths = [0] * alphabet
        for s, d in zip(symbols, depths, strict=True):
            lengths[s] = d
        # Lengths of lengths: 16 symbols of 4 bits; runs aren't used but for zeros now and then.
        self.w.put(0, 1)
        self.w.put(15, 4)
        own = {k: (4 if 0 < k <= 15 else 5 if k in (0, 18) else 0) for k in range(19)}
        for k in webp.CODE_LENGTH_ORDER:
            self.w.put(own[k], 3)
        codes = self.canonical([own[k] for k in range(19)])
        self.w.put(0, 1)
        k = 0
        while k < alphabet:
            run = next((r for r in range(138, 10, -1) if k + r <= alphabet and not any(lengths[k : k + r])), 0)
            if run and rng.random() < 0.8:
                self.w.put(*codes[18])
                self.w.put(run - 11, 7)
                k += run
            else:
                self.w.put(*codes[lengths[k]])
                k += 1
        if len(symbols) == 1:
            return [(symbols[0], 0, 0)]
        codes = self.canonical(lengths)
        return [(s, *codes[s]) for s in symbols]

    @staticmethod
    def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
        out, code = {}, 0
        for length in range(1, 16):
            for s, own in enumerate(lengths):
                if own == length:
                    out[s] = (int(f"{code:0{length}b}"[::-1], 2), length)
                    code += 1
            code <<= 1
        return out

    def image(self, width: int, height: int, cache_bits: int, meta: bool, top: bool, low: bool = False) -> list[int]:
        """low: pixels that number few groups of codes."""
        rng = self.rng
        self.w.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.w.put(cache_bits, 4)
        groups_of = [0]
        across = 1
        if top:
            self.w.put(int(meta), 1)
            if meta:
                self.w.put(0, 3)
                across = (width + 3) // 4
                groups_of = [(p >> 8) & 0xFFFF for p in self.image(across, (height + 3) // 4, 0, False, top=False, low=True)]
        count = max(groups_of) + 1
        groups = []
        for _ in range(count):
            green = self.code(256 + 24 + (1 << cache_bits if cache_bits else 0), rng.choice((1, 2, 6, 40)), 6 if low else 0)
            groups.append([green, *[self.code(256, rng.choice((1, 2, 5)), int(low)) for _ in range(3)], self.code(40, rng.choice((1, 4)))])
        out: list[int] = []
        cache = [0] * (1 << cache_bits)

        def put(colour: int) -> None:
            out.append(colour)
            if cache_bits:
                cache[((0x1E35A7BD * colour) & 0xFFFFFFFF) >> (32 - cache_bits)] = colour

        def value(symbol: int) -> tuple[int, int, int]:
            if symbol < 4:
                return symbol + 1, 0, 0
            extra = (symbol - 2) >> 1
            add = rng.randrange(1 << extra)
            return ((2 + (symbol & 1)) << extra) + add + 1, add, extra

        total = width * height
        while len(out) < total:
            x, y = len(out) % width, len(out) // width
            group = groups[groups_of[(y >> 2) * across + (x >> 2)] if meta else 0]
            choices = []
            for symbol, bits, length in group[0]:
                if symbol < 256 or symbol >= 280:
                    choices.append((symbol, bits, length, None))
                    continue
                copied, add, extra = value(symbol - 256)
                d_symbol, d_bits, d_length = rng.choice(group[4])
                number, d_add, d_extra = value(d_symbol)
                near = webp._NEAR[number - 1] if number <= 120 else None
                back = number - 120 if number > 120 else max(1, int(near[0] + near[1] * width))
                if back <= len(out) and len(out) + copied <= total:
                    choices.append((symbol, bits, length, (copied, back, [(add, extra), (d_bits, d_length), (d_add, d_extra)])))
            if not choices:
                raise StopIteration
            symbol, bits, length, copy = rng.choice(choices)
            self.w.put(bits, length)
            if copy:
                for v, n in copy[2]:
                    self.w.put(v, n)
                for _ in range(copy[0]):
                    put(out[-copy[1]])
            elif symbol >= 280:
                out.append(cache[symbol - 280])
            else:
                parts = []
                for k in (1, 2, 3):
                    s, b, n = rng.choice(group[k])
                    self.w.put(b, n)
                    parts.append(s)
                put(parts[2] << 24 | parts[0] << 16 | symbol << 8 | parts[1])
        return out

    @staticmethod
    def undo(kind: int, pixels: list[int], width: int, height: int, data: list[int] | None, extra: int) -> list[int]:
        split = lambda p: [(p >> s) & 255 for s in (24, 16, 8, 0)]
        join = lambda c: sum((v & 255) << s for v, s in zip(c, (24, 16, 8, 0), strict=True))
        signed = lambda v: v - 256 if v > 127 else v
        if kind == webp.SUBTRACT_GREEN:
            return [join([a, r + g, g, b + g]) for a, r, g, b in map(split, pixels)]
        if kind == webp.PALETTE:
            bits, coded = 8 >> extra, (width + (1 << extra) - 1) >> extra
            at = lambda x, y: (pixels[y * coded + (x >> extra)] >> 8 & 255) >> ((x & ((1 << extra) - 1)) * bits) & ((1 << bits) - 1)
            return [data[i] if (i := at(x, y)) < len(data) else 0 for y in range(height) for x in range(width)]
        if kind == webp.CROSS_COLOUR:
            out = []
            for k, p in enumerate(pixels):
                _, red_blue, green_blue, green_red = split(data[(k // width >> 2) * extra + (k % width >> 2)])
                a, r, g, b = split(p)
                delta = lambda t, c: (signed(t) * signed(c)) >> 5
                r = (r + delta(green_red, g)) & 255
                out.append(join([a, r, g, b + delta(green_blue, g) + delta(red_blue, r)]))
            return out
        out = []
        mean = lambda p, q: [(x + y) // 2 for x, y in zip(p, q, strict=True)]
        clamp = lambda v: max(0, min(255, v))
        for k, p in enumerate(pixels):
            x, y = k % width, k // width
            if not k:
                guess = [255, 0, 0, 0]
            elif not y:
                guess = split(out[-1])
            elif not x:
                guess = split(out[k - width])
            else:
                left, above, corner, beyond = (split(out[i]) for i in (k - 1, k - width, k - width - 1, k - width + 1))
                mode = data[(y >> 2) * extra + (x >> 2)] >> 8 & 15
                paeth = [left, above][sum(abs(t - c) for t, c in zip(above, corner, strict=True)) >= sum(abs(v - c) for v, c in zip(left, corner, strict=True))]
                half = [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, above), corner, strict=True)]
                guess = [
                    [255, 0, 0, 0], left, above, beyond, corner, mean(mean(left, beyond), above), mean(left, corner), mean(left, above), mean(corner, above), mean(above, beyond),
                    mean(mean(left, corner), mean(above, beyond)), paeth, [clamp(v + t - c) for v, t, c in zip(left, above, corner, strict=True)], half, [255, 0, 0, 0], [255, 0, 0, 0],
                ][mode]
            out.append(join([a + b for a, b in zip(split(p), guess, strict=True)]))
        return out


def test_random_streams_decode_as_the_format_says():
    made = []
    for seed in range(160):
        rng = random.Random(seed)
        kinds = rng.sample(range(4), rng.randint(0, 4))
        try:
            made.append(RandomPicture(rng, rng.randint(1, 21), rng.randint(1, 17), kinds, rng.choice((0, 0, 1, 4, 11)), rng.random() < 0.3))
        except (StopIteration, RuntimeError, IndexError):
            continue  # the random codes left no way to go on
    assert len(made) > 80
    decoded = webp.decode([m.data for m in made])
    for m, picture in zip(made, decoded, strict=True):
        assert picture.ravel().tolist() == m.pixels


def test_cut_off_data_are_refused():
    whole = webp.riff_pictures(webp.encode_grey(np.frombuffer(b"some text to store " * 40 + b" " * 8, np.uint8), np.array([0, 768]), 192)[0])[0]
    for n in (0, 1, 5, 30, len(whole) // 2):
        with pytest.raises((webp.WebPError, IndexError)):
            webp.decode([whole[:n]])


TEXTS = ["", None, "a", " ", "word " * 3000, "".join(map(chr, range(1, 256))) * 9, "ünï " * 100, "the same words again and again, the same words again and again. " * 50]


def test_payloads_come_back(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate([*TEXTS, "a"])], "doc_id long, text string, n_bytes string")
    rows = {r.doc_id: r for r in media.describe(media.store(docs)).collect()}
    for k, t in enumerate([*TEXTS, "a"]):
        raw = (t or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[2].media_sha256 == rows[len(TEXTS)].media_sha256 and rows[2].feature == rows[len(TEXTS)].feature  # equal texts, wherever they stand
    assert media.describe(media.store(docs.limit(0))).count() == 0


# HTML ------------------------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><a href=x>Menu {k}</a></nav>
<div class="cookie-notice">We use cookies {k}</div><div id="sidebar">Side {k}</div><article class="post"><h1>Head {k}</h1><p>First &amp; <b>bold {k}<br>line</b><p>Second&nbsp;&#233; {k}
</p><div class="ad-slot">Buy {k}</div><p>Read more on our site</p><ul><li>one {k}<li>two {k}</ul><div class="comments"><p>Nice {k}</p></div><form><input>Mail</form></article><footer>&copy; {k}</footer></body></html>"""


def test_articles_without_what_surrounds_them(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(k=f"n{k}")) for k in range(12)]
    rows += [(20, "http://b.example/1", None), (21, None, "<p>Alone <i>he</i>re</p><p>&lt;x&gt;"), (22, "http://c.example/", ""), (23, "http://d.example/", "<div>" * 3000 + "deep"), (3, "http://a.example/3", PAGE.format(k="n3"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect())
    expected = [(k, f"Head n{k}\nFirst & bold n{k} line\nSecond é n{k}\none n{k}\ntwo n{k}") for k in range(12)]
    expected += [(3, expected[3][1]), (20, ""), (21, "Alone here\n<x>"), (22, ""), (23, "deep")]
    assert got == sorted((k, t, len(t)) for k, t in expected)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_frames_and_fragments():
    read = lambda source: html_extract.content(html_extract.Page(source), set())
    assert read('<body class="x"><div class="layout with-sidebar"><div class="sidebar">s</div><p>text</p></div>') == ["text"]
    assert read("<main><p>in</main><p>out") == ["in"]
    assert read("a < b <b>c</b> &am; &amp &#x41;") == ["a < b c &am; & A"]
    assert read("<p>one<div>two</div>three</p>four") == ["one", "two", "three", "four"]
    assert read("<table><tr><td>1<td>2<tr><td>3</table><!-- <p>no --><script>x") == ["1", "2", "3"]
    assert read('<ul><li><a href="/">only</a> <a>links</a></ul><p>text with <a>one</a> link') == ["text with one link"]


def test_weak_words_lose_no_article():
    read = lambda source: html_extract.content(html_extract.Page(source), set())
    article = '<article class="post"><div class="article-header"><h1>Head</h1></div><p class="share">Share prices rise</p><section class="related-work"><p>Earlier work</p></section>{}</article>'
    assert read(article.format("")) == ["Head", "Share prices rise", "Earlier work"]
    assert read(article.format('<div class="share"><a>One</a> <a>Two</a></div><div class="ad-slot">Buy</div><ol class="comments"><li><article>Nice</article></ol>')) == ["Head", "Share prices rise", "Earlier work"]
    assert read('<article><div class="reader"><p>All of it</p></div></article>') == ["All of it"]
    assert read('<div class="header">Site</div><div class="text"><p>Longer text than that</p><p><a href="/">One block that is a link</a></p></div>') == ["Longer text than that", "One block that is a link"]
    assert read('<div class="reader"><p>All of the page</p></div><p>x</p>') == ["All of the page", "x"]
    assert read('<div class="content-sidebar-wrap"><main><p>in</main><div class="sidebar">out</div></div>') == ["in"]
    assert read("<div><p>text of a page</p><p><a>a</a></p><p><a>menu</a></p></div>") == ["text of a page"]
    assert read("<p>See <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here <video>no video</video></p>") == ["See x=2 here no video"]


def plain_matching(a, b) -> int:
    """Simple tree matching as it is written down: (label, children) trees, no short cuts."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(x, y))
    return 1 + best[-1][-1]


def test_alignment_matches_as_many_nodes_as_the_plain_matcher():
    rng = random.Random(16)

    def tree(depth: int):
        return rng.choice(["div", "ul", "section"]), [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []

    write = lambda t: f"<{t[0]}>{''.join(map(write, t[1]))}</{t[0]}>"
    matcher = html_extract.Matcher()
    for _ in range(150):
        one, two = ("#", [tree(3)]), ("#", [tree(3)])
        a, b = (html_extract.Page(write(t[1][0])) for t in (one, two))
        matched = matcher.align(a, b)
        assert len(matched) == plain_matching(one, two) == matcher.matching(matcher.shapes(a)[0], matcher.shapes(b)[0])[0]
        assert len(set(matched.values())) == len(matched)
        assert all(a.labels[x] == b.labels[y] and (x == 0 or matched[a.parents[x]] == b.parents[y]) for x, y in matched.items())


def test_long_lists_are_matched_as_well_as_by_the_plain_matcher(monkeypatch):
    """By halves, with a table of a few pairs, and lists of thousands."""
    rng = random.Random(8)
    monkeypatch.setattr(html_extract, "TABLE_PAIRS", 6)
    for _ in range(40):
        lists = [[(rng.choice(["ol", "ul", "section"]), [("div", [])] * rng.randrange(3)) for _ in range(rng.randrange(1, 25))] for _ in range(2)]
        a, b = (html_extract.Page("".join(f"<{t}>{'<div></div>' * len(x)}</{t}>" for t, x in own) + "<hr>x") for own in lists)
        matched = html_extract.Matcher().align(a, b)
        assert len(matched) == plain_matching(("#", lists[0]), ("#", lists[1]))
        assert len(set(matched.values())) == len(matched) and all(a.labels[x] == b.labels[y] for x, y in matched.items())
        assert sorted(matched.values()) == [matched[x] for x in sorted(matched)]
    many = [html_extract.Page("".join(f"<{t}><div></div></{t}>" for t in rng.choices(["ol", "ul"], k=2000))) for _ in range(2)]
    matched = html_extract.Matcher().align(*many)
    assert len(matched) > 2000 and all(many[0].labels[x] == many[1].labels[y] for x, y in matched.items())


def test_one_word_of_a_name_loses_no_article():
    read = lambda source: html_extract.content(html_extract.Page(source), set())
    assert read('<div class="post comments-open"><p>Body</p></div>') == ["Body"]
    assert read('<div class="post ad-free"><p>Body</p></div>') == ["Body"]
    assert read('<article class="menu-review"><p>Body</p></article>') == ["Body"]
    assert read('<div><p>Before it all</p></div><section class="promotion-chess"><p>Pawns</p></section>') == ["Before it all", "Pawns"]
    assert read('<h1 class="cookie-title">Biscuits</h1><div class="cookie-recipe"><p>Flour</p></div>') == ["Biscuits", "Flour"]
    assert read('<article><p class="notice">Note</p><p class="ad-hoc">As needed</p><p class="ad">Buy</p><div class="notice">We moved</div></article>') == ["Note", "As needed"]
    assert read('<div class="comments-open"><p>Body</p></div><div class="post-comments"><p>Nice</p></div><div id="top-ad">Buy</div><div class="adSlot-3">Buy</div>') == ["Body"]
    assert read('<div class="share-prices"><p>Up again</p></div><p>A much longer text stands beside it here</p>') == ["Up again", "A much longer text stands beside it here"]
    assert read('<div class="menu-review"><p>Text of it</p><p><a href="/">a</a></p></div>') == ["Text of it"]


def test_names_of_boxes_are_told_from_those_of_texts():
    aside = "comments-section navbar-fixed-top site-footer cookie-consent-banner newsletter-signup-form ad-300x250 google-ads-1 promo-box breadcrumb-list pagination-links post-navigation comment-42 user-comments adBanner comment-form cookie-law-info"
    assert {html_extract.Page._named(x, False) for x in aside.split()} == {html_extract.ASIDE}
    assert {html_extract.Page._named(x, False) for x in "comments-open ad-free menu-review promotion-chess cookie-recipe ad-hoc noticeable-birds".split()} <= {html_extract.HINT, html_extract.CONTENT}
    assert html_extract.Page._named("notice", True) == html_extract.HINT and html_extract.Page._named("ad", True) == html_extract.ASIDE


def test_forms_that_hold_the_page_are_opened():
    read = lambda source: html_extract.content(html_extract.Page(source), set())
    assert read('<form id="aspnet"><nav>Menu</nav><div><p>All of the body lies in here</p></div><label>Mail</label><input><button>Send</button></form>') == ["All of the body lies in here"]
    assert read("<form><article><h1>Head</h1><p>Text</p><form><label>Mail</label> now</form></article></form>") == ["Head", "Text"]
    assert read("<p>A text of some length stands here</p><form>Mail <input></form>") == ["A text of some length stands here"]
    assert read("<main><form><p>Long text of a main part in a form</p><label>Search</label></form></main>") == ["Long text of a main part in a form"]


def test_articles_may_open_and_end_alike():
    extracted = lambda sources: (lambda pages: [html_extract.content(p, t) for p, t in zip(pages, html_extract.induce(pages), strict=True)])([html_extract.Page(x) for x in sources])
    page = "<p>On every page</p><article><h2>Introduction</h2><p>{k}</p><p>The end.</p></article>"
    assert extracted([page.format(k=f"text {k}") for k in range(6)]) == [["Introduction", f"text {k}", "The end."] for k in range(6)]
    assert extracted([page.format(k=f"text {k}") for k in range(12)]) == [["Introduction", f"text {k}"] for k in range(12)]


def test_deep_pages_have_a_template():
    deep = lambda k: "<div>" * 800 + f"<p>On every page</p><p>Own text {k}</p>" + "</div>" * 800
    pages = [html_extract.Page(deep(k)) for k in range(8)]
    assert [html_extract.content(p, t) for p, t in zip(pages, html_extract.induce(pages), strict=True)] == [[f"Own text {k}"] for k in range(8)]


def test_a_page_of_many_rows_is_extracted_once(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "GROUP_PAGES", 4)
    rows = [(1, "http://a.example/1", "<p>one</p>")] * 30 + [(1, "http://a.example/1", "<p>two</p>")] * 3 + [(k, f"http://a.example/{k}", f"<p>page {k}</p>") for k in range(2, 6)] + [(None, None, None)] * 9
    got = sorted((str(r.page_id), r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted([("1", "one")] * 30 + [("1", "two")] * 3 + [(str(k), f"page {k}") for k in range(2, 6)] + [("None", "")] * 9)


def test_copies_are_no_template():
    pages = [html_extract.Page(PAGE.format(k="same")) for _ in range(30)]
    assert html_extract.induce(pages) == [set()] * 30


def test_copies_in_other_frames_are_no_template():
    page = "<nav>Menu {k}</nav><article>{text}</article><div class='ad-slot'>Buy {k}</div><footer>Foot {k}</footer>"
    text = lambda *parts: "".join(f"<p>{x}</p>" for x in parts)
    extracted = lambda sources: (lambda pages: [html_extract.content(p, t) for p, t in zip(pages, html_extract.induce(pages), strict=True)])([html_extract.Page(x) for x in sources])
    long = [f"long {k}" for k in range(9)]
    copies = [page.format(k=k, text=text(*long)) for k in range(5)]
    assert extracted(copies) == [long] * 5
    assert extracted(copies[:4] + [page.format(k=9, text=text("other"))]) == [long] * 4 + [["other"]]
    # Beside shorter articles a long one's tail is reached by its own copies only; a near copy changes a word of it.
    short = [[f"short {k}", f"end {k}"] for k in range(10)]
    near = [[f"near {k}", *long[1:]] for k in range(4)]
    assert extracted(copies + [page.format(k=f"s{k}", text=text(*x)) for k, x in enumerate(short + near)]) == [long] * 5 + short + near
    # What different articles share still is.
    assert extracted([page.format(k=k, text=text("Read more", *x)) for k, x in enumerate(short)]) == short


def test_extraction_equals_the_documents(spark, small):
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op2_extract_html(spark, small).collect()
    assert rows
    for r in rows:
        body = " ".join(r.text.split("\n", 1)[1].split())  # after the headline
        assert body == docs[int(__import__("re").search(r"/(\d+)", r.url.split("://")[1])[1])]


# Chats -----------------------------------------------------------------------------------------------------------------------------------

TURNS = [
    (1, 1, "assistant", "b<|im_end|>\n"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, "user\n<|x", "<\\|im_start|>\\<|<<|"), (2, 0, "user\n<|x", "<\\|im_start|>\\<|<<|"), (2, None, "assistant", "é日"),
    (None, 0, None, ""), (3, 0, "assistant", "<"), (3, 1, "assistant", "|im_end|>"), (4, 0, "assistant", "x" * 100_000),
]


def test_chats_read_back(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    for batch in (10_000, 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.conv_id: r for r in chat_format.digest_chats(chat_format.format_chats(turns)).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
        for conv in {t[0] for t in TURNS}:
            own = sorted((t for t in TURNS if t[0] == conv), key=key)
            every = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()
            loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
            r = got[conv]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(every).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_long_texts_are_copied_in_blocks(monkeypatch):
    rng = random.Random(19)
    texts = ["".join(rng.choice(["<", "|", "\\", "<|", "a", "é"]) for _ in range(rng.choice((0, 1, 30, 400)))) for _ in range(60)]
    roles = ["user<|" if k % 3 else "" for k in range(60)]
    whole = chat_format.assemble(pa.array(roles), pa.array(texts))
    plain = b"".join(b"<|im_start|>%b\n%b<|im_end|>\n" % tuple(__import__("re").sub(rb"<(\\*)\|", rb"<\\\1|", x.encode()) for x in pair) for pair in zip(roles, texts, strict=True))
    assert whole[0].tobytes() == plain
    monkeypatch.setattr(chat_format, "BLOCK_BYTES", 7)
    for a, b in zip(whole, chat_format.assemble(pa.array(roles), pa.array(texts)), strict=True):
        assert (a == b).all()
    monkeypatch.setattr(chat_format, "CHUNK_BYTES", 200)
    parts = list(chat_format._slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])))
    assert len(parts) > 5 and sum(len(p) for p in parts) == 60


def test_markers_can_not_be_forged():
    rng = random.Random(11)
    texts = ["".join(rng.choice(["<", "|", "\\", "im_end|>", "<|im_start|>", "a", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    out, offsets, starts, ends = chat_format.assemble(pa.array(["user"] * 500), pa.array(texts))
    whole = out.tobytes()
    assert whole.count(b"<|im_end|>") == 500 == whole.count(b"<|im_start|>")
    assert [t.decode() for _, t in chat_format.read_turns(whole)] == texts
    assert [chat_format._plain(whole[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == texts


# URLs ------------------------------------------------------------------------------------------------------------------------------------


def test_listed_rules(spark):
    cases = {
        "http://Www.Example.COM/en/1": ("www.example.com", "/en/1", "com/en/", "block"),
        "http://example.com/en/7x?a": ("example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://a.example.net/de/8#f": ("a.example.net", "/de/8", "example.net/de/8", "block"),
        "https://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "x://com/fr/?://org/es/": ("com", "/fr/", None, "allow"),
        "http://org": ("org", "", None, "allow"),
        "no scheme org/es/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://É.org/es/\n1": ("É.org", "/es/\n1", "org/es/", "block"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.union(pages), labels, queries.URL_RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge(pages.limit(0), labels, queries.URL_RULES).count() == 0


def test_mined_rules_block(spark):
    rng = random.Random(12)
    pages, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        pages.append((k, f"http://h{rng.randint(0, 3)}.example/{'casino' if bad else 'news'}/{k}/{'win' if bad and k % 8 else 'x'}"))
        if k < 200:
            labels.append((k, int(not bad), 0))
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()}
    assert all((got[k] == "block") == (k % 4 == 0) for k in got)


def plain_rules(rows: list[tuple[set[str], bool]], least: int, confidence: float) -> set[frozenset]:
    """Every combination of tokens that reaches both figures."""
    from itertools import combinations

    often = {t for t in set().union(*[r[0] for r in rows]) if sum(bad for own, bad in rows if t in own) >= least}
    sets = {frozenset(c) for own, _ in rows for n in range(1, len(own & often) + 1) for c in combinations(sorted(own & often), n)}
    out = set()
    for one in sets:
        bad, total = sum(b for own, b in rows if one <= own), sum(one <= own for own, _ in rows)
        if bad >= least and bad >= total * confidence:
            out.add(one)
    return out


def test_rules_of_any_length_equal_all_combinations(spark):
    rng = random.Random(15)
    shared = {f"s{k}" for k in range(4)}
    rows = []
    for _ in range(400):
        own = {t for t in ("a", "b", "c", "d", "e") if rng.random() < 0.7}
        # Only four tokens together tell; two always come together.
        bad = {"a", "b", "c", "d"} <= own and rng.random() < 0.9 or rng.random() < 0.1
        rows.append((own | shared | ({"x", "y"} if rng.random() < 0.5 else set()), bad))
    labelled = spark.createDataFrame([(k, sorted(own), bad) for k, (own, bad) in enumerate(rows)], "id long, tokens array<string>, bad boolean")
    items = url_filter.token_items(labelled, 20)
    rules = [(set(r["items"]), r.bad, r.total) for r in url_filter.mine(labelled, items).collect()]
    names = {r.token: r.item for r in items.collect()}
    assert len({names[t] for t in shared}) == 1 and names["x"] == names["y"]
    expected = plain_rules(rows, 20, 0.6)
    assert rules and max(len(r) for r, _, _ in rules) >= 4 and not [1 for r, _, _ in rules for o, _, _ in rules if o < r]
    for _ in range(300):
        url = set(rng.sample(["a", "b", "c", "d", "e", "s0", "x", "y", "q"], rng.randint(0, 7)))
        assert any(one <= url for one in expected) == any(r <= {names.get(t) for t in url} for r, _, _ in rules)


def test_what_all_urls_share_is_one_item(spark):
    labelled = spark.createDataFrame([(k, [f"t{i}" for i in range(40)] + [f"u{k}"], True) for k in range(60)], "id long, tokens array<string>, bad boolean")
    rules = url_filter.mine(labelled, url_filter.token_items(labelled, 20)).collect()
    assert [(r["items"], r.bad, r.total) for r in rules] == [(["t0"], 60, 60)]


def test_urls_equal_their_sql(spark, small):
    name = "op9_filter_urls"
    assert differences(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, small) == ""


def test_mix_equals_its_sql(spark, small):
    name = "op1_mix_sources"
    assert differences(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, small) == ""


# Fingerprints ----------------------------------------------------------------------------------------------------------------------------


def prints(*texts: str):
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    return fingerprint.fingerprints(np.frombuffer(b"".join(data), np.uint8), offsets)


def test_fingerprints_are_sums_of_paragraphs():
    a, b, c = "one two three four", "five six", "one two three four five"
    for k in range(2):
        whole, parts = prints(f"{a}\n{b}\n{c}")[k][0], [prints(x)[k][0] for x in (a, b, c)]
        assert (whole == parts[0] + parts[1] + parts[2]).all()
    other = prints(f"{c}\n{a}\n\n{b}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}\n{a}")
    assert (other[0][0] == other[0][1]).all() and (other[0][0] != other[0][2]).any()
    alone = [prints(t)[0][0].tolist() for t in ("x y z", "", "é\nü")]
    assert alone == prints("x y z", "", "é\nü")[0].tolist()


def plain_fingerprint(text: str) -> tuple[list[int], list[int], int]:
    """Paragraph by paragraph and triple by triple: sums of digests, and the triples themselves."""
    exact, triples = [0] * fingerprint.EXACT, []
    for line in text.encode().split(b"\n"):
        if line:
            digest = hashlib.blake2b(line).digest()
            exact = [(x + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % 2**64 for k, x in enumerate(exact)]
            words = [w for w in __import__("re").split(b"[\x20\x09-\x0d]+", line) if w]
            triples += [tuple(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [(line,)] if words else []
    return exact, triples, len(triples)


def test_fingerprints_equal_plain_sums():
    rng = random.Random(13)
    texts = ["", "\n\n", "one", "a b c d\n\na b c d\ne f", "é ü ö ä ß", " \t \n x "] + [" ".join(rng.choice("abcdefg\n") for _ in range(rng.randint(5, 200))) for _ in range(40)]
    exact, sketch, count = prints(*texts)
    for k, text in enumerate(texts):
        own, triples, n = plain_fingerprint(text)
        assert exact[k].tolist() == own and count[k] == n
        # The squared length of the sketch estimates that of the counts of triples; its sum of signs keeps their parity.
        assert int(sketch[k].view(np.int32).astype(int).sum()) % 2 == n % 2 and (n > 0 or not sketch[k].any())
    for a in range(len(texts)):
        for b in range(a):
            one, other = (plain_fingerprint(texts[k])[1] for k in (a, b))
            counts = [{t: x.count(t) for t in x} for x in (one, other)]
            apart = sum((counts[0].get(t, 0) - counts[1].get(t, 0)) ** 2 for t in {*one, *other})
            total = sum(v * v for c in counts for v in c.values())
            near = fingerprint.likeness(tuple(x[a : a + 1] for x in (exact, sketch, count)), tuple(x[b : b + 1] for x in (exact, sketch, count)))[0]
            if total:
                assert abs(near - max(0.0, 1 - apart / total)) < 0.5


def test_a_triple_may_come_very_often():
    one, other = prints("a " * 65_538), prints("a " * 65_538 + "\nb c d")
    assert 0.99 < fingerprint.likeness(one, other)[0] < 1
    assert fingerprint.deleted(fingerprint.rendered(other)[0], ["b c d"]) == fingerprint.rendered(one)[0]


def test_rows_without_an_id_and_copies_are_spread(spark):
    """A third without doc_id, a third copies of one row: no range is much above the mean, and each copy but the last is followed by its like."""
    rows = [(None, f"null {k} " + "x" * 200) for k in range(900)] + [(500, "copied " + "y" * 200)] * 900 + [(k, f"own {k} " + "z" * 200) for k in range(1, 901)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = fingerprint._once(docs.withColumn("key", F.xxhash64("text")))
    assert plain.count() == 1801 and plain.agg(F.sum("copies")).first()[0] == 2700
    bounds = [100 * k for k in range(1, 9)]
    sizes = [r["count"] for r in fingerprint._ranged(plain, bounds, 1, 9).groupBy("range").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    order = docs.withColumn("key", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), F.col("key").desc()).collect()
    expected = sorted((str(a.doc_id), hashlib.sha256(fingerprint.edited(a.text, b.text).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for limit in (1 << 25, 5000):
        assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprint.fingerprint_edits(docs, 4, limit).collect()) == expected


def test_no_family_of_strings_collides():
    from reelmark.llm.common import segment_hashes
    from reelmark.llm.shingles import shingle_sets

    text = "a"
    for _ in range(13):
        text += text.translate(str.maketrans("ab", "ba"))
        other = text.translate(str.maketrans("ab", "ba"))
        hashes = [int(segment_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in (text, other)]
        assert hashes[0] != hashes[1]
        sets = shingle_sets(pa.array([text, other]), 4)
        assert sets[0].tolist() != sets[1].tolist()
        words = prints(text, other)[0]
        assert (words[0] != words[1]).all()


def test_paragraphs_go_in_and_out_of_a_fingerprint():
    lines = ["one two three four", "five six", "", "é", "one two three four"]
    whole, start = (fingerprint.rendered(prints(t))[0] for t in ("\n".join(lines), ""))
    assert fingerprint.inserted(start, lines) == whole
    assert fingerprint.inserted(fingerprint.inserted(start, lines[3:]), lines[:3]) == whole
    assert fingerprint.deleted(whole, lines[1:]) == fingerprint.rendered(prints(lines[0]))[0]
    assert fingerprint.deleted(whole, lines) == start
    assert fingerprint.rendered(fingerprint.parsed(whole)) == [whole]


def test_segments_across_tiles_hash_alike(monkeypatch):
    from reelmark.llm import common

    data = np.frombuffer(random.Random(14).randbytes(5000), np.uint8)
    starts = np.arange(0, 4990, 7)
    ends = np.minimum(5000, starts + np.arange(len(starts)) % 9 * 40)
    ends = np.maximum(ends, starts)
    whole = common.segment_hashes(data, starts, ends)
    monkeypatch.setattr(common, "TILE", 64)
    assert (common.segment_hashes(data, starts, ends) == whole).all()


def test_edits_take_the_next_document(spark):
    texts = {3: "abcdef", 7: "é1é2", 5: None, 11: "", 900: "tail " * 400, 2: "first\nlines\nof the last", 12: "odd"}
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, n_chars string")
    order = sorted(texts, reverse=True)
    for partitions in (1, 3, 8):
        got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs, partitions).collect()}
        assert set(got) == set(texts)
        for k, doc_id in enumerate(order):
            own, after = texts[doc_id] or "", texts[order[(k + 1) % len(order)]] or ""
            changed = fingerprint.edited(own, after)
            r = got[doc_id]
            assert changed == own[: len(own) - len(own) // 2] + after[: len(own) // 2]
            assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
            assert [r.fingerprint, r.edited_fingerprint] == fingerprint.rendered(prints(own, changed))
            near = fingerprint.likeness(prints(own), prints(after))[0]
            assert r.near_next == pytest.approx(near) and 0 <= r.near_edited <= 1
    repeated = fingerprint.fingerprint_edits(docs.union(docs).union(docs), 4)
    assert repeated.count() == 21
    # One doc_id of most rows, null ones and neighbours: rows of equal doc_id follow by falling hash of their text.
    hot = spark.createDataFrame([(5 if k % 3 else k if k % 2 else None, f"text {k} " * (k % 9)) for k in range(300)], "doc_id long, text string")
    order = hot.select("doc_id", "text", F.xxhash64("text").alias("key")).orderBy(F.col("doc_id").desc_nulls_last(), F.col("key").desc()).collect()
    expected = sorted((str(a.doc_id), hashlib.sha256(fingerprint.edited(a.text, b.text).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for limit in (1 << 25, 40):
        assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprint.fingerprint_edits(hot, 4, limit).collect()) == expected
    assert fingerprint.fingerprint_edits(docs.limit(0), 4).count() == 0 and fingerprint.fingerprint_edits(docs.filter("doc_id = 3"), 4).first().near_next == 1.0
    assert struct.calcsize("Q") == 8
