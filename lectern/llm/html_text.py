"""Main text of raw pages: the maximum-scoring run of words and tags.

A page is read as a sequence of words and tags. The score of a word is the log odds, learnt from the labelled pages
below, that one of its kind and place lies in the region from the article's first block to its last; those of tags and
furniture are so, too, but never above 0. Kinds are plain words, words of links outside of paragraphs, and
words of furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). Places are inside the page's
holder elements, outside them, and anywhere on a page that has none. Holders are the main elements, or main and article
elements where articles outside of main hold more words. One pass finds the contiguous run of the highest sum. The
run's blocks, without those of furniture, are the text.

Furniture is told by the element or by a name in its class, id or role, if that consists of words of furniture (with
MODIFIERS or without) and of nothing else. Headers are those of the site: a header in an article or main element is the article's own, with its
title. Names make no furniture of html, body, article and main, of what lies in
pre and code, of headings by their ids, of sections in an article by ids that don't mean reader comments, and of an
element other than reader comments that holds more than half of the page's words, and an h1, an article, a main or two
paragraphs; nor do forms, headers, asides and fieldsets make any where they hold that much, outside of articles. Furniture within a line is left out of its block. Text in head, script, style and like elements is
no text at all. Character references are decoded, white space in a block becomes one space, and
blocks are joined by a line feed. Inline tags and comments join what they stand between; <br> is white space.

Defined cases: null and empty html give the empty text; a page that is cut off gives what it has, without an
unfinished tag; a page of furniture only gives the empty text; of runs of one sum the longest counts, of those the first; nesting
of any depth takes time in proportion to the page; rows that repeat an id are extracted one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.worker import lean
from lectern.session import ship

#: Elements that start and end blocks; that hold no text of the page; that are furniture; and words of class, id or role that mean furniture.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video textarea title noframes xmp".split())
FURNITURE = frozenset("nav header footer aside form menu button select dialog fieldset".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr colophon notice notices alert newsletter subscribe subscription share sharing social comment comments disqus replies respond related recommended popup modal overlay widget toolbar pagination pager skip login signup complementary contentinfo search".split())
MODIFIERS = frozenset("main site page global top bottom left right primary secondary sticky fixed mobile desktop container wrapper wrap inner outer box bar block area list item items link links button buttons icon icons section posts articles stories form".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
NAMELESS = frozenset("html body article main".split())
RAW = frozenset("script style textarea title xmp iframe noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOLDERS = frozenset("article main".split())
#: Furniture elements that some sites wrap around whole pages.
WRAPPERS = frozenset("form header aside fieldset".split())
KINDS, PLACES = ("word", "link", "furniture"), ("inside", "outside", "open")

#: Labelled pages that the scores are learnt from; {{ and }} stand around the article's parts.
LABELLED = (
    "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div class=ad>Buy two of these now</div><article><h1>{{A bridge opens}}</h1><p>{{The new bridge across the river was opened on Monday after three years of work.}}</p><p>{{Its two lanes <b>carry</b> cars and its side paths are for people on foot.}}</p></article><footer>Site owner, all years</footer></body></html>",
    "<html><body><header><a href=/>Paper</a> your daily paper</header><div id=content><h1>{{How bread rises}}</h1><p>{{Yeast eats sugar and gives off gas, which the dough holds in small bubbles.}}<p>{{Warm places <a href=/w>speed this up</a>, and cold ones slow it down for a better taste.}}<ul><li>{{Flour of a strong kind}}</li><li>{{Water and some salt}}</li></ul></div><div class=sidebar><ul><li><a href=/1>Most read</a></li><li><a href=/2>Most shared</a></li></ul></div><div id=comments><p>I tried this and it went well for me.</p></div></body></html>",
    "<body><div class=menu><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div><form action=q><input name=q><button>Go</button></form><main><h2>{{Rain}}</h2><p>{{It rained for nine days, said people who had kept count of them.}}</p><aside><p>Read more about the weather</p></aside><blockquote>{{We had never seen so much of it.}}</blockquote><p>{{On the tenth day it stopped.}}</p></main><div class=cookie-notice>We use cookies on this site</div><footer><a href=x>About</a> <a href=y>Terms</a></footer></body>",
    "<body><div>The Daily Leaf</div><div>Skip to the text</div><main><header><h1>{{Owls}}</h1><p>{{By a writer of ours}}</p></header><p>{{Owls hunt by night.}}</p><ul><li><a href=/a>{{An earlier text on owls}}</a></li><li><a href=/b>{{A book on birds of prey}}</a></li></ul></main><div><p>More of our texts that other people like to read now and then</p><a href=/c>One</a></div><div>All texts belong to those who wrote them</div></body>",
    "<body><div><a href=/>Start</a></div><article><h2>{{Tides}}</h2><p>{{The moon pulls the sea.}}</p><p>{{So does the sun.}}</p><p><a href=/t>{{A table of tides for this year}}</a></p></article><p>Written for people who live by the sea</p><p>Ask us for a copy on paper</p></body>",
    "<body><div class=top-nav><a href=/>Front page</a> <a href=/all>All texts</a></div><h1>{{Salt}}</h1><p>{{Salt was once worth as much as silver in some lands.}}</p><div class=ad>Buy our new set of pans and save</div><p>{{It keeps meat and fish from going bad, and it was carried far for that.}}</p><div class=related><ul><li><a href=/p>Pepper</a></li><li><a href=/s>Sugar and where it comes from</a></li></ul></div><div class=footer>Made by hand</div></body>",
    "<body><nav><a href=/>Home</a></nav><article><h2>{{First day}}</h2><p>{{We walked along the coast until it was dark.}}</p></article><div class=ad>Boots for all ways and all weather</div><article><h2>{{Second day}}</h2><p>{{It rained, and we stayed in and read.}}</p></article><footer>Walks of ours</footer></body>",
    "<body><article><h1>{{Clocks}}</h1><p>{{The first ones had one hand.}}</p><aside><p>Watch our film on how a clock is made, with all its parts shown one by one, and order it for your school</p></aside><form>Your address <input name=m> and press <button>Send</button></form><p>{{Later ones had two.}}</p><section id=comments><p>Mine has none</p></section></article><div>Texts on things</div></body>",
    "<body><table><tr><td><a href=1>Up</a></td><td><a href=2>Down</a></td></tr></table><p>{{Plain pages of old have their text in the body with no other element around.}}</p><p>{{They're long, and they don't say what is what.}}</p><hr><a href=m>Mail us</a></body>",
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|$)|</[^>]*(?:>|$)|<$", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HEADING = re.compile("h[1-6]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _says_furniture(name: str, attributes: str, in_article: bool) -> str:
    """"comments" or "other" furniture, by the names of an element; "" if they say nothing."""
    said = [(a.lower(), n, {w.lower() for w in _PART.findall(n) if len(w) > 1}) for a, value in _ATTRIBUTE.findall(attributes) for n in value.strip("\"'").split()]
    a_section = name == "section" or any(a == "class" and n.lower() == "section" for a, n, _ in said)
    found = ""
    for a, _, parts in said:
        if not parts & WORDS or parts - WORDS - MODIFIERS or a == "id" and _HEADING.fullmatch(name):
            continue
        if parts & COMMENTS:
            return "comments"
        if a != "id" or not (a_section and in_article):
            found = "other"
    return found


class Page:
    """Blocks of a page in order: text, kind of its words, whether they lie in main and in article (0 to 3), and the numbers of tags before it in each of these places."""

    def __init__(self, source: str, spared: frozenset[int] | None = None):
        self.blocks: list[tuple[str, str, int, list[int]]] = []
        self._parts: list[tuple[str, str]] = []
        self._tags = [0, 0, 0, 0]
        open_: list[tuple[str, str]] = []  # name, what it makes of words (or "")
        names, made = Counter(), Counter()  # of the open elements
        at = 0
        spared = spared or frozenset()
        #: Of elements that are furniture by a name, by their places in the page: words, paragraphs, and whether there's a sign of an article.
        self.named: dict[int, list[int]] = {}
        inside: list[tuple[int, int]] = []  # depth in open_, place
        self.words = 0
        kind, held, paragraph = "word", 0, False

        def text(raw: str) -> None:
            if raw:
                self._parts.append((raw, kind))
                n = len(raw.split())
                self.words += n
                if inside:
                    self.named[inside[-1][1]][0] += n

        def leave() -> None:
            """What an element that ends has counted goes to the one around it."""
            while inside and inside[-1][0] >= len(open_):
                _, place = inside.pop()
                if inside:
                    around, own = self.named[inside[-1][1]], self.named[place]
                    around[:] = around[0] + own[0], around[1] + own[1], around[2] | own[2]

        def close() -> str:
            name, makes = open_.pop()
            names[name] -= 1
            made[makes] -= 1
            return name

        def end_block() -> None:
            shown = [(x, k) for x, k in self._parts if k != "furniture"]
            if not any(x.strip() for x, _ in shown):
                shown = self._parts
            t = " ".join(_html.unescape("".join(x for x, _ in shown)).split())
            if t:
                sizes: Counter = Counter()
                for x, k in shown:
                    sizes[k] += len(x)
                most = "furniture" if sizes["furniture"] else sizes.most_common(1)[0][0]
                self.blocks.append((t, most, held, self._tags))
                self._tags = [0, 0, 0, 0]
            self._parts = []

        while True:
            m = _TOKEN.search(source, at)
            text(source[at : m.start()] if m else source[at:])
            if not m:
                break
            at, place = m.end(), m.start()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in SILENT or name in RAW:
                if not closing and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                    if name == "head" and not end:
                        end = re.compile(r"<body[\s>]", re.I).search(source, at)
                    at = end.start() if end else len(source)
                continue
            if name == "br":
                text(" ")
            if name in BLOCKS:
                end_block()
                paragraph = name == "p" and not closing
                while open_ and open_[-1][0] == "p":  # a paragraph ends where another block begins or its holder ends
                    close()
            self._tags[held] += 1
            if closing:
                if names[name]:
                    while close() != name:
                        pass
            elif name not in VOID and not attributes.endswith("/"):
                leave()
                plain = name in NAMELESS or name in ("pre", "code") or names["pre"] + names["code"] > 0
                says = _says_furniture(name, attributes, held > 0) if attributes and not plain and name not in FURNITURE else ""
                own = name == "header" and held > 0
                if name in WRAPPERS and not own and not held:
                    says = "other"
                element = name in FURNITURE and not own and not (name in WRAPPERS and place in spared)
                # a paragraph of a link is prose that is linked; links of menus stand in lists, cells and divisions
                makes = "furniture" if element or says and place not in spared else "link" if name == "a" and not paragraph else ""
                if inside:
                    self.named[inside[-1][1]][1] += name == "p"
                    self.named[inside[-1][1]][2] |= name in HOLDERS or name == "h1"
                if says == "other" and place not in spared:
                    self.named[place] = [0, 0, 0]
                    inside.append((len(open_), place))
                if makes or name in ("code", "article", "main") or name in BLOCKS and name != "p":
                    open_.append((name, makes))
                    names[name] += 1
                    made[makes] += 1
            leave()
            kind = "furniture" if made["furniture"] else "link" if made["link"] else "word"
            held = 2 * (names["main"] > 0) + (names["article"] > 0)
        end_block()
        open_.clear()
        leave()

    def wrappers(self) -> frozenset[int]:
        """Places of elements whose names say furniture, but which hold most of the page."""
        return frozenset(p for p, (n, paragraphs, sign) in self.named.items() if 2 * n > self.words and (sign or paragraphs > 1))

    def places(self) -> list[str]:
        """For the four places in and out of main and article, what they are: inside or outside the page's holders, or open where there's none."""
        n = [0, 0, 0, 0]
        for words, kind, held, _ in self.blocks:
            n[held] += (words.count(" ") + 1) * (kind != "furniture")
        if not n[1] + n[2] + n[3]:
            return ["open"] * 4
        main = n[2] + n[3] >= n[1]
        return ["outside", "outside" if main else "inside", "inside", "inside"]


def _learn() -> dict[tuple[str, str], float]:
    """Log odds of each kind of word, and of tags, in each place to lie between the article's first block and its last."""
    inside, outside = Counter(), Counter()
    for source in LABELLED:
        page = Page(source)
        places, marked = page.places(), [i for i, b in enumerate(page.blocks) if "{{" in b[0]]
        for i, (words, kind, held, tags) in enumerate(page.blocks):
            of = inside if marked[0] <= i <= marked[-1] else outside
            of[kind, places[held]] += len(words.split())
            for k, n in enumerate(tags):
                of["tag", places[k]] += n
    found = {(k, p): math.log((inside[k, p] + 0.5) / (outside[k, p] + 0.5)) for k in (*KINDS, "tag") for p in PLACES}
    return {(k, p): x if k in ("word", "link") else min(x, 0.0) for (k, p), x in found.items()}


SCORES = _learn()


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the highest sum (the longest of equal ones); (0, 0) if none is above 0."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, first = 0.0, i
        total += x
        if total > best or total == best and total > 0 and i + 1 - first > found[1] - found[0]:
            best, found = total, (first, i + 1)
    return found


def main_text(source: str | None) -> str:
    """The article's text, blocks joined by line feeds."""
    if not source:
        return ""
    page = Page(source)
    spared: frozenset[int] = frozenset()
    while more := page.wrappers() - spared:
        spared |= more
        page = Page(source, spared)
    places = page.places()
    line: list[float] = []
    for words, kind, held, tags in page.blocks:
        line += [sum(SCORES["tag", places[k]] * n for k, n in enumerate(tags) if n), SCORES[kind, places[held]] * (words.count(" ") + 1)]
    first, last = best_run(line)
    return "\n".join(b[0] for i, b in enumerate(page.blocks) if first <= 2 * i + 1 < last and b[1] != "furniture")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id_col, url_col, text, n_chars."""
    ship(pages.sparkSession)
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return plain.mapInArrow(lean("html_text", _extracted), "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
