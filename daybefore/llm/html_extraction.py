"""Main text of web pages: site templates go by recurrence, the rest of the frame by its mark-up.

A page is read into its tree once (tolerant of missing end tags).  Every element subtree has a
digest of its tags and texts.  Spark counts, per host and digest, the pages that carry it and how many
*different* pages these are, told apart by a sketch of their main text; a subtree on many different pages
of its host is a site template and is deleted.  Copies of one page, exact or near, share their
sketch and don't make its text a template.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and the like that don't recur
go by element names and by words of class, id and role.  Where a page marks its article
(``article`` or ``main``), the text is what stands in it, and its paragraphs are never taken for
templates, however often a passage is quoted on the site; boxes within it are.

Counting: (host, digest, sketch) first, so that a template on a third of all pages is spread
over its pages' sketches.  Pages get back their own templates by a digest of the page.

Edge rows: a null page is empty, and its text is; text without mark-up is one block; a null or
unreadable URL has no host, and such pages are never counted; repeated rows are answered each; a page that
would lose all its text to templates keeps it; deep nesting and unclosed tags, quotes, comments and
scripts are read in linear time; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.llm.common import arrow_map, stored

#: A template stands on at least so many different pages of its host ...
MIN_PAGES = 3
#: ... and at least one in so many of the pages that carry it differs from the others.
COPIES = 4

# Element names of HTML by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
                   "time tt u var wbr br img picture svg math object".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
                     "li main menu nav ol p pre search section summary table ul dt dd".split())
FRAME = frozenset("nav footer aside form button select option dialog menu svg math object head canvas audio video map datalist noscript search fieldset".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody thead tfoot caption figcaption".split())
# Words in class, id and role that name a part of the frame.
FRAME_WORDS = frozenset("""ad ads adbox adsense advert adverts advertisement advertisements advertising advertorial alert alerts banner breadcrumb breadcrumbs comment comments
    commentlist consent contentinfo cookie cookies copyright disclaimer disqus footer footnav gdpr hidden login menu menubar metanav modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommended recommendations related reply replies respond search share
    sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tagcloud teaser toolbar widget widgets""".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
FRAME_NAMES = {**dict.fromkeys(FRAME, 1), "header": 3}
#: Opening tags of one kind end an open one of these, unless an element of the second set stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}), "thead": ({"tbody", "thead", "tr"}, {"table"})}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])|>")
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_WORD = re.compile(r"[a-z]+")
_WITHOUT = re.compile(r"\b(?:has|with|without|no)[-_]?[A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
#: Elements that an open paragraph doesn't end across.
_CELLS = ("td", "th", "caption")


def _frame(name: str, attributes: str) -> int:
    """1 for a frame element by name, 2 by what its attributes say, 3 for a header (frame outside the article only)."""
    if name in FRAME:
        return 1
    if len(attributes) > 4 and name not in ("html", "body", "main"):
        if _HIDDEN.search(attributes):
            return 2
        for hint in _HINT.findall(attributes):
            said = _WITHOUT.sub(" ", "".join(hint))
            words = {*_WORD.findall(said.lower()), *_WORD.findall(_CAMEL.sub(r"\1 \2", said).lower())}
            if not FRAME_WORDS.isdisjoint(words):
                return 2
            if not HEADER_WORDS.isdisjoint(words):
                return 3
    return 3 if name == "header" else 0


class Page:
    """The elements of one page in the order they open, and its blocks of text as (element, text)."""

    def __init__(self, html: str):
        self.names = ["#page"]
        self.parents = array("l", [-1])
        self.frames = bytearray(1)
        self.digests = [0]
        self.sizes = [0]  # characters in an element, those of them in links, and links
        self.linked = [0]
        self.links = [0]
        self.mains: set[int] = set()
        self.blocks: list[tuple[int, str]] = []
        self._html, self._text, self._anchors = html, [], 0
        self._stack, self._block_places, self._parts, self._open = [0], [0], [[]], {}
        self._read()
        self._close(1)
        self._flush()

    def _flush(self) -> None:
        """End a block of text."""
        words = " ".join("".join(self._text).split())
        self._text.clear()
        if words:
            place = self._block_places[-1]
            self.blocks.append((self._stack[place], words))
            self.sizes[self._stack[place]] += len(words)
            self._parts[place].append(words.encode("utf-8", "surrogatepass"))

    def _last(self, names) -> int:
        """The place of the innermost open element of these names, 0 if none."""
        return max((held[-1] for n in names if (held := self._open.get(n))), default=0)

    def _close(self, place: int) -> None:
        """Close the elements from this place of the stack on."""
        while len(self._stack) > place:
            node, name = self._stack[-1], self.names[self._stack[-1]]
            if self._block_places[-1] == len(self._stack) - 1:
                if self._text:
                    self._flush()
                self._block_places.pop()
                mine, outer = self._parts[-1], self._block_places[-1]
                self.digests[node] = xxhash.xxh3_64_intdigest(b"\0".join([name.encode("utf-8", "surrogatepass"), *mine]))
                if mine:
                    self._parts[outer].append(self.digests[node].to_bytes(8, "little"))
                for counts in (self.sizes, self.linked, self.links):
                    counts[self._stack[outer]] += counts[node]
            if name == "a":
                self._anchors -= 1
            self._open[name].pop()
            self._stack.pop()
            self._parts.pop()

    def _say(self, raw: str) -> None:
        piece = unescape(raw) if "&" in raw else raw
        self._text.append(piece)
        if self._anchors:
            self.linked[self._stack[self._block_places[-1]]] += len(piece.strip())

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name != "wbr":
                self._text.append(" ")
            return
        frame = _frame(name, attributes) if attributes != ">" else FRAME_NAMES.get(name, 0)
        block = name not in INLINE or frame > 0
        if block:
            if name in ENDS:
                same, bars = ENDS[name]
                if (last := self._last(same)) > self._last(bars):
                    self._close(last)
            if name in CLOSES_P and (held := self._open.get("p")) and held[-1] > self._last(_CELLS):
                self._close(held[-1])
            if self._text:
                self._flush()
        if name == "a":
            self._anchors += 1
            self.links[self._stack[self._block_places[-1]]] += 1
        self._open.setdefault(name, []).append(len(self._stack))
        if block:
            self._block_places.append(len(self._stack))
        self.parents.append(self._stack[-1])
        self._stack.append(len(self.names))
        self._parts.append([])
        if name == "main" or _MAIN.search(attributes):
            self.mains.add(len(self.names))
        self.names.append(name)
        self.frames.append(frame)
        for counts in (self.digests, self.sizes, self.linked, self.links):
            counts.append(0)

    def _end(self, name: str) -> None:
        held = self._open.get(name)
        if held and (name not in INLINE or held[-1] >= self._block_places[-1]):
            self._close(held[-1])

    def _read(self) -> None:
        html, at, end = self._html, 0, len(self._html)

        def after(mark: str, start: int) -> int:
            found = html.find(mark, start)
            return end if found < 0 else found + len(mark)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                self._say(html[at:])
                return
            if lt > at:
                self._say(html[at:lt])
            closing = html.startswith("/", lt + 1)
            named = _NAME.match(html, lt + 1 + closing)
            if named is None:
                if html.startswith("<!--", lt):
                    at = after("-->", lt + 2)
                elif closing or html[lt + 1:lt + 2] in ("!", "?"):
                    at = after(">", lt)
                else:
                    self._say("<")
                    at = lt + 1
                continue
            name, at = named.group().lower(), named.end()
            while (mark := _QUOTE.search(html, at)) is not None and mark.group(1):  # the tag's end outside quoted values
                close = html.find(mark.group(1), mark.end())
                if close < 0:
                    at = after(">", mark.end())
                    break
                at = close + 1
            else:
                at = end if mark is None else mark.end()
            if closing:
                self._end(name)
                continue
            if name in RAW:
                found = _RAW_END[name].search(html, at)
                at = after(">", found.end()) if found else end
                continue
            self._start(name, html[named.end():at])


class Extraction:
    """What of a page is main text, and which of its subtrees may be templates."""

    def __init__(self, html: str):
        self.page = page = Page(html)
        n = len(page.names)
        frames = bytearray(page.frames)
        for v in range(1, n):
            if page.names[v] == "form" and 2 * page.sizes[v] > page.sizes[0]:
                frames[v] = 0  # a form around the whole page
        self.region = self._region(frames)
        inside = bytearray(n)  # in the marked article
        holds = bytearray(n)  # around it
        for v in self.region:
            inside[v] = 1
        for v in range(n - 1, 0, -1):
            if inside[v] or holds[v]:
                holds[page.parents[v]] = 1
        headline = self._headline(frames)
        dropped = bytearray(n)
        self.candidates: list[int] = []
        for v in range(1, n):
            up = page.parents[v]
            inside[v] = inside[v] or inside[up]
            menu = page.links[v] >= 3 and 4 * page.linked[v] >= 3 * page.sizes[v]
            frame = not holds[v] and v not in self.region and (frames[v] in (1, 2) or not inside[v] and (frames[v] == 3 or menu))
            dropped[v] = dropped[up] or bool(frame)
            if page.sizes[v] and not holds[v] and not dropped[up] and v not in self.region and not (inside[v] and page.names[v] in PLAIN and not frame):
                self.candidates.append(v)
        self.dropped, self.inside, self.headline = dropped, inside, headline
        self.plain = self._text(dropped)

    def _free(self, frames: bytearray, main: bool) -> list[int]:
        """Outermost articles (or main elements) in no frame; failing that, in none but those that attributes name."""
        page = self.page
        for bars in ((1, 2), (1,)):
            under, found = bytearray(len(page.names)), []
            for v in range(1, len(page.names)):
                mine = v in page.mains if main else page.names[v] == "article"
                state = under[page.parents[v]] or (1 if frames[v] in bars else 0)
                if mine and not state and page.sizes[v]:
                    found.append(v)
                    state = 1
                under[v] = state
            if found:
                return found
        return []

    def _region(self, frames: bytearray) -> frozenset[int]:
        """The marked article; one that holds less than a tenth of the text outside frames is a teaser."""
        page = self.page
        under = bytearray(len(page.names))
        for v in range(1, len(under)):
            under[v] = under[page.parents[v]] or bool(frames[v])
        free = sum(len(text) for owner, text in page.blocks if not under[owner])
        for main in (False, True):
            found = self._free(frames, main)
            if found and 10 * sum(page.sizes[v] for v in found) >= free:
                return frozenset(found)
        return frozenset()

    def _headline(self, frames: bytearray) -> frozenset[int]:
        """A headline just outside an article that has none."""
        names = self.page.names
        if not self.region or "h1" not in names:
            return frozenset()
        heads, under = [], bytearray(len(names))
        for v in range(1, len(names)):
            up = self.page.parents[v]
            under[v] = under[up] | (2 if frames[v] else 0) | (1 if v in self.region else 0)
            if names[v] == "h1":
                if under[v] & 1:
                    return frozenset()
                if not under[v] and v < min(self.region):
                    heads.append(v)
        return frozenset(heads[-1:])

    def _text(self, dropped: bytearray) -> list[str]:
        return [text for owner, text in self.page.blocks if not dropped[owner] and (not self.region or self.inside[owner] or owner in self.headline)]

    def without(self, templates: set[int]) -> tuple[list[str], int]:
        """The blocks left after the templates go, and how many subtrees went."""
        gone = [v for v in self.candidates if self.page.digests[v] in templates]
        if not gone:
            return self.plain, 0
        dropped = bytearray(self.dropped)
        for v in gone:
            dropped[v] = 1
        for v in range(1, len(dropped)):
            dropped[v] = dropped[v] or dropped[self.page.parents[v]]
        left = self._text(dropped)
        return (left, len(gone)) if left or not self.plain else (self.plain, 0)

    def sketch(self) -> int:
        """The smallest digest of five words in a row of the main text: copies, near ones too, mostly share it."""
        words = " ".join(self.plain).encode("utf-8", "surrogatepass").split()
        return min((xxhash.xxh3_64_intdigest(b" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))), default=0) if words else 0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def host(url: Column) -> Column:
    """Host of a URL in lower case without port and user; null if there is none."""
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)", 1))
    return F.when(name != "", name)


def subtrees(pages: DataFrame) -> DataFrame:
    """``page``, ``host``, ``digest``, ``sketch`` of every subtree that may be a template; ``pages`` has page, host and html."""
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, digests, sketches = [], [], []
            for i, html in enumerate(batch.column("html").to_pylist()):
                found = Extraction(html)
                own = {found.page.digests[v] for v in found.candidates}
                rows += [i] * len(own)
                digests += map(_signed, own)
                sketches += [_signed(found.sketch()) if own else 0] * len(own)
            take = pa.array(rows, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column("page").take(take), batch.column("host").take(take), pa.array(digests, pa.int64()), pa.array(sketches, pa.int64())],
                                              ["page", "host", "digest", "sketch"])
        return run
    return arrow_map(pages, make, "page string, host string, digest long, sketch long")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, copies: int = COPIES) -> DataFrame:
    """``host`` and ``digest`` of the subtrees on many different pages of their host."""
    each = found.groupBy("host", "digest", "sketch").agg(F.count("*").alias("n"))
    return (each.groupBy("host", "digest").agg(F.count("*").alias("different"), F.sum("n").alias("n"))
            .filter((F.col("different") >= min_pages) & (copies * F.col("different") >= F.col("n"))).select("host", "digest"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, copies: int = COPIES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page row's ``page_id``, ``url``, main ``text``, ``n_chars`` and ``n_templates`` (subtrees deleted as templates)."""
    html, name = F.coalesce(F.col(html_col), F.lit("")), host(F.col(url_col))
    mine = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), name.alias("host"), html.alias("html"),
                        F.md5(F.concat_ws("\n", name, html)).alias("page"))
    found = stored(subtrees(mine.filter(F.col("host").isNotNull() & (F.col("html") != "")).select("page", "host", "html")))
    site = templates(found, min_pages, copies)
    drops = found.join(site, ["host", "digest"]).groupBy("page").agg(F.collect_set("digest").alias("drops"))  # at most the elements of a page
    rows = mine.join(drops, "page", "left").select("page_id", "url", "html", "drops")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [Extraction(html).without({d & (1 << 64) - 1 for d in drops or ()}) for html, drops in zip(batch.column("html").to_pylist(), batch.column("drops").to_pylist())]
            texts = [" ".join(blocks).encode("utf-8", "replace").decode() for blocks, _ in out]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([n for _, n in out], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_templates"])
        return run
    kind = pages.schema[id_col].dataType.simpleString()
    return arrow_map(rows, make, f"page_id {kind}, url string, text string, n_chars long, n_templates long")
