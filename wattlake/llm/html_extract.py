"""Main text of web pages: site templates are subtrees that recur across a host's pages.

A tolerant scanner turns a page into a tree. All its block subtrees get hashes
of their tags and text, menus and notices among them; Spark counts each hash per
host over distinct pages, and those that recur on many of a host's pages are
deleted: within an article or main element on at least half of them, elsewhere
on a fifth. What pages have but once, such as comments and adverts, is told by
tags, roles and class names, and these only where the name says nothing else.
What lies in an article or main element, or else in the body, is the text.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm import textkit as tk
from wattlake.llm.shared import materialize

#: Template rows known up to this number go to all tasks; beyond, they meet pages in a shuffled join by host.
TEMPLATES_IN_MEMORY = 500_000

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|textarea|select|audio|video|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Removed with all they hold.
REMOVED = frozenset("head nav footer aside form button input menu dialog label option datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Class and id names that by themselves mark what is not the article.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup nav navbar navigation breadcrumb breadcrumbs sidebar widget disqus comments footer masthead topbar pagination pager toolbar".split()
)
#: Names that mark it only where the element's names say nothing else.
WEAK = frozenset("promo promotion banner notice menu widgets related recommended recommendations share sharing social comment reply replies respond login search skip copyright".split())
#: Words that may stand beside those of the two sets.
NEUTRAL = frozenset("site page main top bottom left right list lists box container wrapper wrap section area block blocks content inner outer bar bars button buttons link links post posts article articles slot unit item items primary secondary global form forms header sticky fixed small large text icon icons media row col column group panel strip zone".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
P_LIMITS = frozenset("article aside blockquote body div td th table section main li dd dt header footer nav form button".split())


def _marks(names: str) -> bool:
    """Whether class or id names mark what is not the article."""
    tokens = [[p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", t).lower()) if p and not p.isdigit()] for t in names.split()]
    plain = [all(p in STRONG or p in WEAK or p in NEUTRAL for p in t) for t in tokens]
    if any(ok and any(p in STRONG for p in t) for t, ok in zip(tokens, plain, strict=True)):
        return True
    return all(plain) and any(p in WEAK for t in tokens for p in t)


def noise(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in REMOVED or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in MARKS.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in ROLES:
                return True
        elif _marks(value):
            return True
    return bool(HIDDEN.search(attrs))


class Page:
    """Blocks of text in page order, each with its enclosing subtrees, and the subtrees' hashes."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, tuple[int, ...], bool]] = []  # text, subtrees, in an article; of what is not marked
        self.hashes: list[int | None] = []
        self.within: list[bool] = []  # whether a subtree lies in an article
        self.any_article = False
        # Each open element: tag, marked as noise, subtree number, parts to hash, in an article.
        self.open: list[tuple[str, bool, int, list[bytes], bool]] = [("", False, -1, [], False)]
        self.text: list[str] = []
        last = 0
        for m in TOKEN.finditer(html):
            if m.start() > last:
                self._text(html[last : m.start()])
            last = m.end()
            tag = m[3] or m[6]
            if tag:
                tag = tag.lower()
                if m[2] or m[5]:
                    self._end(tag)
                else:
                    self._start(tag, m[4] if m[3] else m[7])
        if last < len(html):
            self._text(html[last:])
        self._flush()
        while len(self.open) > 1:
            self._pop()

    def _text(self, s: str) -> None:
        self.text.append(entities.unescape(s) if "&" in s else s)

    def _flush(self) -> None:
        if self.text:
            s = " ".join("".join(self.text).split())
            self.text = []
            if s:
                top = self.open[-1]
                if not top[1]:
                    self.blocks.append((s, tuple(x[2] for x in self.open if x[2] >= 0), top[4]))
                raw = s.encode("utf-8", "surrogatepass")
                for x in reversed(self.open):
                    if x[2] >= 0:
                        x[3].append(raw)
                        break

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
            if tag in CLOSES_P:
                self._close(("p",), P_LIMITS)
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag], LIMITS[tag])
        if tag in VOID:
            return
        top = self.open[-1]
        inside = top[4] or tag in ("article", "main") or 'role="main"' in attrs
        marked = noise(tag, attrs, inside)
        if marked and not top[1]:
            # What stands before a marked element is another block's text, else both would be kept or go together.
            self._flush() if tag in BLOCKS else self._hold()
        gone = top[1] or marked
        self.any_article |= inside and not gone
        number = -1
        if tag in BLOCKS and tag not in ("html", "body"):
            number = len(self.hashes)
            self.hashes.append(None)
            self.within.append(inside and not gone)
        self.open.append((tag, gone, number, [], inside and not gone))

    def _hold(self) -> None:
        """An inline element that goes: its text is left out of the block it stands in."""
        self.held = getattr(self, "held", [])
        self.held.append(self.text)
        self.text = []

    def _close(self, tags: tuple[str, ...], limits) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self._flush()
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in limits:
                return

    def _end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or any(x[0] in BLOCKS for x in self.open[i:]):
                    self._flush()
                while len(self.open) > i:
                    self._pop()
                return

    def _pop(self) -> None:
        tag, gone, number, parts, _ = self.open.pop()
        if gone and not self.open[-1][1] and tag not in BLOCKS:
            self.text = self.held.pop()
        if number >= 0 and parts:
            digest = blake2b(tag.encode() + b"\x1f" + b"\x1e".join(parts), digest_size=8).digest()
            self.hashes[number] = int.from_bytes(digest, "little", signed=True)
            for x in reversed(self.open):
                if x[2] >= 0:
                    x[3].append(digest)
                    break

    def main_text(self, outside: frozenset[int] | set[int], inside: frozenset[int] | set[int] = frozenset()) -> str:
        """The text without subtrees of the templates found outside and inside of articles."""
        gone = {i for i, h in enumerate(self.hashes) if h is not None and h in (inside if self.within[i] else outside)} if outside or inside else ()
        return "\n".join(s for s, trees, article in self.blocks if (article or not self.any_article) and (not gone or gone.isdisjoint(trees)))


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _subtrees(batches):
    for batch in batches:
        for part in tk.chunks(batch, "html"):
            out: list[tuple[str, int, bool, int]] = []
            for url, text in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                name = host(url)
                if not name:
                    continue
                text = text or ""
                number = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                page = Page(text)
                out.extend((name, h, w, number) for h, w in {(h, w) for h, w in zip(page.hashes, page.within, strict=True) if h is not None})
                out.append((name, 0, False, number))  # the page itself, to count the host's pages
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["host", "subtree", "inside", "page"])


def _extract(batches):
    for batch in batches:
        for part in tk.chunks(batch, "html"):
            found = [[frozenset(t or ()) for t in part.column(c).to_pylist()] for c in ("outside", "inside")]
            texts = [Page(h or "").main_text(o, i) for h, o, i in zip(part.column("html").to_pylist(), *found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _hosts(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string())], [*batch.schema.names, "host"])


def site_templates(pages: DataFrame, share: float = 0.5, least_pages: int = 8, outside_share: float = 0.2, outside_pages: int = 4) -> DataFrame:
    """host, subtree (hash) and inside of the subtrees that recur: in articles on at least ``share`` of a host's distinct pages, elsewhere on ``outside_share``.

    Exact copies of a page count once; pages without a host have no templates. A
    host has at most ``1 / outside_share`` times as many of them as a page has
    subtrees.
    """
    seen = pages.select("url", "html").mapInArrow(_subtrees, "host string, subtree long, inside boolean, page long").distinct()
    count = seen.groupBy("host", "subtree", "inside").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("inside"), least_pages).otherwise(F.least(F.lit(outside_pages), F.lit(least_pages))))
    count = materialize(count, "subtrees")
    size = count.where("subtree = 0").select("host", F.col("n").alias("pages"))
    enough = F.col("n") >= F.when(F.col("inside"), share).otherwise(outside_share) * F.col("pages")
    return count.where("subtree <> 0").join(size, "host").where(enough).select("host", "subtree", "inside")


def extract(pages: DataFrame, share: float = 0.5, least_pages: int = 8, outside_share: float = 0.2, outside_pages: int = 4, templates_in_memory: int = TEMPLATES_IN_MEMORY) -> DataFrame:
    """page_id, url, text (main text, blocks joined by a line feed), n_chars of every row of ``pages``.

    Null and empty html give the empty text. Pages without a host, or with a
    malformed url, are extracted one by one. Repeated rows are extracted as often
    as they stand. Very long pages are scanned whole, in one task each; other
    columns are ignored, an empty table gives no rows.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = site_templates(src, share, least_pages, outside_share, outside_pages).groupBy("host")
    templates = materialize(found.agg(F.collect_list(F.when(~F.col("inside"), F.col("subtree"))).alias("outside"), F.collect_list(F.when(F.col("inside"), F.col("subtree"))).alias("inside")), "templates")
    known = templates.agg(F.coalesce(F.sum(F.size("outside") + F.size("inside")), F.lit(0))).first()[0] + templates.count()
    if known:
        named = src.mapInArrow(_hosts, "page_id long, url string, html string, host string")
        joined = named.join(F.broadcast(templates) if known <= templates_in_memory else templates, "host", "left").select("page_id", "url", "html", "outside", "inside")
    else:
        joined = src.withColumns({c: F.lit(None).cast("array<long>") for c in ("outside", "inside")})
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
