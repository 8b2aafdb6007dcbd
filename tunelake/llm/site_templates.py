"""Main text of web pages: subtrees that recur across a host's pages are deleted.

1. Every page is parsed into a tree of elements.  The hash of an element covers
   its tag, its class and link, its words and the hashes of its children.
2. Hashes are counted by host, one for each page (tasks count before the
   shuffle; the key is host and hash, so a host with a third of all pages is as
   many keys as it has subtrees).
3. A subtree on at least ``min_pages`` pages and ``share`` of its host's pages
   is site template.  A host has at most (subtrees of a page) / ``share`` of
   them, so one row for each host holds them.
4. Pages are parsed again; templates are deleted, and so are elements whose
   kind is never article (menus, adverts, forms, scripts ...), for hosts with
   too few pages to show a template.  What is left becomes blocks of text.

An ``article`` or ``main`` element, what it holds and what encloses it are never
counted as template: a copied article recurs too, and it must stay.

Defined results: null or empty html gives an empty text; a page without a host
has no templates; repeated pages count as pages each; an unclosed tag or quote
ends at the next ``>``; an empty table gives an empty table.  Other columns pass
through, but for ``text`` and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.llm.common import scratch

MIN_PAGES = 5
SHARE = 0.02
FLUSH = 200_000  # hashes a task holds before it emits their counts
DEEPEST = 512    # elements nested deeper stand beside each other, as in browsers; their texts stay

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
                  "search section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "caption", "html", "legend", "option", "tbody", "tfoot", "thead", "tr"}
CELL = frozenset(("td", "th"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
OWN = frozenset(("article", "main"))
ROOT = frozenset(("html", "body"))
# A start tag ends the open element of the first set, unless one of the second set lies between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
           "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
           "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
SCOPE = frozenset("table td th caption button object".split())
# Elements that are never article, and words of class, id or role that mark such parts.
NEVER = frozenset("applet audio button canvas dialog embed head iframe input menu nav noembed noframes noscript object "
                  "script search select style svg template textarea title video aside footer form".split())
PARTS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
                  "commentlist complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu "
                  "menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
                  "promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored "
                  "subscribe toolbar topbar widget".split())

_NEXT = re.compile(r"<(?:(?=[a-zA-Z/!?]))")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_ATTR = re.compile(r"\b(class|id|role|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")


class Page:
    """Elements of one page in the order of their start tags; ``content`` lists texts and child numbers."""

    def __init__(self, source: str):
        self.tags, self.attrs, self.parents, self.content = ["html"], [""], [-1], [[]]
        self._open = [0]
        self._parse(source)

    # --- tree ---------------------------------------------------------------
    def _push(self, tag: str, attrs: str) -> int:
        n, parent = len(self.tags), self._open[-1]
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parents.append(parent)
        self.content.append([])
        self.content[parent].append(n)
        return n

    def _close(self, names, stop=frozenset()) -> bool:
        """Close the innermost open element of ``names``; not past one of ``stop``."""
        for at in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[at]]
            if tag in names:
                del self._open[at:]
                return True
            if tag in stop:
                return False
        return False

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ROOT:
            return
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in HEADING and self.tags[self._open[-1]] in HEADING:
            self._open.pop()
        n = self._push(tag, attrs)
        if tag not in VOID and len(self._open) < DEEPEST:
            self._open.append(n)

    def _end(self, tag: str) -> None:
        if tag in ROOT or tag in VOID:
            return
        if tag == "p":
            if not self._close(("p",), SCOPE):
                self._push("p", "")
        elif tag in BLOCK or tag in CELL:
            self._close((tag,), () if tag == "table" else ("table",))
        else:  # an inline end tag doesn't close blocks
            self._close((tag,), BLOCK | CELL)

    def _parse(self, s: str) -> None:
        at, loose = 0, False
        while True:
            m = _NEXT.search(s, at)
            stop = m.start() if m else len(s)
            if stop > at:
                self.content[self._open[-1]].append(entities.unescape(s[at:stop]) if "&" in s[at:stop] else s[at:stop])
            if not m:
                return
            if s.startswith("<!--", stop):
                end = s.find("-->", stop + 4)
                at = len(s) if end < 0 else end + 3
                continue
            name = _NAME.match(s, stop)
            tail = None if loose or not name else _REST.match(s, name.end())
            if tail is None:
                loose = loose or name is not None  # a quote is never closed: from here tags end at the next ">"
                end = s.find(">", stop)
                if end < 0:
                    return
                tail_start, at = (name.end() if name else stop), end + 1
            else:
                tail_start, at = name.end(), tail.end()
            if not name:
                continue
            tag = name.group(1).lower()
            if s[stop + 1] == "/":
                self._end(tag)
                continue
            self._start(tag, s[tail_start:at - 1])
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}", re.I).search(s, at)
                self.content[-1].append(s[at:end.start() if end else len(s)])
                at = end.start() if end else len(s)

    # --- judgement ----------------------------------------------------------
    def own(self) -> list[bool]:
        """Is the element an article, inside one or around one?"""
        n = len(self.tags)
        own = [False] * n
        for i in range(1, n):
            own[i] = self.tags[i] in OWN or own[self.parents[i]]
        for i in range(n - 1, 0, -1):
            if own[i] and not own[self.parents[i]]:
                own[self.parents[i]] = True
        own[0] = True
        return own

    def hashes(self) -> list[int | None]:
        """Hash of each subtree, None where it has no words."""
        out: list[int | None] = [None] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            parts, words = [self.tags[i], self.attrs[i].strip()], False
            for c in self.content[i]:
                if isinstance(c, int):
                    if out[c] is not None:
                        parts.append(f"\x01{out[c]}")
                        words = True
                else:
                    text = " ".join(c.split())
                    if text:
                        parts.append(text)
                        words = True
            if words:
                out[i] = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        return out

    def _named_part(self, i: int) -> bool:
        attrs = self.attrs[i]
        if not attrs or self.tags[i] in HEADING:
            return False
        for m in _ATTR.finditer(attrs):
            if m.group(1).lower() != "href":
                value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
                if not PARTS.isdisjoint(_WORDS.split(value)):
                    return True
        return False

    def text(self, templates: frozenset) -> str:
        """Blocks of what is left, joined by newlines."""
        n = len(self.tags)
        own, hashes = self.own(), self.hashes() if templates else [None] * len(self.tags)
        inside, around = [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = self.tags[i] in OWN or inside[self.parents[i]]
        for i in range(n):
            around[i] = own[i] and not inside[i]
        blocks, line = [], []

        def flush():
            text = " ".join("".join(line).split())
            if text:
                blocks.append(text)
            line.clear()

        stack = [(0, iter(self.content[0]))]
        while stack:
            i, rest = stack[-1]
            for c in rest:
                if not isinstance(c, int):
                    line.append(c)
                    continue
                tag = self.tags[c]
                if tag == "br":
                    line.append(" ")
                    continue
                if not own[c] and hashes[c] in templates:
                    gone = True
                elif around[c]:
                    gone = tag == "head"
                else:
                    gone = tag in NEVER or (tag == "header" and not inside[c]) or (
                        tag not in OWN and self._named_part(c))
                if tag in BLOCK:
                    flush()
                elif tag in CELL:
                    line.append(" ")
                if not gone:
                    stack.append((c, iter(self.content[c])))
                    break
            else:
                stack.pop()
                if self.tags[i] in BLOCK:
                    flush()
                elif self.tags[i] in CELL:
                    line.append(" ")
        flush()
        return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host in lower case, null without one."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(host != "", host)


_COUNTS = pa.schema([("host", pa.string()), ("subtree", pa.int64()), ("n", pa.int64())])


def _subtree_counts(batches):
    counts: dict = {}

    def out():
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()),
                                            pa.array([k[1] for k in keys], pa.int64()),
                                            pa.array(list(counts.values()), pa.int64())], schema=_COUNTS)
        counts.clear()
        return batch

    for b in batches:
        for host, source in zip(b.column(0), b.column(1)):
            page = Page(source.as_py())
            seen = {h for h, own in zip(page.hashes(), page.own()) if h is not None and not own}
            name = host.as_py()
            for h in seen:
                counts[name, h] = counts.get((name, h), 0) + 1
            if len(counts) >= FLUSH:
                yield out()
    if counts:
        yield out()


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
                   share: float = SHARE) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur across the pages of each host."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host is not null")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = rows.where("html is not null").mapInArrow(_subtree_counts, "host string, subtree long, n long")
    many = counts.groupBy("host", "subtree").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    return (many.join(totals, "host").where(F.col("n") >= F.col("pages") * F.lit(float(share)))
            .groupBy("host").agg(F.collect_list("subtree").alias("templates")))


@F.arrow_udf(T.StringType())
def _page_text(source: pa.Array, templates: pa.Array) -> pa.Array:
    out, sets = [], {}
    for s, t in zip(source, templates):
        text = s.as_py()
        if not text:
            out.append("")
            continue
        hashes = tuple(t.as_py() or ())
        known = sets.get(hashes)
        if known is None:
            known = sets[hashes] = frozenset(hashes)
        out.append(Page(text).text(known))
    return pa.array(out, pa.string())


def main_text(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
              share: float = SHARE) -> DataFrame:
    """The caller's columns with ``text`` (main text of the html) and ``n_chars`` (its code points)."""
    templates = scratch(site_templates(pages, url, html, min_pages, share), "templates")
    rows = pages.select(F.struct("*").alias("page"), host_of(F.col(url)).alias("host"))
    # Spark broadcasts the templates if their file is small, and else splits the hot host's partitions.
    joined = rows.join(templates, "host", "left")
    done = joined.select("page", _page_text(F.col("page")[html], "templates").alias("text"))
    kept = [F.col("page")[c].alias(c) for c in pages.columns if c not in ("text", "n_chars")]
    return done.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))
