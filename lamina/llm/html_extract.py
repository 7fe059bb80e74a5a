"""Main-text extraction by consensus paths of each host.

First pass: every page is read into blocks of text under containers; containers score by the text outside
links in the blocks they hold (in full for a block's own container, half for the next one out, more for
semantic tags), boilerplate subtrees score nothing, and the page names its best container by a generalised
path of tags and classes (digits dropped). Spark counts these votes per host and path, with map-side sums,
so a host with a third of all pages is no hot group. Every path with at least ``MIN_SHARE`` of its host's
votes wins. Second pass: each page is extracted under the best of its nodes on a winning path; a page that
has none uses its own best container.

The text: blocks in page order, character references decoded, white space inside a block turned into one
space, trimmed, joined by two newlines; without scripts, styles, comments, menus, site headers, footers,
sidebars, notices, adverts, forms and reader comments. Nothing is cut or capped. Two kinds of boilerplate element are only
left out once the page is known: one that is so by its class or id stays if it wraps the page's article or main element and
over half of its text (a layout wrapper called ``content-with-sidebar``); a form stays if it holds over half of the
page's text and in it an article, main or content element or at least ``FORM_WORDS`` words in paragraphs (some sites wrap whole
pages in one), and even then without its labels and controls. A page whose text is a form only is empty.

Reading and scoring take time linear in the page for any nesting of blocks.

Defined results: NULL, empty or text-free pages give an empty text; a page whose URL is NULL or has no host
votes under the empty host. Pages are independent rows, so repeated rows repeat; an empty table gives an
empty table. Input columns pass through, whatever their names; ``host``, ``text`` and ``n_chars`` replace columns of those names.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.text_columns import column, unwrapped, whole_row
from lamina.scratch import materialize

MIN_SHARE, BROADCAST_BYTES, FORM_WORDS = 0.2, 32 << 20, 20

_TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body center div html main section td".split())
DROPPED = set("aside audio button canvas dialog footer head iframe label legend menu nav noscript object script select style svg math template textarea title video".split())
DROPPED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead comment comments disqus cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended recommendations replies responses widget toolbar pagination pager login signup register search alert rail".split()
)
#: Those among them that never wrap a page's article.
FIRM_NAMES = set("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies disqus nav navbar navigation pager pagination recommendations recommended related replies responses".split())
CONTENT_NAMES = set("article content entry main post story".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    """An element: its place in the tree and what is known of it when it opens."""

    __slots__ = ("parent", "tag", "label", "gone", "perhaps", "inside", "linked", "depth")

    def __init__(self, parent: int, tag: str, label: str, gone: bool, perhaps: bool, inside: bool, linked: bool, depth: int):
        self.parent, self.tag, self.label, self.depth = parent, tag, label, depth
        self.gone = gone  # boilerplate, or inside such an element
        self.perhaps = perhaps  # boilerplate unless it wraps the article
        self.inside = inside  # in an article or main element
        self.linked = linked  # its text is link text


class Page:
    """Nodes, each after its parent, and blocks ``(node, text, link characters)`` of one page."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.blocks: list[tuple] = []
        self._stack: list[int] = []
        self._open: Counter = Counter()
        self._text: list[str] = []
        self._links = 0
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        lowered = None
        for token in _TOKEN.finditer(source):
            begin = token.start()
            if begin < at:
                continue  # inside a raw-text element
            if begin > at:
                self._characters(source[at:begin])
            at = token.end()
            name = token[2] or token[5]
            if not name:
                if token[0].startswith("<![CDATA["):
                    self._characters(token[0][9:-3], decode=False)
                continue
            tag = name.lower()
            if token[1] or token[4]:
                self._close(tag)
                continue
            attributes = token[3] or token[6] or ""
            if tag in BLOCK:
                self._flush()
                self._imply_ends(tag)
            if tag == "br":
                self._text.append(" ")
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                lowered = source.lower() if lowered is None else lowered
                if len(lowered) != end:  # a case mapping changed the length: search exactly
                    found = re.compile("</" + re.escape(tag), re.I).search(source, at)
                    close = found.start() if found else -1
                else:
                    close = lowered.find("</" + tag, at)
                stop = end if close < 0 else source.find(">", close)
                at = end if close < 0 or stop < 0 else stop + 1
                continue
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            self._enter(tag, attributes)
        if at < end:
            self._characters(source[at:])
        self._flush()

    def _enter(self, tag: str, attributes: str) -> None:
        above = self._stack[-1] if self._stack else -1
        parent = self.nodes[above] if above >= 0 else None
        label, gone, perhaps = self._describe(tag, attributes, parent is not None and parent.inside)
        linked = tag == "a" or (parent is not None and parent.linked and tag not in BLOCK)
        inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.nodes.append(Node(above, tag, label, gone or (parent is not None and parent.gone), perhaps, inside, linked, parent.depth + 1 if parent else 1))
        self._stack.append(len(self.nodes) - 1)
        self._open[tag] += 1

    def _describe(self, tag: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
        """Label, whether the element is boilerplate, whether it is so unless it wraps the article."""
        gone, perhaps = tag in DROPPED or (tag == "header" and not inside), tag == "form"
        if not attributes or attributes.isspace():
            return tag, gone, perhaps
        classes, identity = "", ""
        for found in _ATTRIBUTE.finditer(attributes):
            key, value = found[1].lower(), found[2] or found[3] or found[4] or ""
            if key == "class":
                classes = value
            elif key == "id":
                identity = value
            elif key == "role":
                gone = gone or value.lower() in DROPPED_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                gone = gone or attributes[max(found.start() - 1, 0) : found.start()].isspace()
            elif key == "style":
                gone = gone or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        if tag not in ("html", "body", "main"):
            for name in [*classes.split(), identity]:
                parts = [p.lower() for p in _PARTS.findall(name) if not p.isdigit()]
                if parts and parts[0] not in ("has", "with", "no", "without", "is"):
                    found = {parts[0], parts[-1]} & DROPPED_NAMES or (not inside and parts[-1] == "header")
                    gone = gone or (bool(found) and (tag not in BLOCK or bool({parts[0], parts[-1]} & FIRM_NAMES)))
                    perhaps = perhaps or bool(found)
        names = sorted({re.sub(r"[\d>]+", "", c) for c in classes.split()} - {""}) or ["#" + re.sub(r"[\d>]+", "", identity)] * bool(identity)
        return ".".join([tag, *names]), gone, perhaps

    def _settle(self) -> None:
        """Decide on the elements that are boilerplate unless they wrap the article, and drop the blocks of those that are."""
        nodes = self.nodes
        if not any(n.perhaps for n in nodes):
            return
        size, words, wraps, named = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes), [False] * len(nodes)
        total = 0
        for k, text, _ in self.blocks:
            total += len(text)
            if k >= 0:
                size[k] += len(text)
                words[k] += len(text.split()) if nodes[k].tag == "p" else 0
        for k in range(len(nodes) - 1, -1, -1):
            node, above = nodes[k], nodes[k].parent
            main = not node.gone and node.tag in ("article", "main")
            content = not node.gone and not node.perhaps and bool(set(re.split(r"[.#_-]", node.label.lower())[1:]) & CONTENT_NAMES)
            if above >= 0:
                size[above] += size[k]
                words[above] += words[k]
                wraps[above] = wraps[above] or wraps[k] or main
                named[above] = named[above] or named[k] or content
        for k, node in enumerate(nodes):
            if node.parent >= 0 and nodes[node.parent].gone:
                node.gone = True
            elif node.perhaps:
                most = 2 * size[k] > total
                node.gone = node.gone or not (most and (wraps[k] or (node.tag == "form" and (named[k] or words[k] >= FORM_WORDS))))
        self.blocks = [b for b in self.blocks if b[0] < 0 or not nodes[b[0]].gone]

    def _imply_ends(self, tag: str) -> None:
        ends, scope = (CLOSES[tag], SCOPE[tag]) if tag in CLOSES else ({"p"}, CONTAINERS | {"li", "td", "th", "button"})
        if not any(self._open[t] for t in ends):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            name = self.nodes[self._stack[k]].tag
            if name in ends:
                self._leave(k)
                return
            if name in scope:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self._open[tag]:
            return
        for k in range(len(self._stack) - 1, -1, -1):
            name = self.nodes[self._stack[k]].tag
            if name == tag:
                self._leave(k)
                return
            if tag not in BLOCK and name in BLOCK:
                return  # an inline end tag does not reach through blocks

    def _leave(self, k: int) -> None:
        """Close the open elements from the ``k``-th on."""
        for node in self._stack[k:]:
            self._open[self.nodes[node].tag] -= 1
        del self._stack[k:]

    def _characters(self, raw: str, decode: bool = True) -> None:
        top = self.nodes[self._stack[-1]] if self._stack else None
        if top is not None and top.gone:
            return
        text = html_module.unescape(raw) if decode and "&" in raw else raw
        self._text.append(text)
        if top is not None and top.linked:
            self._links += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1] if self._stack else -1, text, self._links))
            self._text, self._links = [], 0

    def scores(self) -> dict[int, float]:
        """Score of each container node that holds text; -1 is the page outside any element."""
        container: list[int] = []  # the innermost container at or around each node
        for k, node in enumerate(self.nodes):
            container.append(k if node.tag in CONTAINERS else container[node.parent] if node.parent >= 0 else -1)
        points: dict[int, float] = {}
        for node, text, links in self.blocks:
            worth = max(len(text) - 2 * links, 0)
            own = container[node] if node >= 0 else -1
            points[own] = points.get(own, 0) + worth
            if own >= 0:
                above = self.nodes[own].parent
                outer = container[above] if above >= 0 else -1
                points[outer] = points.get(outer, 0) + worth / 2
        for node in points:
            if node >= 0:
                parts = set(self.nodes[node].label.lower().replace("-", ".").replace("_", ".").split("."))
                points[node] *= 1.6 if self.nodes[node].tag in ("article", "main") else 1.25 if parts & CONTENT_NAMES else 1.0
        return points

    def best(self) -> int | None:
        """The best container, moved out to the article or main element that it lies in."""
        points = self.scores()
        if not points:
            return None
        top = max(points, key=lambda k: (points[k], -k))
        node = top
        while node >= 0:
            if self.nodes[node].tag in ("article", "main"):
                return node
            node = self.nodes[node].parent
        return top

    def path(self, node: int) -> str:
        labels = []
        while node >= 0:
            labels.append(self.nodes[node].label)
            node = self.nodes[node].parent
        return ">".join(reversed(labels))

    def on_path(self, paths: set[str]) -> int | None:
        """The node on one of the paths with the most text, the outermost of equal ones."""
        weight = [0] * len(self.nodes)
        for node, text, _ in self.blocks:
            if node >= 0:
                weight[node] += len(text)
        for k in range(len(self.nodes) - 1, -1, -1):
            if self.nodes[k].parent >= 0:
                weight[self.nodes[k].parent] += weight[k]
        tails = {(p.count(">") + 1, p.rpartition(">")[2]) for p in paths}
        found = [k for k, n in enumerate(self.nodes) if weight[k] and not n.gone and (n.depth, n.label) in tails and self.path(k) in paths]
        return max(found, key=lambda k: (weight[k], -k)) if found else None

    def text_under(self, top: int | None) -> str:
        if top is None:
            return ""
        under = []  # a parent precedes its children
        for k, node in enumerate(self.nodes):
            under.append(k == top or (node.parent >= 0 and under[node.parent]))
        return "\n\n".join(text for node, text, _ in self.blocks if top == -1 or (node >= 0 and under[node]))


def extract(source: str | None, paths: list[str] | None = None) -> str:
    """Main text of one page under its best node on ``paths``, else under its own best container."""
    if not source:
        return ""
    page = Page(source)
    top = page.on_path(set(paths)) if paths else None
    return page.text_under(page.best() if top is None else top)


def _best_paths(pages: pa.Array) -> pa.Array:
    out = []
    for p in pages:
        source = p.as_py()
        page = Page(source) if source else None
        top = page.best() if page else None
        out.append(None if top is None else page.path(top))
    return pa.array(out, type=pa.string())


#: Marked so that the optimiser neither repeats it in a filter nor moves the filter below it: one parse a page.
_best_path = F.arrow_udf(_best_paths, T.StringType()).asNondeterministic()


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array, paths: pa.Array) -> pa.Array:
    return pa.array([extract(p.as_py(), w.as_py()) for p, w in zip(pages, paths, strict=True)], type=pa.string())


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading ``www.``; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, paths)``: the winning container paths of each host."""
    votes = pages.select(host_of(column(url_col)).alias("host"), _best_path(column(html_col)).alias("path")).where("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"))
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("host"))
    return counted.withColumn("share", share).where(F.col("share") >= min_share).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with ``host``, ``text`` and ``n_chars``."""
    winners, _ = materialize(host_paths(pages, url_col, html_col, min_share), "host-paths")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "")))).first()[0] or 0
    kept = [c for c in pages.columns if c not in ("host", "text", "n_chars")]
    hosted = pages.select(whole_row(pages).alias("row"), host_of(column(url_col)).alias("host"), column(html_col).alias("html"))
    joined = hosted.join(F.broadcast(winners) if size <= BROADCAST_BYTES else winners, "host", "left")
    out = joined.select("row", "host", _extract(F.col("html"), F.col("paths")).alias("text"))
    return out.select(*unwrapped("row", kept), "host", "text", F.length("text").cast("long").alias("n_chars"))
