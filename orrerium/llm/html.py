"""Main text of web pages: page structure, and site templates found by counting subtrees per host.

Pass one hashes the boxes of a page's content (its articles or main elements, else all of it) and
counts, in Spark, on how many pages of a host each stands. Pass two drops boxes that recur,
structural boilerplate by its element or class, and returns the blocks that are left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrerium.llm.common import materialise

#: A box is template if it stands on at least this share of its host's pages that differ in content, and on so many pages.
LEAST_SHARE, LEAST_PAGES = 1 / 3, 5

#: Element classes of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = RAW | {"head", "nav", "aside", "footer", "form", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "math", "audio", "video", "map", "datalist", "fieldset"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Parts of a text, list or table, which recur in texts that are no copies and go only with a box that holds them; elements that hold boxes.
PARTS = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "caption", "figcaption", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
HOLDERS = {"#root", "html", "body", "div", "section", "article", "main", "center", "header"}
LISTS = {"ul", "ol", "dl", "table"}
CLOSES_P = BLOCKS - {"br", "body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An element that opens here ends an open sibling of these names, up to the given limits.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that name boilerplate.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|adsense|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|complementary|footer|contentinfo|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|comment|comments|disqus|respond|replies|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|pagination|pager|widget|toolbar|masthead|skip)(?:$|[\s_-])"
    r"|(?:^|\s)(?:site|page|global|top)[_-]?header(?:$|\s)",
    re.I,
)
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.S)
NAMES = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("children", "drop", "main", "name", "tag")

    def __init__(self, tag: str, name: str = "", drop: bool = False, main: bool = False):
        self.tag, self.name, self.drop, self.main = tag, name, drop, main
        self.children: list[Node | str] = []


def _node(tag: str, attrs: str) -> Node:
    said = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(attrs)} if attrs else {}
    name = " ".join(said.get(k, "") for k in ("class", "id", "role")).strip()
    hidden = said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")) is not None
    drop = tag in DROPPED or hidden or (bool(name) and tag not in ("html", "body", "main") and NAMED.search(name) is not None)
    return Node(tag, name, drop, tag in ("article", "main") or said.get("role") == "main")


def parse(html: str) -> Node:
    """A tree of elements and text; unclosed and misplaced tags are mended as browsers do in the plain cases."""
    root = Node("#root")
    stack = [root]
    at = 0
    find = TOKEN.search
    while m := find(html, at):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].main and tag not in ("body", "html", "article", "main", "section", "div"):
                    break
            continue
        node = _node(tag, m[3])
        if tag in CLOSES_P:
            _end(stack, {"p"}, {"article", "main", "section", "div", "td", "li", "blockquote", "body", "button"})
        elif tag in SIBLINGS:
            _end(stack, *SIBLINGS[tag])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<(?:/?[a-zA-Z][^<>]*|!--.*|/)?\Z", rest, re.S)  # a tag that the page's end has cut
        stack[-1].children.append(rest[: cut.start()] if cut else rest)
    return root


def _end(stack: list[Node], names: set[str], limits: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            return
        if stack[k].tag in limits:
            return


def subtrees(root: Node) -> tuple[dict[int, int], int]:
    """(hash of each box of the page's content by identity, hash of the content): of what extract() would return.

    No box: the content itself and its sole wrappers, elements without text, words within a sentence, and PARTS with what
    is all that they hold. Within articles and main elements, what is only text is the author's, however often it stands:
    boxes there are lists and holders of which links are half the text at least, and named holders of several elements.
    """
    mains = _mains(root)
    heads = mains or [root]
    order: list[Node] = []
    todo = list(heads)
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node) and not c.drop]
    digest: dict[int, bytes] = {}
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    held: dict[int, int] = {}
    out: dict[int, int] = {}
    for x in reversed(order):
        h = hashlib.blake2b(f"{x.tag} {x.name}".encode(errors="replace"), digest_size=8)
        inner: list[Node] = []
        text = links = 0
        for c in x.children:
            if isinstance(c, str):
                if t := " ".join(c.split()):
                    text += len(t)
                    h.update(b"\0" + t.encode(errors="replace"))
            elif id(c) in digest:
                inner.append(c)
                links += linked[id(c)]
                h.update(b"\1" + digest[id(c)])
        if not (text or inner):
            continue
        k = id(x)
        digest[k], size[k], held[k] = h.digest(), text + sum(size[id(c)] for c in inner), len(inner)
        linked[k] = size[k] if x.tag == "a" else links
        alone = len(inner) == 1 and not text
        for c in inner:
            i = id(c)
            if c.tag in PARTS or (alone and x.tag in PARTS) or (c.tag not in BLOCKS and (text or x.tag not in HOLDERS)):
                continue
            holds = c.tag in HOLDERS or c.tag in LISTS
            if not mains or (holds and 0 < size[i] <= 2 * linked[i]) or (c.tag in HOLDERS and c.name and held[i] > 1):
                out[i] = int.from_bytes(digest[i], "little", signed=True)
    for x in heads:
        while True:
            out.pop(id(x), None)
            inner = [c for c in x.children if id(c) in digest]
            if len(inner) != 1 or inner[0].tag not in HOLDERS or any(isinstance(c, str) and c.strip() for c in x.children):
                break
            x = inner[0]
    whole = hashlib.blake2b(b"".join(digest.get(id(x), b"") for x in heads), digest_size=8)
    return out, int.from_bytes(whole.digest(), "little", signed=True)


def extract(root: Node, template: set[int]) -> str:
    """Text of the blocks that are no boilerplate, in page order, joined by spaces."""
    hashes = subtrees(root)[0] if template else {}
    main = _mains(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if t := " ".join(unescape("".join(line)).split()):
            blocks.append(t)
        line.clear()

    todo: list[Node | str | None] = list(reversed(main or [root]))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.drop and not (main and x in main) or hashes.get(id(x)) in template:
            if x.tag in BLOCKS:
                flush()
        else:
            if block := x.tag in BLOCKS or x.tag == "#root":
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return " ".join(blocks)


def _mains(root: Node) -> list[Node]:
    """The outermost articles, else the outermost main elements, outside of boilerplate."""
    for tags in (("article",), ("main",)):
        found: list[Node] = []
        todo = [root]
        while todo:
            x = todo.pop()
            if x.drop:
                continue
            if x.tag in tags or ("main" in tags and x.main):
                found.append(x)
            else:
                todo += [c for c in reversed(x.children) if isinstance(c, Node)]
        if found:
            return found
    return []


def host(url) -> F.Column:
    """Host of a URL column, lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, least_share: float = LEAST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page, hashes): of each page the boxes that recur over its host's pages; pages without any are left out.

    pages: page, host, html; equal pages of a host have one key. A hash counts once a page, and pages of a host with equal content
    count once: an article that a site shows under many addresses is not a template.
    """

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, whole = [], []
            for page in batch.column(2).to_pylist():
                mine, content = subtrees(parse(page or ""))
                found.append(sorted({*mine.values()}))
                whole.append(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["page", "host", "content", "hashes"])

    known = materialise(pages.select("page", F.xxhash64("host").alias("host"), "html").mapInArrow(boxes, "page long, host long, content long, hashes array<long>"), "boxes")
    totals = known.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = known.where(F.size("hashes") > 0).dropDuplicates(["host", "content"]).select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    common = materialise(counts.join(totals, "host").where(F.col("n") >= least_share * F.col("total")).select("host", "hash"), "common")
    held = known.where(F.size("hashes") > 0).dropDuplicates(["page"]).select("page", "host", F.explode("hashes").alias("hash")).join(common, ["host", "hash"])
    return held.groupBy("page").agg(F.collect_list("hash").alias("hashes"))


def main_text(pages: DataFrame, least_share: float = LEAST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Every page with its main text: page_id, url, text, n_chars (code points); repeated rows one by one.

    pages: page_id, url, html; other columns are left aside. Null and empty pages have an empty text; pages without a URL
    share the empty host.
    """
    pages = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.col("html").cast("string"))
    pages = pages.withColumn("page", F.xxhash64("host", "html"))
    known = materialise(templates(pages, least_share, least_pages), "templates")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(parse(page or ""), set(t or ())) for page, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.join(known, "page", "left").select("page_id", "url", "html", "hashes").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
