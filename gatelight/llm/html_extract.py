"""Main text of web pages by removal of site templates.

Every page becomes a tree. Its subtrees are hashed twice, with their text (tag, class, id, text, children) and without (tag, class, id
and the runs of equal children), and both are counted per host in Spark. What recurs on enough pages of its host whose articles differ is template and is deleted.
With their text, that is min_pages for containers and for articles within articles, and block_pages for other elements (paragraphs, headings, list items, links), which
articles may share. Without, it is min_pages for containers whose texts differ from page to page, as menus, adverts and footers do, if they hold at most max_share of
a page's text on average, don't hold the article, a main element or its title, and are mostly links, landmarks (nav, footer, ...) or, outside the article, have a class or id. Of these other elements, what is part of a sentence isn't judged, nor what stands in an article or main element
without a class, id or role: passages that articles share are article text. Pages that differ outside their article only count
once, so that copies of an article don't delete it. If nothing else is left of a page, subtrees with over half of its text stay.
What no count can show, because a host has too few pages or its parts differ from page to page, is deleted by its kind: navigation, headers and footers outside the
article, asides, forms, notices, adverts, reader comments, scripts and styles. Of the rest, the article or main element is taken
if the page has one, and the body otherwise.

A host may hold any share of all pages: the counts are sums per (host, subtree), and pages get their list of
templates by a join on a digest of the page.

Defined results. Null html counts as empty and has an empty text; a null url is a host of its own. Pages that
are equal byte by byte count once. Tags that are cut off at the end of a page count as closed. Repeated rows each give
a row. Columns besides the named ones are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("br td th tr tbody thead tfoot caption option select".split())
CONTAINER = frozenset("aside center dl details dialog div fieldset figure footer form header menu nav ol section table ul".split())
DROPPED = frozenset("head nav footer aside form button select iframe object dialog menu".split())
#: Parts of a class, id or role that mark what is no article text.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice banner advert adverts advertisement"
    " ads adsense sponsor sponsored promo promoted newsletter subscribe subscription signup login popup modal overlay comments comment disqus respond"
    " replies share sharing social related recommended pagination pager widget toolbar skip complementary contentinfo search".split()
)
WHOLE_MARKS = frozenset(["ad"])
LANDMARK = frozenset("aside dialog footer form header menu nav".split())
#: What isn't judged by its structure alone if it holds one of these.
HOLDS = frozenset("article h1 main".split())


class Node:
    __slots__ = ("children", "code", "holds", "judged", "links", "names", "shape", "size", "tag")

    def __init__(self, tag: str, names: str):
        self.tag, self.names = tag, names
        self.children: list = []
        self.code, self.judged, self.size = 0, 0, 0
        self.shape, self.links, self.holds = 0, 0, False


def parse(page: str) -> Node:
    root = Node("#", "")
    stack, at = [root], 0
    # Depths of the open elements by tag, and of the open blocks other than paragraphs: no search through the stack.
    where: dict[str, list[int]] = {}
    blocks: list[int] = []

    def close(depth: int) -> None:
        for node in stack[depth:]:
            where[node.tag].pop()
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    for m in _TAG.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        last = blocks[-1] if blocks else 0
        if m[2]:
            own = where.get(tag)
            # An end tag for an inline element doesn't end the blocks around it.
            if own and (tag in BLOCK or own[-1] > max(last, (where.get("p") or [0])[-1])):
                close(own[-1])
            continue
        if tag in ENDS_P or tag in ("li", "dd", "dt"):
            ended = ["p", *{"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}.get(tag, ())]
            nearest = max(where[x][-1] if where.get(x) else 0 for x in ended)
            if nearest and nearest >= last:
                close(nearest)
        names = " ".join(next(filter(None, x[1:]), "") for x in _NAMES.findall(m[4])) if m[4] else ""
        node = Node(tag, names.lower())
        stack[-1].children.append(node)
        if tag not in VOID and not m[5]:
            where.setdefault(tag, []).append(len(stack))
            if tag in BLOCK and tag != "p":
                blocks.append(len(stack))
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "big", signed=True)


def _hashed(node: Node) -> list[Node]:
    """Set code, shape, size (characters of text), links (those within links) and holds of a node and all below it; returns them, parents first."""
    order, todo = [], [node]
    while todo:
        order.append(x := todo.pop())
        todo += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        name = f"{x.tag}|{x.names}".encode()
        parts, shapes, last = [name], [name], None
        x.size = 0
        for c in x.children:
            if isinstance(c, Node):
                parts.append(b"<%d>" % c.code)
                x.size += c.size
                x.links += c.links
                x.holds = x.holds or c.holds
                if c.shape != last:
                    shapes.append(b"<%d>" % c.shape)
                    last = c.shape
            elif text := " ".join(c.split()):
                parts.append(text.encode())
                x.size += len(text)
        if x.tag == "a":
            x.links = x.size
        x.holds = x.holds or x.tag in HOLDS
        x.code, x.shape = _digest(*parts), _digest(*shapes)
    return order


def _judge(root: Node) -> list[tuple[Node, bool]]:
    """Set judged: 1 for what min_pages make template, 2 for what block_pages do, 0 for what counts never delete. Returns
    the nodes with 1 or 2 that have text, and whether their structure counts, but none within a node whose kind would delete it anyway: that is judged as a whole."""
    found, todo = [], [(root, False, False, False, False)]
    while todo:
        node, inside, in_article, in_line, dropped = todo.pop()
        mixed = in_line or any(isinstance(c, str) and not c.isspace() for c in node.children)
        for c in node.children:
            if not isinstance(c, Node):
                continue
            if c.tag in CONTAINER or (c.tag == "article" and in_article):
                c.judged = 1
            elif c.tag not in ("html", "body", "main", "article") and (c.names or not inside) and not (mixed if c.tag not in BLOCK else in_line):
                c.judged = 2
            gone = dropped or _no_text(c, True)
            if c.judged and c.size and not dropped:
                by_shape = c.tag in CONTAINER and not c.holds and (c.tag in LANDMARK or 2 * c.links >= c.size or (bool(c.names) and not inside))
                found.append((c, by_shape))
            todo.append((c, inside or c.tag in ("article", "main"), in_article or c.tag == "article", in_line or c.tag in ("p", "h1") or c.tag in HEADING, gone))
    return found


def subtrees(page: str) -> tuple[int, list[tuple[int, bool, int | None, float]]]:
    """A digest of the page's text without what is deleted by its kind; and of each subtree judged its code, whether block_pages count, its
    shape if that counts, and the share of the page's text that subtrees of this shape hold."""
    root = parse(page)
    _hashed(root)
    judged = _judge(root)
    sizes: dict[int, int] = {}
    for node, by_shape in judged:
        if by_shape:
            sizes[node.shape] = sizes.get(node.shape, 0) + node.size
    found = list({(x.code, x.judged == 2, x.shape if by_shape else None, sizes[x.shape] / root.size if by_shape else 0.0) for x, by_shape in judged})
    text = _text(root, frozenset(), 1.0) if found else ""
    return _digest(text.encode("utf-8", "replace")), found


def _marked(node: Node) -> bool:
    if not node.names:
        return False
    whole = node.names.split()
    return any(x in WHOLE_MARKS or x.startswith(("ad-", "ads-", "ad_")) for x in whole) or any(part in MARKS for x in whole for part in re.split(r"[-_]+", x))


def _no_text(node: Node, inside: bool) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag in ("body", "html", "main", "h1"):
        return False
    if node.tag == "p" or node.tag in HEADING:
        return _marked(node)
    if node.tag == "header" or "header" in re.split(r"[\s_-]+", node.names):
        return not inside
    return _marked(node)


def main_text(page: str, templates: frozenset[int] = frozenset(), kinds: bool = True) -> str:
    """The text of a page without the subtrees whose codes are given and without what is no article text. kinds: whether elements go
    by their kind and the article is looked for; without, only templates go."""
    root = parse(page)
    if not templates:
        return _text(root, templates, 1.0, kinds)
    _hashed(root)
    _judge(root)
    return _text(root, templates, 1.0, kinds) or _text(root, templates, 0.5, kinds)


def _text(root: Node, templates: frozenset[int], most: float, kinds: bool = True) -> str:
    """The text without templates that hold at most that share of the page's text."""

    def gone(node: Node, inside: bool) -> bool:
        return (node.judged > 0 and node.code in templates and node.size <= most * root.size) or (kinds and _no_text(node, inside))

    # Roots of content: outermost articles, else the main element, else everything.
    articles, mains, todo = [], [], [(root, False)]
    while todo:
        node, in_main = todo.pop()
        if node.tag == "article" and not _marked(node):
            articles.append((node, in_main))
            continue
        if node.tag == "main":
            mains.append(node)
        todo += [(c, in_main or node.tag == "main") for c in reversed(node.children) if isinstance(c, Node) and not gone(c, False)]
    tops = ([n for n, own in articles if own] or [n for n, _ in articles] or mains if kinds else []) or [root]
    inside = tops != [root]
    blocks: list[str] = []
    for top in tops:
        line: list[str] = []
        todo = [top]
        while todo:
            x = todo.pop()
            if x is None:
                blocks.append("".join(line))
                line = []
            elif isinstance(x, str):
                line.append(html.unescape(x))
            elif x is top or not gone(x, inside):
                edge = [None] if x.tag in BLOCK else []
                todo += edge + x.children[::-1] + edge
            elif x.tag in BLOCK:
                todo.append(None)
        blocks.append("".join(line))
    return " ".join(filter(None, (" ".join(b.split()) for b in blocks)))


def template_codes(rows: DataFrame, min_pages: int = 4, block_pages: int = 30, max_share: float = 0.25) -> DataFrame:
    """page and codes, those of its subtrees that are template, of each page that has some. rows: page (a digest of host and html), html and host_code, which
    is mixed into all codes, so that those of different hosts differ and rows needn't carry their host.

    A subtree is template if it recurs with its text on min_pages different pages of a host at least, other elements than containers on
    block_pages; or, without its text, on min_pages pages of whose text its structure holds max_share on average at most.
    """

    def listed(batches):
        for batch in batches:
            columns = [[] for _ in range(6)]
            for key, page, host in zip(*(c.to_pylist() for c in batch.columns)):
                text, found = subtrees(page)
                for code, block, shape, share in found:
                    for out, value in zip(columns, (key, text, code ^ host, block, None if shape is None else shape ^ host, share)):
                        out.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page", "text", "code", "block", "shape", "share"])

    found = rows.select("page", "html", "host_code").mapInArrow(listed, "page binary, text long, code long, block boolean, shape long, share float")
    found, _ = scratch.written(found, "page-subtrees")
    many = found.select("code", "block", "text").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("block"))
    same = many.filter(F.col("n") >= F.when(F.col("block"), block_pages).otherwise(min_pages)).select("code")
    shapes = found.filter("shape IS NOT NULL").groupBy("shape", "text").agg(F.max("share").alias("share"))
    alike = shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("share")).filter((F.col("n") >= min_pages) & (F.col("share") <= max_share)).select("shape")
    by_code = found.join(same, "code").select("page", "code")
    by_shape = found.join(alike, "shape").select("page", "code")
    return by_code.unionByName(by_shape).groupBy("page").agg(F.collect_set("code").alias("codes"))


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\w+://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.withColumns({"host_code": F.xxhash64(host), "page": F.unhex(F.md5(F.concat_ws("\n", host, "html")))})


def extract(
    pages: DataFrame,
    min_pages: int = 4,
    block_pages: int = 30,
    max_share: float = 0.25,
    counts: bool = True,
    kinds: bool = True,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (different subtrees of the page that are template). counts and kinds switch either way of deletion off."""
    scratch.bounded_batches(pages.sparkSession)
    rows = _pages(pages, id_col, url_col, html_col)
    types = rows.schema
    schema = f"page_id {types['page_id'].dataType.simpleString()}, url {types['url'].dataType.simpleString()}, text string, n_chars long, n_templates long"

    def extracted(batches):
        for batch in batches:
            texts = [main_text(page, frozenset(c ^ host for c in codes or ()), kinds) for page, codes, host in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([len(x or ()) for x in batch.column(3).to_pylist()], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_templates"],
            )

    marked = rows.join(template_codes(rows, min_pages, block_pages, max_share), "page", "left") if counts else rows.withColumn("codes", F.lit(None).cast("array<long>"))
    return marked.select("page_id", "url", "html", "codes", "host_code").mapInArrow(extracted, schema)
