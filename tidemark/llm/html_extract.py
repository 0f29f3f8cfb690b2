"""Main-text extraction from HTML with site template removal.

A page becomes a tree of elements.  Elements that their tag, role or class marks as
navigation, header, footer, sidebar, notice, advert, form, script, style or reader
comment are left out, and where the page names its main part or article, only that
counts (the main part whole, where it holds the article).  A class or id marks an
element if it is a mark as a whole, or made of marks and words of place and shape:
``cookie-notice`` and ``site-header`` do, ``notice-period`` and ``header-image`` do
not.  Inside the named part a class or id counts on containers only (a ``div``, a
``section``, a list), since paragraphs and headings there are the article's, whatever
they are called; and if nothing would be left of a named part, only those classes and
ids in it count that mark adverts.

Subtrees are compared across the site before these rules: every element's
subtree is hashed, and Spark counts per host in how many pages with different main
texts each hash stands.  Subtrees that stand in at least ``min_pages`` of them and in
a share of the host's are template and are deleted: in ``share`` of them inside a
named part, whose repeated paragraphs are content, and in ``outer_share`` of them
elsewhere (pages that name no part are elsewhere throughout).  Pages that carry one
and the same text count once, so that a copied article does not look like a template.

The hashes to delete are broadcast if they are ``broadcast_hashes`` at most.  More of
them are joined to the pages by host, an array per host: since a template stands in
a share of the host's pages, an array is at most 1 / ``outer_share`` times as long as
the host's pages have subtrees on average.  Pages of hot hosts stay where they are.

The text is made of blocks: character references are decoded, white space inside a
block becomes one space, and non-empty blocks are joined in page order by a newline.

Defined results: null and empty pages have an empty text; text outside any tag is
content; pages without a host share the empty host; repeated rows get the same text
each; unclosed elements end with the page; a list of three or more links of four
words at most, and nothing else, is a menu on pages that name no part, if no text
comes before it; of pages with equal main texts the one with the least subtree hashes is counted; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import annotate, batches_of, no_collection, split_hot_join, written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>\"']*)[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first set ends where an element of the key begins, unless one of the second set lies between.
_ENDS = {
    **dict.fromkeys(_BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "li", "dt", "dd"}, ({"p"}, {"table", "td", "th", "object"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir", "td", "th"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "body": ({"head"}, set()),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"caption"}, {"table"}),
}

_LEFT_OUT = frozenset("nav footer aside form script style head title noscript template svg math iframe object canvas audio video button select textarea dialog menu xmp noembed noframes".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Classes and ids that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup comment comments commentlist disqus respond share sharing social related recommended pagination pager login search skip".split()
)
#: Those of them that also count on the containers of a named article: all but what an article's own parts are called.
_ARTICLE_MARKS = _MARKS - frozenset("header masthead search skip login".split())
#: Those that an article's own text is never called.
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion disqus gdpr".split())
#: What an article is built of and what can hold something that is set into it.
_CONTAINERS = frozenset("div section aside ul ol dl table figure fieldset details article center".split())
#: Words of place and shape, which change nothing about what a mark says.
_SHAPES = frozenset("site page user users reader readers visitor visitors section sections thread threads body text content count form feed message top bottom left right main inner outer primary secondary global fixed sticky mobile desktop wrap wrapper container bar box block banner list item items links link buttons button widget widgets area slot unit panel js".split())


#: Tells the hash of a subtree outside a named article from that of the same one inside.
OUTER = 0x9E3779B97F4A7C15


class Node:
    __slots__ = ("tag", "children", "out", "named", "hash", "main", "words")

    def __init__(self, tag: str, out: bool = False, main: bool = False, named: bool = False):
        self.tag, self.children, self.out, self.main, self.hash, self.words = tag, [], out, main, 0, False
        self.named = named  # left out by a class or id inside a named part


def _marked(names: str, marks: frozenset[str]) -> bool:
    """Whether one of the class names or ids is a mark, alone or with words of place and shape."""
    for name in names.lower().split():
        if name in marks:
            return True
        parts = [p for p in _PARTS.split(name) if p and not p[0].isdigit()]
        if any(p in marks for p in parts) and all(p in marks or p in _SHAPES for p in parts):
            return True
    return False


def _node(tag: str, attributes: str, inside: bool) -> Node:
    out, main, named = tag in _LEFT_OUT or (tag == "header" and not inside), tag == "main", False
    if attributes and not out:
        found = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
        role = found.get("role", "").lower()
        main = main or role == "main"
        if tag not in ("html", "body", "main"):
            within = inside or main or tag == "article"
            marks = (_ARTICLE_MARKS if tag in _CONTAINERS else frozenset()) if within else frozenset() if tag in _HEADING else _MARKS
            names = f"{found.get('class', '')} {found.get('id', '')}"
            marked = _marked(names, marks)
            hidden = role in _ROLES or "hidden" in found or "display:none" in found.get("style", "").lower().replace(" ", "")
            out, named = marked or hidden, marked and not hidden and inside and not _marked(names, _ADVERTS)
    return Node(tag, out, main, named)


def parse(page: str) -> Node:
    """The page's elements under one root.  Every element has the hash of its subtree when it ends."""
    root = Node("#root")
    stack, open_, named = [root], Counter(), 0
    at, search, size = 0, _TOKEN.search, len(page)

    def pop() -> None:
        nonlocal named
        node = stack.pop()
        open_[node.tag] -= 1
        named -= node.main or node.tag == "article"
        _close(node)

    while at < size:
        m = search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_[tag]:
                if tag not in _BLOCK:  # an inline element does not end the blocks inside it
                    depth = len(stack) - 1
                    while stack[depth].tag != tag and stack[depth].tag not in _BLOCK:
                        depth -= 1
                    if stack[depth].tag != tag:
                        continue
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            if any(open_[t] for t in ends):
                depth, last = len(stack) - 1, None
                while depth > 0 and stack[depth].tag not in stops and stack[depth].tag not in ("article", "section", "div", "main", "body"):
                    if stack[depth].tag in ends:
                        last = depth
                    depth -= 1
                while last is not None and len(stack) > last:
                    pop()
        node = _node(tag, m[3] or "", named > 0)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in _VOID:
            stack.append(node)
            open_[tag] += 1
            named += node.main or tag == "article"
    while len(stack) > 1:
        pop()
    return root


def _close(node: Node) -> None:
    parts = [node.tag.encode()]
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            node.words = node.words or bool(text)
            parts.append(text.encode("utf-8", "surrogatepass"))
        else:
            node.words = node.words or child.words
            parts.append(child.hash.to_bytes(8, "little"))
    node.hash = xxhash.xxh64_intdigest(b"\x00".join(parts))


def _outermost(root: Node, wanted) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.out:
            continue
        if wanted(node):
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def content_roots(root: Node) -> tuple[list[Node], bool]:
    """Where the main text stands, and whether the page says so itself: the main part or the article, whichever is outermost."""
    mains = _outermost(root, lambda n: n.words and n.main)
    found = _outermost(root, lambda n: n.words and (n.main or n.tag == "article"))
    if mains:
        found = [n for n in found if n.main] or found
    return (found, True) if found else ([root], False)


def _is_link_list(node: Node) -> bool:
    """Whether a list holds short links and nothing else: a menu that no mark gives away."""
    links, todo = 0, [(node, False)]
    while todo:
        item, in_link = todo.pop()
        words = 0
        for child in item.children:
            if isinstance(child, str):
                words += len(child.split())
            else:
                links += child.tag == "a"
                todo.append((child, in_link or child.tag == "a"))
        if words > (4 if in_link else 0):
            return False
    return links >= 3


def walk(roots: list[Node], named: bool, template=frozenset(), by_name: bool = True) -> Iterator[Node | str | None]:
    """Elements and texts of the content in page order; None where a block begins or ends.  Without ``by_name``, classes and ids inside a named part do not count."""
    begun = False
    for root in roots:
        todo: list = [None, root, None]
        while todo:
            item = todo.pop()
            if not isinstance(item, Node):
                begun = begun or (item is not None and not item.isspace())
                yield item
                continue
            if (item.out and (by_name or not item.named)) or (item.hash if named else item.hash ^ OUTER) in template or (not named and not begun and item.tag in ("ul", "ol") and _is_link_list(item)):
                continue
            if item.tag in ("br", "img"):
                yield " "
                continue
            yield item
            edge = [None] if item.tag in _BLOCK else []
            todo += [*edge, *reversed(item.children), *edge]


def main_text(page: str | None, template=frozenset()) -> str:
    roots, named = content_roots(parse(page)) if page else ([], True)
    return _blocks(roots, named, template, True) or (_blocks(roots, named, template, False) if named else "")


def _blocks(roots: list[Node], named: bool, template, by_name: bool) -> str:
    blocks, buffer = [], []
    for item in [*walk(roots, named, template, by_name), None]:
        if item is None:
            if buffer:
                blocks.append(" ".join(entities.unescape("".join(buffer)).split()))
                buffer = []
        elif isinstance(item, str):
            buffer.append(item)
    return "\n".join(b for b in blocks if b)


def subtrees(page: str | None) -> tuple[int, list[int], list[int]]:
    """A hash of the page's main text, and the hashes of the elements with words inside and outside a named article, as signed 64-bit numbers.

    What is left out by tag, class or role counts as outside; of it, and of what
    surrounds an article, only blocks count, so that a menu's link is not taken for one in a text.
    """
    if not page:
        return 0, [], []
    root = parse(page)
    roots, named = content_roots(root)
    inner, outer, texts = set(), set(), []
    for item in walk(roots, named):
        if isinstance(item, Node):
            if item.words and item.tag not in ("#root", "html", "body"):
                (inner if named else outer).add(item.hash if named else item.hash ^ OUTER)
        elif item:
            texts.append(" ".join(item.split()))
    content, todo = {id(r) for r in roots}, [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = (inside or id(node) in content) and not node.out
        if not inside and node.words and (node.out or node.tag in _BLOCK) and node.tag not in ("html", "body"):
            outer.add(node.hash ^ OUTER)
        todo += [(c, inside) for c in node.children if isinstance(c, Node)]
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    return signed(xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass"))), sorted(map(signed, inner)), sorted(map(signed, outer))


def template_hashes(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_pages: int = 8, share: float = 0.6, outer_share: float = 0.05) -> DataFrame:
    """host and hash of the subtrees that are template."""
    source = pages.select(_host(url_col).alias("host"), F.col(f"`{html_col}`").alias("page"))

    def make():
        def apply(texts: pa.Array) -> list:
            found = [subtrees(t) for t in texts.to_pylist()]
            return [list(c) for c in zip(*found, strict=True)] or [[], [], []]

        return apply

    seen = annotate(source, "page", [("content", T.LongType()), ("hashes", T.ArrayType(T.LongType())), ("outer", T.ArrayType(T.LongType()))], make, drop=["page"])
    distinct = written(seen.where(F.size("hashes") + F.size("outer") > 0), "html-subtrees").groupBy("host", "content").agg(F.min(F.struct("hashes", "outer")).alias("found"))
    distinct = written(distinct, "html-contents")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    each = lambda part, least: distinct.select("host", F.explode(f"found.{part}").alias("hash"), F.lit(least).alias("least"))
    counts = each("hashes", share).union(each("outer", outer_share)).groupBy("host", "hash", "least").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    counts = written(counts, "html-counts", 4)
    hosts = written(counts.groupBy("host").agg(F.count("*").alias("held")).join(hosts, "host"), "html-hosts", 4)
    return split_hot_join(counts, hosts, ["host"], "held").where(F.col("n") >= F.col("least") * F.col("pages")).select("host", "hash")


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", min_pages: int = 8, share: float = 0.6, outer_share: float = 0.05, broadcast_hashes: int = 1 << 20) -> DataFrame:
    """``pages`` with text and n_chars (its code points); columns of those names are replaced."""
    template = written(template_hashes(pages, html_col, url_col, min_pages, share, outer_share), "html-template", 4)
    columns = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    work = pages.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(columns)], _host(url_col).alias("host"), F.col(f"`{html_col}`").alias("page"))
    if template.count() <= broadcast_hashes:
        sets: dict[str, list[int]] = {}
        for row in template.collect():
            sets.setdefault(row["host"], []).append(row["hash"])
        packed = pages.sparkSession.sparkContext.broadcast({h: np.array(sorted(s), "i8") for h, s in sets.items()})
    else:
        packed = None
        arrays = template.groupBy("host").agg(F.collect_set("hash").alias("gone"))
        hosts = written(work.groupBy("host").agg(F.count("*").alias("pages")).join(arrays, "host", "left"), "html-arrays")
        work = split_hot_join(work, hosts, ["host"], "pages").drop("pages")
    texts = _texts(work, packed)
    return texts.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(columns)], "text", F.char_length("text").cast("long").alias("n_chars"))


def _texts(work: DataFrame, packed) -> DataFrame:
    """The main text of every page of (own_0, ..., host, page), without the host's template: from the broadcast, or the array ``gone`` of the row."""
    kept = [f for f in work.schema.fields if f.name.startswith("own_")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches):
        known: dict[str, frozenset[int]] = {}
        column = lambda batch, name: batch.column(batch.schema.get_field_index(name))
        with no_collection():
            for batch in batches_of(batches, "page", 4 << 20):
                hosts, made = column(batch, "host").to_pylist(), []
                for n, (host, page) in enumerate(zip(hosts, column(batch, "page").to_pylist(), strict=True)):
                    if host not in known:
                        if len(known) >= 64:
                            known.clear()
                        gone = packed.value.get(host, ()) if packed else column(batch, "gone")[n].as_py() or ()
                        known[host] = frozenset(int(h) % (1 << 64) for h in gone)
                    made.append(main_text(page, known[host]))
                yield pa.RecordBatch.from_arrays([column(batch, f.name) for f in kept] + [pa.array(made, pa.string())], names=schema.names)

    return work.mapInArrow(run, schema)
