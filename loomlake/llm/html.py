"""Main text of web pages: subtrees that recur across pages of a host are deleted.

A page becomes a small tree. Each subtree has a hash of its tag, classes, text and children. Spark
counts on how many different pages of its host each hash stands; hashes on many pages are the host's template,
and the text is what the body holds without them. ``article`` and ``main`` guard what is in them.
Elements that are never article text by their tag go without being counted; those marked by their
class do if their share of the text, a guard beside them or the counts confirm it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import col, fresh, row_hash, written

#: A subtree outside the article is template from so many pages and this share of its host's pages on.
LEAST_PAGES, LEAST_SHARE = 3, 0.2
#: Inside the article only a container (no paragraph or heading) that stands on most pages goes.
INNER_PAGES, INNER_SHARE = 5, 0.6
#: A marked subtree with so much of the text around it at most goes without being counted.
MARKED_SHARE = 0.25
#: Template hashes that go to every task (8 bytes each); above, they are joined to the pages.
MOST_SENT = 1_000_000

# Fixed values of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
NEVER = frozenset("script style noscript template iframe svg canvas object head title nav footer aside form button select textarea dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption".split())
#: A start tag closes the open elements of this kind, up to the nearest holder.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot article section div main body html".split())
#: Whole classes, ids or roles that mark what may be no article text; the page or its host must confirm it.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social comment comments respond reply replies disqus related newsletter subscribe signup promo popup modal overlay widget".split())

#: Comments, declarations, stray ends, and tags, each read once: a quote after = holds up to the next one.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=\"']++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = frozenset("class id role hidden aria-hidden".split())
#: Elements in each other; deeper ones stand beside each other, as in browsers.
MOST_DEPTH = 512
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "names", "parent", "depth", "parts", "off", "marked", "holds", "inside", "digest", "size")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []  # strings and nodes, in order
        self.off = False
        self.marked = False
        self.holds = False  # a guard, or something above one
        self.inside: Node | None = None  # the guard around it
        self.digest = b""
        self.size = 0


def parse(page: str) -> Node:
    """A tree of the page, in time linear in its length.

    Unclosed elements end where HTML ends them, stray end tags and a tag cut off by the end are dropped.
    """
    top = here = Node("#page", "", None)
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            x = here
            while x is not None and x.tag != tag:
                x = x.parent
            if x is not None and x.parent is not None:
                here = x.parent
            continue
        here = _before(here, tag)
        node = Node(tag, _names(m[3]) if m[3] else "", here)
        here.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.parts.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and (tag in BLOCK or not m[3].rstrip().endswith("/")) and node.depth < MOST_DEPTH:
            here = node  # a slash does not close an element of HTML
    return top


def _before(here: Node, tag: str) -> Node:
    """Where an element of this tag goes, after what it closes."""
    if tag in BLOCK:
        x = here
        while x is not None and x.tag not in BLOCK:
            x = x.parent
        if x is not None and x.tag == "p":
            here = x.parent
        elif tag == "body":
            while here.parent is not None and here.tag != "html":
                here = here.parent
    if closed := CLOSES.get(tag):
        x = here
        while x is not None and x.tag not in HOLDERS:
            if x.tag in closed:
                return x.parent
            x = x.parent
    return here


def _names(attributes: str) -> str:
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind in NAMING:
            value = (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden" or kind == "aria-hidden" and value == "true":
                out.append("hidden")
            elif kind != "aria-hidden":
                out.append(value)
    return " ".join(out)


def _marked(node: Node) -> bool:
    return bool(node.names) and any(w in MARKS or w == "hidden" for w in node.names.split())


def prepare(top: Node) -> tuple[list[Node], bool]:
    """Marks what its tag or class rules out, hashes all subtrees; all nodes, and whether any is a guard.

    Guards are the outermost ``article`` elements with text, and ``main`` where it holds none of them.
    What holds a guard stays; what is inside one goes only as a container on most pages. Marks of class
    act on what is small for the text around it, or stands beside a guard without being the longer prose.
    """
    nodes: list[Node] = []
    todo = [top]
    while todo:
        x = todo.pop()
        nodes.append(x)
        x.off = x.tag in NEVER
        x.marked = x.tag not in ("html", "body", "main", "article") and _marked(x)
        todo.extend(p for p in x.parts if isinstance(p, Node))
    for x in reversed(nodes):  # children come after their parents
        h = hashlib.blake2b(f"{x.tag} {x.names}".encode("utf-8", "replace"), digest_size=8)
        for p in x.parts:
            if isinstance(p, Node):
                h.update(b"<" + p.digest)
                x.size += 0 if p.off else p.size
            else:
                t = SPACE.sub(" ", p).strip()
                h.update(b'"' + t.encode("utf-8", "replace"))
                x.size += len(t)
        x.digest = h.digest()
    found = [x for x in nodes if x.tag in ("article", "main") and x.size]
    guards = _guards([x for x in found if not any(p.off and p.tag != "form" for p in _upward(x))] or found)
    for g in guards:
        g.inside = g
        for p in _upward(g):
            p.holds, p.off = True, False
    for x in nodes:
        if x.inside is None and x.parent is not None:
            x.inside = x.parent.inside
    rest = sum(g.size for g in guards)
    for x in nodes:
        if x.marked and not x.off and not x.holds:
            x.off = x.size <= MARKED_SHARE * (x.inside or top).size if x.inside or not guards else x.size <= rest or not _prose(x)
        elif x.tag == "form" and x.off and not guards and x.size > top.size:  # around the page itself
            x.off = False
            top.size += x.size
    return nodes, bool(guards)


def _prose(x: Node) -> bool:
    """Whether a node holds several paragraphs."""
    todo, n = [x], 0
    while todo and n < 2:
        y = todo.pop()
        n += y.tag == "p"
        todo.extend(p for p in y.parts if isinstance(p, Node))
    return n >= 2


def _upward(x: Node | None) -> Iterator[Node]:
    """The node and all above it."""
    while x is not None:
        yield x
        x = x.parent


def _guards(found: list[Node]) -> list[Node]:
    articles = [x for x in found if x.tag == "article" and not any(p.tag == "article" for p in _upward(x.parent))]
    around = {id(p) for x in articles for p in _upward(x)}
    return articles + [x for x in found if x.tag == "main" and id(x) not in around and not any(p.tag in ("article", "main") for p in _upward(x.parent))]


def _counted(x: Node) -> bool:
    """Whether the pages of its host decide on this node; inside a guard only on containers."""
    if x.off or x.holds or not x.size or x.tag in ("#page", "html", "body"):
        return False
    return x.inside is None or x.tag in BLOCK and x.tag not in PARAGRAPH


def _key(host: bytes, x: Node) -> int:
    return int.from_bytes(hashlib.blake2b(host + b" " + x.digest, digest_size=8).digest(), "little", signed=True)


def subtree_keys(host: str | None, page: str) -> tuple[set[int], set[int], int]:
    """Keys of the subtrees outside all guards, and of containers inside them; a hash of the content.

    The content is the text in the guards, or that of a page without one; copies of a page share it.
    """
    top = parse(page)
    _, guarded = prepare(top)
    name = (host or "").encode()
    outer, inner = set(), set()
    content = hashlib.blake2b(digest_size=8)
    todo = [top]
    while todo:
        x = todo.pop()
        if _counted(x):
            (outer if x.inside is None else inner).add(_key(name, x))
        for p in reversed(x.parts):
            if isinstance(p, Node):
                if not p.off:
                    todo.append(p)
            elif x.inside is not None or not guarded:
                content.update(b" " + SPACE.sub(" ", p).strip().encode("utf-8", "replace"))
    return outer, inner, int.from_bytes(content.digest(), "little", signed=True)


def extract(host: str | None, page: str, template: set[int]) -> str:
    """Blocks of the body in page order without the template, joined by two line ends.

    Outside the guards of a page all of the template goes; inside a guard, and on a page without
    one, only what is marked or at most half of the text there.
    """
    top = parse(page)
    nodes, guarded = prepare(top)
    name = (host or "").encode()
    for x in nodes if template else ():
        if _counted(x) and (x.marked or guarded and x.inside is None or x.size <= (x.inside or top).size / 2):
            x.off = _key(name, x) in template
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            t = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if t:
                blocks.append(t)
            run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif not x.off:
            if x.tag == "br":
                run.append(" ")
            if x.tag in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(x.parts))
    close()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _keys(host_col: str, html_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            inner: list = []
            contents: list[int] = []
            hosts: list = []
            places: list[int] = []
            for k, (host, page) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                a, b, content = subtree_keys(host.as_py(), page.as_py() or "")
                n = len(a) + len(b) + 1  # a row without a key stands for the page itself
                rows += [*a, *b, None]
                inner += [False] * len(a) + [True] * len(b) + [None]
                contents += [content] * n
                hosts += [host.as_py()] * n
                places += [k] * n
            ids = batch.column(2).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(rows, pa.int64()), pa.array(inner, pa.bool_()), pa.array(contents, pa.int64()), ids], names=["host", "key", "inner", "content", "row"])

    return run


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """``pages`` with ``text``: the body without templates, boilerplate and markup.

    Defined cases: null and empty html give an empty text; pages without a host share the null host;
    every page is taken from its whole body, with or without ``article`` or ``main``; copies of a page
    count once on their host, by the content, and are extracted alike; texts of any length are taken whole; an empty table gives no rows; other
    columns stay, one named like ``out_col`` is replaced. Template hashes are sent to all tasks only
    up to ``most_sent`` of them; beyond, each page gets its own by a join.
    """
    spark = pages.sparkSession
    pages = pages.drop(out_col) if out_col not in (url_col, html_col) else pages
    host, row, found = fresh(pages, "host", "row", "found")
    keyed = pages.withColumns({host: host_of(col(url_col)), row: row_hash(pages, 5)})
    keys = keyed.select(host, html_col, row).mapInArrow(_keys(host, html_col), "host string, key bigint, inner boolean, content bigint, row bigint")
    counts = keys.select("host", "key", "inner", "content").distinct().groupBy("host", "key", "inner").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.where(F.col("key").isNull() | (F.col("n") >= LEAST_PAGES)), "subtrees")
    per_host = counts.where(F.col("key").isNull()).select(F.col("host").alias("h"), F.col("n").alias("of"))
    many = ((~F.col("inner")) & (F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("of"))) | (F.col("inner") & (F.col("n") >= INNER_PAGES) & (F.col("n") >= INNER_SHARE * F.col("of")))
    template = counts.where(F.col("key").isNotNull()).join(per_host, F.col("host").eqNullSafe(F.col("h"))).where(many).select("key").distinct()
    some = template.limit(most_sent + 1).collect()
    schema = T.StructType([*[f for f in pages.schema.fields], T.StructField(out_col, T.StringType())])
    if len(some) <= most_sent:
        sent = spark.sparkContext.broadcast(np.array([r[0] for r in some], np.int64))
        return keyed.drop(row).mapInArrow(_texts(pages.columns, host, html_col, out_col, sent, None), schema)
    mine = keys.join(template, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias(found))
    return keyed.join(mine, F.col(row) == mine["row"], "left").drop("row", row).mapInArrow(_texts(pages.columns, host, html_col, out_col, None, found), schema)


def _texts(columns: list[str], host_col: str, html_col: str, out_col: str, sent, found: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = set(sent.value.tolist()) if sent is not None else set()
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = []
            for k in range(batch.num_rows):
                own = template if found is None else set(get[found][k].as_py() or ())
                texts.append(extract(get[host_col][k].as_py(), get[html_col][k].as_py() or "", own))
            yield pa.RecordBatch.from_arrays([*[get[c] for c in columns], pa.array(texts, pa.string())], names=[*columns, out_col])

    return run
