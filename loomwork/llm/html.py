"""HTML extraction by site template removal.

Every page becomes a tree; each element's subtree is hashed twice: exactly, and by its form alone (its path of tags
and classes, and the kinds of blocks in it, with all text masked), so that a menu recurs though its words differ.
Spark counts on how many distinct pages of its host a hash occurs; subtrees that recur across many of them are
deleted. Where a page doesn't mark its article, a form counts as template only if the block is a menu, a header or the like,
or mostly links, or if its words come again on other pages as well: a block whose words differ from page to page is text. What a page marks as its article, or else the block that holds most of its letters outside links, is never
deleted itself, and inside it only exact repeats are. Elements that HTML defines as no part of the text, and those
that name themselves an advert, a comment or the like, go too: they are all there is on hosts of one page or two.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import chunks, read, stored

LEAST_PAGES = 3  # distinct pages of a host that a template subtree occurs on, at least
LEAST_SHARE = 0.2  # and the share of the host's distinct pages
FORM_SHARE = 0.5  # the same for forms without text
INNER_PAGES, INNER_SHARE = 10, 0.5  # the same for exact repeats inside the article, where pages may quote each other
INNER_LETTERS = 30
SMALL = 200_000  # template hashes that every worker may hold
FORM, OUTER, INNER, LOOSE = range(4)  # kinds of hashes; LOOSE: forms of blocks that are mostly text

# Elements of HTML by what a reader sees of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style noscript template title noembed noframes".split())
NOT_TEXT = UNSEEN | frozenset("nav header footer aside form button select option textarea input dialog menu iframe object canvas audio video svg math fieldset".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CELLS = frozenset("td th tr tbody thead tfoot caption li dt dd summary".split())
PARTS = frozenset("nav header footer aside form dialog menu fieldset".split())  # blocks too
BOXES = frozenset("div section center".split()) | PARTS  # what a form without text may be deleted for
LISTS = frozenset("ul ol dl table p".split())  # the same where most of it is links
CLOSES = {  # an opening tag that ends an open element of these kinds
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
} | {b: {"p"} for b in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
ROWS = frozenset("tr thead tbody tfoot td th".split())  # those that end several
SCOPE = frozenset("ul ol dl table div article section main body html td th blockquote aside nav header footer form".split())
BORDERS = {tag: SCOPE - ends for tag, ends in CLOSES.items()}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Whole class names and ids by which elements name themselves, in an article and, with more of them, outside.
NAMED_INSIDE = frozenset("ad ads advert advertisement adslot sponsored comment comments comment-list commentlist comments-area disqus_thread share sharing social-share related related-posts newsletter".split())
NAMED = NAMED_INSIDE | frozenset("banner promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies cookie-banner cookie-notice consent notice popup modal respond replies subscribe pagination pager widget search-form skip-link".split())
#: What a page marks itself as its article; its own class never counts as a sign against it.
KEPT = frozenset(("article", "main", "body", "html"))

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")
FIGURES = re.compile(r"[0-9]+")
UNDISPLAYED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "up", "path", "hash", "words", "form", "size", "plain", "titled", "inner", "guarded")

    def __init__(self, tag: str, attributes: str, up: Node | None) -> None:
        self.tag, self.children, self.up = tag, [], up
        self.attributes: dict[str, str] = {}
        if attributes:
            for name, value in reversed(ATTRIBUTE.findall(attributes)):  # the first of a name counts
                self.attributes[name.lower()] = value.strip("\"'")
        self.path = self.hash = self.words = self.form = self.size = self.plain = 0  # size: letters; plain: those outside links
        self.titled = self.inner = self.guarded = False

    def named(self) -> str:
        a = self.attributes
        return SPACE.sub(" ", f"{a.get('class', '')}\0{a.get('id', '')}") if a else "\0"


def parse(page: str) -> Node:
    """A tree of elements and texts (character references still in place). Never fails; unclosed elements end with their parent.

    Where elements are open is kept by tag, so each tag costs the same however many are open.
    """
    root = Node("html", "", None)
    stack = [root]
    open_at: dict[str, list[int]] = defaultdict(list)
    at, n = 0, len(page)

    def shut(i: int) -> None:
        for x in stack[i:]:
            open_at[x.tag].pop()
        del stack[i:]

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        m = TOKEN.match(page, lt)
        if not m or m.end() == lt:
            end = page.find("<", lt + 1)  # a lone "<" is text
            end = n if end < 0 else end
            stack[-1].children.append(page[at:end])
            at = end
            continue
        if lt > at:
            stack[-1].children.append(page[at:lt])
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            if open_at.get(tag):
                shut(open_at[tag][-1])
            continue
        if tag in ("html", "body") and open_at.get(tag):
            continue
        if ends := CLOSES.get(tag):
            if found := last(ends):
                border = last(BORDERS[tag])
                while found > border:
                    shut(found)
                    found = last(ends) if tag in ROWS else 0
        text = m.group(3) or ""
        node = Node(tag, text, stack[-1])
        stack[-1].children.append(node)
        if tag in VOID or text.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW and tag not in PARTS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else n
            continue
        open_at[tag].append(len(stack))
        stack.append(node)
    return root


def ordered(root: Node) -> list[Node]:
    """All elements, parents first. A list, not recursion: trees may be as deep as a page is long."""
    out, i = [root], 0
    while i < len(out):
        out += [c for c in out[i].children if isinstance(c, Node)]
        i += 1
    return out


def measured(root: Node) -> list[Node]:
    """All elements with path, hashes, letters and what is the article filled in; parents first."""
    nodes = ordered(root)
    for node in nodes:
        node.path = xxhash.xxh64_intdigest(f"{node.up.path if node.up else 0}\0{node.tag}\0{FIGURES.sub('', node.named())}")
    for node in reversed(nodes):
        exact = xxhash.xxh64(f"{node.tag}\0{node.named()}")
        words = xxhash.xxh64()
        forms: dict[int, None] = {}
        for c in node.children:
            if isinstance(c, Node):
                exact.update(c.hash.to_bytes(8, "little"))
                words.update(c.words.to_bytes(8, "little"))
                node.size += c.size
                node.plain += c.plain
                if c.form:
                    forms[c.form] = None  # a menu of four entries has the form of one of six
                node.titled = node.titled or c.titled
            else:
                text = SPACE.sub(" ", c)
                exact.update(text)
                words.update(FIGURES.sub("", text))
                node.size += len(c.strip())
                node.plain += len(c.strip())
        node.hash, node.words = exact.intdigest(), words.intdigest()
        if node.tag in BLOCKS or node.tag in PARTS or forms:  # words inside a block have no form
            node.form = xxhash.xxh64_intdigest(f"{node.tag}\0{FIGURES.sub('', node.named())}\0{list(forms)}") | 1
        if node.tag == "a" or node.tag in NOT_TEXT:
            node.plain = 0
        node.titled = node.titled or node.tag in ("h1", "h2")
    for block in articles(root, nodes):
        block.inner = True  # for now: where the inside begins
        while block is not None and not block.guarded:
            block.guarded, block = True, block.up
    for node in nodes:
        if node.up is not None:
            node.inner = node.inner or node.up.inner
    for node in nodes:
        if node.guarded:
            node.inner = False
    return nodes


def inmost_box(root: Node, less: dict[int, int]) -> Node:
    """The innermost box that holds more than half of the letters outside links; ``less``: letters that don't count, by id."""
    rest = lambda x: x.plain - less.get(id(x), 0)
    fits = lambda c, node: isinstance(c, Node) and rest(c) * 2 > rest(node)
    node = root
    while True:
        into = next((c for c in node.children if fits(c, node) and c.tag not in LISTS and (c.tag in BOXES or c.tag in CELLS or c.tag in KEPT)), None)
        into = into or next((c for c in node.children if fits(c, node) and c.tag == "table"), None)
        if into is None:
            return node
        node = into


def letters_of(some: list[Node]) -> dict[int, int]:
    """Letters outside links of ``some`` blocks, added up for each element around them, by id."""
    out: dict[int, int] = defaultdict(int)
    for x in some:
        node: Node | None = x
        while node is not None:
            out[id(node)] += x.plain
            node = node.up
    return out


def inside(node: Node, tag: str) -> bool:
    """Whether an element stands in one of that tag."""
    while node.up is not None:
        node = node.up
        if node.tag == tag:
            return True
    return False


def teasers(some: list[Node], root: Node) -> bool:
    """Whether marked articles only point to others: there are several, or they are mostly links, and the largest box beside
    them holds more text than all of them, and is none that names itself a comment or the like."""
    if not some or len(some) < 2 and all(x.plain * 2 >= x.size for x in some):
        return False
    less = letters_of(some)
    box: Node | None = inmost_box(root, less)
    if box is root or box.plain - less[id(box)] <= sum(x.plain for x in some):
        return False
    while box is not None:
        if unwanted(box):
            return False
        box = box.up
    return True


def articles(root: Node, nodes: list[Node]) -> list[Node]:
    """The blocks that a page marks as its articles, if these hold a twentieth of its letters outside links and aren't teasers
    beside a longer text; else the innermost box that holds more than half of them."""
    for tag in ("article", "main"):
        some, outside = [], {id(root)}
        for x in nodes[1:]:
            if id(x.up) in outside and x.tag not in NOT_TEXT:
                if x.tag == tag:
                    some.append(x)
                else:
                    outside.add(id(x))
        if tag == "article" and teasers(some, root):
            for x in some:
                x.tag = "aside"  # what it is for a reader
        elif sum(x.plain for x in some) * 20 > root.plain:
            return some
    return [inmost_box(root, letters_of([x for x in nodes if x.tag == "aside" and not inside(x, "aside")]))]


class Page(NamedTuple):
    nodes: list[Node]
    marked: bool  # whether it says what its article is
    most: int  # letters of the article outside links
    guards: frozenset[int]  # forms of the article and of what it stands in


def page_of(html: str | None) -> Page:
    nodes = measured(parse(html or ""))
    inmost = [x for x in nodes if x.guarded and not any(isinstance(c, Node) and c.guarded for c in x.children)]
    return Page(nodes, any(x.tag in ("article", "main") for x in inmost), sum(x.plain for x in inmost), frozenset(form_key(x) for x in nodes if x.guarded))


def article_key(page: Page) -> int:
    """Pages of one article are one page, whatever stands around it."""
    return xxhash.xxh64_intdigest(repr([x.hash for x in page.nodes if x.guarded and not any(isinstance(c, Node) and c.guarded for c in x.children)])) - (1 << 63)


def form_key(node: Node) -> int:
    return xxhash.xxh64_intdigest(f"{node.path}\0{node.form}", seed=FORM) - (1 << 63)


def keys(node: Node, page: Page) -> list[tuple[int, int]]:
    """(kind, hash) under which a subtree may be a piece of template: none for the article and what it stands in; in it only
    for exact repeats of some length, since short blocks and list items recur there by chance, and none for most of it."""
    if node.guarded or node.tag not in BLOCKS and node.tag not in PARTS:
        return []
    exact = node.tag not in CELLS and node.tag not in KEPT and node.size > 0
    if node.inner:
        return [(INNER, xxhash.xxh64_intdigest(node.hash.to_bytes(8, "little"), seed=INNER) - (1 << 63))] if exact and node.size >= INNER_LETTERS and node.plain * 2 <= page.most else []
    out = []
    if exact and (page.marked or node.plain * 2 <= page.most):
        out.append((OUTER, xxhash.xxh64_intdigest(node.hash.to_bytes(8, "little"), seed=OUTER) - (1 << 63)))
    if node.tag in BOXES and (node.tag in PARTS or not node.titled) or node.tag in LISTS and node.plain * 2 < node.size:
        key = form_key(node)
        if key not in page.guards and (node.plain <= page.most if page.marked else node.plain * 4 <= page.most):
            menu = page.marked or node.tag in PARTS or node.plain * 2 < node.size
            out.append((FORM, key) if menu else (LOOSE, key ^ LOOSE))
    return out


def unwanted(node: Node) -> bool:
    """Whether HTML, or the element's own name, says that it is no part of the article."""
    if node.tag in NOT_TEXT:
        return True
    if not node.attributes or node.guarded:
        return False
    a = node.attributes
    named = NAMED_INSIDE if node.inner else NAMED
    if named.intersection(f"{a.get('class', '')} {a.get('id', '')}".lower().split()):
        return True
    return a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(UNDISPLAYED.search(a.get("style", "")))


def text_of(page: Page, template: frozenset[int] | set[int]) -> tuple[str, int, int]:
    """Blocks in page order, white space inside each made one space, joined by one space; and how many subtrees went as
    template, and by what HTML or their names say.

    A header inside an article that holds its title (h1, h2) is kept.
    """
    blocks: list[str] = []
    line: list[str] = []
    gone = named = 0

    def flush() -> None:
        if line:
            text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
            if text:
                blocks.append(text)
            line.clear()

    root = page.nodes[0]
    stack = [(root, iter(root.children))]  # an explicit stack, for deep trees
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCKS:
                flush()
            continue
        if isinstance(child, str):
            line.append(child)
            continue
        if child.tag == "br":
            line.append(" ")
            continue
        block = child.tag in BLOCKS or child.tag in PARTS
        if child.tag in UNSEEN:
            continue
        if template and any(k in template for _, k in keys(child, page)):
            gone += 1
            flush()
            continue
        if not (child.inner and child.tag == "header" and child.titled) and unwanted(child):
            named += 1
            if block:
                flush()
            continue
        if block:
            flush()
        stack.append((child, iter(child.children)))
    flush()
    return " ".join(blocks), gone, named


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    return text_of(page_of(page), template)[0]


def host_of(url: Column) -> Column:
    """The host in lower case, without port and user; an address without one has the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, article, found): each page's article and the distinct (kind, hash) of its subtrees that may be template, those of
    kind LOOSE with the hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("hash", pa.int64()), ("text", pa.int64())]))
        for whole in batches:
            for b in chunks(whole, "html"):
                names, found = [], []
                for text in b.column("html").to_pylist():
                    page = page_of(text)
                    names.append(article_key(page))
                    some = sorted({(k, h, x.words - (1 << 63) if k == LOOSE else 0) for x in page.nodes for k, h in keys(x, page) if x.tag not in UNSEEN})
                    found.append([{"kind": k, "hash": h, "text": t} for k, h, t in some])
                yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(names, pa.int64()), pa.array(found, kind)], names=["host", "article", "found"])

    return pages.select("host", "html").mapInArrow(run, "host string, article bigint, found array<struct<kind:int,hash:bigint,text:bigint>>")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """(host, hash) of subtrees that recur across many distinct pages of their host; pages of one article count once.

    As each takes a share of the host's pages, a host has at most (mean subtrees of a page / ``share``) of them.
    """
    each = stored(subtrees(pages).groupBy("host", "article").agg(F.min("found").alias("found")))
    sizes = each.groupBy("host").agg(F.count("*").alias("pages"))
    by_text = each.select("host", F.explode("found").alias("f")).groupBy("host", "f.kind", "f.hash", "f.text").agg(F.count("*").alias("n"))
    counts = by_text.groupBy("host", "kind", "hash").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where((F.col("n") >= least_pages) & ((F.col("kind") != LOOSE) | (2 * F.col("texts") <= F.col("n"))))
    least = F.when(F.col("kind").isin(FORM, LOOSE), FORM_SHARE).when(F.col("kind") == OUTER, share).otherwise(INNER_SHARE)
    enough = (F.col("n") >= F.col("pages") * least) & ((F.col("kind") != INNER) | (F.col("n") >= INNER_PAGES))
    return counts.join(sizes, "host").where(enough).select("host", "hash")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = LEAST_SHARE, counts: bool = False) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html, ...)``.

    A null html counts as empty (text empty); pages without a host share one; rows that repeat, and pages of one article
    under several addresses, count as one page and each get their text; broken markup is read as far as it goes; other
    columns are ignored; an empty table gives no rows. With ``counts``, n_template and n_named count the subtrees that were
    deleted because they recur, and because of what HTML or their names say. A notice without an article beside it that is marked
    as such, and longer than all else on its page, is taken for the article.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    known = stored(templates(slim, least_pages, share))
    few = known.limit(SMALL + 1).collect()  # bounded; beyond the bound they are joined
    held = None
    if len(few) <= SMALL:
        by_host = defaultdict(set)
        for r in few:
            by_host[r.host].add(r.hash)
        held = pages.sparkSession.sparkContext.broadcast(dict(by_host))
        joined = slim.withColumn("template", F.lit(None).cast("array<bigint>"))
    else:  # hosts may hold a third of the pages
        salts = 64
        arrays = known.groupBy("host").agg(F.collect_list("hash").alias("template"))  # bounded, see templates()
        spread = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "html"):
                rows = []
                for host, page, template in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("template")):
                    rows.append(text_of(page_of(page), held.value.get(host, frozenset()) if held else frozenset(template.as_py() or ())))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *cols], names=["page_id", "url", "text", "n_template", "n_named"])

    out = joined.select("page_id", "url", "host", "html", "template").mapInArrow(run, "page_id bigint, url string, text string, n_template bigint, n_named bigint")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), *(["n_template", "n_named"] if counts else []))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), counts=True)
