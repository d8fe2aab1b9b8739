"""Main text of web pages, with the site's templates removed.

Each page is parsed into a tree, and the subtree of every element is hashed,
also of those that the rules below drop. Spark counts per host in how many
different pages each subtree occurs; those on ``SHARE`` of the host's different
pages (or of those without a main element), and on ``PAGES`` at least, are
deleted from the trees before anything else. Protected by its place is the
page's story, its ``article`` or, if most of its text is in none, its ``main``
element, of several the one of most text, with all that is in it and around it:
lists, tables and repeated paragraphs of an article stay. Other articles and
what stands beside them in a ``main`` element are counted and go if they recur.
Pages are different if their stories are, or their texts where there is none,
so that copies of one page don't make their own article a template.

Then rules take what is too rare to be counted: text beside the main elements,
elements that HTML itself marks as page furniture, and those whose class, id
or role is the name of furniture (a whole name, such as ``sidebar`` or
``cookie-notice``, not one word of a longer one), unless all of a page's main
text lies in them.

Pages are parsed twice, to be counted and to be cleaned, and read twice rather
than stored. A host's templates are ``1 / SHARE`` times its mean number of
subtrees a page at most, so they go to its pages as one list.

Defined results: null or empty html has no text; broken markup is closed as
browsers do, but for raw elements that are never closed: a script or style
ends with the element around it, the others don't begin; pages of any length
are parsed whole; repeated rows each get a row; a null or odd URL is a host of
its own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spread_join, stored, table
from .url_filters import host_of

#: A subtree on so many different pages of a host, and on such a share of them, is a template.
PAGES = 5
SHARE = 0.1

#: The lists of hosts with over ``LARGE`` times the pages of a heavy key are broadcast: a thousand lists at most.
LARGE = 10

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes")
FURNITURE = frozenset("head nav header footer aside form script style noscript template iframe object embed svg canvas button select option input textarea label fieldset dialog menu audio video map title link meta base xmp noframes".split())
BLOCK = frozenset(
    "html body address article blockquote center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li main ol p pre section summary "
    "table caption thead tbody tfoot tr td th ul br nav header footer aside form fieldset menu dialog search".split()
)
MAIN = ("article", "main")
#: An opening tag in the key closes an open element in the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "html", "body", "dd", "dt", "summary", "figcaption"}
#: Elements that keep an inner li, td or p from closing an outer one.
SCOPE = frozenset("html body table ul ol dl article section div main td th blockquote".split())

#: Names of furniture in class, id or role, and words that may stand with them in such a name.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer sidebar sidebars aside widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login "
    "comment comments disqus respond reply replies share sharing social related recommended pagination pager toolbar search form copyright legal toc skip".split()
)
BESIDE = frozenset("site page main top bottom left right global primary secondary container wrapper wrap box bar block list area links link item items inner outer section button buttons icons form thread policy".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[-_0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """``dropped``: furniture by its element; ``marked``: by its name."""

    __slots__ = ("name", "children", "dropped", "marked")

    def __init__(self, name: str, dropped: bool = False, marked: bool = False):
        self.name, self.dropped, self.marked, self.children = name, dropped, marked, []


def _furniture(name: str) -> bool:
    words = [w for w in _PARTS.split(name) if w]
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words)


def _marked(attributes: str) -> bool:
    return any(_furniture(t) for m in _MARK.finditer(attributes) for t in m[1].strip("\"'").lower().split())


def parse(html: str, whole: bool = False) -> Node:
    """Tree of nodes and texts; elements that are furniture keep their place, and their content only if ``whole``."""
    root = Node("")
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack elements of a name stand
    scopes = [0]  # where those stand that keep inner elements apart
    never: set[str] = set()  # raw elements and sections that nothing further on closes
    at = 0
    hidden = 0  # open elements that are dropped
    end = len(html)
    last = html.rfind(">")

    def close_from(i: int) -> int:
        """Close all elements from a place on; how many of them are dropped."""
        gone = stack[i:]
        del stack[i:]
        for n in gone:
            places[n.name].pop()
        while scopes[-1] >= i:
            scopes.pop()
        return sum(n.dropped for n in gone)

    def innermost(name: str) -> int:
        at = places.get(name)
        return at[-1] if at else 0

    def after(pattern: str, name: str, at: int) -> re.Match | None:
        """The next match; none is looked for again once there is no more."""
        found = None if name in never else re.compile(pattern, re.I).search(html, at)
        if found is None:
            never.add(name)
        return found

    while at < end:
        m = _TAG.search(html, at) if at <= last else None
        if m is None:
            if whole or not hidden:
                stack[-1].children.append(html[at:])
            break
        if m.start() > at and (whole or not hidden):
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if html.startswith("<![CDATA[", m.start()):
                close = after(r"\]\]>", "[", m.start())
                at = close.end() if close else at
            continue
        name = name.lower()
        if m[1]:  # a closing tag closes the nearest open element of its name
            i = innermost(name)
            if i and (name != "p" or i > scopes[-1]):
                hidden -= close_from(i)
            continue
        if name in RAW:  # no markup inside
            close = after(rf"</{name}\s*>", name, at)
            start = stop = at
            if close:
                stop, at = close.span()
            elif name in ("script", "style"):
                outer = "|".join(n for n, where in places.items() if where)
                close = re.compile(rf"</(?:{outer})\s*>", re.I).search(html, at) if outer else None
                stop = at = close.start() if close else end
            if whole and stop > start:
                node = Node(name, True)
                node.children.append(html[start:stop])
                stack[-1].children.append(node)
            continue
        closes = CLOSES.get(name, ())
        i = max([innermost(n) for n in (*closes, *(("p",) if name in CLOSES_P else ()))], default=0)
        if i and i >= scopes[-1]:
            hidden -= close_from(i)
        node = Node(name, name in FURNITURE, "=" in m[3] and name not in ("html", "body", "main") and _marked(m[3]))
        if whole or not hidden:
            stack[-1].children.append(node)
        if name not in VOID and not m[3].endswith("/>"):
            places.setdefault(name, []).append(len(stack))
            if name in SCOPE:
                scopes.append(len(stack))
            stack.append(node)
            hidden += node.dropped
    return root


def _find(node: Node, name: str, marked: bool = False) -> list[Node]:
    """Outermost elements of a name that aren't dropped nor, unless so asked, in or of marked ones."""
    found, work = [], [node]
    while work:
        n = work.pop()
        if n.dropped or n.marked and not marked:
            continue
        if n.name == name:
            found.append(n)
        else:
            work += [c for c in reversed(n.children) if not isinstance(c, str)]
    return found


def _mains(root: Node) -> list[Node]:
    """The elements that hold the page's main text: the main ones, or of each the only article in it, or else the articles; those in marked elements only if there are no others."""
    for marked in (False, True):
        mains = _find(root, "main", marked)
        if mains:
            inner = [[a for a in _find(m, "article", marked) if a is not m] for m in mains]
            return [a[0] if len(a) == 1 else m for m, a in zip(mains, inner)]
        articles = _find(root, "article", marked)
        if articles:
            return articles
    return []


def _stories(main: Node) -> list[Node]:
    """The articles in a main element, or itself if most of its text is in none of them; an article is its own."""
    articles = [a for a in _find(main, "article", main.marked) if a is not main] if main.name == "main" else []
    return articles if articles and 2 * sum(len(_text([a])) for a in articles) > len(_text([main])) else [main]


def _digests(root: Node, story: Node | None) -> list[tuple[Node, int]]:
    """Each element with the hash of its subtree, but for the story and what is in it or around it.

    Elements that are dropped or marked have a hash of their own and add
    nothing to those around them, so a counter or a date in an advert doesn't
    tell two templates apart.
    """
    out: list[tuple[Node, int]] = []
    stack: list[list] = [[root, 0, [], False]]  # node, next child, parts, whether the story is in it
    while stack:
        top = stack[-1]
        n, i, parts, around = top
        if i < len(n.children):
            top[1] += 1
            child = n.children[i]
            if isinstance(child, str):
                text = _SPACE.sub(" ", child)
                if text != " " and text:
                    parts.append(text)
            elif child is story:
                top[3] = True
            else:
                stack.append([child, 0, [], False])
            continue
        stack.pop()
        if around:
            if stack:
                stack[-1][3] = True
            continue
        key = _digest(f"<{n.name}>{''.join(parts)}</>")
        if n is not root and n.name not in VOID and parts:
            out.append((n, key))
        if stack and not n.dropped and not n.marked:
            stack[-1][2].append(f"<{key}>")
    return out


def blocks(nodes: list[Node], marked: bool = False) -> list[str]:
    """Texts of the blocks in page order, those of marked elements only if so asked."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    for top in nodes:
        work: list[Node | str | None] = [None, top]  # None closes a block
        while work:
            n = work.pop()
            if n is None:
                close()
            elif isinstance(n, str):
                run.append(n)
            elif n.dropped or n.marked and not marked and n is not top:
                if n.name in BLOCK:
                    close()
            else:
                block = n.name in BLOCK
                if block:
                    close()
                    work.append(None)
                work += reversed(n.children)
        close()
    return out


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _text(nodes: list[Node]) -> str:
    return "\n".join(blocks(nodes) or blocks(nodes, marked=True))


class Page:
    """A parsed page: the elements that hold its main text, of these the story, and the hashes of all subtrees that may be templates."""

    def __init__(self, html: str | None):
        self.root = parse(html or "", whole=True)
        mains = _mains(self.root)
        self.nodes = mains or [self.root]
        stories = [s for m in mains for s in _stories(m)]
        self.story = max(stories, key=lambda n: len(_text([n]))) if len(stories) > 1 else stories[0] if stories else None

    def trees(self) -> list[int]:
        return list({key for _, key in _digests(self.root, self.story)})

    def identity(self) -> int:
        """Equal for pages that count as one."""
        return _digest(_text([self.story or self.root]))

    def delete(self, skip: set[int]) -> int:
        """Delete the templates from the tree; how many elements these are, those inside others not counted."""
        gone = {id(n) for n, key in _digests(self.root, self.story) if key in skip} if skip else ()
        count, work = 0, [self.root] if gone else []
        while work:
            for c in work.pop().children:
                if isinstance(c, str):
                    continue
                if id(c) in gone:
                    c.dropped = True
                    count += 1
                else:
                    work.append(c)
        return count

    def text(self) -> str:
        return _text(self.nodes)


def counted(pages: DataFrame) -> DataFrame:
    """(host, page, plain, trees) of each row of (host, html): the hash that tells different pages apart, whether the page has no story, and the hashes of its subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, plain, trees = [], [], []
            for html in batch.column(1).to_pylist():
                page = Page(html)
                own.append(page.identity())
                plain.append(page.story is None)
                trees.append(page.trees())
            arrays = [pa.array(own, pa.int64()), pa.array(plain, pa.bool_()), pa.array(trees, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["host", "page", "plain", "trees"])

    return stored(pages.select("host", "html").mapInArrow(run, "host string, page long, plain boolean, trees array<long>"))


def templates(found: DataFrame, hosts: DataFrame, pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, tree) of (host, page, plain, tree) on ``pages`` different pages of the host or more, and on ``share`` of them or of its plain ones."""
    n = (F.count("*").alias("n"), F.count_if("plain").alias("n_plain"))
    counts = stored(found.distinct().groupBy("host", "tree").agg(*n).where(F.col("n") >= pages))
    total = hosts.agg(F.sum("all")).first()[0] or 0
    known = spread_join(counts, hosts.select("host", "all", "all_plain"), ["host"], "all", total)
    alone = (F.col("n_plain") >= pages) & (F.col("n_plain") >= share * F.col("all_plain"))
    return known.where((F.col("n") >= share * F.col("all")) | alone).select("host", "tree")


def extract(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_templates) of each row of (page_id, url, html); the last is how many elements were deleted because they recur."""
    small_batches(pages.sparkSession)
    mine = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")
    seen = counted(mine)
    different = seen.groupBy("host", "page", "plain").agg(F.count("*").alias("rows"))
    hosts = stored(different.groupBy("host").agg(F.count("*").alias("all"), F.count_if("plain").alias("all_plain"), F.sum("rows").alias("rows")))
    found = seen.select("host", "page", "plain", F.explode("trees").alias("tree"))
    lists = templates(found, hosts, least, share).groupBy("host").agg(F.collect_list("tree").alias("skip"))
    skips = stored(hosts.select("host", "rows").join(lists, "host", "left"))
    total = hosts.agg(F.sum("rows")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = [], []
            for html, skip in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(html)
                n.append(page.delete(set(skip or ())))
                text.append(page.text())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_templates"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_templates long"
    return spread_join(mine, skips, ["host"], "rows", LARGE * total).select("page_id", "url", "html", "skip").mapInArrow(run, schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates")
