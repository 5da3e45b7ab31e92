"""Main text of web pages by a site style tree.

All pages of a host are laid over each other: element nodes with the same path
(tags with their classes) are one style node.  Two things are counted per style node:
on how many pages it has which sequence of children (presentation), and on how
many pages it holds which text (content).  Copies of a page on its host count as one page.  Entropies of both, to the base of the
number of pages, say how much a node differs from page to page; what is the same
everywhere is template.  Each page is then read again: a branch's importance is
composed from its nodes, and branches of low importance are removed.

Importance says nothing where a host has a page or two.  So elements that are
never article by the rules of HTML (navigation, forms, scripts, ...), or by the name
of their class, have importance 0 from the start, and those inside an article keep
their place unless they are of that kind.

Only hashes and counts are shuffled by host, with map-side sums; a host with a
third of all pages is a row per task, node and text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.llm.shared import ddl, written

#: Hosts with fewer distinct pages that have a node say nothing about it.
MIN_PAGES = 4
LOW = 0.25
#: Weight of a node's own presentation falls as GAMMA ** children, as published for style trees.
GAMMA = 0.9
#: Elements below this depth share a style node.
DEPTH = 32

#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe title textarea xmp noembed noframes svg math canvas object".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("head nav footer aside form menu dialog button select option label input datalist fieldset audio video map".split())
ARTICLE = frozenset(("article", "main"))
#: An element of the first kind ends an open one of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An open element of this kind is not searched beyond.
SCOPE = frozenset("table ul ol dl article section div body main td th blockquote".split())
#: Names (class, id or role) that consist of these words, and of words of place, mark what isn't article; has-sidebar and category-social don't.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice alert popup modal overlay newsletter "
    "subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget related recommended share sharing social "
    "comment comments replies respond footer header masthead topbar toolbar search complementary contentinfo pagination tags".split()
)
PLACE = frozenset("site main global top bottom left right primary secondary bar box block section container wrapper area list links items posts articles form inner".split())
#: Names that begin or end with one of the first words mark what readers wrote, unless one of the others says whether they may.
COMMENTS = frozenset("comment comments commentlist commentbox replies respond disqus".split())
SWITCHES = frozenset("has no with without open closed is count allow".split())
#: Elements that no name makes noise.
NAMELESS = frozenset(("html", "body", *ARTICLE))

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("children", "depth", "named", "noise", "parent", "style", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None, unseen: bool = False):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.named = unseen or bool(names) and noisy(tag, names, parent)
        never = tag in NEVER and not (tag == "aside" and inside_article(parent, ("article",)))
        self.noise = never or self.named or (tag == "header" and not inside_article(parent))
        base = parent.style if parent else 0
        self.style = xxhash.xxh3_64_intdigest(f"{tag}.{names}", base) if self.depth < DEPTH else base


@lru_cache(maxsize=65536)
def attributes_of(text: str) -> tuple[str, bool]:
    """Names of an element (class, id and role, sorted, digits as one sign) and whether it is never shown."""
    names, unseen = [], False
    for name, *values in _ATTRIBUTE.findall(text):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            names += value.split()
        elif name == "hidden" and value.lower() != "until-found" or name == "style" and _UNSEEN.search(value):
            unseen = True
    return re.sub(r"\d+", "0", " ".join(sorted(names))), unseen


@lru_cache(maxsize=65536)
def kinds(names: str) -> tuple[bool, bool, bool]:
    """Whether one of the names marks noise: any, any but header, and readers' comments."""
    anywhere = inside = comments = False
    for name in names.split():
        ordered = [w for w in re.split("[-_:]+", name.lower()) if w]
        words = set(ordered)
        strong = words & NOISE
        if strong and words <= NOISE | PLACE:
            anywhere, inside = True, inside or strong != {"header"}
        if ordered and not words & SWITCHES and (ordered[0] in COMMENTS or ordered[-1] in COMMENTS):
            comments = True
    return anywhere, inside, comments


def noisy(tag: str, names: str, parent: Node | None) -> bool:
    """An article has a header of its own, and may be a comment, but is nothing else by its name."""
    anywhere, inside, comments = kinds(names)
    if tag in NAMELESS:
        return comments and tag == "article"
    return comments or inside or anywhere and not inside_article(parent)


def inside_article(node: Node | None, tags: Container[str] = ARTICLE) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> list[Node]:
    """The elements of a page in order, each with its children: elements and texts."""
    top = Node("html", "", None)
    nodes, at, position = [top], top, 0
    end = len(page)
    while position < end:
        match = _TOKEN.match(page, position)
        position = match.end()
        text = match.group(7)
        if text is not None:
            at.children.append(text)
            continue
        tag = match.group(2) or match.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        if match.group(1) or match.group(4):
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node is not top:
                at = node.parent
            continue
        if tag == "html" or tag == "body" and at.tag == "body":
            continue
        if tag in BLOCKS:
            at = closed(at, ("p",), SCOPE)
        if tag in ENDS:
            at = closed(at, ENDS[tag], frozenset(("table", "ul", "ol", "dl")))
        if tag == "body":
            at = top
        attributes = match.group(3) if match.group(2) else match.group(6)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, position)
            if not attributes.endswith("/"):
                close = page.find(">", stop.start()) if stop else -1
                position = close + 1 if close >= 0 else end
            continue
        names, unseen = attributes_of(attributes) if attributes else ("", False)
        node = Node(tag, names, at, unseen)
        at.children.append(node)
        nodes.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            at = node
    return nodes


def text_sizes(nodes: list[Node], counted) -> dict[Node, int]:
    """Characters of text of every branch; one that isn't ``counted`` has none."""
    sizes: dict[Node, int] = {}
    for node in reversed(nodes):
        sizes[node] = sum(len(c.strip()) if isinstance(c, str) else sizes[c] for c in node.children) if counted(node) else 0
    return sizes


def spare(nodes: list[Node]) -> None:
    """Takes the mark of noise off branches that hold at least half of the page's text that isn't noise otherwise:
    forms, and names around an article if no article is outside of such branches.  Puts it on boxes inside an article that
    are links for the most part."""
    articles = [n for n in nodes if n.tag in ARTICLE and not n.noise]
    around = {p for n in articles for p in ancestors(n)} if all(any(p.noise for p in ancestors(n)) for n in articles) else ()
    marked = {n for n in nodes if n.noise and (n.tag == "form" and not n.named or n in around and (n.tag == "form" or n.tag not in NEVER and n.named))}
    if marked:
        sizes = text_sizes(nodes, lambda n: not n.noise or n in marked)
        for node in marked:
            if sizes[node] and 2 * sizes[node] >= sizes[nodes[0]]:
                node.noise = False
    boxes = [n for n in nodes if n.tag == "aside" and not n.noise]
    if boxes:
        sizes = text_sizes(nodes, lambda n: not n.noise)
        linked = text_sizes(nodes, lambda n: not n.noise)
        for node in reversed(nodes):
            linked[node] = sizes[node] if node.tag == "a" else sum(linked[c] for c in node.children if not isinstance(c, str))
        for node in boxes:
            node.noise = 2 * linked[node] >= sizes[node]


def closed(at: Node, tags: tuple[str, ...], scope: frozenset) -> Node:
    """The place after ending the nearest open element of ``tags``, if it is in scope."""
    node = at
    while node is not None:
        if node.tag in tags:
            return node.parent
        if node.tag in scope:
            return at
        node = node.parent
    return at


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def features(page: str) -> Iterator[tuple[int, bool, int]]:
    """(style node, whether presentation, feature) of a page, each once."""
    styles: dict[int, list[str]] = {}
    seen = set()
    for node in parse(page):
        styles.setdefault(node.style, []).append(">".join("#" if isinstance(c, str) else c.tag for c in node.children if not isinstance(c, str) or not c.isspace()))
        for child in node.children:
            if isinstance(child, str) and not child.isspace():
                seen.add((node.style, False, xxhash.xxh3_64_intdigest(squeezed(child))))
    for style, sequences in styles.items():
        seen.add((style, True, xxhash.xxh3_64_intdigest("|".join(sequences))))
    return iter(seen)


def importances(nodes: list[Node], model: dict[int, tuple[float, float]]) -> dict[Node, float]:
    """Composite importance of every element: presentation and content of its branch."""
    out: dict[Node, float] = {}
    for node in reversed(nodes):
        look, content = model.get(node.style, (1.0, 1.0))
        parts = [out[c] for c in node.children if not isinstance(c, str)]
        if any(isinstance(c, str) and not c.isspace() for c in node.children):
            parts.append(content)
        weight = GAMMA ** len(parts)
        out[node] = 0.0 if node.noise else (1 - weight) * look + weight * sum(parts) / len(parts) if parts else look
        if parts and not node.noise:
            out[node] = max(out[node], max(parts)) if max(parts) >= LOW else out[node]
    return out


def main_text(page: str | None, model: dict[int, tuple[float, float]]) -> str:
    """Blocks of the page without branches of low importance.

    The roots are the articles of the page if they hold at least half of its important text, else the page: a teaser is no article.
    """
    nodes = parse(page or "")
    spare(nodes)
    importance = importances(nodes, model)
    articles = [n for n in nodes if n.tag in ARTICLE and not n.noise and not any(p.noise for p in ancestors(n))]
    articles = [n for n in articles if not any(p in articles for p in ancestors(n))]
    # an article that is the same on every page of its host tells nothing about its own branches
    steady = {n for n in articles if importance[n] < LOW}
    inside = steady | {n for n in nodes if any(p in steady for p in ancestors(n))} if steady else steady
    sizes = text_sizes(nodes, lambda n: not n.noise and (n in inside or n is nodes[0] or importance[n] >= LOW))
    if not articles or 2 * sum(sizes[n] for n in articles) < sizes[nodes[0]]:
        roots = [nodes[0]]
    else:
        roots = [n for n in articles if sizes[n]]
    blocks: list[list[str]] = [[]]
    for root in roots:
        stack: list = [root]
        blocks.append([])
        while stack:
            item = stack.pop()
            if item is None:
                blocks.append([])
            elif isinstance(item, str):
                blocks[-1].append(item)
            elif item.tag == "br":
                blocks[-1].append(" ")
            elif not item.noise and (item is root or item in inside or importance[item] >= LOW):
                edge = item.tag in BLOCKS
                if edge:
                    blocks.append([])
                    stack.append(None)
                stack.extend(reversed(item.children))
    return "\n".join(x for x in (squeezed("".join(block)) for block in blocks) if x)


def ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_features(pages: DataFrame) -> DataFrame:
    """host and features (style, look, feature) of every distinct page of a host."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            hosts, digests, styles, looks, found = [], [], [], [], []
            for name, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = xxhash.xxh3_128_digest(page or "")
                if (name, digest) in seen:
                    continue
                if len(seen) < 1_000_000:  # beyond, copies in one task are only repeated rows
                    seen.add((name, digest))
                rows = list(features(page or ""))
                hosts.append(name)
                digests.append(digest)
                styles.append([signed(r[0]) for r in rows])
                looks.append([r[1] for r in rows])
                found.append([signed(r[2]) for r in rows])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(styles, longs), pa.array(looks, pa.list_(pa.bool_())), pa.array(found, longs)],
                ["host", "digest", "style", "look", "feature"],
            )

    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, digest binary, style array<long>, look array<boolean>, feature array<long>")
    return rows.dropDuplicates(["host", "digest"]).select("host", F.arrays_zip("style", "look", "feature").alias("features"))


def site_styles(pages: DataFrame) -> DataFrame:
    """host and model: an array of (style, look, content) for each style node below full importance."""
    rows = page_features(pages).select("host", F.inline("features"))
    counted = rows.groupBy("host", "style", "look", "feature").agg(F.count(F.lit(1)).cast("double").alias("n"))
    look, n = F.col("look"), F.col("n")
    sums = counted.groupBy("host", "style").agg(
        F.sum(F.when(look, n)).alias("m"),
        F.sum(F.when(look, n * F.log(n))).alias("looks"),
        F.sum(F.when(~look, F.log(n))).alias("texts"),
        F.sum(F.when(~look, 1.0)).alias("n_texts"),
    )
    m = F.col("m")
    scored = sums.where(m >= MIN_PAGES).select(
        "host",
        "style",
        ((F.log(m) - F.col("looks") / m) / F.log(m)).alias("look"),
        F.coalesce(1 - F.col("texts") / F.col("n_texts") / F.log(m), F.lit(1.0)).alias("content"),
    )
    low = scored.where((F.col("look") < 0.95) | (F.col("content") < 0.95))
    return low.groupBy("host").agg(F.collect_list(F.struct("style", "look", "content")).alias("model"))


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars of every page.

    Blocks are joined by a line break; character references are decoded; white space inside a block is
    one space.  A null or empty page has an empty text; a null url is a host of its own name, the empty
    one.  Repeated rows and null keys are rows of their own.  Other columns are not read.
    """
    rows = pages.select(F.col(key), F.col("url"), F.col("html"), host(F.col("url")).alias("host"))
    # written, so that its size is known to the planner, which then joins it as it should
    joined = rows.join(written(site_styles(pages), "styles"), "host", "left").select(key, "url", "html", "host", "model")
    schema = rows.select(key, "url").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for i, (page, name) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if name not in models:
                    if len(models) > 1000:
                        models.clear()
                    models[name] = {x["style"] % (1 << 64): (x["look"], x["content"]) for x in batch.column(4)[i].as_py() or ()}
                texts.append(main_text(page, models[name]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [key, "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, f"{ddl(schema)}, text string, n_chars long")
