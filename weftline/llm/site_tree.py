"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree of style nodes: a node is the path of element names with their class, id
and role. For each node Spark counts on how many distinct pages of the host each text at or below it occurs; texts that stand on many pages carry
little information, and a branch of such texts is removed from every page. Nothing but counts decides about a node's importance. What differs from page to page and
still is no article (comments, forms), and pages of hosts with few pages, are left to what markup itself declares as page furniture. All counting is by (host, node, feature) with
partial sums, so a host with a third of all pages is no single task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved
from weftline.llm.url_rules import host_of

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search summary table ul".split()
)
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe button select textarea menu dialog svg canvas object embed audio video option datalist title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that name furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu sidebar footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal newsletter subscribe signup share sharing social comment comments disqus respond replies related recommended widget pagination pager login toolbar".split()
)
MAIN = frozenset("article main".split())

#: Class words that inside ``article`` and ``main`` name its own head.
OWN_HEAD = frozenset("header masthead banner".split())

#: Importance under which a node is furniture, and pages of a host from which its tree is asked.
LOW_IMPORTANCE, LEAST_PAGES = 0.9, 8
#: How deep a node's path is told apart; deeper elements count with their ancestor at this depth.
DEPTH = 24

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z](?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*$", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _node(tag: str, attributes: str, main: bool = False) -> tuple[str, bool]:
    """The style of an element, and whether its markup says furniture; ``main`` says that it is inside the main element."""
    style, bad = tag, tag in FURNITURE
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "role":
                bad = bad or value.strip() in ROLES
            elif name in ("class", "id"):
                bad = bad or (tag not in ("body", "html", *MAIN) and not (NAMES - OWN_HEAD if main else NAMES).isdisjoint(_WORD.findall(value)))
            else:
                bad = bad or value != "false"
            style += f"|{' '.join(sorted(re.sub('[0-9]+', '0', value).split()))}"
    return style, bad


def blocks_of(page: str | None) -> list[tuple[str, str, bool, bool, bool]]:
    """The text blocks of a page in order: (style path, text, furniture, inside the main element, below a header of the page).

    A lenient walk: elements that are not closed end with their parent; unknown end tags are ignored."""
    page = page or ""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, furniture, in main
    out: list[tuple[str, str, bool, bool, bool]] = []
    part: list[str] = []
    at, raw, size = 0, None, len(page)

    def flush() -> None:
        if part:
            text = _SPACE.sub(" ", html.unescape("".join(part))).strip()
            part.clear()
            if text:
                path, bad, main = stack[-1][1:] if stack else ("", False, False)
                out.append((path, text, bad, main, any(s[0] == "header" for s in stack)))

    while at < size:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            at, raw = end.start(), None
            close = page.find(">", at)
            if stack:
                stack.pop()
            at = size if close < 0 else close + 1
            continue
        m = _TOKEN.search(page, at)
        if m is None:
            part.append(page[at:])
            break
        if m.start() > at:
            part.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:  # comment, declaration or a tag that the page's end cuts
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            part.append(" ") if tag == "br" else flush()
            continue
        block = tag not in INLINE
        if block:
            flush()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("table", "td", "article", "body") and tag not in ("table", "article", "body", "html", "main", "div", "section"):
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag or (tag in ("dd", "dt") and stack[k][0] in ("dd", "dt")) or (tag in ("td", "th") and stack[k][0] in ("td", "th")):
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "tr", "select", "menu"):
                    break
        if tag in VOID or m.group(3).endswith("/") and tag not in RAW and tag in ("svg", "path", "circle", "rect", "use"):
            continue
        style, bad = _node(tag, m.group(3), bool(stack) and stack[-1][3])
        if tag in INLINE and not bad:  # inline elements add no node; a furniture one still hides its text
            stack.append((tag, *(stack[-1][1:] if stack else ("", False, False))))
            continue
        _, path, above, main = stack[-1] if stack else ("", "", False, False)
        if bad and tag in INLINE:
            flush()
        stack.append((tag, path if path.count("/") >= DEPTH else f"{path}/{style}", above or bad, main or tag in MAIN))
        if tag in RAW:
            raw = tag
            part.clear()
    flush() if not raw else None
    return out


def branches(path: str) -> Iterator[str]:
    """A node and the nodes above it."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, node, feature, size, page): for each page and style node with text of its own a hash of every text block in it with its length, and one row with a null feature for the
    node; the nodes above follow from its path (``upward``). Rows that pages of one batch share are sent once; ``page`` is a hash of the page's main blocks (of all, where there is no ``article`` or ``main``). No list of names plays a part here."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, int] = {}
            for host, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                found = blocks_of(page.as_py())
                own = [x for x in found if x[3]] or found
                whole = hash_of(repr([(p, t) for p, t, *_ in own if p]))
                for path, text, *_ in found:
                    if path:
                        seen[host, path, None, whole] = 0
                        seen[host, path, hash_of(text), whole] = len(text)
            cols = list(zip(*((host, node, h, size, whole) for (host, node, h, whole), size in seen.items()), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["host", "node", "feature", "size", "page"])

    return pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(walk, "host string, node string, feature long, size long, page long")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def upward(node: Column) -> Column:
    """A node's path and those of the nodes above it."""
    parts = F.split(node, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the merged tree of each host: 1 less the entropy of a node's features over its pages, as a share of its maximum and
    weighted by their lengths. A text that stands on n of m pages has the entropy log n / log m: near 1 for a menu that all pages share, 0 for an article's own words. A branch
    counts all that is below it. Pages with the same main blocks count once; a node on one page has importance 1."""
    # dealt by text and page, so that the nodes above arise after the shuffle and need no other one to be told apart
    spread = style_rows(pages).repartition("page", "feature").withColumn("node", F.explode(upward(F.col("node"))))
    once = spread.groupBy("host", "node", "feature", "page").agg(F.max("size").alias("size"))
    each = once.groupBy("host", "node", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    text = F.col("feature").isNotNull()
    sums = each.groupBy("host", "node").agg(
        F.max(F.when(~text, F.col("n"))).alias("pages"), F.sum(F.when(text, F.col("size") * F.col("n"))).alias("w"), F.sum(F.when(text, F.col("size") * F.col("n") * F.log2("n"))).alias("s")
    )
    return sums.select("host", "node", "pages", F.when((F.col("pages") > 1) & (F.col("w") > 0), 1 - F.col("s") / F.col("w") / F.log2("pages")).otherwise(F.lit(1.0)).alias("importance"))


def noisy(tree: DataFrame, low: float, least_pages: int) -> DataFrame:
    """(host, node) of the branches of low importance: no node at or below them that stands on ``least_pages`` pages has more. High nodes
    are joined to their ancestors by path."""
    judged = tree.filter(F.col("pages") >= least_pages)
    kept = judged.filter(F.col("importance") >= low).select("host", F.explode(upward(F.col("node"))).alias("node")).distinct()
    return judged.filter(F.col("importance") < low).select("host", "node").join(kept, ["host", "node"], "left_anti")


def extract_text(pages: DataFrame, *, low: float = LOW_IMPORTANCE, least_pages: int = LEAST_PAGES, markup: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Outside ``article`` and ``main`` every branch of the page falls that has an importance under ``low`` in the tree of its host, over at least ``least_pages`` distinct
    pages. What a tree cannot see, for lack of pages or because it differs from page to page (reader comments, forms, notices), falls by ``markup``: its element, role or class. Where the
    page has an ``article`` or ``main`` element, only its blocks stay; without ``markup`` the tree alone decides. Character references are decoded, white space inside a block becomes one space, blocks are joined by one
    space. A null or empty page gives an empty text. A null url has the empty host, as has one without ``://``. Cut pages are read as far
    as they go. Repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    dull = saved(noisy(saved(importance(pages), "importance"), low, least_pages), "dull")
    dull = dull.groupBy("host").agg(F.collect_set("node").alias("dull"))  # one entry per low branch of a host's tree

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, gone in zip(b.column("html"), b.column("dull"), strict=True):
                drop = frozenset(gone.as_py() or ())
                found = [x for x in blocks_of(page.as_py()) if x[3] or drop.isdisjoint(branches(x[0]))]
                if markup:
                    found = [x for x in found if not x[2]]
                    if any(x[3] for x in found):
                        found = [x for x in found if x[3]]
                    else:
                        found = [x for x in found if not x[4]]
                texts.append(" ".join(x[1] for x in found))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host")).join(dull, "host", "left").select("page_id", "url", "html", "dull")
    return rows.mapInArrow(prune, f"page_id {kind}, url string, text string, n_chars long")
