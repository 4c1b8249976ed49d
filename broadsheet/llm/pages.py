"""Main text of web pages by a site style tree.

The pages of a host are laid over each other: a node of the tree is a path of elements
(tag and class names). For each node the tree counts the pages that have it, the sequences
of children it is shown with (presentation) and the texts under it (content). A node whose
presentation and content are the same on most pages has low entropy and so low importance;
of its branch every page loses the nodes whose own texts repeat as well. This judges what is
inside an article or main element too; such an element is evidence that raises importance.
Elements whose tag or class says that they are no article (menus, forms, comments, ...) go
by that alone, as hosts with few pages say little.

Copies of a story are no template: pages of which most of the text is the same count once,
and a text counts once for all pages on which most of the other text is the same, too.

The tree travels as counted rows (host, path, feature) that partial aggregates sum before
any shuffle; html itself is never shuffled unless the table of removed branches is too
large to broadcast.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.storage import materialize

# Element groups of HTML.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir
div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend
li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead
tr ul""".split())
VOID = frozenset("""area base br col embed hr img input link meta param source track wbr""".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NO_ARTICLE = frozenset("""nav footer aside form menu dialog head script style template noscript
iframe svg canvas object button select textarea audio video map search""".split())
ROLES = frozenset("""navigation banner contentinfo complementary search form alert alertdialog
dialog menu menubar toolbar""".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising banner promo promotion
sponsor sponsored sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer cookie
cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup
share sharing social related recommended recommendations comment comments commentlist disqus
respond reply replies widget widgets pagination pager skip toolbar login copyright masthead
topbar""".split())
NOT_A_PART = frozenset("with has no without".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr",
                     "option", "optgroup", "legend"}
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"),
            "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
RAW_END = {t: re.compile(rf"</{t}[^>]*(?:>|\Z)", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

KEEP, DROP, MAIN = 0, 1, 2
MARK = "#main"      # ends the node names of a main part
LEAST_PAGES, LOW, DAMP = 4, 0.35, 0.9
EVIDENCE = 0.2      # share by which a main part closes the gap to importance 1
BROADCAST_ROWS = 200_000


@lru_cache(maxsize=50_000)
def _element(tag: str, attributes: str) -> tuple[str, int]:
    """The node name of an element, and whether it is none or the main part."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    named = f"{found.get('class', '')} {found.get('id', '')}"
    name = f"{tag}.{re.sub('[0-9]+', '0', ' '.join(found.get('class', '').split()))}"
    if tag in NO_ARTICLE:
        return name, DROP
    if tag in ("html", "body"):
        return name, KEEP
    if ("hidden" in found or found.get("aria-hidden") == "true"
            or re.search(r"display\s*:\s*none", found.get("style", ""))
            or found.get("role") in ROLES):
        return name, DROP
    for part in named.split():
        words = {w.lower() for w in WORD.findall(part)}
        if words & WORDS and not words & NOT_A_PART:
            return name, DROP
    if tag in ("article", "main") or found.get("role") in ("main", "article"):
        return name, MAIN
    return name, KEEP


class Block:
    """A run of text: its node path, and whether a part of the page decides over it."""
    __slots__ = ("path", "parts", "state")

    def __init__(self, path, state):
        self.path, self.parts, self.state = path, [], state

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def parse(page: str) -> tuple[list[Block], dict[tuple, list[str]]]:
    """The text blocks of a page in order, and the children of each node."""
    # Stack entries: tag, path, state; inline elements other than dropped ones have none.
    stack: list[tuple[str, tuple, int]] = [("", (), KEEP)]
    blocks: list[Block] = []
    shown: dict[tuple, list[str]] = {}
    current: Block | None = None
    at = 0

    def close(tags, stop=()):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return True
            if stack[k][0] in stop:
                return False
        return False

    def text(piece):
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            _, path, state = stack[-1]
            current = Block(path, state)
            blocks.append(current)
        current.parts.append(piece)

    while (found := TAG.search(page, at)) is not None:
        text(page[at:found.start()])
        at = found.end()
        tag = found.group(2) or found.group(5)
        if tag is None:
            continue
        tag, ends = tag.lower(), found.group(1) or found.group(4)
        attributes = found.group(3) or found.group(6) or ""
        block = tag in BLOCKS
        if block:
            current = None
        elif tag == "br":
            text(" ")
        if ends:
            if block or tag in NO_ARTICLE:
                if close((tag,)):
                    current = None
            elif stack[-1][0] == tag:
                stack.pop()
                current = None
            continue
        if tag in RAW:
            # Up to its own end tag nothing in it is markup.
            last = RAW_END[tag].search(page, at)
            at = last.end() if last else len(page)
            continue
        if tag in CLOSES_P:
            close(("p",), ("article", "section", "div", "td", "li", "main", "body", "blockquote",
                           "aside", "nav", "footer", "header", "form", "table"))
        if tag in SIBLINGS:
            close(SIBLINGS[tag], ("ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot")
                  + (("tr",) if tag in ("td", "th") else ()))
        name, state = _element(tag, attributes)
        if tag in VOID:
            continue
        if not block and state != DROP:
            continue
        _, path, above = stack[-1]
        if tag == "header" and above != MAIN:
            state = DROP
        if above == DROP:
            state = DROP
        elif above == MAIN and state == KEEP:
            state = MAIN
        if block:
            if above != DROP:
                shown.setdefault(path, []).append(name)
            path = (*path, name + MARK if state == MAIN else name)
        else:
            current = None
        stack.append((tag, path, state))
    text(page[at:])
    return blocks, shown


def key(*parts) -> int:
    """A 64-bit hash that is the same in every process."""
    import xxhash
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


@lru_cache(maxsize=100_000)
def node(path: tuple) -> int:
    return key(*path)


PAGE, STYLE, CONTENT = 0, 1, 2
HASH = (1 << 64) - 1


def contexts(texts: list[str]) -> tuple[int, list[int]]:
    """A hash of most of a page's text, and for each text one of most of the others.

    Longest first, until half of the characters are reached. A text longer than all
    others together is its own context.
    """
    hashes = [key(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), hashes[i]))
    lengths, sums = [0], [0]
    for i in order:
        lengths.append(lengths[-1] + len(texts[i]))
        sums.append(sums[-1] + hashes[i] & HASH)
    total, out = lengths[-1], [0] * len(texts)
    for rank, i in enumerate(order):
        size = len(texts[i])
        if 2 * size > total:
            out[i] = hashes[i] & HASH
            continue
        half = (total - size + 1) // 2
        k = bisect_left(lengths, half)
        if rank < k:
            k = bisect_left(lengths, half + size)
            out[i] = sums[k] - hashes[i] & HASH
        else:
            out[i] = sums[k]
    signed = lambda h: h - (1 << 63)
    return signed(sums[bisect_left(lengths, (total + 1) // 2)]), list(map(signed, out))


def _features(batches):
    for batch in batches:
        rows = []
        hosts = batch.column("host").to_pylist()
        for host, page in zip(hosts, batch.column("html").to_pylist()):
            blocks, shown = parse(page or "")
            own = set()
            blocks = [b for b in blocks if b.state != DROP]
            texts = [b.text() for b in blocks]
            whole, rest = contexts(texts)
            for block, text, other in zip(blocks, texts, rest):
                path = block.path
                for depth in range(1, len(path) + 1):
                    own.add((node(path[:depth]), PAGE, 0, whole, depth, node(path[:depth - 1]),
                             path[depth - 1].endswith(MARK)))
                own.add((node(path), CONTENT, key(text), other, len(path), node(path[:-1]),
                         path[-1:] != () and path[-1].endswith(MARK)))
            for path, names in shown.items():
                own.add((node(path), STYLE, key(*names), whole, len(path), node(path[:-1]),
                         path[-1:] != () and path[-1].endswith(MARK)))
            rows.extend((host, *row) for row in own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(),
                 pa.int64(), pa.bool_()))],
            ["host", "node", "kind", "feature", "context", "depth", "parent", "main"])


def _branches(table: pa.Table) -> pa.Table:
    """The nodes of one host whose texts go, weighed bottom-up.

    An inner node's importance is that of its presentation and, damped, the mean of its
    children; a node's own texts count as a child. A branch of low importance loses the
    nodes of which the content is low as well, so never a text for its place alone.
    """
    rows = sorted(table.to_pylist(), key=lambda r: -r["depth"])
    importance: dict[int, float] = {}
    children: dict[int, list[float]] = {}
    raised = lambda row, v: v + EVIDENCE * (1 - v) if row["main"] else v
    for row in rows:
        below = children.get(row["node"], [])
        if row["content"] is not None:
            below = [*below, raised(row, row["content"])]
        if row["presentation"] is None:
            value = sum(below) / len(below) if below else 1.0
        elif not below:
            value = raised(row, row["presentation"])
        else:
            share = DAMP ** len(below)
            value = ((1 - share) * raised(row, row["presentation"])
                     + share * sum(below) / len(below))
        importance[row["node"]] = value
        children.setdefault(row["parent"], []).append(value)
    branch, low = set(), []
    for row in reversed(rows):
        # The root and the outermost element are no branches.
        if row["parent"] in branch or row["depth"] > 1 and importance[row["node"]] < LOW:
            branch.add(row["node"])
            if row["content"] is not None and raised(row, row["content"]) < LOW:
                low.append(row["node"])
    return pa.table({"host": table.column("host").slice(0, 1),
                     "removed": pa.array([np.array(sorted(low), np.int64).tobytes()],
                                         pa.binary())})


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, depth, parent, main, pages, presentation, content): entropies from 0 to 1.

    With a feature on n of m pages, presentation is the entropy of the styles to the base
    m, and content one less the mean entropy of the texts, log n / log m each. Pages are
    told apart by most of their text, texts by most of the text beside them.
    """
    rows = pages.select("host", "html").mapInArrow(
        _features, "host string, node long, kind int, feature long, context long, depth int, "
        "parent long, main boolean")
    of_node = ["host", "node", "depth", "parent", "main"]
    counted = rows.distinct().groupBy(*of_node, "kind", "feature").agg(F.count("*").alias("n"))
    logs = F.col("n") * F.log("n")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    nodes = counted.groupBy(*of_node).agg(
        F.coalesce(of(PAGE, F.col("n")), of(STYLE, F.col("n"))).alias("pages"),
        of(STYLE, F.col("n")).alias("styles"), of(STYLE, logs).alias("style_logs"),
        of(CONTENT, F.col("n")).alias("texts"), of(CONTENT, logs).alias("text_logs"))
    base = F.log(F.greatest("pages", F.lit(2)))
    return nodes.where(F.col("pages") >= LEAST_PAGES).select(
        *of_node, "pages",
        F.when(F.col("styles") > 0, F.least(F.lit(1.0), F.log("styles") / base
               - F.col("style_logs") / F.col("styles") / base)).alias("presentation"),
        F.when(F.col("texts") > 0, F.greatest(F.lit(0.0), 1 - F.col("text_logs")
               / F.col("texts") / base)).alias("content"))


def removed_branches(pages: DataFrame) -> DataFrame:
    """(host, removed): packed hashes of the nodes whose texts go, hosts with any.

    Nodes are template elements (digits in names are levelled, rare nodes left out), so
    what one host gathers doesn't grow with its pages.
    """
    tree = materialize(style_tree(pages), "style-tree")
    low = tree.groupBy("host").applyInArrow(_branches, "host string, removed binary")
    return materialize(low.where(F.length("removed") > 0), "removed")


def main_text(page: str | None, removed=frozenset()) -> str:
    """The article's blocks, each on one line; empty if there is none.

    Where a page has a main part, only that counts. Texts of removed nodes go inside it
    and elsewhere; if that left nothing, it is not applied.
    """
    blocks, _ = parse(page or "")
    blocks = [b for b in blocks if b.state != DROP]
    chosen = [b for b in blocks if b.state == MAIN] or blocks
    chosen = [b for b in chosen if node(b.path) not in removed] or chosen
    return "\n".join(t for t in (b.text() for b in chosen) if t)


def _extract(batches):
    for batch in batches:
        texts = []
        for page, low in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist()):
            texts.append(main_text(page, _nodes(low) if low else frozenset()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


@lru_cache(maxsize=256)
def _nodes(low: bytes) -> frozenset:
    return frozenset(np.frombuffer(low, np.int64).tolist())


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)),
                      F.lit(""))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row.

    Null html reads as empty and gives an empty text; a null or odd url is of the host ''.
    Unclosed elements end with their parent; text of a page cut short is kept.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    low = removed_branches(rows)
    if low.count() <= BROADCAST_ROWS:
        low = F.broadcast(low)
    return rows.join(low, "host", "left").select("page_id", "url", "html", "removed").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
