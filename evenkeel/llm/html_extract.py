"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. Each host has a reference page, the one with the smallest id.
Every page's DOM tree is aligned with it by simple tree matching, and for each slot (node) of the reference four things
are summed over the different pages that have it: pages, pages with the reference's text in it, its share of the
page's text, and the share of links in its own; copies of a page count as one. From them a host's wrapper is learned:

- The content slot is the deepest that nearly all pages have and that holds most of their varying text on average,
  reached from the root without passing over headings or paragraphs that vary.
- Slots beside the way to it, at a place that nearly all pages have, are template, whether their
  text is the same or varies from page to page, as menus and adverts do.
- Anywhere outside an article, slots with the same text on 90 % of the pages are template.

Markup decides what alignment cannot: parts of the content that say that they are no text of the article (forms,
adverts, comments ...) are left out, article elements in it bound it, and pages of which no wrapper is known are judged by
their markup alone: article elements, or else main elements, bound the content, all that a page
has; without them the smallest element around all that are named like content does, if it holds
most of the text. Nothing in an article is template; a page that is template throughout is kept whole.

Only sums are shuffled, summed per task first; references and templates join by host, which
Spark broadcasts if they are small and otherwise shuffles, splitting a host with many pages.

Defined results: null and empty pages have an empty text; pages without a host, and hosts with
fewer than SUPPORT pages, are judged by their markup alone; repeated rows are reported once per row; unclosed
and unknown elements are kept as a browser would, at any depth.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.common import column, slices
from evenkeel.session import staged

SUPPORT = 3  # pages a slot must have been seen on
CONSTANT = 0.9  # share of them with the same text, and of all pages that have a slot at a constant place
DOMINANT = 0.5  # share of the text that varies from page to page that the content slot holds on average

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr dd dt li".split())
SELF_CLOSING = {  # an element ends one of these that is open, up to the given container
    "li": ("li", frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "tr": (("tr", "td", "th"), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "option": ("option", frozenset(("select",))),
}
SKIP = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas "
    "dialog menu map audio video title".split()
)
INVISIBLE = frozenset("head script style noscript template textarea select iframe object embed svg canvas audio video title".split())
CONTAINERS = frozenset("#root html body div section article main center table tbody tr td".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement adverts advertising banner "
    "promo promotion sponsor sponsored cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus "
    "reply replies respond discussion breadcrumb breadcrumbs pagination pager toolbar widget copyright disclaimer skip search".split()
)
MAIN_WORDS = frozenset("article content post entry story main text".split())


@dataclass
class Tree:
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parts: list[list] = field(default_factory=list)  # texts, and children as numbers
    children: list[list[int]] = field(default_factory=list)
    shapes: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, attrs: str) -> int:
        number = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.attrs.append(attrs)
        self.parts.append([])
        self.children.append([])
        if parent >= 0:
            self.parts[parent].append(number)
            self.children[parent].append(number)
        return number

    def text(self, node: int) -> str:
        """The text directly in a node, white space as single spaces."""
        return " ".join(" ".join(p for p in self.parts[node] if isinstance(p, str)).split())


def parse(page: str) -> Tree:
    tree = Tree()
    tree.add("#root", -1, "")
    stack, at, n = [0], 0, len(page)
    while at < n:
        token = _TOKEN.search(page, at)
        if token is None:
            tree.parts[stack[-1]].append(page[at:])
            break
        if token.start() > at:
            tree.parts[stack[-1]].append(page[at : token.start()])
        at = token.end()
        if token.group(2) is None:
            if token.group().startswith("<![CDATA["):
                tree.parts[stack[-1]].append(token.group()[9:].removesuffix("]]>"))
            continue
        tag = token.group(2).lower()
        if token.group(1):
            _close(tree, stack, tag)
            continue
        _imply(tree, stack, tag)
        node = tree.add(tag, stack[-1], token.group(3))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else n  # what such an element holds is never content
        elif tag not in VOID and not (token.group(3).endswith("/") and tag not in BLOCK):
            stack.append(node)
    _measure(tree)
    return tree


def _close(tree: Tree, stack: list[int], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if tree.tags[stack[i]] == tag:
            del stack[i:]
            return
        if tree.tags[stack[i]] in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "body", "html"):
            return


def _imply(tree: Tree, stack: list[int], tag: str) -> None:
    if tag in CLOSES_P:
        for i in range(len(stack) - 1, 0, -1):
            if tree.tags[stack[i]] == "p":
                del stack[i:]
                break
            if tree.tags[stack[i]] in BLOCK or tree.tags[stack[i]] == "button":
                break
    if tag in SELF_CLOSING:
        ends, container = SELF_CLOSING[tag]
        for i in range(len(stack) - 1, 0, -1):
            if tree.tags[stack[i]] in container:
                break
            if tree.tags[stack[i]] == ends or tree.tags[stack[i]] in ends and not isinstance(ends, str):
                del stack[i:]
                break
    if tag == "body":
        for i in range(1, len(stack)):
            if tree.tags[stack[i]] == "head":
                del stack[i:]
                break


def _measure(tree: Tree) -> None:
    """Shape (equal for subtrees of the same tags) and size of every subtree; children come after parents."""
    n = len(tree.tags)
    tree.shapes, tree.sizes = [0] * n, [1] * n
    for node in range(n - 1, -1, -1):
        children = tree.children[node]
        tree.shapes[node] = hash((tree.tags[node], *[tree.shapes[c] for c in children]))
        tree.sizes[node] = 1 + sum(tree.sizes[c] for c in children)


def align(page: Tree, reference: Tree) -> dict[int, int]:
    """Node of `page` to node of `reference`, by simple tree matching from the roots.

    Subtrees of equal shape at both ends of two lists of children are matched at once: no other
    partner could give either more matches. The rest goes through the table of the matching.
    """
    matched, todo = {}, [(0, 0)]
    scores: dict[tuple[int, int], int] = {}
    while todo:
        a, b = todo.pop()
        matched[a] = b
        todo += _pairs(page, reference, page.children[a], reference.children[b], scores)[1]
    return matched


def _pairs(x: Tree, y: Tree, a: list[int], b: list[int], scores: dict) -> tuple[int, list[tuple[int, int]]]:
    """The most matches of two lists of subtrees, and the pairs of their roots that give them."""
    pairs, total, a, b = _equal_ends(x, y, a, b)
    if not a or not b:
        return total, pairs
    table = [[0] * (len(b) + 1)]
    for u in a:
        row, above = [0], table[-1]
        for j, v in enumerate(b):
            here = above[j] + _score(x, y, u, v, scores) if x.tags[u] == y.tags[v] else 0
            row.append(max(row[j], above[j + 1], here))
        table.append(row)
    i, j = len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j]))
    return total + table[-1][-1], pairs


def _equal_ends(x: Tree, y: Tree, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], int, list[int], list[int]]:
    """Pairs of equal shape at both ends of two lists and their sizes, and what is left of the lists."""
    low, high_a, high_b = 0, len(a), len(b)
    pairs, total = [], 0
    while low < high_a and low < high_b and x.shapes[a[low]] == y.shapes[b[low]]:
        pairs.append((a[low], b[low]))
        total += x.sizes[a[low]]
        low += 1
    while low < high_a and low < high_b and x.shapes[a[high_a - 1]] == y.shapes[b[high_b - 1]]:
        high_a, high_b = high_a - 1, high_b - 1
        pairs.append((a[high_a], b[high_b]))
        total += x.sizes[a[high_a]]
    return pairs, total, a[low:high_a], b[low:high_b]


def _score(x: Tree, y: Tree, u: int, v: int, scores: dict) -> int:
    """The most matches of two subtrees whose roots match. Scores of lower subtrees are found first, without
    recursion, so trees may be of any depth."""
    if x.shapes[u] == y.shapes[v]:
        return x.sizes[u]
    todo = [(u, v)]
    while todo:
        p, q = todo[-1]
        key = (x.shapes[p], y.shapes[q])
        if key not in scores:
            _, _, a, b = _equal_ends(x, y, x.children[p], y.children[q])
            open_ = [
                (c, d) for c in a for d in b
                if x.tags[c] == y.tags[d] and x.shapes[c] != y.shapes[d] and (x.shapes[c], y.shapes[d]) not in scores
            ]
            if open_:
                todo += open_
                continue
            scores[key] = 1 + _pairs(x, y, x.children[p], y.children[q], scores)[0]
        todo.pop()
    return scores[x.shapes[u], y.shapes[v]]


def _attributes(raw: str) -> dict[str, str]:
    return {m.group(1).lower(): (m.group(2) or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}


def _words(value: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


def _left_out(tree: Tree, node: int, in_main: bool) -> bool:
    """Whether the markup of an element says that it is not the article."""
    tag = tree.tags[node]
    if tag in SKIP or tag == "header" and not in_main:
        return True
    raw = tree.attrs[node]
    if not raw or tag in ("html", "body", "main"):
        return False
    found = _attributes(raw)
    if not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return True
    named = _words(found.get("class", "") + " " + found.get("id", ""))
    aside = named & ASIDE_WORDS
    return bool(aside) and not (tag in ("article", "header") and aside <= {"header"}) and not (tag == "article" and not aside & {"comment", "comments", "reply", "related", "sponsored", "ad", "promo"})


def _regions(tree: Tree) -> tuple[list[int], dict[int, list[int]]]:
    """All nodes that the markup does not leave out, and those of them that may bound the article."""
    kept, bounds, todo = [], {"article": [], "main": [], "named": []}, [(0, False)]
    while todo:
        node, in_main = todo.pop()
        if node and _left_out(tree, node, in_main):
            continue
        kept.append(node)
        tag = tree.tags[node]
        named = _attributes(tree.attrs[node]) if tree.attrs[node] and tag in ("div", "section", "td", "main") else {}
        if tag == "article":
            bounds["article"].append(node)
        elif tag == "main" or named.get("role", "").lower() == "main":
            bounds["main"].append(node)
        elif _words(named.get("class", "") + " " + named.get("id", "")) & MAIN_WORDS:
            bounds["named"].append(node)
        inside = in_main or tag in ("article", "main")
        todo += [(c, inside) for c in reversed(tree.children[node])]
    return kept, bounds


def blocks(tree: Tree, template: set[int] = frozenset(), content: int | None = None, markup: bool = True) -> list[str]:
    """The content's blocks in page order.

    `template` are nodes whose text belongs to the wrapper, `content` is the node that was learned to hold the content.
    Without `markup` the wrapper alone decides.
    """
    if not markup:
        alive = {n for n in range(len(tree.tags)) if n == 0 or tree.tags[n] not in INVISIBLE}
        return _collect(tree, content or 0, alive, template) or _collect(tree, 0, alive, frozenset())
    kept, bounds = _regions(tree)
    alive = set(kept)
    articles = [b for b in _outermost(tree, bounds["article"]) if _amount(tree, b, alive)]
    if content in alive:
        inside = [b for b in articles if b == content or _within(tree, b, content)]
        if inside or not articles:
            found = _all_of(tree, inside, alive, frozenset()) if inside else _collect(tree, content, alive, template)
            if found:
                return found
    for kind in ("article", "main"):
        found = [b for b in _outermost(tree, bounds[kind]) if _amount(tree, b, alive)]
        if found:
            wrapper = frozenset() if kind == "article" else template
            return _all_of(tree, found, alive, wrapper) or _all_of(tree, found, alive, frozenset())
    top = 0
    if bounds["named"]:
        around = _around(tree, bounds["named"])
        if 2 * _amount(tree, around, alive, template) > _amount(tree, 0, alive, template):
            top = around
    return _collect(tree, top, alive, template) or _collect(tree, top, alive, frozenset())


def _within(tree: Tree, node: int, top: int) -> bool:
    while node > top:
        node = tree.parents[node]
    return node == top


def _all_of(tree: Tree, tops: list[int], alive: set[int], template: set[int]) -> list[str]:
    return [block for top in tops for block in _collect(tree, top, alive, template)]


def _outermost(tree: Tree, nodes: list[int]) -> list[int]:
    """Those of the nodes that are in no other one, in page order."""
    inside, chosen = set(nodes), []
    for node in sorted(nodes):
        above = tree.parents[node]
        while above >= 0 and above not in inside:
            above = tree.parents[above]
        if above < 0:
            chosen.append(node)
    return chosen


def _around(tree: Tree, nodes: list[int]) -> int:
    """The lowest common ancestor; parents have smaller numbers than children."""
    top = nodes[0]
    for node in nodes[1:]:
        while top != node:
            top, node = (tree.parents[top], node) if top > node else (top, tree.parents[node])
    return top


def _amount(tree: Tree, top: int, alive: set[int], template: set[int] = frozenset()) -> int:
    total, todo = 0, [top]
    while todo:
        node = todo.pop()
        for part in tree.parts[node]:
            if isinstance(part, str):
                total += len(part.strip()) if node not in template else 0
            elif part in alive:
                todo.append(part)
    return total


def _collect(tree: Tree, top: int, alive: set[int], template: set[int]) -> list[str]:
    out, text = [], []

    def flush() -> None:
        block = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if block:
            out.append(block)

    todo: list = [(top, 0)]
    while todo:
        node, at = todo.pop()
        if at == 0 and tree.tags[node] in BLOCK:
            flush()
        parts = tree.parts[node]
        while at < len(parts):
            part = parts[at]
            at += 1
            if isinstance(part, str):
                if node not in template:
                    text.append(part)
            elif part in alive:
                if tree.tags[part] == "br":
                    text.append(" ")
                elif tree.tags[part] not in VOID or tree.tags[part] in BLOCK:
                    todo += [(node, at), (part, 0)]
                    break
        else:
            if tree.tags[node] in BLOCK:
                flush()
    flush()
    return out


class References:
    """Parsed reference pages of the hosts seen last."""

    def __init__(self) -> None:
        self.trees: dict[str, Tree] = {}

    def get(self, host: str, page: str) -> Tree:
        if host not in self.trees:
            if len(self.trees) >= 200:
                self.trees.clear()
            self.trees[host] = parse(page)
        return self.trees[host]


def _weights(tree: Tree) -> tuple[list[int], list[int]]:
    """Visible characters in every subtree, and those of them in links."""
    n = len(tree.tags)
    chars, links = [0] * n, [0] * n
    for node in range(n - 1, -1, -1):  # children come after parents
        if tree.tags[node] in INVISIBLE:
            chars[node] = links[node] = 0
            continue
        chars[node] += sum(len(p.strip()) for p in tree.parts[node] if isinstance(p, str))
        if tree.tags[node] == "a":
            links[node] = chars[node]
        if node:
            chars[tree.parents[node]] += chars[node]
            links[tree.parents[node]] += links[node]
    return chars, links


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and slot of its reference: pages that have it, with the same text, and shares of text and links.

    Each of n copies of a page counts as 1 / n.
    """
    references = References()
    for batch in slices(batches, "html"):
        sums: dict[tuple[str, int], list[float]] = {}
        columns = (column(batch, c).to_pylist() for c in ("host", "html", "reference", "copies"))
        for host, page, reference, copies in zip(*columns, strict=True):
            tree, model = parse(page), references.get(host, reference)
            chars, links = _weights(tree)
            for a, b in align(tree, model).items():
                text = model.text(b)
                here = sums.setdefault((host, b), [0.0] * 4)
                here[0] += 1 / copies
                here[1] += bool(text and tree.text(a) == text) / copies
                here[2] += chars[a] / max(1, chars[0]) / copies
                here[3] += links[a] / max(1, chars[a]) / copies
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                *[pa.array([sums[k][i] for k in keys], pa.float64()) for i in range(4)],
            ],
            names=["host", "slot", "seen", "same", "share", "linked"],
        )


def learned(model: Tree, slots: dict[int, tuple[float, float, float, float]]) -> tuple[int, list[int]]:
    """The content slot (0 if none is found) and the template slots of a reference page, from the sums of `_slots`."""
    pages = slots[0][0]

    def steady(slot: int) -> bool:
        return slot in slots and slots[slot][0] >= max(SUPPORT, CONSTANT * pages)

    def constant(slot: int) -> bool:
        return slot in slots and slots[slot][0] >= SUPPORT and slots[slot][1] >= CONSTANT * slots[slot][0]

    content, template = 0, {b for b in slots if constant(b)}
    varying = {}  # share of a page's text in a slot, without what is constant in it
    for slot in sorted(slots, reverse=True):  # children come after parents
        below = [c for c in model.children[slot] if c in slots]
        own = max(0.0, slots[slot][2] - sum(slots[c][2] for c in below))
        varying[slot] = sum(varying[c] for c in below) + (0.0 if constant(slot) else own)
    while True:
        children = [c for c in model.children[content] if c in slots and model.tags[c] not in INVISIBLE]
        large = [c for c in children if model.tags[c] in CONTAINERS and steady(c) and varying[c] > DOMINANT * varying[0]]
        if not large:
            break
        best = max(large, key=varying.get)
        if any(c != best and model.tags[c] in TEXT_BLOCKS and slots[c][2] and not constant(c) and slots[c][3] < 0.5 * slots[c][0] for c in children):
            break  # a headline beside it belongs to the content
        content = best
    if model.tags[content] in ("#root", "html", "body"):
        content = 0
    node = content
    while node:
        above = model.parents[node]
        todo = [c for c in model.children[above] if c != node and steady(c)]
        while todo:
            slot = todo.pop()
            template.add(slot)
            todo += [c for c in model.children[slot] if c in slots]
        node = above
    return content, sorted(template)


def _wrappers(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents, templates = [], []
        for reference, slots in zip(column(batch, "reference").to_pylist(), column(batch, "slots").to_pylist(), strict=True):
            found = learned(parse(reference), {s["slot"]: (s["seen"], s["same"], s["share"], s["linked"]) for s in slots})
            contents.append(found[0])
            templates.append(found[1])
        yield pa.RecordBatch.from_arrays(
            [column(batch, "host"), column(batch, "reference"), pa.array(contents, pa.int32()), pa.array(templates, pa.list_(pa.int32()))],
            schema=schema,
        )


def _extracted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, markup: bool) -> Iterator[pa.RecordBatch]:
    references = References()
    for batch in slices(batches, "html"):
        texts = []
        columns = (column(batch, c).to_pylist() for c in ("host", "html", "reference", "content", "template"))
        for host, page, reference, content, template in zip(*columns, strict=True):
            tree, wrapper, inside = parse(page or ""), set(), None
            if reference:
                slots, model = set(template), references.get(host, reference)
                beside = {b for b in slots if not _within(model, b, content)} if content else set()
                for a, b in align(tree, model).items():
                    if content and b == content:
                        inside = a
                    if b in beside or b in slots and tree.text(a) == model.text(b):
                        wrapper.add(a)
            texts.append("\n".join(blocks(tree, wrapper, inside, markup)))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            schema=schema,
        )


class Wrappers(NamedTuple):
    """rows: page_id, url, html, host; slots: sums per host and slot; learned: host, reference, content, template."""

    rows: DataFrame
    slots: DataFrame
    learned: DataFrame


def wrappers(pages: DataFrame, html: str = "html") -> Wrappers:
    """What the pages of each host with at least SUPPORT different ones have in common. Runs when called."""
    host = F.lower(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select("page_id", "url", F.col(html).alias("html"), F.nullif(host, F.lit("")).alias("host"))
    usable = rows.where("host IS NOT NULL AND length(html) > 0").withColumn("page", F.xxhash64("html"))
    # copies of a page are one page: only hashes are shuffled, and those of repeated pages staged
    different = usable.groupBy("host", "page").agg(F.count("*").alias("copies"))
    supported = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= SUPPORT).select("host")
    repeated = staged(different.where("copies > 1"), "wrapper-copies")
    models = usable.groupBy("host").agg(
        F.min_by("html", F.struct(F.col("page_id").isNull(), "page_id", "page")).alias("reference")
    )
    models = staged(models.join(supported, "host"), "wrapper-models")
    weighed = usable.join(repeated, ["host", "page"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    counted = weighed.join(models, "host").select("host", "html", "reference", "copies").mapInArrow(
        _slots, "host string, slot int, seen double, same double, share double, linked double"
    )
    sums = [F.round(F.sum(c), 3).alias(c) for c in ("seen", "same", "share", "linked")]
    slots = staged(counted.groupBy("host", "slot").agg(*sums), "wrapper-slots")
    per_host = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "seen", "same", "share", "linked")).alias("slots"))  # of one page
    schema = T._parse_datatype_string("host string, reference string, content int, template array<int>")
    arrow = to_arrow_schema(schema)
    made = models.join(per_host, "host").mapInArrow(lambda it: _wrappers(it, arrow), schema)
    return Wrappers(rows, slots, staged(made, "wrappers"))


def extract(pages: DataFrame, html: str = "html", markup: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page. Without `markup` only learned wrappers decide."""
    rows, _, known = wrappers(pages, html)
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    arrow = to_arrow_schema(schema)
    # pages without a host meet no wrapper; a null key would gather them in one task
    key = F.coalesce("host", F.concat(F.lit("\0"), F.xxhash64("page_id").cast("string")))
    joined = rows.withColumn("host", key).join(known, "host", "left")
    return joined.mapInArrow(lambda it: _extracted(it, arrow, markup), schema)
