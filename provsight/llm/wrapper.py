"""Main text of web pages by wrapper induction.

Every page of a host is aligned with the host's reference page by simple tree matching. A reference node whose text
is the same on nearly all different articles that have it is template; the others are slots. The smallest node with
blocks of its own that holds most of the words that vary outside links is the content's region. Extraction aligns a page
once more, leaves out the nodes that hold their template's own text, and reads the blocks of the page's article or main
elements or, where it has none, of the region. Parts that are no article by their element or role are left out as well
(menus, headers, footers, asides, notices, adverts, forms, comments, scripts).
Articles are told apart by host and key, so a hot host is spread, and node counts meet by host and node after being
summed in each task; hosts' references are broadcast only while they are small.

Varying slots alone are no article: menus and adverts differ from page to page too, hence the second rule. Pages are no
witnesses by their number: copies of an article count once, and near copies of the reference's own article (those that
share half of their shingles with it) not at all, whatever else differs on them. A host with fewer than MIN_PAGES
different articles besides the reference's has no template nodes.

Defined cases: null or empty html gives empty text; a url without a host shares the host ''; an unclosed or stray tag
is repaired as browsers do for paragraphs, list items and cells; repeated rows each give their row; an empty table
gives an empty result; other columns are ignored; deep and long pages are read and aligned without recursion.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

#: Different articles that must have a node, and the share of them with the same text, before it counts as template.
MIN_PAGES, SAME_SHARE = 5, 0.9
#: Words of a shingle, and the share of an article's shingles that the reference must lack for it to be another article.
SHINGLE, OWN_SHARE = 5, 0.5
#: Share of the varying words that the content's region holds; sums that alignment holds at once.
REGION_SHARE, CELLS = 0.8, 4_000_000
#: Bytes of reference pages that may be broadcast.
MAX_BROADCAST = 8_000_000
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]")
_rest = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_attr = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas dialog menu video audio".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words of class and id that mark a part as no article.
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that say nothing beside these: a name of several words marks a part only if all others are of this kind.
NEUTRAL = frozenset("area bar block body bottom box center container element fixed global group inner item items left links list lower module outer page panel posts region right row section site slot sticky text top unit upper wrap wrapper zone".split())
#: A part that holds so much of what it is in is not left out for its class or id: nothing would be left.
CONTENT_SHARE = 0.9
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "marks", "kids")

    def __init__(self, tag: str, marks: frozenset = frozenset()):
        self.tag, self.marks, self.kids = tag, marks, []


def _marks(attributes: str) -> frozenset:
    found = set()
    for name, value in _attr.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() in ("hidden", "aria-hidden"):
            if name.lower() == "hidden" or value == "true":
                found.add("hidden")
        elif name.lower() == "role":
            found.update(f"role:{r}" for r in value.split())
        else:
            found.update(value.split())
    return frozenset(found)


def parse(page: str) -> Node:
    """A DOM of elements and texts; entities are decoded in the texts."""
    root = Node("#")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # where on the stack each name is open, so that no end tag walks the stack
    blocks: list[int] = []

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].kids.append(entities.unescape(page[at:upto]))

    def close(names: set, hold: int) -> None:
        """Ends the innermost open element of these names, if it is above the place `hold`."""
        k = max((places[n][-1] for n in names if places.get(n)), default=0)
        if k > hold:
            for node in reversed(stack[k:]):
                places[node.tag].pop()
                if node.tag in BLOCK:
                    blocks.pop()
            del stack[k:]

    def last_block(but: str) -> int:
        for k in reversed(blocks):
            if stack[k].tag != but:
                return k
        return 0

    pos, quotes = 0, True
    while m := _tag.search(page, pos):
        start, pos = m.start(), m.end()
        if m[2] is None:
            end = page.find("-->", pos) + 3 if m[0] == "<!--" else page.find(">", pos) + 1
            if m[0] == "<!--" and end < 3:
                end = len(page)
            if not end:
                continue
            text(start)
            at = pos = end
            continue
        rest = _rest.match(page, pos) if quotes else None
        if rest is None:  # a quote that never ends: from here on tags end at the next bracket, so that no page is read twice
            quotes = False
            end = page.find(">", pos)
            if end < 0:
                break
            attributes, end = page[pos:end], end + 1
        else:
            attributes, end = rest[1], rest.end()
        text(start)
        at = pos = end
        name = m[2].lower()
        if m[1]:
            # a stray inline end tag does not close blocks
            close({name}, last_block(name) if name == "p" or name not in BLOCK else 0)
            continue
        if name in BLOCK and name not in ("html", "body"):
            close({"p"}, last_block("p"))
        if name in _ENDS:
            close(_ENDS[name], max((places[n][-1] for n in _HOLDS[name] if places.get(n)), default=0))
        node = Node(name, _marks(attributes) if attributes.strip() else frozenset())
        stack[-1].kids.append(node)
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            close_tag = re.compile(f"</{re.escape(name)}[\\s>/]", re.I).search(page, pos)
            stop = close_tag.start() if close_tag else len(page)
            node.kids.append(page[pos:stop])
            at = pos = stop
            if close_tag:
                at = pos = (page.find(">", stop) + 1) or len(page)
            continue
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append(node)
    text(len(page))
    return root


def _marked(name: str) -> bool:
    """A class or id that says that its part is no article: one word that does, or several of which the rest say nothing."""
    parts = [x for x in re.split(r"[-_]+", name) if x]
    return name in MARKS or (not MARKS.isdisjoint(parts) and all(x in MARKS or x in NEUTRAL for x in parts))


def _words(root: Node) -> dict[int, int]:
    """By id of each node: the words below it, but those of elements that never count."""
    order, todo, found = [], [root], {}
    while todo:
        at = todo.pop()
        order.append(at)
        todo.extend(k for k in at.kids if isinstance(k, Node) and k.tag not in SKIP)
    for at in reversed(order):
        found[id(at)] = sum(len(k.split()) if isinstance(k, str) else found.get(id(k), 0) for k in at.kids)
    return found


def _skipped(node: Node, inside: bool, words: dict[int, int], whole: int) -> bool:
    """Whether a part is left out. words: of each node; whole: those of the area that is read."""
    if node.tag in SKIP or "hidden" in node.marks or (node.tag == "header" and not inside):
        return True
    if node.tag in ("html", "body", "article", "main") or not node.marks:
        return False
    if any(m[5:] in ROLES for m in node.marks if m.startswith("role:")):
        return True
    named = any(_marked(m) for m in node.marks if not m.startswith("role:") and not (inside and m == "header"))
    return named and words.get(id(node), 0) < CONTENT_SHARE * whole


def _pieces(node: Node):
    """The texts below a node in page order, each with whether it is in a link."""
    todo: list = [(node, False)]
    while todo:
        at, linked = todo.pop()
        if isinstance(at, str):
            yield at, linked
        elif at.tag not in RAW:
            todo.extend((k, linked or at.tag == "a") for k in reversed(at.kids))


def _whole(node: Node) -> str:
    return "".join(t for t, _ in _pieces(node))


class Slot:
    """A run of like siblings, as one node of the tree that is aligned. shape tells trees apart by labels and structure."""

    __slots__ = ("label", "nodes", "kids", "size", "shape")

    def __init__(self, nodes: list[Node]):
        self.label, self.nodes, self.kids = (nodes[0].tag, nodes[0].marks), nodes, []


@lru_cache(maxsize=64)
def slots(page: str) -> Slot:
    root = Slot([parse(page)])
    made = [root]
    for at in made:  # grows while it is read
        for kid in (k for n in at.nodes for k in n.kids if isinstance(k, Node) and k.tag in BLOCK):
            if not at.kids or (kid.tag, kid.marks) != at.kids[-1].label:
                at.kids.append(Slot([kid]))
                made.append(at.kids[-1])
            else:
                at.kids[-1].nodes.append(kid)
    for at in reversed(made):
        at.size = 1 + sum(k.size for k in at.kids)
        at.shape = hash((at.label, *(k.shape for k in at.kids)))
    return root


def _weights(x: list[Slot], y: list[Slot], known: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight of each two distinct shapes, the shape of each of x, of each of y)."""
    left, right = ({s.shape: s for s in side} for side in (x, y))
    table = np.array([[known[p, q] if s.label == t.label else 0 for q, t in right.items()] for p, s in left.items()], np.int32)
    number = [{shape: k for k, shape in enumerate(side)} for side in (left, right)]
    return table, np.array([number[0][s.shape] for s in x]), np.array([number[1][s.shape] for s in y])


def _sums(table: np.ndarray, xs: np.ndarray, ys: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The best sums of weights for all of xs against each prefix of ys; rows, if given, gets those of the prefixes of xs."""
    best = np.zeros(len(ys) + 1, np.int32)
    for k, i in enumerate(xs):
        now = np.maximum(best[1:], best[:-1] + table[i, ys])
        best = np.concatenate(([0], np.maximum.accumulate(now)))
        if rows is not None:
            rows[k + 1] = best
    return best


def _matched(table: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """Places of xs and ys matched in order with the largest sum of weights. Long lists are halved where both halves' sums are
    largest together, so memory is that of CELLS sums; the sum is the same whatever the length."""
    found, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a + 1) * (d - c + 1) > CELLS:
            half = (a + b) // 2
            at = int(np.argmax(_sums(table, xs[a:half], ys[c:d]) + _sums(table, xs[half:b][::-1], ys[c:d][::-1])[::-1]))
            todo += [(a, half, c, c + at), (half, b, c + at, d)]
            continue
        best = np.zeros((b - a + 1, d - c + 1), np.int32)
        _sums(table, xs[a:b], ys[c:d], best)
        i, j = b - a, d - c
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((a + i, c + j))
    return sorted(found)


def align(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: the most pairs of equal labels that keep parents and order, and those pairs.

    Trees of equal shape match as a whole, also where they begin or end both lists of kids; others are compared once for each
    two shapes. Nothing recurses, and nothing depends on the lists' lengths but the order of the work.
    """
    if a.label != b.label:
        return 0, []
    known: dict[tuple[int, int], int] = {}

    def ends(x: Slot, y: Slot) -> tuple[int, int]:
        """How many kids at the start, and at the end, have equal shapes in both."""
        most, start, end = min(len(x.kids), len(y.kids)), 0, 0
        while start < most and x.kids[start].shape == y.kids[start].shape:
            start += 1
        while end < most - start and x.kids[-1 - end].shape == y.kids[-1 - end].shape:
            end += 1
        return start, end

    def middle(x: Slot, y: Slot) -> tuple[list[Slot], list[Slot], int, int]:
        start, end = ends(x, y)
        return x.kids[start : len(x.kids) - end], y.kids[start : len(y.kids) - end], start, end

    def solve(top: Slot, other: Slot) -> None:
        todo = [(top, other)]
        while todo:
            x, y = todo[-1]
            if (x.shape, y.shape) in known:
                todo.pop()
                continue
            if x.shape == y.shape:
                known[x.shape, y.shape] = x.size
                continue
            left, right, start, _ = middle(x, y)
            base = 1 + sum(k.size for k in x.kids[:start]) + sum(k.size for k in x.kids[start + len(left) :])
            if not left or not right:
                known[x.shape, y.shape] = base
                continue
            unlike = [(p, q) for p in {k.shape: k for k in left}.values() for q in {k.shape: k for k in right}.values() if p.label == q.label and (p.shape, q.shape) not in known]
            if unlike:
                todo.extend(unlike)
            else:
                known[x.shape, y.shape] = base + int(_sums(*_weights(left, right, known))[-1])

    pairs, at = [(a, b)], 0
    while at < len(pairs):  # grows while it is read
        x, y = pairs[at]
        at += 1
        left, right, start, end = middle(x, y)
        matched = list(zip(x.kids[:start], y.kids[:start]))
        if left and right:
            if x.shape != y.shape:
                solve(x, y)
            matched += [(left[i], right[j]) for i, j in _matched(*_weights(left, right, known))]
        pairs += matched + [(x.kids[len(x.kids) - k], y.kids[len(y.kids) - k]) for k in range(end, 0, -1)]
    return len(pairs), pairs


def _preorder(slot: Slot) -> list[Slot]:
    out, todo = [], [slot]
    while todo:
        out.append(todo.pop())
        todo.extend(reversed(out[-1].kids))
    return out


def _text(slot: Slot) -> str:
    return " ".join("\n".join(map(_whole, slot.nodes)).split())


def _free_words(slot: Slot) -> int:
    """Words of the slot that are in no link."""
    return sum(len(t.split()) for n in slot.nodes for t, linked in _pieces(n) if not linked)


def extract(page: str, template: set[int] | None = None, reference: str | None = None, region: int | None = None) -> str:
    """The page's main text. template: preorder numbers of the reference's template nodes; region: of the one that holds the content."""
    return _extract(page, template, reference, region)[0]


def _extract(page: str, template: set[int] | None, reference: str | None, region: int | None) -> tuple[str, int]:
    """As extract, and how many slots of the page the wrapper decided: template left out, or the region taken."""
    left_out: set[int] = set()
    inside: list[Node] = []
    decided = 0
    tree = slots.__wrapped__(page)
    if reference and (template or region):
        base = slots(reference)
        number = {id(s): k for k, s in enumerate(_preorder(base))}
        for r, s in align(base, tree)[1]:
            if template and number[id(r)] in template and not s.kids and _text(r) == _text(s):
                left_out.update(id(n) for n in s.nodes)
                decided += 1
            if number[id(r)] == region:
                inside = s.nodes
    words = _words(tree.nodes[0])
    areas = _areas(tree.nodes[0], words)
    if not areas and inside:
        areas, decided = inside, decided + 1
    return _main(tree.nodes[0], areas, left_out, words), decided


def _main(root: Node, areas: list[Node], left_out: set[int], words: dict[int, int]) -> str:
    blocks: list[str] = []
    for area in areas or [root]:
        pieces: list[str] = []
        _read(area, area is not root, left_out, pieces, blocks, words)
        _flush(pieces, blocks)
    return "\n".join(blocks)


def _areas(node: Node, words: dict[int, int]) -> list[Node]:
    """The outermost articles, else the main parts."""
    for name in ("article", "main"):
        found: list[Node] = []
        todo = [node]
        while todo:
            at = todo.pop()
            if at.tag == name or f"role:{name}" in at.marks:
                found.append(at)
            elif not _skipped(at, False, words, words[id(node)]):
                todo.extend(k for k in reversed(at.kids) if isinstance(k, Node))
        if found:
            return found
    return []


def _flush(pieces: list[str], blocks: list[str]) -> None:
    if text := " ".join("".join(pieces).split()):
        blocks.append(text)
    pieces.clear()


def _read(node: Node, inside: bool, left_out: set[int], pieces: list[str], blocks: list[str], words: dict[int, int]) -> None:
    todo: list = [k for k in reversed(node.kids)]
    whole = words.get(id(node), 0)
    while todo:
        kid = todo.pop()
        if kid is None:
            _flush(pieces, blocks)
        elif isinstance(kid, str):
            pieces.append(kid)
        elif kid.tag == "br":
            pieces.append("\n")
        elif id(kid) in left_out or _skipped(kid, inside, words, whole):
            if kid.tag in BLOCK:
                _flush(pieces, blocks)
        else:
            if kid.tag in BLOCK:
                _flush(pieces, blocks)
                todo.append(None)
            todo.extend(reversed(kid.kids))


def _shingles(text: str) -> set[str]:
    words = text.split()
    return {" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _own_main(tree: Slot) -> str:
    """The main text by the page alone, without a wrapper."""
    words = _words(tree.nodes[0])
    return _main(tree.nodes[0], _areas(tree.nodes[0], words), set(), words)


@lru_cache(maxsize=64)
def _reference_shingles(reference: str) -> set[str]:
    return _shingles(_own_main(slots(reference)))


def article_key(tree: Slot, reference: str) -> bytes | None:
    """The digest of what the page's article has and the reference's lacks, or None if that is too little."""
    has = _shingles(_own_main(tree))
    own = has - _reference_shingles(reference)
    return hashlib.md5("\n".join(sorted(own)).encode("utf-8", "surrogatepass")).digest() if own and len(own) >= OWN_SHARE * len(has) else None


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _sent(hosts: DataFrame, size: str, limit: int) -> DataFrame:
    total = hosts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(hosts) if total <= limit else hosts


def content_region(reference: str, varying: dict[int, int], share: float = REGION_SHARE) -> int | None:
    """The preorder number of the smallest node with blocks of its own that holds `share` of the words that vary; None for the root."""
    order = _preorder(slots(reference))
    number = {id(s): k for k, s in enumerate(order)}
    words = [varying.get(k, 0) for k in range(len(order))]
    for k in range(len(order) - 1, -1, -1):  # kids come after their parents
        words[k] += sum(words[number[id(c)]] for c in order[k].kids)
    at, total = 0, words[0]
    while total:
        inner = [number[id(c)] for c in order[at].kids if c.kids and words[number[id(c)]] >= share * total]
        if not inner:
            break
        at = inner[0]
    return at or None


def induce(pages: DataFrame, min_pages: int = MIN_PAGES, same_share: float = SAME_SHARE) -> DataFrame:
    """(host, reference, template, region): each host's reference page, the numbers of its template nodes, and of the node with the content.

    Hosts with fewer than min_pages different articles besides the reference's have no row.
    """
    named = pages.select(host_of(F.col("url")).alias("host"), "page_id", "html")
    hosts = named.where("html IS NOT NULL").groupBy("host").agg(F.min_by("html", F.struct("page_id", "html")).alias("reference"))
    hosts = cut(hosts)
    read = named.where("html IS NOT NULL").join(_sent(hosts.withColumn("size", F.octet_length("reference") + 64), "size", MAX_BROADCAST).drop("size"), "host")

    def make(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("host", "article", "seen", "same", "words")}
        for host, html, reference in zip(c["host"], c["html"], c["reference"]):
            tree = slots.__wrapped__(html)
            if (key := article_key(tree, reference)) is None:
                continue
            base = slots(reference)
            number = {id(s): k for k, s in enumerate(_preorder(base))}
            leaves = [(number[id(r)], text == _text(s), _free_words(s)) for r, s in align(base, tree)[1] if not r.kids and not s.kids and (text := _text(r))]
            for k, v in zip(out, (host, key, [n for n, _, _ in leaves], [n for n, same, _ in leaves if same], [w for _, _, w in leaves])):
                out[k].append(v)
        return out

    found = map_batches(read.select("host", "html", "reference"), make, "host string, article binary, seen array<int>, same array<int>, words array<int>")
    articles = found.groupBy("host", "article").agg(F.min(F.struct("seen", "same", "words")).alias("nodes")).select("host", "nodes.*")
    each = articles.select("host", F.posexplode("seen").alias("k", "node"), "same", "words").select("host", "node", F.array_contains("same", F.col("node")).cast("long").alias("same"), F.element_at("words", F.col("k") + 1).alias("words"))
    nodes = each.groupBy("host", "node").agg(F.count("*").alias("seen"), F.sum("same").alias("same"), F.sum("words").alias("words"))
    # a host's nodes are as many as its reference page has
    judged = nodes.where(F.col("seen") >= min_pages).withColumn("constant", F.col("same") >= same_share * F.col("seen"))
    wrapper = judged.groupBy("host").agg(F.collect_list(F.when(F.col("constant"), F.col("node"))).alias("template"), F.collect_list(F.when(~F.col("constant"), F.struct("node", "words"))).alias("varying"))
    known = hosts.join(wrapper, "host")

    def regions(c: dict[str, list]) -> dict[str, list]:
        found = [content_region(r, {x["node"]: x["words"] for x in v}) for r, v in zip(c["reference"], c["varying"])]
        return {k: c[k] for k in ("host", "reference", "template")} | {"region": found}

    return map_batches(known, regions, "host string, reference string, template array<int>, region int")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, same_share: float = SAME_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars, n_decided) per row of pages. n_decided: slots that the wrapper left out or took as the content."""
    hosts = cut(induce(pages, min_pages, same_share).withColumn("size", F.octet_length("reference") + 64))  # only hosts with a wrapper
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    read = named.join(_sent(hosts, "size", MAX_BROADCAST).drop("size"), "host", "left")

    def make(c: dict[str, list]) -> dict[str, list]:
        found = [_extract(h, set(t) if t else None, r, g) for h, t, r, g in zip(c["html"], c["template"], c["reference"], c["region"])]
        texts = [t for t, _ in found]
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": list(map(len, texts)), "n_decided": [n for _, n in found]}

    return map_batches(read.select("page_id", "url", "html", "template", "reference", "region"), make, "page_id long, url string, text string, n_chars long, n_decided long")
