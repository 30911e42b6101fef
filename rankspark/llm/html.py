"""Main-text extraction from raw HTML as a minimum cut.

A page is cut into blocks (runs of text between block-level tags). Every block gets two integer
costs: being called content and being called boilerplate. They become its capacities to the two terminals;
neighbouring blocks and blocks of one parent are joined by edges that grow with their closeness in the tree. The
minimum cut is the labelling of least total cost, so a block that says little by itself follows its neighbours.

The costs come from a classifier over the block's length, share of links, kind of element and punctuation. ``fit``
learns it from all pages that mark their article (``article`` or ``main``, or a class like them): blocks inside
are content, others boilerplate, and each cell of the features has the log-odds of its counts; a cell
with few blocks is drawn towards a fixed linear rule, which also serves without any such page. The article's
container adds to the costs of its blocks where there is one. A class, id or role that names another part of a page adds a finite
cost the other way: a large one (STRONG) for adverts, comments, sidebars and the like, a small one (WEAK) for words that
sections of articles have, too. It does not count for an element that holds the article, and words that say
what the page's layout has (``has-sidebar``) do not count at all. Only elements that are never article text (scripts, menus, asides,
footers, hidden ones, the page's header, and forms that are not a wrapper of half the page) tie their blocks to the boilerplate
terminal with more than all edges of a block can carry.

Cases: null or empty html, or html without text, gives an empty text; unclosed, stray and wrongly
nested tags close what they can; an unclosed comment, script or tag runs to the end of the page; ties
label a block as boilerplate; repeated pages give repeated rows; a null page_id or url is kept; other columns are not
read, so their names cannot clash; an empty table gives an empty result; nothing is cut off or capped.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their part in the page.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style template noscript iframe object svg math canvas audio video textarea select title noframes noembed".split())
NEVER = frozenset("nav aside footer menu dialog button search".split())
FORMS = frozenset(["form", "fieldset"])
CLOSED_BY_BLOCK = frozenset(["p"])
ITEMS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select"}
#: Words in class, id and role that name other parts of a page; words for what the layout has; words that sections have, too.
OTHER = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|reply|replies|reader-\w+|discussion|menu|nav\w*|"
    r"breadcrumbs?|sidebar\w*|side-bar|widget\w*|footer|masthead|site-header|page-header|topbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|pagination|pager|toolbar|skip-link|complementary|contentinfo)(?![a-z])")
LAYOUT = re.compile(r"(?:^|[-_\s])(?:has|no|with|without|is|not)[-_][\w-]*")
ALSO = re.compile(r"(?:^|[^a-z])(?:related|recommend\w*|search\w*|discussion|navigation)(?![a-z])")
REMARK = re.compile(r"(?:^|[^a-z])(?:comments?|reply|replies|disqus)(?![a-z])")
MAIN = re.compile(r"(?:^|[^a-z])(?:article|main|main-content|content|post|entry|story|body-text|article-body|post-body|entry-content)(?![a-z])")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
HARD, STRONG, WEAK = 1 << 20, 200, 45
FORM = -1  # an element that is hard unless it wraps the page


class _Element:
    __slots__ = ("tag", "parent", "depth", "main", "cost", "apart", "chars", "within", "holds_main", "hard", "added")

    def __init__(self, tag: str, parent: _Element | None, cost: int = 0, main: bool = False):
        self.tag, self.parent, self.cost, self.main = tag, parent, cost, main
        self.depth = parent.depth + 1 if parent else 0
        self.apart = bool(cost) or bool(parent and parent.apart)  # it, or an element around it, is named as another part
        self.within = main or bool(parent and parent.within)  # in an article's container
        self.chars, self.holds_main = 0, False


def _marked(tag: str, attributes: str, parent: _Element) -> tuple[int, bool]:
    """What an element by itself adds to the cost of calling its blocks content, and whether it is an article's container."""
    if tag in NEVER:
        return HARD, False
    cost, main = FORM if tag in FORMS else 0, tag in ("article", "main")
    if tag == "header" and not parent.within:
        return HARD, False  # the page's header; one inside the article is its head
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, *values in MARKS.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return HARD, False
            if tag in ("html", "body"):
                continue
            said = LAYOUT.sub(" ", value)
            if name == "id" and tag == "section" and ALSO.search(said):
                cost = cost or WEAK
            elif (REMARK if tag in ("article", "main") else OTHER).search(said):
                cost = cost or STRONG
            elif tag not in ("article", "main") and ALSO.search(said):
                cost = cost or WEAK
            main = main or bool(MAIN.search(value))
    return cost, main and cost in (0, FORM)


def blocks(page: str) -> list[tuple[str, int, int, _Element]]:
    """(text, characters inside links, characters, parent element) of each block, in page order."""
    out: list[tuple[str, int, int, _Element]] = []
    root = _Element("", None)
    stack = [root]
    text: list[str] = []
    linked, links, at = 0, 0, 0
    owner = root

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append((joined, linked, len(joined), owner))
            text.clear()
        linked = 0

    def holder() -> _Element:
        for e in reversed(stack):
            if e.tag in BLOCK or e.apart or e is root:
                return e
        return root

    def close(tag: str, within: str = "") -> None:
        stop = within.split()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    scan, n = TOKEN.search, len(page)
    while at < n:
        m = scan(page, at)
        end = m.start() if m else n
        if end > at:
            piece = page[at:end]
            if links:
                linked += len(piece)
            text.append(piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                flush()
            if tag not in VOID:
                close(tag, "" if tag in BLOCK else "article main section div td th")
                owner = holder()
            continue
        if tag in OPAQUE:
            if tag not in ("noscript", "title"):
                text.append(" ")
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ITEMS:
                close(tag, ITEMS[tag])
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag == "a":
            links += 1
        e = _Element(tag, stack[-1], *_marked(tag, m[3], stack[-1]))
        if e.apart and not stack[-1].apart:
            flush()  # an inline advert is a block of its own
        stack.append(e)
        owner = holder()
    flush()
    return out


def _places(found: list[tuple[str, int, int, _Element]]) -> list[tuple[bool, int]]:
    """Of each block: whether it is in an article's container, and what the elements around it add to the cost of
    calling it content."""
    line: list[_Element] = []  # every element around a block, once
    seen: set[int] = set()
    for _, _, chars, e in found:
        e.chars += chars
        while e is not None and id(e) not in seen:
            seen.add(id(e))
            line.append(e)
            e = e.parent
    line.sort(key=lambda x: x.depth)
    for x in reversed(line):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.holds_main |= x.main or x.holds_main
    for x in line:
        x.hard = x.cost == HARD or bool(x.parent and x.parent.hard)
    total = sum(chars for _, _, chars, e in found if not e.hard)
    for x in line:
        own = x.cost
        if own == FORM:
            own = 0 if x.holds_main or 2 * x.chars >= total else HARD
        elif own != HARD and x.holds_main:
            own = 0
        x.added = max(own, x.parent.added if x.parent else 0)
    return [(e.within, e.added) for *_, e in found]


def cell(block: tuple[str, int, int, _Element]) -> int:
    """The block's features as one number: length, share of links, kind of element, punctuation at the end."""
    text, linked, chars, parent = block
    words = text.count(" ") + 1
    length = sum(words >= w for w in (5, 10, 20, 40))
    links = sum(min(linked, chars) >= share * chars for share in (0.01, 0.3, 0.7))
    return ((length * 4 + links) * 4 + _sort(parent.tag)) * 2 + (text[-1] in ".!?\u2026:\"")


def _sort(tag: str) -> int:
    if tag in ("p", "blockquote", "pre"):
        return 1
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return 2
    return 3 if tag in ("li", "dt", "dd", "td", "th") else 0


def _rule(block: tuple[str, int, int, _Element]) -> int:
    """Score of a block by itself, by a fixed linear rule: positive for content."""
    text, linked, chars, parent = block
    words = text.count(" ") + 1
    score = min(words, 40) - 60 * min(linked, chars) // chars + (0, 15, 10, 0)[_sort(parent.tag)]
    return score - 15 if words < 5 and _sort(parent.tag) != 2 else score


FEW = 50  # blocks that the rule weighs as much as
SCALE, MOST = 15, 60  # cost of one unit of log-odds, and of a cell at most
IN_MAIN = 60


def _costs(block: tuple[str, int, int, _Element], place: tuple[bool, int], has_main: bool, learnt: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    main, added = place
    if added == HARD:
        return 0, HARD
    content, other = learnt.get(cell(block), (0, 0))
    n = content + other
    odds = max(-MOST, min(MOST, round(SCALE * math.log((content + 0.5) / (other + 0.5)))))
    score = (FEW * _rule(block) + n * odds) // (FEW + n)
    if main:
        score = IN_MAIN + max(score, 1 - IN_MAIN) if not added else IN_MAIN + score - added
    else:
        score -= added + (IN_MAIN if has_main else 0)
    return (score, 0) if score > 0 else (0, -score)


def _closeness(a: _Element, b: _Element) -> int:
    """Capacity between two blocks: the fewer steps between their parents, the larger."""
    steps = 0
    while a is not b and steps < 6:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        steps += 1
    return (12, 12, 10, 6, 4, 2, 1)[steps]


def minimum_cut(costs: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source, given (source, sink) capacities and edges (i, j, capacity).

    Shortest augmenting paths in phases (levels by breadth first, then blocking flow).
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (s, t) in enumerate(costs):
        if s > t:
            join(source, i, s - t, 0)
        elif t > s:
            join(i, sink, t - s, 0)
    for i, j, c in edges:
        join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            edges_of, k = out[a], turn[a]
            while k < len(edges_of) and not (room[edges_of[k]] and level[to[edges_of[k]]] == level[a] + 1):
                k += 1
            turn[a] = k
            if k < len(edges_of):
                path.append(edges_of[k])
                a = to[edges_of[k]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def labels(page: str | None, learnt: dict[int, tuple[int, int]] | None = None) -> list[tuple[str, bool, bool]]:
    """(text, whether content, whether it would be by its own costs alone) of each block, in page order."""
    found = blocks(page or "")
    if not found:
        return []
    costs, edges = network(found, learnt or {})
    signs = {s >= t for s, t in costs}
    if len(signs) == 1 and not any(s == t for s, t in costs):  # every node leans the same way: the cut is empty
        content = [signs.pop()] * len(found)
    else:
        content = minimum_cut(costs, edges)
    return [(b[0], yes, s > t) for b, yes, (s, t) in zip(found, content, costs, strict=True)]


def network(found: list, learnt: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Terminal capacities and edges of a page's blocks."""
    places = _places(found)
    has_main = any(main for main, _ in places)
    costs = [_costs(b, p, has_main, learnt) for b, p in zip(found, places, strict=True)]
    edges = [(i, i + 1, _closeness(found[i][3], found[i + 1][3])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):  # the previous block under the same parent's parent
        home = id(b[3].parent or b[3])
        if last.get(home, i - 1) < i - 1:
            edges.append((last[home], i, 4))
        last[home] = i
    return costs, edges


def main_text(page: str | None, learnt: dict[int, tuple[int, int]] | None = None) -> str:
    return "\n".join(text for text, yes, _ in labels(page, learnt) if yes)


def told(page: str | None) -> list[tuple[int, bool]]:
    """(cell, whether content) of the blocks of a page that marks its article; none of other pages."""
    found = blocks(page or "")
    places = _places(found)
    if not any(main for main, _ in places):
        return []
    return [(cell(b), main and not added) for b, (main, added) in zip(found, places, strict=True)]


def fit(pages: DataFrame, html: str = "html") -> dict[int, tuple[int, int]]:
    """Counts of (content, other) blocks per cell over all pages that mark their article; some hundred cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[tuple[int, bool]] = Counter()
        for b in batches:
            for h in b["html"]:
                n.update(told(h))
        if n:
            yield pd.DataFrame({"cell": [c for c, _ in n], "yes": [y for _, y in n], "n": list(n.values())})

    rows = pages.select(F.col(html).alias("html")).mapInPandas(run, "cell int, yes boolean, n long")
    got = rows.groupBy("cell").agg(F.sum(F.when(F.col("yes"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("yes"), 0).otherwise(F.col("n"))))
    return {c: (yes, no) for c, yes, no in got.collect()}


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            learnt: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; the classifier is learnt from the same pages if none is given."""
    kind = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}
    known = fit(pages, html) if learnt is None else learnt

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h, known) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"page_id {kind[page_id]}, url {kind[url]}, text string, n_chars long")
