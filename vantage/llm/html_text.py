"""Main text of web pages by tag-path ratios.

A page becomes a list of text nodes, each with the path of block tags (and first class or id) from the root down to it.
Per path, characters outside links and punctuation are summed over its nodes. Both ratios to the number of nodes are
smoothed over the paths in page order and fused; the nodes whose score is at least a share of the best are content. Short
blocks and headings of the same article come back afterwards: those in the content's nearest common container, or, where
that is the whole page, those between content and the headings before it.

Links count against a path outside articles only. Tags and class or id words are a second signal: each element of a region that is no part of an article multiplies the
scores below it by a weight less than one, and <article> and <main> by one above. The elements around the best path take
nothing away, so an article that lies whole in such an element loses nothing by it; only inside <nav>, <footer> and their like there is no article at all.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.arrays import slices

# fixed values: tag names
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math select datalist canvas audio video object".split())
OUTSIDE = frozenset("head nav footer aside dialog menu".split())
WIDGETS = frozenset("form button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": (), "thead": ()}
SCOPES = "ul ol dl table div article section main body aside nav blockquote".split()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
# fixed values: words in a class or id that mark a region outside the article
NOT_CONTENT = frozenset("""ad ads adbox adslot advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs
comment commentlist comments consent cookie cookies copyright disqus discussion footer gdpr header login masthead menu
menubar modal nav navbar navigation newsletter notice notices overlay pagination pager paywall popup popular promo
promotion recommended related replies reply respond search share sharing sidebar signup sitemap skip skyscraper social
sponsor sponsored subscribe subscription tags toolbar topbar trending widget widgets""".split())
# fixed values: words that make the name of a region whatever follows them, and words that only tell of a region
REGIONS = frozenset("ad ads comment comments cookie cookies disqus".split())
TELLING = frozenset("has have no not with without hide hides show shows is in".split())
# weights: regions by tag or role, elements that a class word names or mentions, and articles
WEIGHT = {"outside": 0.02, "name": 0.05, "mention": 0.5, "article": 5.0}
PUNCTUATION = frozenset(".,;:!?…。、，！？；：")

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}


class Node:
    """A block's text: its path, the innermost weighed element it lies in, whether a region by tag holds it, and its pieces."""

    __slots__ = ("path", "mark", "outside", "heading", "parts", "linked")

    def __init__(self, path: int, mark: int, outside: bool, heading: bool):
        self.path, self.mark, self.outside, self.heading, self.parts, self.linked = path, mark, outside, heading, [], 0


class Paths:
    """Paths as numbers, each with a parent and a label, 0 being the root; and weighed elements likewise."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.label = [0], [""]
        self.marks: list[tuple[int, float]] = [(0, 1.0)]

    def below(self, path: int, label: str) -> int:
        found = self.known.setdefault((path, label), len(self.parent))
        if found == len(self.parent):
            self.parent.append(path)
            self.label.append(label)
        return found

    def mark(self, above: int, weight: float) -> int:
        self.marks.append((above, weight))
        return len(self.marks) - 1

    def weights(self, around: int = 0) -> list[float]:
        """What the elements around each mark weigh together; those around the mark given take nothing away."""
        free = set()
        while around:
            free.add(around)
            around = self.marks[around][0]
        out = [1.0]
        for k, (above, weight) in enumerate(self.marks[1:], 1):
            out.append(out[above] * (max(1.0, weight) if k in free else weight))
        return out

    def common(self, some: set[int]) -> int:
        """The deepest path above or at all of these; a path's number is greater than its parent's."""
        many = [0] * len(self.parent)
        for p in some:
            many[p] = 1
        for p in range(len(many) - 1, 0, -1):
            if many[p] == len(some):
                return p
            many[self.parent[p]] += many[p]
        return 0

    def under(self, root: int) -> list[bool]:
        """Whether each path is root or below it."""
        out = [p == root for p in range(len(self.parent))]
        for p in range(root + 1, len(out)):
            out[p] |= out[self.parent[p]]
        return out


def _kind(value: str) -> str:
    """Whether a class or id names a region outside the article, mentions one, or neither."""
    out = ""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        if any(w in NOT_CONTENT for w in words):
            names = (words[-1] in NOT_CONTENT or words[0] in REGIONS) and not TELLING & set(words)
            out = "name" if names or out == "name" else "mention"
    return out


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[str, float, bool]:
    """The tag with its first class or id, the element's weight, and whether it is a region outside by tag or role."""
    label, kind, outside = tag, "", tag in OUTSIDE
    hidden = tag in WIDGETS or (tag == "header" and not in_article)
    for m in _NAME.finditer(attributes) if attributes.strip() else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
            if tag not in ("html", "body", "main") and kind != "name":
                kind = _kind(value) or kind
            if label == tag and words[0]:
                label = f"{tag}.{words[0]}"
        elif key == "role":
            outside |= value.lower() in ROLES
        else:
            hidden |= key == "hidden" or value.lower() == "true"
    weight = WEIGHT["outside"] if outside or hidden else WEIGHT[kind] if kind else 1.0
    if tag in ("article", "main") and not in_article:
        weight *= WEIGHT["article"]
    return label, weight, outside


def text_nodes(page: str) -> tuple[list[Node], Paths]:
    """The blocks of a page in order. Unclosed and wrongly nested tags are closed as browsers close them.

    Every step looks at the top of a stack or of a tag's own list of places there, so the time grows with the page alone.
    """
    paths = Paths()
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]  # tag, path, mark, outside, in an article
    places: dict[str, list[int]] = {}
    blocks = [0]
    nodes: list[Node] = []
    fresh, at, end, last = True, 0, len(page), page.rfind(">")

    def add(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        _, path, mark, outside, in_article = stack[-1]
        if fresh or not nodes or mark != nodes[-1].mark:  # an inline element may have a weight too
            if not text.strip():
                if not fresh:
                    nodes[-1].parts.append(text)
                return
            nodes.append(Node(path, mark, outside, stack[blocks[-1]][0] in HEADINGS))
            fresh = False
        node = nodes[-1]
        node.parts.append(text)
        if places.get("a") and not in_article:  # a link in an article is a part of its text
            node.linked += len(text.strip())

    def close(k: int) -> None:
        nonlocal fresh
        fresh |= blocks[-1] >= k
        while len(stack) > k:
            places[stack.pop()[0]].pop()
        while blocks[-1] >= k:
            blocks.pop()

    def top(tags) -> int:
        return max((places[x][-1] for x in tags if places.get(x)), default=0)

    while at < end:
        m = _OPEN.search(page, at)
        if not m or m.start() > last:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m[2] is None:
            stop = page.find("-->", m.end()) + 2 if m[0] == "<!--" else page.find(">", m.end())
            at = stop + 1 if stop > 1 else end
            continue
        inner = _ATTRIBUTES.match(page, m.end())
        at = inner.end() if inner else page.find(">", m.end()) + 1  # a quote that nothing closes ends with the tag
        attributes = page[m.end() : at - 1]
        tag = m[2].lower()
        if m[1]:
            k = top((tag,))
            if k and not (tag in INLINE and blocks[-1] > k):
                close(k)
            elif tag == "p":
                fresh = True
            continue
        if tag in VOID:
            if tag in ("br", "hr") and nodes and not fresh:
                nodes[-1].parts.append(" ")
            continue
        if tag in RAW:
            closing = _CLOSING[tag].search(page, at)
            at = closing.end() if closing else end
            fresh = True
            continue
        if tag in CLOSES_P or tag in ITEMS:
            k = top((*ITEMS.get(tag, ()), *(("p",) if tag in CLOSES_P else ())))
            if k > top(SCOPES):
                close(k)
        _, path, mark, outside, in_article = stack[-1]
        label, weight, out = _marks(tag, attributes, in_article)
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            fresh = True
            path = paths.below(path, label)
            blocks.append(len(stack))
        if weight != 1:
            mark = paths.mark(mark, weight)
        stack.append((tag, path, mark, outside or out, in_article or tag in ("article", "main")))
    return nodes, paths


def _squeeze(node: Node) -> str:
    return " ".join("".join(node.parts).split())


def ratios(nodes: list[tuple[Node, str]]) -> dict[int, float]:
    """The fused score of each path: characters outside links and punctuation, a node, smoothed in page order.

    A path with no more text outside links than in them has 0.
    """
    sums: dict[int, list[float]] = {}
    for n, t in nodes:
        x = sums.setdefault(n.path, [0.0, 0.0, 0.0, 0.0])
        x[0] += 1
        x[1] += max(0, len(t) - n.linked)
        x[2] += sum(map(t.count, PUNCTUATION))
        x[3] += min(len(t), n.linked)
    by_text = _smooth([x[1] / x[0] for x in sums.values()])
    by_mark = _smooth([x[2] / x[0] for x in sums.values()])
    return {p: math.sqrt(a * (1 + b)) if x[1] > x[3] else 0.0 for (p, x), a, b in zip(sums.items(), by_text, by_mark, strict=True)}


def main_text(page: str, share: float = 0.35) -> str:
    """The article's text: white space in a block becomes one space, blocks are joined by one space."""
    nodes, paths = text_nodes(page)
    nodes = [(n, t) for n in nodes if (t := _squeeze(n))]
    if not nodes:
        return ""
    path_score = ratios(nodes)
    weights = paths.weights()
    score = [path_score[n.path] * weights[n.mark] for n, _ in nodes]
    best = max(range(len(nodes)), key=score.__getitem__)
    weights = paths.weights(nodes[best][0].mark)
    score = [path_score[n.path] * weights[n.mark] for n, _ in nodes]
    best = max(range(len(nodes)), key=score.__getitem__)
    if not score[best] or nodes[best][0].outside:
        return ""
    content = [k for k, x in enumerate(score) if x >= share * score[best]]
    root = paths.common({paths.parent[nodes[k][0].path] for k in content})
    low, high = content[0], content[-1]
    while low and nodes[low - 1][0].heading:
        low -= 1
    whole = paths.label[root].split(".")[0] in ("", "html", "body")
    under = paths.under(root)
    chosen = set(content)
    for k, (n, t) in enumerate(nodes):
        if k in chosen or 2 * n.linked > len(t) or weights[n.mark] < 0.5 * weights[nodes[best][0].mark]:
            continue
        if low <= k <= high if whole else under[n.path]:
            chosen.add(k)
    return " ".join(t for k, (_, t) in enumerate(nodes) if k in chosen)


def _smooth(x: list[float]) -> list[float]:
    """Each value with a tenth of its neighbours in page order."""
    last = len(x) - 1
    return [(v + 0.1 * (x[max(k - 1, 0)] + x[min(k + 1, last)])) / 1.2 for k, v in enumerate(x)]


def extract(pages: DataFrame, share: float = 0.35) -> DataFrame:
    """(page_id, url, text, n_chars) for each page.

    Cases: a null or empty html, or one without content, gives an empty text; a null url stays null; text outside all
    tags counts as a block; paths with equal scores are all in or all out; the time grows with a page's length, whatever
    its nesting or its unclosed tags; repeated rows are extracted each; an empty table gives no rows; other columns are
    ignored.
    """

    def run(batches):
        for batch in slices(batches, "html"):
            out = [main_text(x or "", share) for x in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
