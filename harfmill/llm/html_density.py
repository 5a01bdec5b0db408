"""HTML main-text extraction by composite text density.

The DOM nodes are the page's block elements, links and marked elements; a tag
inside a line of text counts as a tag of the node around it.  Every node gets
its characters, tags, link characters and link tags; its composite density is
characters per tag, scaled by a logarithm that falls as links take over.  A
node's density sum adds up its children's densities.  The node with the largest
sum below `body` is the seed; the smallest density on the way from it up to
`body` is the threshold, and every node whose density reaches it adds the
largest-sum node below it.  Blocks that are mostly links and fall below the
threshold go, wherever they stand.  Between two siblings that are kept nothing
else is left out, and a heading stays with what it heads.  Where the seed lies
in an `article` or `main`, the page itself marks the extent.

Before densities are counted, scripts, styles and the like are cut, and so are
elements that say they are no article (menus, page headers, footers, sidebars,
notices, adverts, forms, hidden parts, reader comments; by tag, role, or words
of class and id) - unless they hold an `article` or `main`, or most of the
page's text that is no link while the rest of the page shows neither one of these
nor a title with text of its own.  A class that names such a part among unknown words (`research-share`)
only counts for elements that are mostly links.

Results in odd cases: null or blank html gives an empty text; broken markup is
read as far as it goes (an open element ends with its parent, an unclosed tag,
comment or script runs to the end); a page without `body` is its own body;
repeated rows give repeated results; an empty table gives an empty table.  Texts
are never cut, whatever their length, and time grows with a page's length only.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfmill.llm.shared import ship

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Never article text.
HARD = frozenset("head script style template button select textarea iframe svg canvas object noembed noframes audio video title option datalist".split())
#: Rarely article text.
SOFT = frozenset("nav aside footer form dialog menu noscript".split())
#: Of these, such as stand beside the text even where there is little of it.
BESIDE = SOFT - {"form", "noscript"}
#: An opening tag of the key ends an open element of the value, within the nearest container.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("optgroup", "option"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("#page html body table td th ul ol dl div section article main aside nav header footer form select blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("ul ol dl div section table menu".split())
MAIN = frozenset("article main".split())
# Words in a class or id, and roles, that mark what is no article text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer"
    " discussion disqus dropdown footer hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination"
    " popup promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription toolbar topbar widget widgets".split()
)
#: These tell enough where they come last, whatever stands before them.
CLEAR = frozenset("adverts advertisement breadcrumb breadcrumbs comments commentlist cookie cookies disclaimer footer navbar newsletter pagination sidebar".split())
#: Words that go with them without a meaning of their own.
PLAIN = frozenset(
    "area article bar block body bottom box btn center col column container content desktop element entry fixed form global group holder icon inner item items left link links"
    " list main mobile module outer page panel part post primary reader readers right row secondary section site slot small story sub tab text thread top unit user users"
    " wide wrap wrapper zone".split()
)
#: Words that turn a class into a statement about something else.
TURNS = frozenset("above after and before below free has hide is less no non not show to with without".split())
PAGE_HEADERS = frozenset("header site-header main-header top-header global-header".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|!\[CDATA\[|[!?/])")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"']++))?+""")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_NOT, _WEAK, _STRONG = 0, 1, 2


def _mark(tag: str, attributes: str) -> int:
    """How clearly an element's attributes say that it is no article text."""
    found = _NOT
    if tag in ("html", "body", "main") or not attributes.strip():
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word)]
                if word.lower() in PAGE_HEADERS:
                    found = max(found, _STRONG)
                elif any(p in NOISE for p in parts) and not any(p in TURNS for p in parts):
                    clear = parts[-1] in CLEAR or all(p in NOISE or p in PLAIN for p in parts)
                    found = max(found, _STRONG if clear else _WEAK)
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return _STRONG
        elif name == "style" and _HIDING.search(value):
            return _STRONG
    return found


class _Tree:
    """Nodes by number; a parent's number is smaller than its children's."""

    def __init__(self) -> None:
        self.tag, self.parent, self.inner, self.mark = ["#page"], [-1], [0], [_NOT]
        #: (node, text), in page order; a block boundary is (node, None).
        self.text: list[tuple[int, str | None]] = []

    def add(self, tag: str, parent: int, mark: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.inner.append(0)  # tags inside lines
        self.mark.append(mark)
        return len(self.tag) - 1


class _Stack:
    """Open elements with their nodes, and in each container how many of each tag are open."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = [("#page", 0)]
        self.open: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    def push(self, tag: str, node: int) -> None:
        self.items.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in SCOPES:
            self.scopes.append({})
        else:
            self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag, _ = self.items.pop()
        self.open[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            while self.pop() != tag:
                pass

    def end(self, tags: tuple[str, ...]) -> None:
        """End all open elements of these tags within the nearest container."""
        here = self.scopes[-1]
        while any(here.get(t) for t in tags):
            self.pop()


class _Page:
    """A page's markup, with what is known to come no more, so that nothing is looked for twice."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, {}

    def find(self, what: str, at: int) -> int:
        if at >= self.gone.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`, past quoted values; -1 if there is none."""
        page = self.page
        while m := _STOP.search(page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=":  # a quote anywhere else is a sign like others
                closing = self.find(m[0], at)
                if closing >= 0:
                    at = closing + 1
        return -1


def _parse(source: str) -> _Tree:
    tree, stack, at, page = _Tree(), _Stack(), 0, _Page(source)
    text, size = tree.text, len(source)
    while m := _OPEN.search(source, at):
        node = stack.items[-1][1]
        if m.start() > at:
            text.append((node, source[at : m.start()]))
        at = m.end()
        if not m[2]:
            closing = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(closing, at - 2 if closing == "-->" else at)
            at = size if end < 0 else end + len(closing)
            continue
        end = page.tag_end(at)
        if end < 0:
            at = size
            break
        tag, attributes = m[2].lower(), source[at:end]
        at = end + 1
        if m[1]:
            if tag == "br" or tag not in INLINE and tag != "a":
                text.append((node, None))
            stack.close(tag)
            if tag not in INLINE and tag != "a":
                text.append((stack.items[-1][1], None))
            continue
        block = tag not in INLINE and tag != "a"
        if block and tag not in VOID:
            ends = ENDS.get(tag, ())
            stack.end((*ends, "p") if tag in P_ENDERS else ends)
        elif tag == "hr":
            stack.end(("p",))
        parent = stack.items[-1][1]
        if block:
            text.append((parent, None))
        if tag in VOID:
            tree.inner[parent] += tag != "wbr"
            continue
        mark = _STRONG if tag in SOFT or tag == "header" and not any(stack.open.get(t) for t in MAIN) else _mark(tag, attributes)
        if tag == "header" and any(stack.open.get(t) for t in MAIN):
            mark = _NOT
        if not block and tag != "a" and not mark:
            tree.inner[parent] += 1
            stack.push(tag, parent)
            continue
        child = tree.add(tag, parent, mark)
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            text.append((child, source[at : end.start() if end else size]))
            close = page.find(">", end.start()) if end else -1
            at = size if close < 0 else close + 1
        else:
            stack.push(tag, child)
    if at < size:
        text.append((stack.items[-1][1], source[at:]))
    return tree


def _weigh(tree: _Tree, cut: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, link characters, tags and link tags of each node's subtree, without what is cut."""
    n = len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = tree.tag[k] == "a" or in_link[tree.parent[k]]
    for node, t in tree.text:
        if t and not cut[node]:
            length = len("".join(t.split()))
            chars[node] += length
            links[node] += length * in_link[node]
    for k in range(n - 1, 0, -1):
        if not cut[k]:
            p = tree.parent[k]
            tags[k] += tree.inner[k]
            chars[p] += chars[k]
            links[p] += links[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + (tree.tag[k] == "a")
    tags[0] += tree.inner[0]
    return chars, links, tags, link_tags


def _cuts(tree: _Tree) -> list[bool]:
    """What goes before densities are counted."""
    n = len(tree.tag)
    hard, marked = [False] * n, [False] * n
    for k in range(1, n):
        hard[k] = hard[tree.parent[k]] or tree.tag[k] in HARD
        marked[k] = marked[tree.parent[k]] or tree.mark[k] == _STRONG
    chars, links, _, _ = _weigh(tree, hard)
    prose = [c - x for c, x in zip(chars, links, strict=True)]
    own = prose[:]
    for k in range(n - 1, 0, -1):
        if not hard[k]:
            own[tree.parent[k]] -= prose[k]
    unmarked = sum(x for k, x in enumerate(own) if not marked[k] and not hard[k])
    has_main, titles = [False] * n, [0] * n
    for k in range(n - 1, 0, -1):
        has_main[k] |= tree.tag[k] in MAIN and tree.mark[k] == _NOT and prose[k] > 0
        titles[k] += tree.tag[k] == "h1" and chars[k] > 0
        has_main[tree.parent[k]] |= has_main[k]
        titles[tree.parent[k]] += titles[k]
    cut = hard[:]
    for k in range(1, n):
        if cut[tree.parent[k]]:
            cut[k] = True
        elif not cut[k] and tree.mark[k]:
            if tree.mark[k] == _WEAK:
                cut[k] = 2 * links[k] > chars[k]
            elif not has_main[k]:
                title = titles[0] > titles[k]
                rest = has_main[0] or title and (unmarked >= 100 or tree.tag[k] in BESIDE)
                cut[k] = 2 * prose[k] <= prose[0] or rest
    return cut


def _densities(tree: _Tree, cut: list[bool]) -> tuple[list[float], list[float], int, list[bool]]:
    """Composite density and density sum of each node, the body's number, and which nodes are lists of links."""
    n = len(tree.tag)
    chars, links, tags, link_tags = _weigh(tree, cut)
    body = tree.tag.index("body") if "body" in tree.tag else 0
    if not chars[body]:
        body = 0
    share = links[body] / max(chars[body], 1)
    density, total = [0.0] * n, [0.0] * n
    for k in range(n):
        c = chars[k]
        if c and not cut[k]:
            t = max(tags[k], 1)
            base = math.log(c / max(c - links[k], 1) * links[k] + share * c + math.e)
            density[k] = max(0.0, c / t * math.log(c / max(links[k], 1) * t / max(link_tags[k], 1)) / base)
            if k:
                total[tree.parent[k]] += density[k]
    listed = [tree.tag[k] in LISTS and link_tags[k] > 1 and 2 * links[k] > chars[k] for k in range(n)]
    return density, total, body, listed


def _chosen(tree: _Tree) -> list[bool]:
    """For each node whether its text is main text."""
    n, cut = len(tree.tag), _cuts(tree)
    density, total, body, listed = _densities(tree, cut)
    below = [k == body for k in range(n)]
    for k in range(body + 1, n):
        below[k] = below[tree.parent[k]]
    best = list(range(n))  # the largest-sum node of each subtree
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        if not cut[k] and tree.tag[k] != "a" and total[best[k]] > total[best[p]]:
            best[p] = best[k]
    seed = best[body]
    extent, k, threshold = -1, seed, density[seed]
    while k > 0 and k != body:
        if tree.tag[k] in MAIN:
            extent = k
        k = tree.parent[k]
        threshold = min(threshold, density[k])
    keep, drop = [False] * n, [c or x and d < threshold for c, x, d in zip(cut, listed, density, strict=True)]
    if extent >= 0:
        keep[extent] = True
    else:
        keep[seed] = True
        for k in range(body, n):
            if below[k] and not cut[k] and density[k] >= threshold > 0:
                keep[best[k]] = True
        _fill(tree, keep, drop, listed)
    for k in range(1, n):
        drop[k] |= drop[tree.parent[k]]
        keep[k] = (keep[k] or keep[tree.parent[k]]) and not drop[k]
    return keep


def _fill(tree: _Tree, keep: list[bool], drop: list[bool], listed: list[bool]) -> None:
    """Keep what stands between two siblings that hold main text, and the headings right before one."""
    n = len(tree.tag)
    holds = keep[:]
    for k in range(n - 1, 0, -1):
        holds[tree.parent[k]] |= holds[k]
    waiting: dict[int, list[int]] = {}  # a parent's children since the last that holds main text
    started = [False] * n
    for k in range(1, n):
        p = tree.parent[k]
        if not holds[p] or drop[k]:
            continue
        since = waiting.setdefault(p, [])
        if not holds[k]:
            since.append(k)
            continue
        for x in reversed(since):
            if not started[p] and tree.tag[x] not in HEADINGS:
                break
            keep[x] = not listed[x]
        started[p], waiting[p] = True, []


def main_text(page: str | None) -> str:
    """The main text of one page: white space becomes one space, blocks are joined by one."""
    if not page or not page.strip():
        return ""
    tree = _parse(page)
    keep = _chosen(tree)
    return " ".join(entities.unescape("".join(" " if t is None else t for node, t in tree.text if keep[node])).split())


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the kept columns, text (main text, empty if none) and n_chars (its code points).

    A narrow map: no shuffle, and memory for one Arrow batch of pages.
    """
    ship(pages.sparkSession)
    slim = pages.select(*keep, F.col(html).cast("string").alias("_hm_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    [*part.schema.names[:-1], "text", "n_chars"],
                )

    return slim.mapInArrow(run, schema)
