"""Main text of web pages by composite text density.

The page is read into a tree by a tolerant parser (unclosed and stray tags, raw-text elements, comments).
Elements that are boilerplate by their name or role (menus, forms, scripts, adverts, notices, reader comments, ...) are
left out. Every other node gets its composite text density, characters per tag, lowered by the share of link
characters and link tags; its density sum is that of its children. The node with the largest sum is the core; the
least density on the path from it up to the body is the threshold, and below each node that reaches the
threshold the subtree with the largest sum is content. So is the outermost article or main around the core with
the articles beside it, whatever the density of their parts. Without one, all of the body is, but for the blocks
beside the core or its ancestors that are mostly links.

A class or id does not make boilerplate of what holds the page's article or main, or all but a tenth of its text.
Inside an article or main its words only weigh: a block of running text there stays unless a whole name of it says
that it is an advert, a notice, a sidebar, a form or readers' comments.

The text is that of the content in page order: character references decoded, white space inside a block
turned into one space, blocks joined by one line feed.

Time is linear in the page: tags are sought only before the last ``>``; after ``QUOTE_MISSES`` tags whose quotes never end,
tags end at the first ``>``; what an end tag or an implied end closes is looked up in scopes that every open element
carries, and each element is closed once.

Defined results: null or empty html, or a page without content, gives an empty text; of subtrees with equal sums the
first in page order is the core; repeated pages stay; pages of any size are read whole; columns of the input that
have the name of a result are replaced, others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import workers_can_import
from .columns import texts, with_columns

_open = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_quoted_tag = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: Tags with quotes that never end, after which quotes are no longer heeded.
QUOTE_MISSES = 16
_attribute = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_part = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("head script style noscript template iframe noembed noframes nav menu footer aside form button select textarea input object embed canvas audio video svg math dialog title datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class names and ids that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead comment comments commentlist disqus respond replies share sharing social newsletter subscribe signup login related recommended pagination pager search skip".split())
#: Those of them that name parts of an article as well.
WEAK = frozenset("promotion notification overlay widget widgets share sharing social related recommended search skip footer".split())
#: Words beside a mark that do not change what a name says.
NEUTRAL = frozenset("area bar block bottom box container content footer header inner item left link links list main note outer panel post reader right row section site slot text title top unit user wrap wrapper".split())
#: Characters of a block of running text at least.
RUNNING = 80
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag of the key ends an open element of the values, unless one of the limits stands between.
IMPLIED = {
    **{b: (("p",), frozenset("button table td th".split())) for b in BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}},
    "li": (("li", "p"), frozenset("ul ol menu dir table".split())),
    "dt": (("dt", "dd", "p"), frozenset("dl table".split())),
    "dd": (("dt", "dd", "p"), frozenset("dl table".split())),
    "tr": (("tr", "td", "th", "caption"), frozenset(["table"])),
    "td": (("td", "th", "p"), frozenset("tr table".split())),
    "th": (("td", "th", "p"), frozenset("tr table".split())),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), frozenset(["table"])),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), frozenset(["table"])),
    "option": (("option",), frozenset("select optgroup datalist".split())),
}
_raw_end = {name: re.compile(f"</{name}(?=[\\s/>])|</{name}\\Z", re.I) for name in RAW}
#: The different (ends, limits) of the rules, and the number of each start tag's rule.
_RULES = list(dict.fromkeys(IMPLIED.values()))
_RULE_OF = {name: _RULES.index(rule) for name, rule in IMPLIED.items()}
_SCOPED = frozenset(x for ends, limits in _RULES for x in (*ends, *limits))


class Node:
    __slots__ = ("name", "parent", "items", "boiler", "marked", "scope", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, boiler: bool):
        self.name, self.parent, self.boiler, self.marked = name, parent, boiler, 0
        self.items: list[Node | str] = []
        #: For each rule, the outermost open element within its limits that a start tag of the rule would end.
        self.scope: tuple[Node | None, ...] = (None,) * len(_RULES) if parent is None else parent.scope
        if name in _SCOPED:
            self.scope = tuple(None if name in limits else held if held is not None or name not in ends else self for (ends, limits), held in zip(_RULES, self.scope, strict=True))


def _is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for key, a, b, c in _attribute.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
    return False


def _mark(name: str, attributes: str) -> int:
    """How far a word of its class or id marks the element as boilerplate: 0 not, 1 by a word, 2 by a whole name."""
    if not attributes or name in ("html", "body", "main", "article"):
        return 0
    found = 0
    for key, a, b, c in _attribute.findall(attributes):
        if key.lower() not in ("class", "id"):
            continue
        for whole in (a or b or c).split():
            parts = {p.lower() for p in _part.findall(whole) if not p.isdigit()}
            marks = parts & MARKS
            if marks:
                found = max(found, 2 if marks - WEAK and parts - MARKS <= NEUTRAL else 1)
    return found


def _tags(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, is it an end tag, name, attributes) of all tags; comments and declarations have no name."""
    at, last, misses = 0, html.rfind(">"), 0
    while True:
        m = _open.search(html, at)
        if m is None:
            return
        name, start = m[2], m.start()
        if name is None:
            comment = html.startswith("<!--", start)
            close = html.find("-->", start + 4) if comment else html.find(">", m.end())
            if close < 0 and not comment:
                at = m.end()
                continue
            at = len(html) if close < 0 else close + (3 if comment else 1)
            yield start, at, False, None, ""
            continue
        if start > last:
            at = m.end()
            continue
        whole = _quoted_tag.match(html, m.end()) if misses < QUOTE_MISSES else None
        if whole is not None:
            at, attributes = whole.end(), whole[1]
        else:
            misses += 1
            close = html.find(">", m.end())
            if close < 0:
                at = m.end()
                continue
            at, attributes = close + 1, html[m.end() : close]
        skip = yield start, at, bool(m[1]), name.lower(), attributes
        if skip is not None:
            at = skip


def parse(html: str) -> Node:
    """The tree of a page; the root stands for the body. Start and end tags of html and body are ignored."""
    root = Node("body", None, False)
    open_, n = root, len(html)
    opened: dict[str, int] = {}
    done = 0

    def close(x: Node) -> Node:
        """Closes the open element and its parents up to ``x``; returns its parent."""
        y = open_
        while y is not x.parent:
            opened[y.name] -= 1
            y = y.parent
        return y

    tags, jump = _tags(html), None
    while True:
        try:
            start, at, closing, name, attributes = tags.send(jump)
        except StopIteration:
            break
        jump = None
        if start > done:
            open_.items.append(html[done:start])
        done = at
        if name is None or name in ("html", "body"):
            continue
        if closing:
            if opened.get(name):
                x = open_
                while x.name != name:
                    x = x.parent
                open_ = close(x)
            elif name in ("br", "p"):
                open_.items.append(Node(name, open_, False))
            continue
        if name in _RULE_OF and (x := open_.scope[_RULE_OF[name]]) is not None:
            open_ = close(x)
        in_article = bool(opened.get("article") or opened.get("main"))
        node = Node(name, open_, _is_boilerplate(name, attributes, in_article))
        node.marked = 0 if node.boiler else _mark(name, attributes)
        open_.items.append(node)
        if name in RAW:
            end = _raw_end[name].search(html, at)
            if end is None:
                done = n
                break
            last = html.find(">", end.end())
            done = jump = last + 1 if last >= 0 else n
        elif name not in VOID and not (attributes.endswith("/") and name not in BLOCKS):
            open_ = node
            opened[name] = opened.get(name, 0) + 1
    if done < n:
        open_.items.append(html[done:])
    settle_marks(root)
    return root


def settle_marks(root: Node) -> None:
    """Makes boilerplate of the marked elements that hold neither the article nor nearly all of the text."""
    order, stack = [], [(root, 0, False, False)]
    inside = set()
    while stack:
        node, depth, within, linked = stack.pop()
        linked = linked or node.name == "a"
        order.append((node, depth + bool(node.marked)))
        if within:
            inside.add(id(node))
        within = within or node.name in ("article", "main")
        node.chars = sum(len(" ".join(unescape(x).split())) for x in node.items if type(x) is str)
        node.link_chars = node.chars if linked else 0
        stack.extend((x, depth + bool(node.marked), within, linked) for x in reversed(node.items) if type(x) is not str and not x.boiler)
    if not any(node.marked for node, _ in order):
        return
    for node, _ in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    articles = [(depth, -node.chars, k) for k, (node, depth) in enumerate(order) if node.name in ("article", "main") and node.chars]
    holders = set()
    if articles:
        x = order[min(articles)[2]][0]
        while x is not None:
            holders.add(id(x))
            x = x.parent
    for node, _ in order:
        if node.marked == 1 and id(node) in inside and node.chars >= RUNNING and node.link_chars * 3 < node.chars:
            continue
        node.boiler = node.boiler or (node.marked > 0 and id(node) not in holders and (bool(articles) or node.chars * 10 <= root.chars * 9))


def measure(root: Node) -> list[Node]:
    """Densities of all nodes that are not boilerplate, in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.name == "a"
        order.append(node)
        own = sum(len(" ".join(unescape(x).split())) for x in node.items if type(x) is str)
        node.chars, node.tags = own, 0
        node.link_chars, node.link_tags = (own, 0) if linked else (0, 0)
        stack.extend((x, linked) for x in reversed(node.items) if type(x) is not str and not x.boiler)
    for node in reversed(order):
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + (node.name not in VOID)
            up.link_tags += node.link_tags + (node.name == "a")
    share = max(1, root.link_chars) / max(1, root.chars)
    for node in order:
        node.density = _density(node, share)
        node.total = 0.0
    for node in order:
        if node.parent is not None:
            node.parent.total += node.density
    for node in order:
        if not any(type(x) is not str and not x.boiler for x in node.items):
            node.total = node.density
    return order


def _density(node: Node, share: float) -> float:
    """Characters per tag times the logarithm of the plain share of characters and tags; a count of 0 stands for 1."""
    if not node.chars:
        return 0.0
    chars, tags = node.chars, max(1, node.tags)
    links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
    base = log(chars / max(1, chars - node.link_chars) * links + share * chars + e)
    return chars / tags * max(0.0, log(chars / links * tags / link_tags)) / log(base)


def content(root: Node) -> list[Node]:
    """The nodes whose subtrees are content, in page order; none lies inside another."""
    order = measure(root)
    core = max(order, key=lambda x: x.total)
    if core.total <= 0:
        return [root] if root.chars else []
    threshold, x = core.density, core
    while x is not None:
        threshold = min(threshold, x.density)
        x = x.parent
    best: dict[int, Node] = {}
    for node in reversed(order):  # children come before their parents
        mine = best.get(id(node))
        if mine is None or node.total >= mine.total:
            mine = best[id(node)] = node
        up = node.parent
        if up is not None and ((other := best.get(id(up))) is None or mine.total >= other.total):
            best[id(up)] = mine
    marked = {id(best[id(node)]) for node in order if node.density >= threshold and node.chars} | {id(x) for x in _whole(core)}
    out, covered = [], set()
    for node in order:
        if node.parent is not None and id(node.parent) in covered:
            covered.add(id(node))
        elif id(node) in marked:
            covered.add(id(node))
            out.append(node)
    return out


def _mostly_links(node: Node) -> bool:
    return node.link_tags + (node.name == "a") > 1 and node.link_chars * 2 > node.chars


def _whole(core: Node) -> list[Node]:
    """The article or main around the core and the articles beside it, else the body without blocks of links."""
    path, x = [], core
    while x is not None:
        path.append(x)
        x = x.parent
    around = [x for x in path if x.name in ("article", "main")]
    if around:
        return [around[-1], *(x for x in around[-1].parent.items if type(x) is not str and x.name == "article" and not x.boiler and not _mostly_links(x))]
    held = set(map(id, path))
    for node in path[1:]:
        for x in node.items:
            if type(x) is not str and id(x) not in held and not x.boiler and x.name in BLOCKS and _mostly_links(x):
                x.boiler = True
    return [path[-1]]


def text_of(nodes: list[Node]) -> str:
    """The blocks of the nodes, boilerplate left out."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        block = " ".join(unescape("".join(run)).split())
        if block:
            blocks.append(block)
        run.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        flush()
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif type(x) is str:
                run.append(x)
            elif x.name == "br":
                run.append(" ")
            elif not x.boiler or x is top:
                if x.name in BLOCKS:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.items))
        flush()
    return "\n".join(blocks)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return text_of(content(parse(html)))


ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns, or all) with the main ``text`` and its ``n_chars`` code points."""
    workers_can_import(df.sparkSession)

    def make():
        def compute(column: pa.Array) -> list[pa.Array]:
            out = [main_text(x) for x in texts(column)]
            return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

        return compute

    return with_columns(df, html_col, ADDED, make, keep)
