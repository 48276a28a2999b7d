"""Main text of web pages by composite text density.

A forgiving tree is built from the whole page; subtrees that name themselves as boilerplate go.
Every node gets a link-adjusted number of characters per tag; the subtree with the greatest sum of
its children's densities is the core of the article, and what lies beside it joins in if its
density reaches the least on the path from the core up to the body.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomfold.llm.common import map_columns

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)(?:>|$)|</?[a-zA-Z][^>]*>?""", re.DOTALL)
_HINT = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)

#: Fixed values of the HTML standard: tags without content, tags whose content is no markup, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
                  "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes the nearest open one of these, unless one of the walls stands between.
CLOSES = {t: frozenset({"p"}) for t in BLOCK - {"body", "html", "head", "td", "th", "tr", "caption", "option", "tbody", "thead", "tfoot"}}
CLOSES |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th"}),
           "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
WALLS = {"li": frozenset({"ul", "ol", "menu"}), "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"}), "tr": frozenset({"table"}),
         "dt": frozenset({"dl"}), "dd": frozenset({"dl"})}
_ANY_WALL = frozenset({"table", "td", "th", "article", "section", "div", "blockquote", "button", "figure", "main", "aside", "li", "body"})


@dataclass(frozen=True)
class HtmlRules:
    """Tags and name parts of subtrees that are no article text."""
    tags: frozenset = frozenset("nav footer aside form script style noscript template iframe svg canvas button select textarea input object embed audio video "
                                "dialog menu head title xmp noembed noframes map math".split())
    words: frozenset = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                                 "notices alert sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment "
                                 "comments comment-list disqus replies respond related recommended recommendations share sharing social newsletter subscribe "
                                 "subscription signup login popup modal overlay widget widgets pagination pager search skip".split())
    roles: frozenset = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
    homes: frozenset = frozenset({"article", "main"})


class _Node:
    __slots__ = ("tag", "parts", "parent", "drop", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag, parent, drop, inside=False):
        self.tag, self.parent, self.drop, self.inside, self.parts = tag, parent, drop, inside, []


def _is_boilerplate(tag: str, attributes: str, inside: bool, rules: HtmlRules) -> bool:
    """Whether a subtree names itself as no article text; ``inside`` an article a header is its title's place."""
    if tag in rules.tags:
        return True
    if tag == "header" and not inside:
        return True
    if tag in rules.homes or tag in ("body", "html") or not attributes:
        return False
    for m in _HINT.finditer(attributes):
        name, value = m.group(1).lower(), html.unescape((m.group(2) or "").strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in rules.roles:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = {word, *re.split(r"[-_:]+", word)} - ({"header"} if inside else set())
                if not rules.words.isdisjoint(parts):
                    return True
    return False


def parse(page: str, rules: HtmlRules) -> _Node:
    """The page's tree; text parts stay undecoded strings beside child nodes."""
    root = _Node("html", None, False)
    open_, at, n = root, 0, len(page)
    pos, within = 0, Counter()                                                # how many elements of a tag are open

    def close_to(node: _Node) -> _Node:
        """Leave the open elements below ``node``'s parent."""
        x = open_
        while x is not node.parent:
            within[x.tag] -= 1
            x = x.parent
        return x

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > pos:
            open_.parts.append(page[pos:m.start()])
        at = pos = max(m.end(), m.start() + 1)
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            node = open_
            while within[tag] and node.tag != tag:                            # nothing to look for unless one is open
                node = node.parent
            if within[tag]:
                open_ = close_to(node)
            continue
        if tag in ("html", "body", "head") and tag == "html":
            continue
        closes = CLOSES.get(tag)
        left = sum(within[t] for t in closes) if closes else 0                # open ones that it may close
        if left:
            walls = WALLS.get(tag, _ANY_WALL)
            node, last = open_, None
            stops = walls - closes
            while left and node.tag not in stops:
                if node.tag in closes:
                    last, left = node, left - 1
                node = node.parent
            if last is not None:
                open_ = close_to(last)
        if tag == "body" and open_.tag == "head":
            open_ = close_to(open_)
        inside = open_.inside or open_.tag in rules.homes
        node = _Node(tag, open_, open_.drop or _is_boilerplate(tag, m.group(3) or "", inside, rules), inside)
        open_.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = pos = close.end() if close else n
        elif tag not in VOID and not m.group(4):
            open_ = node
            within[tag] += 1
    if pos < n:
        open_.parts.append(page[pos:])
    return root


def _measure(root: _Node) -> list[_Node]:
    """Counts and densities from the leaves up; the kept nodes in document order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, _Node) and not x.drop]
    for node in reversed(order):
        children = [x for x in node.parts if isinstance(x, _Node) and not x.drop]
        own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        link = node.tag == "a"
        node.chars = own + sum(c.chars for c in children)
        node.tags = len(children) + sum(c.tags for c in children)
        node.link_chars = node.chars if link else sum(c.link_chars for c in children)
        node.link_tags = node.tags + 1 if link else sum(c.link_tags for c in children)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        if not node.chars:
            node.density = 0.0
        else:
            plain = node.chars - node.link_chars
            base = math.log(node.chars * node.link_chars / max(plain, 1) + share * node.chars + math.e)
            node.density = node.chars / max(node.tags, 1) * math.log(node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1) + 1) / base
        node.total = sum(x.density for x in node.parts if isinstance(x, _Node) and not x.drop)
    return order


def _blocks(node: _Node, out: list[list[str]]) -> None:
    """Inline text of the subtree, cut into blocks (iterative: trees may be very deep)."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.drop:
            if x.tag in ("br", "wbr"):
                out[-1].append(" " if x.tag == "br" else "")
                continue
            block = x.tag in BLOCK
            if block:
                out.append([])
                stack.append(None)
            stack += reversed(x.parts)


def main_text(page: str, rules: HtmlRules = HtmlRules()) -> str:
    root = parse(page, rules)
    order = _measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        return ""
    core, node = body, body
    for node in order:
        if node.total > core.total:
            core = node
    home, node = core, core
    while node is not None:                                                   # an article's own element holds all of it
        if node.tag in rules.homes:
            home = node
        node = node.parent
    core = home
    least, node = math.inf, core
    while node is not None and node is not body and node.tag != "html":
        least, node = min(least, node.density), node.parent
    out: list[list[str]] = [[]]
    if core is body or core is root:
        _blocks(core, out)
    else:
        on_path, node = set(), core.parent
        while node is not None:
            on_path.add(id(node))
            node = node.parent
        stack: list = [root]
        while stack:                                                          # in document order
            node = stack.pop()
            if node is core or (id(node) not in on_path and node.density >= least and not (home.tag in rules.homes)):
                out.append([])
                _blocks(node, out)
                out.append([])
            elif id(node) in on_path or not home.tag in rules.homes and node.tag not in ("a",):
                stack += [x for x in reversed(node.parts) if isinstance(x, _Node) and not x.drop]
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in out)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, rules: HtmlRules = HtmlRules(), html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) and ``main_text`` of every row.

    A null or empty page has an empty text, as has one with nothing but boilerplate; text without
    any tag is all article.  Repeated rows are read each; an empty table gives an empty one.
    """
    wanted = pages.columns if keep is None else keep
    names = {c: f"_c{i}" for i, c in enumerate(wanted)}
    source = pages.select(*[pages[c].alias(n) for c, n in names.items()], F.coalesce(pages[html_column].cast("binary"), F.lit(b"")).alias("_bytes"))

    def make():
        return lambda batch: {"_main": [main_text(p.decode("utf-8", "replace"), rules) for p in batch.column("_bytes").to_pylist()]}

    found = map_columns(source, "_main string", make, list(names.values()))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_main").alias("main_text"))
