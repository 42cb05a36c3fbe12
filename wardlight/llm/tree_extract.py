"""Main text of HTML pages by tree scoring.

Every paragraph earns points for its length and its commas and passes them to its ancestors, less with every level; an element's points are
discounted by the share of its text that lies in links. The best container and those of its siblings that look like text are kept; what is navigation, advertising,
a form, a script, a notice or a reader's comment by its tag, role or class earns nothing and is left out wherever it stands; save articles, and forms and elements with such a class that hold most of the page's text.
An article's own header, lists of links and tables are its text; of several articles all that hold prose are kept, and a page's first heading before the container is kept where the container has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from wardlight.llm.common import slices

#: Fixed values of HTML: elements without content, elements that are blocks of their own, and what starting one element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES = {
    **{t: ("p",) for t in BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr"} | {"aside", "footer", "form", "header", "nav", "menu"}},
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: An implied close does not reach beyond these.
SCOPES = frozenset("html body table td th ul ol dl article section main div aside header footer nav form figure button".split())
#: What is never main text: by tag, by ARIA role, by a word of the class or id.
DROPPED = frozenset("aside button canvas dialog embed footer form head header iframe input label menu nav noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adbox adslot advert advertisement adverts advertorial banner billboard breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright "
    "disclaimer discussion disqus donate footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup "
    "privacy promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: A class that begins with one of these says something of the element, not what it is ("has-sidebar", "category-privacy"); one with a preposition is a title ("comments-on-policy").
UNNAMED = frozenset("has no with without after before category tag tagged topic type format is".split())
PREPOSITIONS = frozenset("on of about for to in from at".split())
#: Words for a part of an element: a name's head is the last other word.
PART_WORDS = frozenset("area bar block body bottom box button buttons column container content group header heading holder inner item items left link links list main outer panel region right row section slot title top unit wrap wrapper".split())
#: A single paragraph, heading or cell is left out by these names alone.
ADVERTS = frozenset("ad ads adslot advert advertisement adverts advertorial promo promotion sponsor sponsored".split())
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption span b i em strong".split())
#: A header with one of these in its class is that of the text.
TITLED = frozenset("article content entry page post story title".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ARTICLES = ("article", "main")
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Points of a paragraph: one, one a comma, one for each so many characters up to a limit; a shorter one than FULL gets its share of one.
PER_POINT, MOST_POINTS, FULL = 100, 3.0, 25
#: Points that an <article> or <main> starts with.
MARKED = 25.0
#: A sibling of the best container joins it from this share of its points on, or as a long paragraph with few links.
SIBLING_SHARE, LONG_PARAGRAPH, FEW_LINKS = 0.2, 80, 0.25
#: A list or table with more of its text in links than this is navigation.
MOSTLY_LINKS = 0.5
#: A form or an article with a name in NAMES stays from this share of the page's text outside links on, another named element from the second.
MOST_TEXT, NEARLY_ALL = 0.5, 0.75
#: Levels up to which points are divided by three times the level; what passes further up is halved at each.
DEEP = 32


class Node:
    __slots__ = ("children", "doubtful", "dropped", "links", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped, self.doubtful = tag, parent, dropped, False
        self.children: list[Node | str] = []
        self.size = self.links = 0
        self.score = MARKED if tag in ARTICLES else 0.0

    def density(self) -> float:
        return self.links / self.size if self.size else 0.0


def head_words(value: str) -> list[str]:
    """What the names in a class or id say that an element is: the last word of each that isn't a word for a part."""
    heads = []
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not words or words[0] in UNNAMED or PREPOSITIONS.intersection(words):
            continue
        rest = [w for w in words if w not in PART_WORDS] or words
        heads.append(rest[-1])
    return heads


def is_dropped(tag: str, attrs: list[tuple[str, str | None]], in_article: bool = False) -> bool:
    """Whether an element is left out whatever it holds."""
    if tag == "header":
        named = " ".join(value for name, value in attrs if name in ("class", "id") and value)
        if in_article or TITLED.intersection(w.lower() for w in WORDS.findall(named)):
            return False
    if tag in DROPPED and tag != "form":
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES and value != "form":
            return True
        if name == "style" and value and HIDDEN.search(value):
            return True
    return False


def is_doubtful(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is left out unless it holds most of the page: a form, or one with a name in NAMES."""
    if tag == "form":
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "role" and value == "form":
            return True
        if name in ("class", "id") and value:
            if any(w in (ADVERTS if tag in SINGLE else NAMES) for w in head_words(value)):
                return True
    return False


class Tree(HTMLParser):
    """The elements of a page, with the ends that HTML lets authors leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open: dict[str, int] = {}
        self.nodes = [self.root]

    def _close_to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and (tag == "html" or self.open.get("body")):
            return
        if tag == "body" and self.open.get("head"):
            self._close_to(self.root)
        for ended in CLOSES.get(tag, ()):
            if self.open.get(ended):
                node = self.at
                while node.tag != ended and node.tag not in SCOPES:
                    node = node.parent
                if node.tag == ended:
                    self._close_to(node.parent)
        node = Node(tag, self.at, self.at.dropped or is_dropped(tag, attrs, bool(self.open.get("article") or self.open.get("main"))))
        node.doubtful = not node.dropped and is_doubtful(tag, attrs)
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent:
            self._close_to(self.at.parent)

    def handle_endtag(self, tag):
        if not self.open.get(tag) or tag in ("html", "body"):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._close_to(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)


def settle(nodes: list[Node]) -> None:
    """Drop the doubtful elements that don't hold the page's main text; nodes: all elements, each before what it holds.

    One stays that holds most of the text, unless an article or main element without such a name stands elsewhere; a named article stays too where no other article does. Whether one element holds another follows from their
    places in the page, so a page takes time in proportion to its length.
    """
    if not any(n.doubtful for n in nodes):
        return
    weight: dict[Node, int] = {}
    place = {node: i for i, node in enumerate(nodes)}
    past = list(range(1, len(nodes) + 1))  # the place after the last element that each holds
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.parent:
            up = place[node.parent]
            past[up] = max(past[up], past[i])
        if not node.dropped and node.tag != "a":
            weight[node] = sum(len(c) - c.count(" ") if isinstance(c, str) else weight.get(c, 0) for c in node.children)
    whole = weight[nodes[0]]
    marked = [n.tag in ARTICLES and not n.doubtful and bool(weight.get(n)) for n in nodes]
    # how many marked elements, and marked articles, stand before each place
    upto, articles = [0], [0]
    for node, is_marked in zip(nodes, marked, strict=True):
        upto.append(upto[-1] + is_marked)
        articles.append(articles[-1] + (is_marked and node.tag == "article"))
    before = 0  # marked elements before the place that are not dropped
    around = [0] * len(nodes)  # those of them that hold the element
    for i, node in enumerate(nodes):
        if node.parent:
            up = place[node.parent]
            around[i] = around[up] + (marked[up] and not nodes[up].dropped)
        if node.parent and node.parent.dropped:
            node.dropped = True
        elif node.doubtful:
            share = weight.get(node, 0) / whole if whole else 0.0
            rivals = before - around[i] + upto[-1] - upto[past[i]]
            alone = node.tag == "article" and articles[-1] == articles[past[i]] - articles[i]
            most = MOST_TEXT if node.tag in ("form", "article") else NEARLY_ALL
            node.dropped = not (alone or share > most and not rivals)
        before += marked[i] and not node.dropped


def in_order(root: Node) -> list[Node]:
    """Elements that aren't dropped, each before what it holds."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            found.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def own_text(node: Node) -> str:
    """Text of an element outside its block elements."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag == "br":
            parts.append(" ")
        elif not c.dropped and c.tag not in BLOCKS:
            if c.tag in ("td", "th"):
                parts.append(" ")
            stack.extend(reversed(c.children))
    return " ".join("".join(parts).split())


def score(nodes: list[Node]) -> None:
    for node in reversed(nodes):  # what an element holds comes before it
        for c in node.children:
            if isinstance(c, str):
                n = len(c) - c.count(" ")
                node.size += n
                node.links += n if node.tag == "a" else 0
            elif not c.dropped:
                node.size += c.size
                node.links += c.size if node.tag == "a" else c.links
    far: dict[Node, float] = {}
    for node in nodes:
        if node.tag not in PARAGRAPHS or not (text := own_text(node)):
            continue
        if len(text) >= FULL:
            points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / PER_POINT, MOST_POINTS)
        else:
            points = len(text) / FULL
        points *= 1 - node.density()
        up, level = (node.parent if node.tag in ("p", "pre", "td", "li", "dd", "blockquote") else node), 0
        while up and level < DEEP:
            up.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
            up, level = up.parent, level + 1
        if up:
            far[up] = far.get(up, 0.0) + points / (3 * DEEP)
    for node in reversed(nodes) if far else ():  # what reaches an element from further below is halved at each level above
        if points := far.pop(node, 0.0):
            node.score += points
            if node.parent:
                far[node.parent] = far.get(node.parent, 0.0) + points / 2


def kept_parts(nodes: list[Node]) -> list[Node]:
    """The best container with the siblings that belong to it, in page order."""
    holders = [n for n in nodes if n.tag not in ("p", "a", "li", "ul", "ol", "tr", "span", "b", "i", "em", "strong") and n.size]
    if not holders:
        return [nodes[0]]
    best = max(holders, key=lambda n: n.score * (1 - n.density()))
    up = best
    while up:  # the whole of the article that it stands in
        if up.tag in ARTICLES:
            best = up
            break
        up = up.parent
    if best.tag == "article":
        up = best.parent
        while up:  # an article in an article is part of it
            best, up = up if up.tag == "article" else best, up.parent
        prose = lambda n: (n.score - MARKED) * (1 - n.density())
        inner = held(nodes, [n for n in nodes if n.tag == "article"])
        top = [n for n in nodes if n.tag == "article" and n.parent not in inner]
        return headed(nodes, [n for n in top if n is best or prose(n) >= SIBLING_SHARE * prose(best) and n.density() < MOSTLY_LINKS])
    if best.tag in ARTICLES or not best.parent:
        around = [best]
    else:
        around = [c for c in best.parent.children if isinstance(c, Node) and not c.dropped]
    least = SIBLING_SHARE * best.score * (1 - best.density())
    parts = []
    for node in around:
        text_like = node.tag in ("p", "pre", "blockquote") and node.size >= LONG_PARAGRAPH and node.density() < FEW_LINKS
        heading = node.tag in HEADINGS and node.density() < FEW_LINKS
        if node is best or text_like or heading or node.score * (1 - node.density()) >= max(least, 1e-9) and node.tag in PARAGRAPHS:
            parts.append(node)
    return headed(nodes, parts)


def held(nodes: list[Node], outer: list[Node]) -> set[Node]:
    """The outer elements and all that stand in them; nodes: each before what it holds."""
    found = set(outer)
    for node in nodes:
        if node.parent in found:
            found.add(node)
    return found


def headed(nodes: list[Node], parts: list[Node]) -> list[Node]:
    """The parts with the last first-level heading before them, where they hold none."""
    if any(n.tag == "h1" for n in held(nodes, parts)):
        return parts
    before: list[Node] = []
    for node in nodes:
        if node is parts[0]:
            break
        if node.tag == "h1" and node.size and node.density() < MOSTLY_LINKS:
            before = [node]
    return before + parts


def blocks(nodes: list[Node], parts: list[Node]) -> list[str]:
    """Text blocks of the parts in page order."""
    in_articles = held(nodes, [n for n in nodes if n.tag == "article"])
    found, run = [], []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            found.append(text)
        run.clear()

    for part in parts:
        whole = part in in_articles  # an article's lists are its text
        stack: list[Node | str | None] = [part]
        while stack:
            c = stack.pop()
            if c is None:
                end()
            elif isinstance(c, str):
                run.append(c)
            elif c.tag == "br":
                run.append(" ")
            elif not c.dropped and not (not whole and c.tag in ("ul", "ol", "table", "dl") and c.density() > MOSTLY_LINKS):
                if c.tag in BLOCKS:
                    end()
                    stack.append(None)
                elif c.tag in ("td", "th"):
                    run.append(" ")
                stack.extend(reversed(c.children))
        end()
    return found


def main_text(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    settle(tree.nodes)
    nodes = in_order(tree.root)
    score(nodes)
    return "\n\n".join(blocks(nodes, kept_parts(nodes)))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, text and n_chars (its code points) for every row of pages.

    A null or empty page, or one without main text, has an empty text. Every page is read whole and by itself: repeated rows give repeated results, broken markup is read as
    browsers do as far as ends of elements go, an empty table gives no rows.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            found = [main_text(h or "") for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(texts, f"{kinds}, text string, n_chars long")
