"""Main text of web pages by tree scoring.

Each text block gives points to its ancestors: one, one for each comma, and one for each hundred
characters up to three; the parent gets them whole, the grandparent half, and further ancestors a
share that falls with the distance, up to the ``REACH``-th. A container's points are discounted by its link density. The
best container is kept, with those siblings that score well beside it or are plain paragraphs.

Reading and scoring take time in proportion to the page, however its tags are nested or broken: what an end tag
may close is looked up, and characters are summed once on the way up.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements whose content is never part of an article.
DROPPED = frozenset("head script style template noscript nav header footer aside form button select option textarea input iframe object embed svg canvas menu dialog title xmp noembed noframes audio video map".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body article main section div td blockquote center figure".split())
#: Class and id words of page furniture and of reader comments.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|breadcrumbs?|combx|comments?|commentlist|comment-?section|disqus|community|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|footer|header|masthead|menu|menubar|nav|navbar|navigation|topbar|toolbar|pager|pagination|related|recommended|recommendations|remark|replies|respond|rss|share|sharing|shoutbox|sidebar|side-?bar|skip|social|supplemental|tags|toc|widget)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|post|story|text)(?:$|[\s_-])", re.I)
#: Ancestors that a block gives points to; the share of those further out would be below a hundredth.
REACH = 32
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Start tags that end an open paragraph.
_ENDS_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_SCOPE = frozenset("table td th button object html body".split())

_GROUPS = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3, "option": 4}
#: For each group the tags at which the search for an open one of its kind ends.
_ENDS_GROUP = [frozenset().union(*(_SAME[t] | _STOPS[t] for t, g in _GROUPS.items() if g == n)) for n in range(5)]
_ANY_GROUP = frozenset().union(*_ENDS_GROUP)
#: End tags that look past the scope they stand in.
_FREE_ENDS = frozenset("table tr tbody thead tfoot html body article main section div object button".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    """An element. ``open_p``: the open paragraph that a block start tag here would end; ``near``: by group, the open element at which the search for one to close ends."""

    __slots__ = ("tag", "parent", "children", "attrs", "score", "drop", "open_p", "near", "scope", "scoped", "chars", "links", "kept")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.score = 0.0
        self.drop = tag in DROPPED
        self.chars = self.links = 0
        self.kept = False
        if parent is None:
            self.open_p, self.near, self.scope, self.scoped = None, (self,) * 5, {}, self
            return
        self.open_p = self if tag == "p" else None if tag in BLOCKS or tag in _SCOPE else parent.open_p
        self.near = tuple(self if tag in ends else n for ends, n in zip(_ENDS_GROUP, parent.near, strict=True)) if tag in _ANY_GROUP else parent.near
        # open elements by tag since the innermost scope began, and the element that began it
        self.scope, self.scoped = ({}, self) if tag in _SCOPE else (parent.scope, parent.scoped)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)}


def _furniture(node: Node) -> bool:
    if not node.attrs or node.attrs.isspace():
        return False
    a = _attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and bool(re.search(r"(?:^|[\s_-])(?:comments?|related|promo|ads?|teaser)(?:$|[\s_-])", names, re.I))
    return bool(UNLIKELY.search(names)) and not (LIKELY.search(a.get("class", "")) and not re.search(r"comment|sidebar|footer|nav|advert|cookie|related|share", names, re.I))


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


class _Tags:
    """Finds the ends of tags; what is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the start tag whose attributes begin at ``at``, outside quotes where they are closed; -1 if none."""
        if at > self.last:
            return -1
        i = at
        while self.quotes:
            m = _EDGE.search(self.page, i)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end())
            if close < 0 or close > self.last:
                self.quotes = False  # quotes don't match up: from here on they mean nothing
                break
            i = close + 1
        return self.page.find(">", at)


def parse(page: str) -> Node:
    """Element tree, lenient as browsers are: missing end tags are supplied, stray ones ignored."""
    root = here = Node("#root", None)
    everywhere: dict[str, int] = {}  # open elements by tag
    at, text, size, tags = 0, 0, len(page), _Tags(page)

    def close_to(node: Node) -> None:
        """Closes everything that is open inside ``node``."""
        nonlocal here
        while here is not node:
            everywhere[here.tag] -= 1
            if here.tag not in _SCOPE:
                here.scope[here.tag] -= 1
            here = here.parent

    while True:
        at = page.find("<", at)
        if at < 0:
            if text < size:
                here.children.append(page[text:])
            break
        c = page[at + 1 : at + 2]
        close = c == "/"
        m = _NAME.match(page, at + 1 + close)
        if m is None and c not in ("!", "?"):
            at += 1
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            stop = size if stop < 0 else stop + 3
        elif m is None or close:
            stop = page.find(">", at) + 1 if at < tags.last else 0
        else:
            stop = tags.end(m.end()) + 1
        if text < at:
            here.children.append(page[text:at])
        if not stop:  # a tag that never ends is no text
            break
        begin, at, text = at, stop, stop
        if m is None or page.startswith("<!", begin):
            continue
        tag = m[0].lower()
        if close:
            if tag == "br":
                here.children.append(Node("br", here))
            elif tag in ("td", "th"):
                if here.scoped.tag == tag:
                    close_to(here.scoped.parent)
            elif (everywhere if tag in _FREE_ENDS else here.scope).get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                close_to(node.parent)
            continue
        attrs = page[m.end() : stop - 1]
        if tag in _ENDS_P and here.open_p is not None:
            close_to(here.open_p.parent)
        if tag in HEADINGS and here.tag in HEADINGS:
            close_to(here.parent)
        if tag in _SAME:
            node = here.near[_GROUPS[tag]]
            while node is not root and node.tag in _SAME[tag] and node.tag not in _STOPS[tag]:
                node = node.parent
                close_to(node)
        child = Node(tag, here, attrs)
        here.children.append(child)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            if tag in ("title", "textarea"):
                child.children.append(page[at : end.start() if end else size])
            at = text = end.end() if end else size
            continue
        if tag == "plaintext":
            child.children.append(page[at:])
            break
        everywhere[tag] = everywhere.get(tag, 0) + 1
        if tag not in _SCOPE:
            child.scope[tag] = child.scope.get(tag, 0) + 1
        here = child
    return root


def _blocks(top: Node) -> list[tuple[Node, str, int, bool]]:
    """Text blocks in page order: nearest block element, text, characters in links, under a dropped element."""
    out: list[tuple[Node, str, int, bool]] = []
    parts: list[str] = []
    linked = [0]
    owner = [top]
    gone = [False]

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((owner[0], text, linked[0], gone[0]))
            parts.clear()
            linked[0] = 0

    # an explicit stack: (node, next child, inside a link, block element, dropped)
    stack = [[top, 0, False, top, top.drop]]
    while stack:
        frame = stack[-1]
        node, i, link, block, drop = frame
        if i >= len(node.children):
            stack.pop()
            if node.tag in BLOCKS:
                flush()
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            if not parts:
                owner[0], gone[0] = block, drop
            elif drop != gone[0]:
                flush()
                owner[0], gone[0] = block, drop
            parts.append(child)
            if link:
                linked[0] += len(child)
        elif child.tag == "br":
            flush()
        else:
            if child.tag in BLOCKS:
                flush()
            child.drop = child.drop or _furniture(child)
            stack.append([child, 0, link or child.tag == "a", child if child.tag in BLOCKS else block, drop or child.drop])
    flush()
    return out


def _nodes(root: Node) -> list[Node]:
    """Every element, parents before their children."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node)]
    return out


def extract(page: str | None) -> str:
    """Main text: blocks joined by one line feed, white space in a block made one space."""
    if not page:
        return ""
    root = parse(page)
    blocks = [b for b in _blocks(root) if not b[3]]
    if not blocks:
        return ""
    nodes = _nodes(root)
    for owner, text, linked, _ in blocks:
        owner.chars += len(text)
        owner.links += linked
        points = 0.0 if owner.tag in HEADINGS or len(text) < 25 else 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) // 100, 3)
        points *= 1 - min(linked / len(text), 1.0)
        node, distance = owner if owner.tag in CONTAINERS or owner.parent is None else owner.parent, 0
        while node is not None and points and distance <= REACH:
            node.score += points / (1 if distance == 0 else 2 if distance == 1 else 3 * distance)
            node, distance = node.parent, distance + 1
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.links += node.links

    def worth(n: Node) -> float:
        return n.score * (1 - min(n.links / max(n.chars, 1), 1.0))

    candidates = [n for n in nodes if n.chars and (n.tag in CONTAINERS or n.parent is None)]
    scored = [n for n in candidates if worth(n) > 0]
    if scored:
        best = max(scored, key=lambda n: (worth(n) * (1.25 if n.tag in ("article", "main") else 1.0), n.chars))
        node = best.parent
        while node is not None:  # an article element around the best container is the whole of it
            if node.tag in ("article", "main") and worth(node) > 0:
                best = node
            node = node.parent
    else:
        named = [n for n in candidates if n.tag in ("article", "main")]
        best = max(named or candidates, key=lambda n: n.chars)
    best.kept = True
    if best.parent is not None and best.tag not in ("article", "main", "body", "html"):
        least = max(10.0, worth(best) * 0.2)
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and sibling.chars and sibling is not best:
                density = sibling.links / sibling.chars
                if worth(sibling) >= least or (sibling.tag == "p" and density < 0.25 and sibling.chars > 80) or (sibling.tag in HEADINGS and density < 0.25):
                    sibling.kept = True
    for node in nodes[1:]:
        node.kept = node.kept or node.parent.kept
    return "\n".join(text for owner, text, _, _ in blocks if owner.kept)


def extract_column(page: Column) -> Column:
    return arrow_column("string", lambda: lambda pages: list(map(extract, pages)), page)


def main_text(df: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` columns, ``text`` and ``n_chars`` (code points) of every row.

    Null, empty or text-free pages have the empty text. Unclosed tags, comments and cut-off pages
    are read as far as they go. Nothing of the main text is dropped or capped. Repeated rows return
    repeated rows, an empty table none. Other columns are ignored. No shuffle.
    """
    out = df.select(*carry, extract_column(F.col(html_col)).alias("text"))
    return out.select(*carry, "text", F.length("text").cast("long").alias("n_chars"))
