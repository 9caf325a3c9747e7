"""Leaves of an HTML page: blocks of text with the path of tags above them, in page order."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

#: A tag up to its name; the rest of an opening or end tag: attributes, of which quoted ones may hold a >.
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN, QUOTED = re.compile(r"[^>\"']*"), re.compile(r"[\"']")
#: A whole tag without < in it, as nearly all are: what doesn't match is left at the next <.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")
#: Elements whose text is no markup.
RAW_END = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}


class Tokens:
    """A page's tokens, in order, as (start, end, tag, whether closing, attributes): the tag is in lower case, and empty for a comment, a
    declaration, a script or a style. Scripts, styles and comments run to the page's end if they have no end; nothing else is left out here.

    Every search begins behind the one before, or is remembered to be in vain, so that the time is in proportion to the page
    whatever is in it.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.none: set[str] = set()  # what doesn't occur any more behind the cursor

    def find(self, what: str, at: int) -> int:
        """Where ``what`` is next, or -1."""
        if what in self.none:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def end_of_tag(self, at: int) -> int:
        """Where the > of a tag is whose attributes begin at ``at``. A quote without its end is a character like others, and so are all quotes
        in a tag that they would not let end."""
        k = at
        while True:
            k = PLAIN.match(self.page, k).end()
            if k >= len(self.page):
                break
            if self.page[k] == ">":
                return k
            close = self.find(self.page[k], k + 1)
            if close < 0:
                break
            k = close + 1
        return self.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        page, at, n = self.page, 0, len(self.page)
        follow = True  # until quotes were followed to the page's end in vain, which isn't done twice
        whole, find, none = TAG.match, page.find, self.none
        while True:
            at = find("<", at) if not none else self.find("<!--" if ">" in none else "<", at)
            if at < 0:
                return
            if (m := whole(page, at)) and (tag := m[2].lower()) not in RAW_END:
                end = m.end()
                yield at, end, tag, m[1] != "", m[3]
                at = end
                continue
            if page.startswith("<!--", at):
                k = self.find("-->", at + 4)
                k = n if k < 0 else k + 3
                yield at, k, "", False, ""
                at = k
                continue
            m = m or NAME.match(page, at)
            if not m:
                k = self.find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") else -1
                if k >= 0:
                    yield at, k + 1, "", False, ""
                at = max(at, k) + 1
                continue
            tag, first = m[2].lower(), m.end(2)
            raw = tag in RAW_END and not m[1]
            k = m.end() - 1 if m.re is TAG else self.find(">", first)
            if k < 0:
                if raw:  # the page ends in its opening tag
                    yield at, n, "", False, ""
                    return
                at = first
                continue
            if m.re is NAME and not raw and follow:
                plain, k = k, self.end_of_tag(first)
                follow = k != plain or PLAIN.match(page, first).end() == k
            attrs = page[first:k]
            if raw and not attrs.endswith("/"):
                end = None if tag in self.none else RAW_END[tag].search(page, k + 1)
                if end is None:
                    self.none.add(tag)
                k = end.end() if end else n
                yield at, k, "", False, ""
                at = k
                continue
            yield at, k + 1, "" if raw else tag, bool(m[1]), attrs
            at = k + 1


ATTR = re.compile(r"\b(class|id|role|href|name|content)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")

#: Tags that stand inside a line of text; every other tag bounds a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object".split()) | frozenset(
    "svg g defs symbol use path circle rect line polygon polyline ellipse text tspan math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation".split()
)
#: Tags that may stand in a head; any other opening tag, or text, ends one that is open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open one of these, up to the nearest tag that holds such a list.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}}
BLOCKS_END_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


class Node:
    """A tag of a page and those above it: one step each, so that a page of any depth takes memory by its tags."""

    __slots__ = ("depth", "hidden", "own", "parent", "vector")

    def __init__(self, parent: Node | None, own: str) -> None:
        self.parent, self.own = parent, own  # the tag with its class and id words: "div.ad.box"
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = bool(parent and (parent.hidden or own == "head" or own.startswith(("head.", "title"))))
        self.vector = None  # kept here by whoever reads the path


class Leaf(NamedTuple):
    path: Node  # the innermost tag that isn't inline
    text: str
    linked: int  # characters of the text inside links


class Page(NamedTuple):
    leaves: list[Leaf]
    title: str
    links: list[str]
    metas: list[tuple[str, str]]


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)} if "=" in raw else {}


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


def parsed(page: str | None) -> Page:
    """The leaves of a page, its title, the targets of its links and its named meta entries.

    Markup errors never stop it: an end tag without its opening is skipped, an element without an end
    goes on to its parent's. Comments, scripts and styles are no text. Two line breaks with nothing between them
    bound a block, one is white space.
    """
    page = page or ""
    leaves: list[Leaf] = []
    links, metas, title = [], [], ""
    root = Node(None, "")
    stack: list[tuple[str, Node]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where each tag is on the stack, so that it needn't be searched
    blocks: list[int] = []  # where the tags are that aren't inline
    buffer: list[str] = []
    linked = in_link = at = 0
    broken = -1  # where the text behind the last line break of the block begins in the buffer

    def flush() -> None:
        nonlocal linked, broken
        broken = -1
        if buffer:
            text = tidy("".join(buffer))
            if text:
                leaves.append(Leaf(stack[-1][1] if stack else root, text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close_to(k: int) -> None:
        nonlocal in_link
        while len(stack) > k:
            t, _ = stack.pop()
            places[t].pop()
            in_link -= t == "a"
        while blocks and blocks[-1] >= k:
            blocks.pop()

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def end_head() -> None:
        flush()
        close_to(places["head"][0])

    for start, end, tag, closing, attrs in Tokens(page):
        if start > at:
            piece = page[at:start]
            if stack and stack[-1][0] == "head" and not piece.isspace():
                end_head()
            buffer.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if closing:
            k = last({tag})
            if tag in INLINE:
                if k >= 0 and (not blocks or k > blocks[-1]):
                    close_to(k)
                continue
            if tag == "title" and buffer:
                title = title or tidy("".join(buffer))
            if k >= 0:
                flush()
                close_to(k)
            continue
        if places["head"] and not places["title"] and tag not in IN_HEAD and tag != "head":
            end_head()
        own = attributes(attrs)
        if tag == "br":
            if broken >= 0 and not html.unescape("".join(buffer[broken:])).strip():
                flush()
            else:
                buffer.append(" ")
                broken = len(buffer)
            continue
        if tag == "meta":
            if own.get("name"):
                metas.append((own["name"], own.get("content", "")))
            continue
        if tag == "a" and own.get("href"):
            links.append(own["href"])
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS_END_P else set())
            k = last(ends)
            if k > last(BOUNDS.get(tag, set())) and ("p" not in ends or blocks[-1] <= k):
                close_to(k)
        if not attrs.endswith("/"):
            node = stack[-1][1] if stack else root
            if tag not in INLINE:
                words = WORDS.findall(f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".lower())
                node = Node(node, ".".join([tag, *words]))
                blocks.append(len(stack))
            places[tag].append(len(stack))
            stack.append((tag, node))
            in_link += tag == "a"
    if at < len(page):
        if stack and stack[-1][0] == "head" and not page[at:].isspace():
            end_head()
        buffer.append(page[at:])
    flush()
    return Page([x for x in leaves if not x.path.hidden], title, links, metas)
