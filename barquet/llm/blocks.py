"""A page as a sequence of leaf blocks: the text between block-level tags, with its tag path."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Attributes of a tag: no bare "<", so an unfinished tag ends at the next one and a broken page takes no longer
#: than a sound one.
_INSIDE = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|textarea)(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^<>]*+>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_INSIDE})>"
    r"|<[!?][^<>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
SPLIT = re.compile(r"[^a-z]+")
# Element names of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - frozenset("button caption label legend option optgroup tbody td tfoot th thead tr".split())
#: An opening tag of the key ends an open element of the value, up to the nearest of its containers.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
P_SCOPE = frozenset("html body article section main div table td th button li blockquote aside nav header footer form".split())
NOT_SHOWN = frozenset("head title".split())
#: Shown in place of their content, or not at all: what lies between their tags is no text of the page.
EMBEDDED = frozenset("noscript template svg iframe select canvas object".split())


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    links: float


def steps(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    out = [tag]
    if attributes:
        for m in NAMES.finditer(attributes):
            out += [f".{w}" for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]
        if HIDDEN.search(attributes):
            out.append(".hidden")
    return tuple(out)


def closed(tokens: list[re.Match[str]]) -> set[int]:
    """Places of the embedded elements' start tags that have an end tag of their own."""
    found: set[int] = set()
    open_: dict[str, list[int]] = {}
    for m in tokens:
        tag = m[3].lower() if m[3] else ""
        if tag in EMBEDDED:
            if not m[2]:
                if not m[4].endswith("/"):
                    open_.setdefault(tag, []).append(m.start())
            elif open_.get(tag):
                found.add(open_[tag].pop())
    return found


#: Elements of a block's path that count: so many outermost and innermost ones.
ENDS = 64


class _Stack:
    """Open elements, and for each name where it is open, so that no search walks down the stack."""

    def __init__(self) -> None:
        self.items: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, tag: str, own: tuple[str, ...]) -> None:
        place = len(self.items)
        self.items.append((tag, own))
        self.at.setdefault(tag, []).append(place)
        if tag in P_SCOPE:
            self.scopes.append(place)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of one of the names, -1 if there is none."""
        return max((found[-1] for t in tags if (found := self.at.get(t))), default=-1)

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1

    def cut(self, to: int) -> list[str]:
        """Close the elements from ``to`` on; their names."""
        gone = [tag for tag, _ in self.items[to:]]
        for tag in gone:
            self.at[tag].pop()
        del self.items[to:]
        while self.scopes and self.scopes[-1] >= to:
            self.scopes.pop()
        return gone

    def path(self) -> tuple[str, ...]:
        items = self.items if len(self.items) <= 2 * ENDS else self.items[:ENDS] + self.items[-ENDS:]
        return tuple(s for _, own in items for s in own)


def parse(page: str) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments, form fields and the head have none.

    An embedded element hides what is inside it; one without an end tag, or empty (``/>``), hides nothing.
    The work grows with the page's length, however its tags are nested or broken.
    """
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    in_link = 0
    hidden = 0
    cover = -1  # place of the outermost embedded element on the stack

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not hidden:
                blocks.append(Block(text, stack.path(), min(1.0, linked / max(1, sum(map(len, parts))))))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal in_link, hidden, cover
        for tag in stack.cut(to):
            in_link -= tag == "a"
            hidden -= tag in NOT_SHOWN
        if to <= cover:
            cover = -1

    at = 0
    tokens = list(TOKEN.finditer(page))
    ended = closed(tokens)
    for m in tokens:
        if m.start() > at and cover < 0:
            piece = page[at : m.start()]
            parts.append(piece)
            linked += len(piece) * (in_link > 0)
        at = m.end()
        if not m[3]:
            if m[1] and cover < 0:
                parts.append(" ")
            continue
        tag = m[3].lower()
        block = tag in BLOCK
        if m[2]:
            i = stack.last(tag)
            if i < 0:
                if tag == "p" and cover < 0:
                    flush()
            elif block or stack.scope() <= i:  # a stray inline end tag does not close its container
                if i < cover:
                    pop(cover)
                if cover < 0 and any(name in BLOCK for name, _ in stack.items[i:]):
                    flush()
                pop(i)
            continue
        if tag == "br":
            if cover < 0:
                parts.append(" ")
            continue
        if tag in EMBEDDED:
            if cover < 0:
                parts.append(" ")
            if m.start() in ended:
                stack.push(tag, steps(tag, m[4]))
                cover = len(stack.items) - 1 if cover < 0 else cover
            continue
        if block:
            if cover < 0:
                flush()
            if tag in SIBLINGS:
                ends, scope = SIBLINGS[tag]
                i = stack.last(*ends)
                if i > max(cover, stack.last(*scope)):
                    pop(i)
            if tag in CLOSES_P:
                i = stack.last("p")
                if i > cover and i > stack.scope():
                    pop(i)
        if tag in VOID or m[4].endswith("/") and not block:
            if tag == "img" and cover < 0:
                parts.append(" ")
            continue
        stack.push(tag, steps(tag, m[4]))
        in_link += tag == "a"
        hidden += tag in NOT_SHOWN
    if cover >= 0:
        pop(cover)
    elif at < len(page):
        parts.append(page[at:])
    flush()
    return blocks
