"""One pass over a page's HTML: its anchors, iframes and script bodies.

A state machine moves from one ``<`` to the next: text, start tag, end tag, comment, declaration, raw text.
Attributes may be double-quoted, single-quoted, unquoted or without a value, in any order, with ``>`` inside
quotes; the first of a repeated name counts. Nothing in comments, scripts, styles or attribute values is a tag.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_END = re.compile(r"[\s/]*(>|$)")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in ("script", "style")}

# Fixed by the HTML standard: elements without an end tag, and elements whose start ends open ones up to a barrier.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tr": {"tr", "td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
        "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
BARRIER = frozenset("ul ol dl table select".split())
CELLS = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption body html".split())


def decode(s: str) -> str:
    """Character references resolved: numeric ones, and named ones that end with a semicolon."""
    return _REFERENCE.sub(lambda m: _html.unescape(m[0]), s) if "&" in s else s


def _start_tag(page: str, at: int, wanted: bool) -> tuple[dict[str, str], int, bool]:
    """(attributes, offset after the tag, whether it closes itself) of a start tag whose name ends at ``at``.

    A quote that is never closed is part of an unquoted value, so that the rest of the page is not lost."""
    close = page.find(">", at)
    if close < 0:
        return {}, len(page), False
    if not wanted and '"' not in (part := page[at:close]) and "'" not in part:
        return {}, close + 1, part.endswith("/")
    attributes: dict[str, str] = {}
    while True:
        end = _TAG_END.match(page, at)
        if end:
            return attributes, end.end(), "/" in end[0]
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if wanted:
            value = next((v for v in m.groups()[1:] if v is not None), "")
            attributes.setdefault(m[1].lower(), decode(value))


class _Anchor:
    """An anchor that is open: its text nodes are stripped and joined."""

    def __init__(self, pos: int, attributes: dict[str, str], depth: int) -> None:
        self.pos, self.attributes, self.depth = pos, attributes, depth
        self.done: list[str] = []
        self.node: list[str] = []

    def node_ends(self) -> None:
        if self.node:
            self.done.append(decode("".join(self.node)).strip())
            self.node = []

    def row(self) -> tuple:
        self.node_ends()
        return "a", self.pos, self.attributes.get("href"), "".join(self.done), self.attributes.get("data-file")


def page_items(page: str) -> Iterator[tuple[str, int, str | None, str | None, str | None]]:
    """(kind, position, url, text, data file) of a page; positions count from 1 within a kind.

    Kind ``a``: an anchor with its href (null if absent), the stripped texts inside it joined, and its data-file.
    Kind ``f``: an iframe's src. Kind ``s``: the body of a script. An anchor ends at its end tag; without one,
    at the next anchor, at the end tag of an element around it, where a list item, definition, option, cell or
    row around it ends by implication, or with the page.
    """
    stack: list[str] = []
    open_count: Counter = Counter()
    seen: Counter = Counter()
    anchor: _Anchor | None = None
    at, size = 0, len(page)

    def cut(depth: int) -> None:
        for name in stack[depth:]:
            open_count[name] -= 1
        del stack[depth:]

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if anchor and lt > at:
            anchor.node.append(page[at:lt])
        if lt == size:
            break
        nxt = page[lt + 1:lt + 2]
        ending = nxt == "/"
        if nxt in ("!", "?") or (ending and not ("a" <= page[lt + 2:lt + 3].lower() <= "z")):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2 if page.startswith("<!-->", lt) else lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            if anchor:
                anchor.node_ends()
            continue
        if not ending and not ("a" <= nxt.lower() <= "z"):
            if anchor:
                anchor.node.append("<")
            at = lt + 1
            continue
        m = _NAME.match(page, lt + 2 if ending else lt + 1)
        name = m[0].lower()
        attributes, at, closed = _start_tag(page, m.end(), name in ("a", "iframe") and not ending)
        if anchor:
            anchor.node_ends()
        depth = None
        if ending:
            if name == "a":
                if anchor:
                    yield anchor.row()
                    stack[anchor.depth] = ""
                    open_count["a"] -= 1
                    anchor = None
                continue
            if open_count[name] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] == name:
                        depth = i
                        break
                    if stack[i] in CELLS and name not in TABLE_PARTS:
                        break
        else:
            ends = ENDS.get(name)
            if ends and any(open_count[x] > 0 for x in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] in ends:
                        depth = i
                    elif stack[i] in BARRIER:
                        break
        if depth is not None:
            if anchor and anchor.depth >= depth:
                yield anchor.row()
                anchor = None
            cut(depth)
        if ending:
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            body = page[at:end.start() if end else size]
            at = end.start() if end else size
            if name == "script":
                seen["s"] += 1
                yield "s", seen["s"], body, None, None
            if end:
                at = _start_tag(page, end.end(), False)[1]
            continue
        if name == "iframe":
            seen["f"] += 1
            yield "f", seen["f"], attributes.get("src"), None, None
        elif name == "a":
            if anchor:
                yield anchor.row()
                stack[anchor.depth] = ""
                open_count["a"] -= 1
            seen["a"] += 1
            anchor = _Anchor(seen["a"], attributes, len(stack))
            if closed:
                yield anchor.row()
                anchor = None
        if name not in VOID and not closed:
            stack.append(name)
            open_count[name] += 1
    if anchor:
        yield anchor.row()
