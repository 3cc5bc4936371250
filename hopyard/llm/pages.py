"""Text events of a page by the standard library's parser."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple

#: What HTML defines.
HIDDEN = {"script", "style", "template", "noscript", "head", "title", "svg", "iframe", "object", "select", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BOXES = {"body", "div", "main", "article", "section", "aside", "nav", "header", "footer", "form", "center"}
#: Cells and divs without a name are boxes only once a block stands in them; before, they are lines of their parent.
LAZY = {"td", "th", "div"}
ASIDE = {"nav", "aside", "footer", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = BOXES | HEADINGS | {"p", "ul", "ol", "table", "blockquote", "dl", "pre"}
#: Opening one of these closes an open one of the same set that isn't shut off by a box.
CLOSES = {
    "p": {"p", *HEADINGS}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    **{x: {"p", *HEADINGS} for x in (*HEADINGS, "ul", "ol", "table", "blockquote", "dl", "pre", *BOXES)},
}


#: What a text stands in, as bits of ``Piece.kind``.
LINK, TITLE, HEADING = 1, 2, 4
_KINDS = {"a": LINK, "h1": TITLE | HEADING, "h2": TITLE | HEADING, **dict.fromkeys(("h3", "h4", "h5", "h6"), HEADING)}


class Box(NamedTuple):
    """A block container, or the page itself."""

    number: int
    tag: str
    mark: str
    parent: int


class Piece(NamedTuple):
    """One visible text on one line."""

    line: int
    text: str
    box: int
    kind: int


@dataclass(slots=True)
class Page:
    boxes: list[Box] = field(default_factory=lambda: [Box(0, "page", "", -1)])
    pieces: list[Piece] = field(default_factory=list)
    tags_on: dict[int, int] = field(default_factory=dict)


class _Reader(HTMLParser):
    """``open`` holds (tag, box, kind, hidden) of each open element, with what it takes over from those around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.open = Page(), [("page", 0, 0, False)]
        self.tags, self.pieces = self.page.tags_on, self.page.pieces

    def handle_starttag(self, tag: str, attrs: list) -> None:
        line = self.lineno
        self.tags[line] = self.tags.get(line, 0) + 1
        if tag in VOID:
            return
        opened = self.open
        shut = CLOSES.get(tag)
        if shut:
            while len(opened) > 1 and opened[-1][0] in shut:
                opened.pop()
        if tag == "body":
            while opened[-1][0] in HIDDEN:
                opened.pop()
        outer, box, kind, hidden = opened[-1]
        if tag in BLOCKS:
            mark = ""
            if tag in BOXES and attrs:
                own = dict(attrs)
                mark = f"{own.get('class') or ''} {own.get('id') or ''} {own.get('role') or ''}".strip().lower()
            named = tag in BOXES and (tag not in LAZY or bool(mark))
            if (named or tag != "div") and outer in LAZY and len(opened) > 1 and opened[-2][1] == box:
                box = self._box(outer, "", box)
                opened[-1] = (outer, box, kind, hidden)
            if named:
                box = self._box(tag, mark, box)
        opened.append((tag, box, kind | _KINDS.get(tag, 0), hidden or tag in HIDDEN))

    def _box(self, tag: str, mark: str, parent: int) -> int:
        self.page.boxes.append(Box(len(self.page.boxes), tag, mark, parent))
        return len(self.page.boxes) - 1

    def handle_endtag(self, tag: str) -> None:
        line = self.lineno
        self.tags[line] = self.tags.get(line, 0) + 1
        if self.open[-1][0] == tag and len(self.open) > 1:
            self.open.pop()
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in BOXES and tag not in BOXES:
                return

    def handle_data(self, data: str) -> None:
        _, box, kind, hidden = self.open[-1]
        if hidden or data.isspace():
            return
        line = self.lineno
        if "\n" not in data:
            self.pieces.append(Piece(line, " ".join(data.split()), box, kind))
            return
        for i, text in enumerate(data.split("\n")):
            if words := text.split():
                self.pieces.append(Piece(line + i, " ".join(words), box, kind))


def read(html: str) -> Page:
    """The page's text events. Never fails: what the parser can't go on with ends the page there."""
    reader = _Reader()
    # A comment that is never closed hides the rest.
    start = html.rfind("<!--")
    if start > html.rfind("-->") and "</script" not in html[start:].lower():
        html = html[:start]
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError, RecursionError):
        pass
    return reader.page
