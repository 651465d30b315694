"""A library's boilerplate emptied out of XHTML documents, their sequence of blocks kept."""

from __future__ import annotations

import html
from html.parser import HTMLParser

from granthika.sources.epub import BLOCKS, BOILERPLATE_CLASSES, BOILERPLATE_IDS, VOID

# Elements that hold blocks, and those that an empty span may stand in.
CONTAINERS = ("ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "div", "section")
ROOMS = (*BLOCKS, "dt", "dd", "div", "section")


def _is_boilerplate(attrs: dict) -> bool:
    return bool(set((attrs.get("class") or "").split()) & set(BOILERPLATE_CLASSES)) or (attrs.get("id") or "") in BOILERPLATE_IDS


class _Hollow(HTMLParser):
    """Copies a document but for what stands inside its outermost boilerplate elements: of that the blocks and their containers stay, empty.

    The id of an element that goes becomes an empty span in the next place that may hold one.
    """

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.source, self.out, self.copied = source, [], 0
        self.starts = [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.inside: list[str] = []
        self.ids: list[str] = []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _spans(self) -> None:
        self.out += [f'<span id="{html.escape(i)}"></span>' for i in self.ids]
        self.ids.clear()

    def handle_starttag(self, tag: str, attrs) -> None:
        names, raw = dict(attrs), self.get_starttag_text()
        if not self.inside:
            if tag not in VOID and _is_boilerplate(names):
                self.out.append(self.source[self.copied : self._at() + len(raw)])
                self.inside = [tag]
            return
        if tag in BLOCKS or tag in CONTAINERS:
            self.out.append(raw)
            if tag in ROOMS:
                self._spans()
        elif names.get("id"):
            self.ids.append(names["id"])
        if tag not in VOID:
            self.inside.append(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if self.inside:
            if tag in BLOCKS or tag in CONTAINERS:
                self.out.append(self.get_starttag_text())
            elif dict(attrs).get("id"):
                self.ids.append(dict(attrs)["id"])

    def handle_endtag(self, tag: str) -> None:
        if not self.inside or tag not in self.inside:
            return
        while self.inside[-1] != tag:
            self.inside.pop()
        if len(self.inside) == 1 or tag in ROOMS:
            self._spans()
        self.inside.pop()
        if not self.inside:
            self.copied = self._at()
        elif tag in BLOCKS or tag in CONTAINERS:
            self.out.append(f"</{tag}>")


def hollow_document(data: bytes) -> bytes:
    """An XHTML document whose boilerplate has no text, comment or inline element left; block tags and all ids are those of ``data``.

    A document without boilerplate comes out as it is.
    """
    source = data.decode("utf-8")
    reader = _Hollow(source)
    reader.feed(source)
    reader.close()
    if not reader.out:
        return data
    rest = "" if reader.inside else source[reader.copied :]
    return "".join([*reader.out, rest]).encode()
