"""EPUB files as a Spark data source, one partition for each file.

``spark.read.format("granthika_epub").option("path", …)`` gives paragraphs; option ``view`` may be "paragraphs", "metadata" or
"manifest". ``spark.dataSource.register(EpubSource)`` makes it known. Only the standard library is used, inside the tasks.
"""

from __future__ import annotations

import glob
import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree as ET
from xml.parsers import expat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Tags that hold a paragraph of their own, tags without end tag, and marks of boilerplate.
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "caption")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CELLS = ("td", "th")
VOID = ("br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr")
BOILERPLATE_CLASSES = ("pg-boilerplate", "licenseContainer")
BOILERPLATE_IDS = ("pg-header", "pg-footer")
WIKI_HOST = "wikisource.org"
WIKI_EXTRA = ("title", "about")
INLINE = ("i", "em", "b", "strong", "u", "cite", "a", "sup", "sub", "small", "abbr", "q")
MAX_TITLE = 200

PARAGRAPHS = "path string, book_title string, chapter_ord int, chapter_id string, chapter_title string, pos int, index int, kind string, text string, marked_text string"
METADATA = "path string, title string, creator string, date string, language string"
MANIFEST = "path string, item_id string, href string, media_type string, properties string, in_spine boolean"


_EMPTY_MARK = re.compile(r"⟦(\d+)⟧\s*⟦/\1⟧")


def _flat(text: str) -> str:
    return " ".join(text.split())


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(data: bytes) -> ET.Element:
    """Parse XML, refusing documents that declare entities, wherever they do and however they are encoded."""

    def refuse(*_) -> None:
        raise ValueError("entity declarations are not read")

    first = expat.ParserCreate()
    first.EntityDeclHandler = refuse
    first.Parse(data, True)
    return ET.fromstring(data)


class BlockReader(HTMLParser):
    """Blocks of an XHTML document in order: index, tag, text, marked text, whether it holds a block, boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.stack: list[tuple[str, dict | None, bool]] = []
        self.title: list[str] = []
        self.named: list[dict] = []  # the body's h1, h2 and title elements in order
        self.in_title = self.in_head = False
        self.skip = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        if tag == "head":
            self.in_head = True
        if tag == "title":
            self.in_title = True
            if not self.in_head:
                self.named.append({"tag": tag, "text": [], "junk": False})
        if tag in ("script", "style"):
            self.skip += 1
        names = dict(attrs)
        junk = bool(set((names.get("class") or "").split()) & set(BOILERPLATE_CLASSES)) or (names.get("id") or "") in BOILERPLATE_IDS
        junk = junk or bool(self.stack and self.stack[-1][2])
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.handle_endtag("p")
        block = None
        if tag in BLOCKS:
            for _, outer, _ in self.stack:
                if outer is not None:
                    outer["inner"] = True
            parent = next((b["tag"] for _, b, _ in reversed(self.stack) if b is not None), None)
            block = {"index": len(self.blocks), "tag": tag, "parent": parent, "text": [], "marked": [], "marks": 0, "inner": False, "junk": junk}
            self.blocks.append(block)
            if tag in ("h1", "h2"):
                self.named.append(block)
        elif tag in INLINE:
            for _, outer, _ in reversed(self.stack):
                if outer is not None:
                    outer["marks"] += 1
                    outer["marked"].append(f"⟦{outer['marks']}⟧")
                    self.stack.append((f"{tag}#{outer['marks']}", None, junk))
                    return
        self.stack.append((tag, block, junk))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.in_head = False
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name.partition("#")[0] == tag:
                if "#" in name:
                    for _, outer, _ in reversed(self.stack[:k]):
                        if outer is not None:
                            outer["marked"].append(f"⟦/{name.partition('#')[2]}⟧")
                            break
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.in_title:
            (self.title if self.in_head else self.named[-1]["text"]).append(data)
        elif not self.skip:
            self._text(data)

    def _text(self, data: str) -> None:
        for _, block, _ in self.stack:
            if block is not None:
                block["text"].append(data)
                block["marked"].append(data)


def read_document(data: bytes) -> BlockReader:
    reader = BlockReader()
    reader.feed(data.decode("utf-8", "replace"))
    reader.close()
    return reader


def read_blocks(data: bytes) -> tuple[list[dict], str]:
    """The blocks of a document and the title in its head."""
    reader = read_document(data)
    return reader.blocks, _flat("".join(reader.title))


def kind_of(block: dict) -> str:
    """table_cell before heading before text, by the tag, then by the block around it."""
    for tag in (block["tag"], block["parent"]):
        if tag in CELLS:
            return "table_cell"
    return "heading" if block["tag"] in HEADINGS or block["parent"] in HEADINGS else "text"


def paragraphs_of(blocks: list[dict], least: int = 1) -> list[tuple[int, str, str, str | None]]:
    """(index, kind, text, marked text) of the innermost blocks; index counts all blocks, also those left out."""
    out = []
    for block in blocks:
        text = _flat("".join(block["text"]))
        if block["inner"] or block["junk"] or len(text) < least:
            continue
        marked = _flat(_EMPTY_MARK.sub("", "".join(block["marked"]))) if block["marks"] else None
        if marked is not None and "⟦" not in marked:
            marked = None
        if marked is not None and _flat(re.sub(r"⟦/?\d+⟧", "", marked)) != text:
            marked = None
        out.append((block["index"], kind_of(block), text, marked))
    return out


class Book:
    """An open EPUB: its package document, manifest, spine and navigation labels."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        container = _xml(self.zip.read("META-INF/container.xml"))
        self.opf_path = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        self.dir = posixpath.dirname(self.opf_path)
        self.opf = _xml(self.zip.read(self.opf_path))
        self.items = {e.attrib["id"]: dict(e.attrib) for e in self.opf.iter() if _local(e.tag) == "item" and "id" in e.attrib}
        self.spine = [(e.attrib.get("idref"), e.attrib.get("linear", "yes")) for e in self.opf.iter() if _local(e.tag) == "itemref"]

    def resolve(self, href: str, base: str | None = None) -> str:
        path = unquote(href.partition("#")[0])
        return posixpath.normpath(posixpath.join(self.dir if base is None else base, path))

    def first(self, name: str) -> str | None:
        return next((_flat("".join(e.itertext())) or None for e in self.opf.iter() if _local(e.tag) == name and _flat("".join(e.itertext()))), None)

    def from_wiki(self) -> bool:
        """Whether the package says that it was exported from the transcription wiki."""
        for e in self.opf.iter():
            text = (e.text or "").strip()
            if _local(e.tag) == "contributor" and text == "Wikisource":
                return True
            if _local(e.tag) in ("identifier", "source"):
                host = urlsplit(text).hostname or ""
                if host == WIKI_HOST or host.endswith("." + WIKI_HOST):
                    return True
        return False

    def documents(self) -> list[tuple[str, str]]:
        """(item id, zip path) of the linear XHTML documents in reading order, each once; a missing file is an error."""
        out, seen = [], set()
        for idref, linear in self.spine:
            item = self.items.get(idref or "")
            if item is None or linear == "no" or idref in seen or item.get("media-type") != "application/xhtml+xml" or "cover" in item.get("properties", "").split():
                continue
            seen.add(idref)
            path = self.resolve(item.get("href", ""))
            if path not in self.zip.namelist():
                raise FileNotFoundError(f"{path} is in the spine but not in the file")
            out.append((idref, path))
        return out

    def _part(self, item: dict | None) -> tuple[str, ET.Element | None]:
        """Path and root of a navigation file; no root where it is missing or unreadable."""
        path = self.resolve(item.get("href", "")) if item is not None else ""
        try:
            return path, _xml(self.zip.read(path)) if path else None
        except (KeyError, ET.ParseError, expat.ExpatError):
            return path, None

    def labels(self) -> dict[str, str]:
        """The first table-of-contents label of each document: from the contents of the navigation document, then from the NCX.

        Page lists and landmarks of the navigation document name no chapters.
        """
        out: dict[str, str] = {}
        path, root = self._part(next((i for i in self.items.values() if "nav" in i.get("properties", "").split()), None))
        for nav in root.iter() if root is not None else ():
            kind = nav.attrib.get("{http://www.idpf.org/2007/ops}type") or nav.attrib.get("epub:type") or ""
            if _local(nav.tag) == "nav" and "toc" in kind.split():
                for a in (e for e in nav.iter() if _local(e.tag) == "a"):
                    label, href = _flat("".join(a.itertext())), a.attrib.get("href")
                    if label and href:
                        out.setdefault(self.resolve(href, posixpath.dirname(path)), label)
        path, root = self._part(next((i for i in self.items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None))
        for point in (e for e in root.iter() if _local(e.tag) == "navPoint") if root is not None else ():
            label = next((_flat("".join(e.itertext())) for e in point if _local(e.tag) == "navLabel"), "")
            target = next((e.attrib.get("src", "") for e in point if _local(e.tag) == "content"), "")
            if label and target:
                out.setdefault(self.resolve(target, posixpath.dirname(path)), label)
        return out


def _cut_title(title: str) -> str:
    return title if len(title) <= MAX_TITLE else (title[:MAX_TITLE].rsplit(" ", 1)[0] or title[:MAX_TITLE])


def chapter_title(document: BlockReader, label: str | None) -> str | None:
    """The first h1, h2 or title in the body, if it says anything, else the contents label, else the first lower heading.

    The title in the head names the book more often than the chapter and is not asked.
    """

    def text_of(found: list[dict]) -> str:
        return next((_flat("".join(b["text"])) for b in found if not b["junk"]), "")

    title = text_of(document.named) or label or text_of([b for b in document.blocks if b["tag"] in ("h3", "h4", "h5", "h6")])
    return _cut_title(title) if title else None


def book_rows(path: str, data: bytes, view: str, least: int) -> list[tuple]:
    """The rows of one EPUB for a view."""
    book = Book(data)
    if view == "metadata":
        return [(path, book.first("title"), book.first("creator"), book.first("date"), book.first("language"))]
    if view == "manifest":
        inside = {i for i, _ in book.spine}
        return [(path, k, v.get("href"), v.get("media-type"), v.get("properties"), k in inside) for k, v in book.items.items()]
    title, labels, out, order = book.first("title"), book.labels(), [], 0
    left_out = WIKI_EXTRA if book.from_wiki() else ()
    for item, name in book.documents():
        if item in left_out:
            continue
        document = read_document(book.zip.read(name))
        rows = paragraphs_of(document.blocks, least)
        if not rows:
            continue
        order += 1
        named = chapter_title(document, labels.get(name))
        out += [(path, title, order, item, named, pos, *row) for pos, row in enumerate(rows)]
    return out


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.view, self.least = options["path"], options.get("view", "paragraphs"), int(options.get("minparagraphchars", options.get("minParagraphChars", 1)))

    def partitions(self):
        found = sorted(glob.glob(self.path if any(c in self.path for c in "*?[") else posixpath.join(self.path, "*.epub"))) if not self.path.endswith(".epub") or "*" in self.path else [self.path]
        return [_File(p) for p in found] or [_File("")]

    def read(self, partition):
        if partition.path:
            with open(partition.path, "rb") as file:
                yield from book_rows(partition.path, file.read(), self.view, self.least)


class EpubSource(DataSource):
    """Reader of EPUB files; options path, view and minParagraphChars."""

    @classmethod
    def name(cls) -> str:
        return "granthika_epub"

    def schema(self) -> str | StructType:
        return {"metadata": METADATA, "manifest": MANIFEST}.get(self.options.get("view", "paragraphs"), PARAGRAPHS)

    def reader(self, schema):
        return _Reader(self.options)


def read_epub_binary(files, view: str = "paragraphs", least: int = 1):
    """Rows of EPUB files from a ``binaryFile`` DataFrame (path, content), for storage that only Spark can reach."""
    import pandas as pd

    schema = {"metadata": METADATA, "manifest": MANIFEST}.get(view, PARAGRAPHS)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for path, data in zip(batch["path"], batch["content"], strict=True) for r in book_rows(path, data, view, least)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)
