"""Checks and features of EPUB files, as rows."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from .epub import Book, read_blocks

PROBLEMS = "path string, check_no int, entry string, message string"
FEATURES = "path string, version string, documents int, blocks int, tables int, lists int, note_links int, images int, verse_blocks int, duplicate_ids int"
# How image files begin.
SIGNATURES = {".png": (b"\x89PNG\r\n\x1a\n",), ".jpg": (b"\xff\xd8\xff",), ".jpeg": (b"\xff\xd8\xff",), ".gif": (b"GIF87a", b"GIF89a"), ".webp": (b"RIFF",)}
GENERATED_COVER = re.compile(r"^\d+_\d+-cover\.png$")
GENERATED_SIZE = (1600, 2400)


def png_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, None for other data."""
    if len(data) < 24 or not data.startswith(SIGNATURES[".png"][0]) or data[12:16] != b"IHDR":
        return None
    return struct.unpack(">II", data[16:24])


def is_generated_cover(name: str, media_type: str, data: bytes) -> bool:
    """A cover that was made by machine: its name, type and size say so."""
    return media_type == "image/png" and bool(GENERATED_COVER.match(posixpath.basename(name))) and png_size(data) == GENERATED_SIZE


def has_png_text(data: bytes, keyword: bytes) -> bool:
    """Whether a PNG has a tEXt chunk of ``keyword`` before its pixels."""
    at = 8
    while png_size(data) and at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind in (b"IDAT", b"IEND"):
            return False
        if kind == b"tEXt" and data[at + 8 : at + 8 + size].split(b"\0")[0] == keyword:
            return True
        at += 12 + size
    return False


def duplicate_ids(data: bytes) -> list[tuple[str, int]]:
    """(id, times) of the ids that an XML document holds more than once, in order of appearance."""
    seen: dict[str, int] = {}
    for element in ET.fromstring(data).iter():
        if "id" in element.attrib:
            seen[element.attrib["id"]] = seen.get(element.attrib["id"], 0) + 1
    return [(k, n) for k, n in seen.items() if n > 1]


def problems_of(path: str, data: bytes) -> list[tuple[str, int, str, str]]:
    """(path, check, entry, message) in the order of the checks, then of the entries; an unreadable file is a problem, no error."""
    out: list[tuple[int, str, str]] = []
    try:
        file = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return [(path, 0, "", "not a zip file")]
    names = file.infolist()
    if not names or names[0].filename != "mimetype":
        out.append((1, "mimetype", "is not the first entry"))
    elif names[0].compress_type != zipfile.ZIP_STORED:
        out.append((1, "mimetype", "is compressed"))
    if any(n.filename == "mimetype" for n in names) and file.read("mimetype") != b"application/epub+zip":
        out.append((1, "mimetype", "has other content"))
    for info in names:
        name, ext = info.filename, posixpath.splitext(info.filename)[1].lower()
        if ext in SIGNATURES and not file.read(name).startswith(SIGNATURES[ext]):
            out.append((2, name, "is not the image its name says"))
        if ext in (".xhtml", ".opf", ".ncx", ".svg", ".xml"):
            try:
                twice = duplicate_ids(file.read(name))
            except ET.ParseError as error:
                out.append((3, name, f"is not well-formed: {error}"))
                continue
            if twice:
                rest = sum(n - 1 for _, n in twice[1:])
                out.append((4, name, f"id {twice[0][0]!r} is used {twice[0][1]} times" + (f", {rest} more repeated" if rest else "")))
    try:
        book = Book(data)
        there = set(file.namelist())
        out += [(5, book.resolve(i.get("href", "")), "is listed but missing") for i in book.items.values() if book.resolve(i.get("href", "")) not in there]
    except (KeyError, StopIteration, ValueError, ET.ParseError) as error:
        out.append((5, "", f"the package can't be read: {error}"))
    return [(path, *row) for row in sorted(out)]


def features_of(path: str, data: bytes) -> tuple:
    """Counts of what a book is made of."""
    book = Book(data)
    texts = [(name, book.zip.read(name)) for _, name in book.documents()]
    blocks = [b for _, d in texts for b in read_blocks(d)[0]]
    count = lambda pattern: sum(len(re.findall(pattern, d, re.IGNORECASE)) for _, d in texts)
    verse = sum(len(re.findall(rb"<br\b", p)) >= 3 for _, d in texts for p in re.findall(rb"<p\b.*?</p>", d, re.S))
    repeated = sum(len(duplicate_ids(d)) for _, d in texts)
    return path, book.opf.attrib.get("version"), len(texts), len(blocks), count(rb"<table\b"), count(rb"<[ou]l\b"), count(rb"epub:type=\"noteref\"|href=\"#(?:fn|note)"), count(rb"<img\b"), verse, repeated


def _rows(files: DataFrame, make, schema: str, many: bool) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            found = [make(p, d) for p, d in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([r for rows in found for r in rows] if many else found, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def epub_problems(files: DataFrame) -> DataFrame:
    """(path, check_no, entry, message) of EPUB files from a ``binaryFile`` DataFrame."""
    return _rows(files, problems_of, PROBLEMS, True)


def epub_features(files: DataFrame) -> DataFrame:
    """One row of counts for each readable EPUB."""
    return _rows(files, features_of, FEATURES, False)
