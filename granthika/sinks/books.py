"""Books written from DataFrames: one task a book, files put in place by renaming a finished temporary one."""

from __future__ import annotations

import html
import os
import posixpath
import re
import struct
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_OUT = "book_id string, path string, files int"


def _replace(path: str, write: Callable[[str], None]) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    write(part)
    os.replace(part, path)


def epub_bytes_order(file: zipfile.ZipFile, title: str, language: str, chapters: list[tuple[str, str, list[str]]], creator: str) -> None:
    """Write an EPUB 3 of (id, title, paragraphs) chapters; the mimetype comes first and is stored."""
    esc = html.escape
    file.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
    file.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
    for key, name, paragraphs in chapters:
        body = "".join(f"<p>{esc(p)}</p>" for p in paragraphs)
        file.writestr(f"EPUB/{key}.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{language}"><head><title>{esc(name)}</title></head><body><h1>{esc(name)}</h1>{body}</body></html>')
    nav = "".join(f'<li><a href="{k}.xhtml">{esc(n)}</a></li>' for k, n, _ in chapters)
    file.writestr("EPUB/nav.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
    items = "".join(f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k, _, _ in chapters)
    spine = "".join(f'<itemref idref="{k}"/>' for k, _, _ in chapters)
    ident = uuid.uuid5(uuid.NAMESPACE_URL, title + "\n" + "\n".join(n for _, n, _ in chapters))
    file.writestr("EPUB/package.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{ident}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:creator>{esc(creator)}</dc:creator><dc:language>{language}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>')


def _chapters(rows: pd.DataFrame) -> list[tuple[str, str, list[str]]]:
    out = []
    for k, (_, part) in enumerate(rows.sort_values(["chapter_ord", "pos"]).groupby("chapter_ord", sort=True), 1):
        name = next((t for t in part["chapter_title"] if isinstance(t, str) and t), f"Chapter {k}")
        out.append((f"chapter-{k:04d}", name, [t for t in part["text"] if isinstance(t, str)]))
    return out


def write_epubs(paragraphs: DataFrame, folder: str, language: str = "en") -> DataFrame:
    """Write an EPUB for each book of (book_id, book_title, chapter_ord, chapter_title, pos, text); returns what was written."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        book = str(rows["book_id"].iloc[0])
        title = next((t for t in rows["book_title"] if isinstance(t, str) and t), book)
        chapters, path = _chapters(rows), posixpath.join(folder, re.sub(r"[^\w\-]+", "_", book) + ".epub")

        def fill(part: str) -> None:
            with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as file:
                epub_bytes_order(file, title, language, chapters, "Unknown author")

        _replace(path, fill)
        return pd.DataFrame([(book, path, len(chapters))], columns=["book_id", "path", "files"])

    return paragraphs.select("book_id", "book_title", "chapter_ord", "chapter_title", "pos", "text").groupBy("book_id").applyInPandas(write, _OUT)


def write_sites(paragraphs: DataFrame, folder: str) -> DataFrame:
    """A folder of HTML pages for each book, with links to the chapter before and after."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        book = str(rows["book_id"].iloc[0])
        slug = re.sub(r"[^a-z0-9]+", "-", book.lower()).strip("-") or "book"
        chapters, esc = _chapters(rows), html.escape
        links = "".join(f'<li><a href="{k}.html">{esc(n)}</a></li>' for k, n, _ in chapters)
        pages = {"index": f"<h1>{esc(book)}</h1><ol>{links}</ol>"}
        for i, (key, name, texts) in enumerate(chapters):
            around = "".join(f'<a href="{chapters[j][0]}.html">{word}</a> ' for j, word in ((i - 1, "previous"), (i + 1, "next")) if 0 <= j < len(chapters))
            pages[key] = f"<h1>{esc(name)}</h1><nav>{around}</nav>" + "".join(f"<p>{esc(t)}</p>" for t in texts)
        for name, body in pages.items():
            path = posixpath.join(folder, slug, f"{name}.html")

            def fill(part: str, body: str = body) -> None:
                with open(part, "w", encoding="utf-8") as file:
                    file.write(f'<!doctype html><html><head><meta charset="utf-8"></head><body>{body}</body></html>')

            _replace(path, fill)
        return pd.DataFrame([(book, posixpath.join(folder, slug), len(pages))], columns=["book_id", "path", "files"])

    return paragraphs.select("book_id", "book_title", "chapter_ord", "chapter_title", "pos", "text").groupBy("book_id").applyInPandas(write, _OUT)


def write_narration(sounds: DataFrame, folder: str, rate: int = 16_000, gap: float = 0.6) -> DataFrame:
    """A WAV for each book from (book_id, chapter_ord, pos, pcm) rows of 16-bit sound, ``gap`` seconds after each."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        book = str(rows["book_id"].iloc[0])
        rows = rows.sort_values(["chapter_ord", "pos"])
        path, silence = posixpath.join(folder, re.sub(r"[^\w\-]+", "_", book) + ".wav"), b"\0\0" * int(rate * gap)
        size = sum(len(p) + len(silence) for p in rows["pcm"])

        def fill(part: str) -> None:
            with open(part, "wb") as file:
                file.write(b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", size))
                for pcm in rows["pcm"]:
                    file.write(bytes(pcm) + silence)

        _replace(path, fill)
        return pd.DataFrame([(book, path, len(rows))], columns=["book_id", "path", "files"])

    return sounds.select("book_id", "chapter_ord", "pos", "pcm").groupBy("book_id").applyInPandas(write, _OUT)


def write_review(glossary: DataFrame, path: str, least: int = 1) -> None:
    """The pending terms of a glossary as one CSV with header, the most frequent first."""
    columns = ("source_term_key", "source_term", "term_type", "target_term", "status", "frequency", "first_seen_chapter", "notes")
    rows = glossary.where((F.col("status") == "pending") & (F.col("frequency") >= least)).select(*columns)
    rows.orderBy(F.desc("frequency"), "source_term_key").coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


