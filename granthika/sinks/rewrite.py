"""Translated copies of EPUB files: the texts of blocks are replaced in place, all else is copied as it is."""

from __future__ import annotations

import html
import io
import os
import posixpath
import re
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granthika.sources.epub import BLOCKS, INLINE, VOID, Book, BlockReader

from .strip import hollow_document

_MARK = re.compile(r"⟦(/?)(\d+)⟧")


class PlacedReader(BlockReader):
    """Blocks with the places of their inner markup and the tags behind their inline markers."""

    def __init__(self, text: str) -> None:
        super().__init__()
        self.starts = [0]
        for line in text.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.source = text
        self.open: list[tuple[str, dict | None]] = []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs) -> None:
        known, marks = len(self.blocks), {id(b): b["marks"] for b in self.blocks}
        super().handle_starttag(tag, attrs)
        if tag in VOID:
            return
        block = None
        if tag in BLOCKS and len(self.blocks) > known:
            block = self.blocks[-1]
            block["from"], block["to"], block["tags"] = self._at() + len(self.get_starttag_text()), None, {}
        elif tag in INLINE:
            for b in self.blocks:
                if b["marks"] > marks.get(id(b), 0):
                    b.setdefault("tags", {})[b["marks"]] = (self.get_starttag_text(), f"</{tag}>")
        self.open.append((tag, block))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for _, block in self.open[k:]:
                    if block is not None and block["to"] is None:
                        block["to"] = self._at()
                del self.open[k:]
                break
        super().handle_endtag(tag)


def _markup(text: str, tags: dict[int, tuple[str, str]]) -> str:
    """Escaped text with its inline markers turned to their tags; markers that don't nest are dropped."""
    stack, good = [], True
    for m in _MARK.finditer(text):
        n = int(m.group(2))
        if not m.group(1):
            stack.append(n)
            good &= n in tags
        else:
            good &= bool(stack) and stack.pop() == n
    good &= not stack
    parts, last = [], 0
    for m in _MARK.finditer(text):
        parts.append(html.escape(text[last : m.start()], quote=False))
        if good:
            parts.append(tags[int(m.group(2))][1 if m.group(1) else 0])
        last = m.end()
    return "".join([*parts, html.escape(text[last:], quote=False)])


def translate_document(data: bytes, texts: dict[int, str]) -> bytes:
    """An XHTML document with the blocks of ``texts`` (by index) replaced; an index that is no innermost block is an error."""
    source = data.decode("utf-8")
    reader = PlacedReader(source)
    reader.feed(source)
    reader.close()
    blocks = {b["index"]: b for b in reader.blocks if not b["inner"]}
    unknown = set(texts) - set(blocks)
    if unknown:
        raise ValueError(f"no block to translate at {sorted(unknown)[:5]}")
    out = source
    for index in sorted(texts, reverse=True):
        block = blocks[index]
        end = block["to"] if block["to"] is not None else block["from"] + len(source[block["from"] :].split("<", 1)[0])
        out = out[: block["from"]] + _markup(texts[index], block["tags"]) + out[end:]
    return out.encode()


def translate_epub(data: bytes, texts: dict[str, dict[int, str]], language: str, hollow: bool = False) -> bytes:
    """A copy of an EPUB with translated documents (by manifest id) and its language set; an unknown id is an error.

    ``hollow`` empties a library's boilerplate in the documents.
    """
    book, target = Book(data), io.BytesIO()
    where = dict(book.documents())
    if set(texts) - set(where):
        raise ValueError(f"no chapter {sorted(set(texts) - set(where))[:5]}")
    changed = {where[k]: v for k, v in texts.items()}
    with zipfile.ZipFile(target, "w") as out:
        order = sorted(book.zip.infolist(), key=lambda i: i.filename != "mimetype")
        for info in order:
            content = book.zip.read(info.filename)
            if info.filename in changed:
                content = translate_document(content, changed[info.filename])
            if hollow and info.filename in where.values():
                content = hollow_document(content)
            if info.filename == book.opf_path:
                content = re.sub(rb"(<dc:language\b[^>]*>)[^<]*", rb"\g<1>" + language.encode(), content, count=1)
            copy = zipfile.ZipInfo(info.filename, info.date_time)
            copy.compress_type, copy.external_attr = zipfile.ZIP_STORED if info.filename == "mimetype" else info.compress_type, info.external_attr
            out.writestr(copy, content)
    return target.getvalue()


def write_translations(files: DataFrame, texts: DataFrame, folder: str, language: str, hollow: bool = False) -> DataFrame:
    """Write a translated copy of each EPUB of ``files`` (path, content) with ``texts`` (path, chapter_id, index, text), with ``hollow`` without
    a library's boilerplate. ``folder`` must be one that all executors share.

    Returns (path, written, blocks). Files without texts aren't written. One task handles a book; files appear by renaming.
    """
    per = texts.where("text is not null").groupBy("path").agg(F.collect_list(F.struct("chapter_id", "index", "text")).alias("texts"))

    def run(batches):
        for batch in batches:
            out = []
            for path, content, items in zip(batch["path"], batch["content"], batch["texts"], strict=True):
                by: dict[str, dict[int, str]] = {}
                for item in items:
                    by.setdefault(item["chapter_id"], {})[int(item["index"])] = item["text"]
                target = posixpath.join(folder, posixpath.splitext(posixpath.basename(path))[0] + f".{language}.epub")
                os.makedirs(folder, exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as file:
                    file.write(translate_epub(content, by, language, hollow))
                os.replace(part, target)
                out.append((path, target, sum(map(len, by.values()))))
            yield pd.DataFrame(out, columns=["path", "written", "blocks"])

    return files.select("path", "content").join(per, "path").mapInPandas(run, "path string, written string, blocks int")
