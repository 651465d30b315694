"""Plain text, transcriptions, review lists and saved runs as DataFrames of ordinal-keyed rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from granthika.functions import text as X

REVIEW = "source_term_key string, source_term string, term_type string, target_term string, status string, frequency int, first_seen_chapter string, notes string"
MANIFEST = (
    "epub string, preview boolean, exclude_ids array<string>, chapter_context string, preserve_inline_markup boolean, target_language string, paragraphs_translated int, paragraphs_total int, "
    "chapters array<struct<id: string, title: string, paragraphs: int, total_paragraphs: int>>, skipped array<string>, source_problems array<struct<path: string, message: string>>, cover_replaced boolean"
)


def split_plain(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, text): blocks between blank lines, or one paragraph for each line where a text has no blank line."""
    flat = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), " ", " ")
    blocks = F.when(flat.rlike(r"\n[^\S\n]*\n"), F.split(flat, r"\n(?:[^\S\n]*\n)+")).otherwise(F.split(flat, "\n"))
    clean = F.filter(F.transform(blocks, lambda b: X.collapse(b)), lambda b: b != "")
    return texts.select(key, F.posexplode(clean).alias("pos", "text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text) of whole text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return split_plain(rows, "path")


class _Node:
    """An element of a page: tag, attributes, children (elements and strings)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def elements(self):
        """Itself and all elements in it, in order, each with its depth."""
        todo = [(self, 0)]
        while todo:
            node, depth = todo.pop()
            yield node, depth
            todo += [(c, depth + 1) for c in reversed(node.children) if isinstance(c, _Node)]

    def text(self, line_break: str = "") -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br":
                out.append(line_break)
            else:
                todo += reversed(node.children)
        return "".join(out)


class _Page(HTMLParser):
    """The tree of a page without scripts, navigation and forms."""

    DROPPED = ("script", "style", "nav", "header", "footer", "form", "noscript")
    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
    CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open, self.drop = [self.root], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.DROPPED:
            self.drop += 1
        if self.drop:
            return
        while len(self.open) > 1 and self.open[-1].tag in self.CLOSES.get(tag, ()):
            self.open.pop()
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in self.DROPPED and not self.drop:
            self.open[-1].children.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROPPED:
            self.drop = max(0, self.drop - 1)
        elif not self.drop and tag in (n.tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.drop:
            self.open[-1].children.append(data)


# The elements that hold a paragraph of a transcription page, the mark of the element that holds the book, end marks of lines.
PAGE_BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "caption")
BOOK_PROPERTY = "sioc:content"
LINE_ENDS = tuple(".!?\"'”’):;")


def main_container(page: _Node) -> _Node:
    """The element that holds the book: the marked one, else the innermost that has all the text of the page's body.

    As no element has more text than one around it, that is the one with the most text, of several the innermost.
    """
    scope = next((n for n, _ in page.elements() if n.tag == "body"), page)
    marked = next((n for n, _ in scope.elements() if n.attrs.get("property") == BOOK_PROPERTY), None)
    if marked is not None and marked.text().split():
        return marked
    here = scope
    while True:
        full = [c for c in here.children if isinstance(c, _Node) and c.text().split()]
        if len(full) != 1 or any(isinstance(c, str) and c.split() for c in here.children):
            return here
        here = full[0]


def is_wrapped(lines: list[str]) -> bool:
    """At least three lines of 50 to 90 characters, of which 60 % have no end mark: a hard-wrapped text."""
    middle = [x for x in lines if 50 <= len(x) <= 90]
    return len(middle) >= 3 and sum(not x.endswith(LINE_ENDS) for x in middle) >= 0.6 * len(middle)


def html_paragraphs(html: str) -> list[str]:
    """The paragraphs of a transcription page's book.

    Its innermost blocks, line breaks parting them; where it has none its lines, or, if they are hard-wrapped, what stands between
    blank lines.
    """
    page = _Page()
    page.feed(html)
    page.close()
    holder = main_container(page.root)
    blocks = [n for n, _ in holder.elements() if n is not holder and n.tag in PAGE_BLOCKS]
    if blocks:
        inner = [n for n in blocks if not any(x is not n and x.tag in PAGE_BLOCKS for x, _ in n.elements())]
        return [t for n in inner for part in n.text("\0").split("\0") if (t := " ".join(part.split()))]
    raw = holder.text("\n").replace("\xa0", " ")
    parts = [[x.strip() for x in part.split("\n") if x.strip()] for part in re.split(r"\n[^\S\n]*\n+", raw)]
    lines = [x for part in parts for x in part]
    return [" ".join(x.split()) for x in ([" ".join(part) for part in parts if part] if is_wrapped(lines) else lines)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paragraphs(html: pd.Series) -> pd.Series:
    return html.map(lambda h: html_paragraphs(h) if h is not None else None)


def split_html(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, text) of HTML pages."""
    return pages.select(key, F.posexplode(_paragraphs(F.col(html))).alias("pos", "text"))


def bilingual_sample(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, en, kn) of samples written as "[n] EN: … [n] KN: …"."""
    pattern = r"(?s)\[(\d+)\] EN: (.*?)\s*\[\1\] KN: (.*?)(?=\s*\[\d+\] EN:|\s*$)"
    marks = {name: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(k)) for k, name in ((1, "n"), (2, "en"), (3, "kn"))}
    return texts.select(key, F.explode(F.arrays_zip(*[c.alias(n) for n, c in marks.items()])).alias("z")).select(key, F.col("z.n").cast("int").alias("n"), "z.en", "z.kn")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed glossary list (CSV with header)."""
    return spark.read.schema(REVIEW).csv(path, header=True, escape='"', multiLine=True)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Saved run manifests (JSON), newest file first; unreadable ones come out without values and are dropped."""
    rows = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    kept = rows.withColumns({"path": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time")})
    return kept.where("epub is not null").orderBy(F.desc("modified"), "path")


def read_qa_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, total, passed, retry, flagged) of saved quality reports (JSON with a summary); null where a report can't be read."""
    names = {"total": "total", "passed": "pass", "retry": "retry", "flagged": "flagged_for_review"}
    schema = "summary struct<total: int, pass: int, retry: int, flagged_for_review: int>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema)["summary"].alias("s"))
    return rows.select("path", *(F.col("s")[v].alias(k) for k, v in names.items()))


def checker_report(texts: DataFrame, key: str, text: str = "text", most: int = 50) -> DataFrame:
    """(key, fatals, errors, warnings, messages, version) of a checker's console text; a text without summary line is an error."""
    body = F.col(text)
    total = r"(?i)(\d+) fatals?\s*/\s*(\d+) errors?\s*/\s*(\d+) warnings?"
    number = lambda k: F.nullif(F.regexp_extract(body, total, k), F.lit("")).cast("int")
    version = F.nullif(F.regexp_extract(body, r"(?im)\bversion:?\s*v?(\d+(?:\.\d+)*)", 1), F.lit(""))
    messages = F.slice(F.regexp_extract_all(body, F.lit(r"(?m)^((?:FATAL|ERROR|WARNING)\([^)]*\).*)$"), F.lit(1)), 1, most)
    fatals = F.when(body.rlike(total), number(1)).otherwise(F.raise_error(F.lit("no summary line")).cast("int"))
    return texts.where(body.isNotNull()).select(key, fatals.alias("fatals"), number(2).alias("errors"), number(3).alias("warnings"), messages.alias("messages"), version.alias("version"))
