"""Assembly of imported books: lines of plain, scanned and HTML text become paragraphs, chapters and warnings.

A document is a row (``key``, text); everything about one is told from others by ``key``, so documents stay side by side.
Rows carry their place; vocabularies are joined, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granthika.functions import text as X
from granthika.operators import imports, ordered
from granthika.sources.texts import split_plain

_NO_PAIR = r"\b([A-Za-z]+- +[a-z]+)\b"
FRONT = "Front matter"


def book_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, spaced): the collapsed lines of each text, and whether blank lines part its paragraphs."""
    flat = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), " ", " ")
    rows = texts.where(F.col(text).isNotNull()).select(key, flat.rlike(r"\n[^\S\n]*\n").alias("spaced"), F.posexplode(F.split(flat, "\n")).alias("line_no", "line"))
    return rows.select(key, "line_no", X.collapse(F.col("line")).alias("line"), "spaced")


def without_page_numbers(lines: DataFrame) -> DataFrame:
    """``lines`` but those that are nothing but a page number."""
    return lines.where((F.col("line") == "") | ~X.is_page_number(F.col("line")))


def first_headers(lines: DataFrame, key: str, least: int = 3) -> DataFrame:
    """``lines`` with ``dropped``: a running header, printed ``least`` times or more in its document, is kept where it stands first.

    Headers are told by their letters. A chapter's opening page prints the title as well, so the first one may be a heading.
    """
    head = F.when((F.col("line") != "") & X.is_header_candidate(F.col("line")), X.letters_key(F.col("line")))
    marked = lines.withColumn("_head", head)
    by_head = Window.partitionBy(key, "_head")
    heads = marked.where("_head is not null").withColumn("_n", F.count("*").over(by_head)).withColumn("_k", F.row_number().over(by_head.orderBy("line_no")))
    rest = marked.where("_head is null").select(*lines.columns, F.lit(False).alias("dropped"))
    return heads.select(*lines.columns, ((F.col("_n") >= least) & (F.col("_k") > 1)).alias("dropped")).unionByName(rest)


def scanned_paragraphs(texts: DataFrame, key: str, text: str = "text", words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, pos, text) of the paragraphs of scanned texts, and (key, dropped): how many header lines were left out.

    Page numbers and repeated headers go, blocks are joined and mended, a paragraph that a page tore is joined again, junk before the
    first real paragraph is left out, words divided at line ends are joined where the text, or ``words`` (column word), has them.
    Null texts give no row.
    """
    lines = first_headers(without_page_numbers(book_lines(texts, key, text)), key)
    dropped = lines.where("dropped").groupBy(key).agg(F.count("*").alias("dropped"))
    here = Window.partitionBy(key).orderBy("line_no")
    block = F.when(F.col("spaced"), F.count_if(F.col("line") == "").over(here)).otherwise(F.col("line_no"))
    kept = lines.where("not dropped").withColumn("block", block).where("line <> ''")
    joined = kept.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    mended = joined.select(key, "block", X.fix_ocr(F.array_join(F.transform("lines", lambda x: x["line"]), " ")).alias("text")).where("text <> ''")
    last = F.lag("text").over(Window.partitionBy(key).orderBy("block"))
    torn = F.coalesce(~X.ends_sentence(last) & F.col("text").rlike(r"^[\p{Ll},;]"), F.lit(False))
    whole = ordered.join_torn(mended.withColumn("torn", torn), [key], "block", "torn", "text").where(X.keep_paragraph(F.col("text")))
    real = imports.drop_front_junk(whole, [key], "island").select(key, F.col("island").alias("pos"), "text")
    return join_divided(real, vocabulary(texts, key, text), key, words).where(X.keep_paragraph(F.col("text"))), dropped


def vocabulary(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word): the distinct words that each document writes out, in lower case."""
    return texts.select(key, F.explode(F.array_distinct(X.words(F.col(text)))).alias("word")).distinct()


def join_divided(rows: DataFrame, known: DataFrame, key: str, words: DataFrame | None = None) -> DataFrame:
    """``rows`` (key, pos, text) with "re- cently" as "recently" where the document or ``words`` knows it, else as "re-cently".

    Only the divided words travel to the vocabulary.
    """
    pairs = F.array_distinct(F.regexp_extract_all("text", F.lit(_NO_PAIR), F.lit(1)))
    low = F.lower(F.regexp_replace("pair", "- +", ""))
    found = rows.select(key, "pos", F.explode(pairs).alias("pair")).select(key, "pos", "pair", F.explode(F.array_distinct(F.array(low, F.rtrim(low, F.lit("s"))))).alias("word"))
    every = known.select(key, "word") if words is None else known.select(key, "word").unionByName(found.select(key, "word").join(words.select(F.lower("word").alias("word")), "word", "left_semi").select(key, "word"))
    judged = found.join(every.distinct().withColumn("known", F.lit(True)), [key, "word"], "left").groupBy(key, "pos", "pair").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"))
    fixes = judged.groupBy(key, "pos").agg(F.sort_array(F.collect_list(F.struct("pair", "known"))).alias("fixes"))

    def fix(done: Column, pair: Column) -> Column:
        written = F.regexp_replace(pair["pair"], "- +", F.when(pair["known"], "").otherwise("-"))
        return F.regexp_replace(done, F.concat(F.lit("\\b"), pair["pair"], F.lit("\\b")), written)

    return rows.join(fixes, [key, "pos"], "left").select(key, "pos", F.coalesce(F.aggregate("fixes", F.col("text"), fix), "text").alias("text"))


def contents_of(rows: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, titles, after): the first contents list with ``least`` titles or more, and the place of the first row behind it.

    A contents heading, then lines "PAGE" or none, then entries "title page" without gap.
    """
    bare = F.trim("text")
    marked = rows.select(key, "pos", bare.alias("line"), bare.rlike(X.CONTENTS_HEADING).alias("head"), F.regexp_extract(bare, X.CONTENTS_ENTRY, 1).alias("title"))
    here = Window.partitionBy(key).orderBy("pos")
    parted = marked.withColumn("section", F.count_if("head").over(here)).where("section > 0 and not head")
    inside = Window.partitionBy(key, "section").orderBy("pos")
    begun = F.count_if((F.col("title") != "") | ~F.upper("line").isin("PAGE", "PAGE.", "")).over(inside) > 0
    body = parted.withColumn("begun", begun).where("begun")
    run = body.withColumn("broken", F.count_if(F.col("title") == "").over(inside)).where("broken = 0")
    title = F.trim(F.col("title"), F.lit(" .·•…\t"))
    lists = run.withColumn("title", title).groupBy(key, "section").agg(F.array_sort(F.collect_list(F.when(title != "", F.struct("pos", "title")))).alias("titles"), (F.max("pos") + 1).alias("after"))
    first = lists.where(F.size("titles") >= least).groupBy(key).agg(F.min_by(F.struct("titles", "after"), "section").alias("x"))
    return first.select(key, F.transform("x.titles", lambda t: t["title"]).alias("titles"), F.col("x.after").alias("after"))


def heading_remainder(paragraph: Column, heading: Column) -> Column:
    """What a long paragraph goes on with behind the heading it begins with, whatever stands between its words; else empty."""
    words = F.regexp_extract_all(heading, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    pattern = F.concat(F.lit("(?i)^"), F.array_join(words, r"\s*"))
    behind = F.regexp_replace(F.regexp_replace(paragraph, pattern, ""), r"^[\s.,;:!?\"'”’—-]+", "")
    return F.when((F.length(paragraph) > 130) & (F.size(words) > 0) & F.regexp_like(paragraph, pattern), F.trim(behind)).otherwise(F.lit(""))


def import_chapters(rows: DataFrame, key: str, *, headings: DataFrame | None = None, words: DataFrame | None = None, dropped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, chapter_no, title, place, text) and warnings (key, kind, place, message) of paragraphs ``rows`` (key, pos, text).

    Headings are the given ones (key, heading_no, heading), else the titles of a contents list, else paragraphs that look like one.
    They are searched forwards, behind the contents list; what stands before the first is front matter, chapter 0. A chapter without
    paragraph has one row with null place and text. ``dropped`` is the second result of ``scanned_paragraphs``. Warned of are header
    lines left out, headings not found and chapters that open with capitals that neither the document (twice) nor ``words`` has.
    """
    at = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    placed = rows.withColumn("at", at).select(key, F.col("at").alias("pos"), "text")
    contents = contents_of(placed, key)
    listed = contents.select(key, F.posexplode("titles").alias("heading_no", "heading"))
    looks = placed.select(key, F.col("pos").alias("heading_no"), X.pattern_heading(F.col("text")).alias("heading")).where("heading is not null")
    used = listed.unionByName(looks.join(contents.select(key), key, "left_anti"))
    if headings is not None:
        given = headings.select(key, "heading_no", "heading")
        used = given.unionByName(used.join(given.select(key).distinct(), key, "left_anti"))
    found = imports.split_at(placed, used, [key], "pos", starts=contents.select(key, F.col("after").alias("start")))
    heads = found.where("pos is not null").select(key, "pos", "heading", F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("chapter_no"))
    here = Window.partitionBy(key).orderBy("pos")
    marked = placed.join(heads, [key, "pos"], "left").withColumn("rest", heading_remainder(F.col("text"), F.col("heading")))
    body = marked.withColumn("chapter_no", F.coalesce(F.last("chapter_no", ignorenulls=True).over(here), F.lit(0))).withColumn("title", F.coalesce(F.last("heading", ignorenulls=True).over(here), F.lit(FRONT)))
    body = body.withColumn("text", F.when(F.col("heading").isNull(), F.col("text")).otherwise(F.nullif("rest", F.lit(""))))
    full = body.where("text is not null").withColumn("place", F.row_number().over(Window.partitionBy(key, "chapter_no").orderBy("pos")) - 1)
    empty = heads.join(full.select(key, "chapter_no"), [key, "chapter_no"], "left_anti")
    chapters = full.select(key, "chapter_no", "title", "place", "text").unionByName(empty.select(key, "chapter_no", F.col("heading").alias("title"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("text")))
    missing = found.where("pos is null").select(key, F.lit("missing").alias("kind"), F.col("chapter_no").alias("place"), F.concat(F.lit('Heading "'), "heading", F.lit('" was not found in the text.')).alias("message"))
    counted = placed.select(key, F.explode(X.words(F.col("text"))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n")).where("n >= 2").select(key, "word")
    tokens = F.split(F.trim("text"), r"\s+")
    opening = F.regexp_replace(tokens[0], "[^A-Za-z0-9]", "")
    opens = full.where("place = 0 and chapter_no > 0").select(key, "chapter_no", "title", opening.alias("opening"), F.array_join(F.slice(tokens, 1, 3), " ").alias("start"))
    odd = opens.where("length(opening) > 1 and opening rlike '^[A-Z0-9]+$'").withColumn("word", F.lower("opening")).join(counted, [key, "word"], "left_anti")
    if words is not None:
        odd = odd.join(words.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    suspicious = odd.select(key, F.lit("opening").alias("kind"), F.col("chapter_no").alias("place"), F.concat(F.lit('Chapter "'), "title", F.lit('" starts with "'), "start", F.lit(' …" — check the first word.')).alias("message"))
    warnings = missing.unionByName(suspicious)
    if dropped is not None:
        message = F.format_string("Dropped %d running page header line(s) repeated at least 3 times.", "dropped")
        warnings = dropped.select(key, F.lit("headers").alias("kind"), F.lit(0).alias("place"), message.alias("message")).unionByName(warnings)
    return chapters, warnings


def import_texts(texts: DataFrame, key: str, *, ocr: str = "ocr", headings: DataFrame | None = None, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``import_chapters`` of whole texts (key, text, ocr): scanned ones (flag true) are mended first, others split as they are."""
    scanned, dropped = scanned_paragraphs(texts.where(F.col(ocr)), key, words=words)
    plain = split_plain(texts.where(~F.coalesce(F.col(ocr), F.lit(False))), key)
    return import_chapters(scanned.select(key, F.col("pos").cast("long").alias("pos"), "text").unionByName(plain.select(key, F.col("pos").cast("long").alias("pos"), "text")), key, headings=headings, words=words, dropped=dropped)


def import_html(pages: DataFrame, key: str, *, html: str = "html", headings: DataFrame | None = None, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``import_chapters`` of transcription pages (key, html), their divided words joined."""
    from granthika.sources.texts import split_html

    rows = split_html(pages, key, html)
    return import_chapters(join_divided(rows, vocabulary(rows, key), key, words), key, headings=headings, words=words)
