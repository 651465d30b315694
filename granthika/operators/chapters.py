"""Operators on chapters and runs: context mode, selection, editions, libraries, problem lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from granthika.functions import text as X


def context_mode(chapters: DataFrame) -> DataFrame:
    """(book_id, chapters, numbered, mode) from (book_id, chapter_ord, title, first_text).

    Front matter is left out; a book carries context over its chapters when three or more remain and at least 60 % of them are
    numbered, by their title or their first paragraph.
    """
    titled = F.coalesce(F.trim("title"), F.lit("")) != ""
    front = F.coalesce(X.is_front_matter(F.col("title")), F.lit(False))
    numbered = F.coalesce(X.is_chapter_heading(F.col("title")), F.lit(False)) | (titled & F.coalesce(X.is_chapter_heading(F.col("first_text")), F.lit(False)))
    counted = chapters.where(~front).groupBy("book_id").agg(F.count("*").alias("chapters"), F.count_if(numbered).alias("numbered"))
    return counted.withColumn("mode", F.when((F.col("chapters") >= 3) & (F.col("numbered") / F.col("chapters") >= 0.6), "carry").otherwise("reset"))


def select_chapters(paragraphs: DataFrame, excluded: DataFrame) -> DataFrame:
    """The paragraphs whose (book_id, chapter_id) is not among ``excluded``."""
    return paragraphs.join(excluded, ["book_id", "chapter_id"], "left_anti")


def preview(paragraphs: DataFrame, most: int) -> DataFrame:
    """(book_id, translated, total, preview) when each chapter is cut to its first ``most`` paragraphs."""
    per = paragraphs.groupBy("book_id", "chapter_id").agg(F.count_if(F.col("pos") < most).alias("kept"), F.count("*").alias("all"))
    return per.groupBy("book_id").agg(F.sum("kept").alias("translated"), F.sum("all").alias("total"), F.bool_or(F.col("kept") < F.col("all")).alias("preview"))


def edition_notes(
    paragraphs: DataFrame, this_year: int, window_chapters: int = 3, window_paragraphs: int = 60, imprint: int = 120, heading: int = 60, most: int = 5, dates: DataFrame | None = None,
) -> DataFrame:
    """(book_id, front_matter, recent_years, notices, recent_notice, edition_year, needs_review): what a book says of its edition.

    ``paragraphs``: book_id, chapter_ord, chapter_id, chapter_title, pos, text; ``dates`` (book_id, date) the package's dates. Looked at are the first
    paragraphs of the first chapters, and all of a chapter whose title names front matter. ``front_matter``: the kinds of titles and
    short paragraphs, as first met. ``recent_years``: (label, year, snippet) of the first ``most`` short paragraphs with a year of the last 95,
    one year each; ``notices``: (label, snippet) of the first ``most`` copyright notices. A notice is recent if the latest year of all
    notices is, or, where none has a year, as it stands. Recent years, a recent notice or a recent edition year (four
    digits alone) need a review; headings don't.
    """
    cutoff = this_year - 95
    chapter = Window.partitionBy("book_id").orderBy("chapter_ord")
    titled = paragraphs.withColumn("_title_kind", X.front_matter_kind(F.col("chapter_title"))).withColumn("_chapter", F.dense_rank().over(chapter))
    opening = titled.where((F.col("_title_kind").isNotNull()) | ((F.col("_chapter") <= window_chapters) & (F.col("pos") < window_paragraphs)))
    recent = F.filter(X.years(F.col("text")), lambda y: (y >= cutoff) & (y <= this_year))
    year = F.when(F.length("text") <= imprint, F.try_element_at(recent, F.lit(1)))
    notice = F.col("text").rlike(X.COPYRIGHT)
    noticed = F.when(notice, F.filter(X.years(F.col("text")), lambda y: y <= this_year))
    place = F.struct("chapter_ord", "pos")
    seen = opening.select(
        "book_id", place.alias("place"), F.coalesce("chapter_title", "chapter_id").alias("label"), X.snippet(F.col("text")).alias("snippet"), year.alias("year"), notice.alias("notice"), noticed.alias("noticed"),
        F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("_title_kind").alias("kind")), F.struct(F.lit(1).alias("n"), F.when(F.length("text") <= heading, X.front_matter_kind(F.col("text"))).alias("kind")))).alias("k"),
    ).select("*", F.col("k.kind").alias("kind"), F.col("k.n").alias("n")).drop("k")
    kinds = seen.where("kind is not null").groupBy("book_id", "kind").agg(F.min(F.struct("place", "n")).alias("first"))
    front = kinds.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"]).alias("front_matter"))
    once = seen.where("n = 1")
    found = once.where("year is not null").withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("place"))).where(F.col("k") <= most)
    years = found.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "year", "snippet"))).alias("y"))
    told = once.where("notice").withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("place")))
    notices = told.groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("place", "label", "snippet")))).alias("c"),
        F.coalesce(F.max(F.array_max("noticed")) >= cutoff, F.bool_or(F.size("noticed") == 0)).alias("recent_notice"),
    )
    books = paragraphs.select("book_id").distinct()
    dated = books.withColumn("edition_year", F.lit(None).cast("int")) if dates is None else books.join(dates.groupBy("book_id").agg(F.min(X.edition_year(F.col("date"))).alias("edition_year")), "book_id", "left")
    out = dated.join(front, "book_id", "left").join(years, "book_id", "left").join(notices, "book_id", "left")
    none_text, none_year, none_notice = F.array().cast("array<string>"), F.array().cast("array<struct<label:string,year:int,snippet:string>>"), F.array().cast("array<struct<label:string,snippet:string>>")
    listed = out.select(
        "book_id", F.coalesce("front_matter", none_text).alias("front_matter"),
        F.coalesce(F.transform("y", lambda x: F.struct(x["label"].alias("label"), x["year"].alias("year"), x["snippet"].alias("snippet"))), none_year).alias("recent_years"),
        F.coalesce(F.transform("c", lambda x: F.struct(x["label"].alias("label"), x["snippet"].alias("snippet"))), none_notice).alias("notices"),
        F.coalesce("recent_notice", F.lit(False)).alias("recent_notice"), "edition_year",
    )
    return listed.withColumn("needs_review", (F.size("recent_years") > 0) | F.col("recent_notice") | F.coalesce(F.col("edition_year") >= cutoff, F.lit(False)))


def problem_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book_id, inherited, new): messages of ``after`` that ``before`` of the same book has too, line and column aside, and those it lacks."""
    old = before.select("book_id", X.message_key(F.col("message")).alias("key")).distinct().withColumn("known", F.lit(True))
    marked = after.select("book_id", X.message_key(F.col("message")).alias("key")).join(old, ["book_id", "key"], "left")
    return marked.groupBy("book_id").agg(F.count_if(F.col("known").isNotNull()).alias("inherited"), F.count_if(F.col("known").isNull()).alias("new"))


def batch_coordinates(batches: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(batch_id, book_id, chapter_id, row_no, pos, index): the document place of each row of a batch.

    A batch row is at paragraph_start + its number; ``paragraphs`` gives the index of that position, null where it has none.
    """
    rows = batches.select("batch_id", "book_id", "chapter_id", "paragraph_start", F.posexplode("rows").alias("k", "row"))
    placed = rows.select("batch_id", "book_id", "chapter_id", (F.col("k") + 1).alias("row_no"), (F.col("paragraph_start") + F.col("k")).alias("pos"))
    where = paragraphs.groupBy("book_id", "chapter_id", "pos").agg(F.min("index").alias("index"))
    return placed.join(where, ["book_id", "chapter_id", "pos"], "left")
