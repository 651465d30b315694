"""Books on the shelf: names with fallbacks, where a run's source lies, corrected chapter titles, selections and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def stem(path: Column) -> Column:
    """The file name of a path without its last ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def named(metadata: DataFrame) -> DataFrame:
    """``metadata`` (path, title, creator, …) with the file's name for a missing title and "Unknown author" for a missing creator."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return metadata.withColumns({"title": F.coalesce(blank("title"), stem(F.col("path"))), "creator": F.coalesce(blank("creator"), F.lit("Unknown author"))})


def shelf(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, title, creator, readable) of all ``files`` (path), sorted by title, whatever the case; books without metadata can't be read."""
    known = metadata.select("path", "title", "creator", F.lit(True).alias("readable"))
    rows = named(files.select("path").distinct().join(known, "path", "left")).withColumn("readable", F.coalesce("readable", F.lit(False)))
    return rows.orderBy(F.lower("title"), "path")


def source_files(runs: DataFrame, files: DataFrame, books: str) -> DataFrame:
    """(folder, source): for each of ``runs`` (folder, epub) the first that is among ``files`` (path): the path it names, its file name in the
    folder ``books``, the run's own folder name there; null where none is.
    """
    base = books.rstrip("/") + "/"
    name = F.regexp_extract("epub", r"([^/]*)$", 1)
    tries = F.array(F.col("epub"), F.when(name != "", F.concat(F.lit(base), name)), F.concat(F.lit(base), F.col("folder"), F.lit(".epub")))
    wanted = runs.select("folder", F.posexplode(tries).alias("turn", "path")).where("path <> ''")
    found = wanted.join(files.select("path").distinct(), "path", "left_semi").groupBy("folder").agg(F.min_by("path", "turn").alias("source"))
    return runs.select("folder").distinct().join(found, "folder", "left")


def chapter_titles(saved: DataFrame, sources: DataFrame) -> DataFrame:
    """(folder, id, title): of each saved chapter (folder, id, title) the title its source (folder, id, title) has by now, or its id there
    where that has none; without source the saved one, else the id.
    """
    now = sources.groupBy("folder", "id").agg(F.coalesce(F.max("title"), F.first("id")).alias("now"))
    return saved.join(now, ["folder", "id"], "left").select("folder", "id", F.coalesce("now", "title", "id").alias("title"))


def without_sections(chapters: DataFrame, skipped: DataFrame) -> DataFrame:
    """``chapters`` (book_id, chapter_id, …) without the ``skipped`` ones (book_id, chapter_id); an unknown id or a book with none left fails the run."""
    keys = ["book_id", "chapter_id"]
    marks = skipped.select(*keys).distinct().withColumn("_skip", F.lit(True))
    joined = chapters.withColumn("_there", F.lit(True)).join(marks, keys, "full_outer")
    left = F.count_if(F.col("_skip").isNull()).over(Window.partitionBy("book_id"))
    wrong = F.when(F.col("_there").isNull(), F.concat(F.lit("no such section: "), F.col("chapter_id"))).when(left == 0, F.lit("no section is left"))
    checked = joined.withColumn("_wrong", wrong).where(F.when(F.col("_wrong").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("_wrong")).cast("boolean")))
    return checked.where("_skip is null").select(*chapters.columns)


def selected_totals(sections: DataFrame) -> DataFrame:
    """(book_id, sections, selected, paragraphs) of sections (book_id, selected, paragraphs): all, the chosen, and these's paragraphs."""
    on = F.coalesce("selected", F.lit(False))
    return sections.groupBy("book_id").agg(F.count("*").alias("sections"), F.count_if(on).alias("selected"), F.sum(F.when(on, F.col("paragraphs")).otherwise(0)).alias("paragraphs"))


def flagged_places(checks: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, places): the places of each chapter that are flagged for review, each once, in order."""
    return checks.where("status = 'FLAGGED_FOR_REVIEW'").groupBy(*keys).agg(F.array_sort(F.collect_set(place)).alias("places"))


def one_copy(files: DataFrame, *, name: str = "name", size: str = "length", order: str = "path") -> DataFrame:
    """``files`` of which those with the same name and size come once, the first by ``order``."""
    return files.withColumn("_k", F.row_number().over(Window.partitionBy(name, size).orderBy(order))).where("_k = 1").drop("_k")
