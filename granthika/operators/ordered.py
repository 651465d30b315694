"""Operators on ordered rows: batching, rolling context, chains, navigation and islands. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granthika.functions import text as X


def assert_aligned(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``after``, which must hold every key of ``before`` exactly once and no other; anything else is an error when rows are read."""
    a = before.groupBy(*keys).agg(F.count("*").alias("_want"))
    b = after.withColumn("_got", F.count("*").over(Window.partitionBy(*keys)))
    joined = a.join(b, keys, "full_outer")
    ok = F.coalesce((F.col("_want") == 1) & (F.col("_got") == 1), F.lit(False))
    return joined.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("rows are out of step with their source")).cast("boolean"))).select(*after.columns)


def batches(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """``rows`` with ``position`` counted from 0 within ``keys`` and the number of its batch of ``size``."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("position", position).withColumn("batch_no", F.floor(F.col("position") / size).cast("int"))


def rolling_context(rows: DataFrame, keys: list[str], size: int, tail: int) -> DataFrame:
    """For each batch the last ``tail`` texts of the batch before, joined by spaces; empty for the first of a key."""
    grouped = rows.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("items"))
    texts = F.transform(F.slice("items", F.greatest(F.size("items") - tail + 1, F.lit(1)), tail), lambda x: x["text"])
    ends = grouped.withColumn("end", F.array_join(texts, " "))
    order = Window.partitionBy(*keys).orderBy("batch_no")
    return ends.select(*keys, "batch_no", F.size("items").alias("n"), F.coalesce(F.lag("end").over(order), F.lit("")).alias("prior_context"))


def carried_tail(rows: DataFrame, book: str, chapter: str, tail: int) -> DataFrame:
    """For each chapter the last ``tail`` texts of the chapter before it in the book. No more than these are gathered."""
    last = F.row_number().over(Window.partitionBy(book, chapter).orderBy(F.desc("pos"), F.desc("text")))
    ends = rows.withColumn("_back", last).where(F.col("_back") <= tail).groupBy(book, chapter).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("items"))
    order = Window.partitionBy(book).orderBy(chapter)
    joined = F.array_join(F.transform("items", lambda x: x["text"]), " ")
    return ends.select(book, chapter, F.coalesce(F.lag(joined).over(order), F.lit("")).alias("incoming_context"))


def first_delivery(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def checkpoint_chain(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reached, steps, complete): how far the spans (start, end and, where there is one, fits) follow on each other from 0.

    The spans of a key are walked by start; one that begins where the last taken ended is taken, the shorter of several. Spans of other
    batch sizes may lie between; those that don't fit what is to be covered now (see ``fitting_spans``) are passed over. Complete
    means that the walk reaches the largest end of all.
    """
    fits = F.col("fits") if "fits" in spans.columns else F.lit(True)
    ordered = F.array_sort(F.collect_set(F.when(fits, F.struct("start", "end"))))
    walk = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit(0).alias("steps")),
        lambda s, x: F.when((x["start"] == s["at"]) & (x["end"] > x["start"]), F.struct(x["end"].alias("at"), (s["steps"] + 1).alias("steps"))).otherwise(s),
    )
    out = spans.groupBy(*keys).agg(ordered.alias("spans"), F.max("end").alias("last")).withColumn("w", walk)
    return out.select(*keys, F.col("w.at").alias("reached"), F.col("w.steps").alias("steps"), (F.col("w.at") == F.col("last")).alias("complete"))


def neighbours(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``rows`` with the ``name`` of the row before and after."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("previous", F.lag(name).over(w)).withColumn("next", F.lead(name).over(w))


def unique_slugs(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """``rows`` with ``unique_slug``: by ``order``, a slug that is taken gets the least of -2, -3 … that is free.

    Slugs can only meet that are alike but for numbers at the end. Where all of such a family are the same, their numbers are
    counted; only families with several are walked in order.
    """
    root = F.regexp_replace(slug, "(?:-[0-9]+)+$", "")
    family = Window.partitionBy("_root")
    marked = rows.withColumn("_root", root).withColumn("_several", F.min(slug).over(family) != F.max(slug).over(family))
    k = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    counted = marked.where("not _several").withColumn("unique_slug", F.when(k == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), k.cast("string"))))
    walked = marked.where("_several").groupBy("_root").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(slug).alias("s")))).alias("items"))
    none = F.array().cast("array<string>")

    def free(used: Column, base: Column) -> Column:
        numbers = F.sequence(F.lit(2), F.size(used) + 2)
        return F.when(~F.array_contains(used, base), base).otherwise(F.concat(base, F.lit("-"), F.filter(numbers, lambda n: ~F.array_contains(used, F.concat(base, F.lit("-"), n.cast("string"))))[0].cast("string")))

    named = F.aggregate("items", none, lambda used, x: F.concat(used, F.array(free(used, x["s"]))))
    given = walked.select(F.explode(F.arrays_zip("items", named.alias("names"))).alias("z")).select(F.col("z.items.o").alias(order), F.col("z.items.s").alias(slug), F.col("z.names").alias("unique_slug"))
    rest = marked.where("_several").join(given, [order, slug])
    columns = [*rows.columns, "unique_slug"]
    return counted.select(*columns).unionByName(rest.select(*columns))


def join_torn(rows: DataFrame, keys: list[str], order: str, torn: str, text: str) -> DataFrame:
    """Texts joined over gaps: a row whose ``torn`` flag is set continues the row before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.sum(F.when(F.col(torn), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("island", island).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("items"))
    return grouped.select(*keys, "island", F.size("items").alias("pieces"), F.array_join(F.transform("items", lambda x: x[text]), " ").alias(text))


def contents_list(rows: DataFrame, keys: list[str], order: str, text: str, least: int = 3) -> DataFrame:
    """(keys, title, place): entries "title page" that follow a contents heading without gap, where there are ``least`` or more."""
    w = Window.partitionBy(*keys).orderBy(order)
    bare = F.trim(F.col(text))
    marked = rows.select(*keys, F.col(order).alias("place"), bare.alias("line"), bare.rlike(X.CONTENTS_HEADING).alias("head"), bare.rlike(X.CONTENTS_ENTRY).alias("entry"))
    w = Window.partitionBy(*keys).orderBy("place")
    heads = marked.withColumn("section", F.count_if("head").over(w)).where("section >= 1 and not head and upper(line) not in ('PAGE', 'PAGE.', '')")
    w2 = Window.partitionBy(*keys, "section").orderBy("place")
    run = heads.withColumn("broken", F.count_if(~F.col("entry")).over(w2)).where("broken = 0")
    counted = run.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "section"))).where(F.col("n") >= least)
    first = counted.withColumn("f", F.min("section").over(Window.partitionBy(*keys))).where("section = f")
    title = F.trim(F.regexp_extract("line", X.CONTENTS_ENTRY, 1), F.lit(" .·•…\t"))
    return first.select(*keys, title.alias("title"), "place").where("title <> ''")


def heading_numbers(rows: DataFrame, keys: list[str], order: str, wanted: str, heading: str) -> DataFrame:
    """``rows`` with ``heading_no``: of the headings among the ``wanted`` rows of a batch their number there, counted from 1."""
    number = F.count_if(F.col(wanted)).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("heading_no", F.when(F.col(wanted) & F.col(heading), number.cast("int")))


def assign_edited(spans: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, place, edited): a chapter's flat texts (keys, place, edited) dealt to its batches (keys, start, end) in order.

    The batches take as many texts as they span, one behind the other; where a chapter's totals differ the run fails.
    """
    before = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    slots = spans.withColumn("_from", F.coalesce(before, F.lit(0))).where(F.col("end") > F.col("start")).select(*keys, "start", "end", F.posexplode(F.sequence(F.col("_from"), F.col("_from") + F.col("end") - F.col("start") - 1)).alias("_slot", "place"))
    joined = slots.join(edited.select(*keys, F.col("place").cast("long").alias("place"), F.col("edited"), F.lit(True).alias("_there")), [*keys, "place"], "full_outer")
    ok = F.col("start").isNotNull() & F.col("_there").isNotNull()
    return joined.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("texts and batches are out of step")).cast("boolean"))).select(*keys, "start", "end", (F.col("start") + F.col("_slot")).alias("place"), "edited")


def fitting_spans(batches: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """``batches`` (keys, start, end, rows: array of source and edited) with ``fits``: saved rows that can be taken over.

    Their sources are the texts that ``paragraphs`` (keys, pos, text) has from start to end now, and no row is missing. Texts are compared by
    fingerprint, so only numbers travel.
    """
    rows = batches.select(*keys, "start", "end", F.xxhash64("rows").alias("_print"), F.posexplode("rows").alias("_k", "_row")).distinct()
    now = paragraphs.groupBy(*keys, "pos").agg(F.min(F.xxhash64("text")).alias("_now"), F.count("*").alias("_times"))
    met = rows.withColumn("pos", F.col("start") + F.col("_k")).join(now, [*keys, "pos"], "left")
    same = F.coalesce((F.xxhash64(F.col("_row")["source"]) == F.col("_now")) & (F.col("_times") == 1), F.lit(False))
    judged = met.groupBy(*keys, "start", "end", "_print").agg((F.bool_and(same) & (F.count("*") == F.max("end") - F.max("start"))).alias("fits"))
    marked = batches.withColumn("_print", F.xxhash64("rows")).join(judged, [*keys, "start", "end", "_print"], "left")
    return marked.withColumn("fits", F.coalesce("fits", F.lit(False))).drop("_print")


def restored(rows: DataFrame, needed: Column) -> DataFrame:
    """Saved ``rows`` (source, draft, edited, emotion) whose source needs no translation put back to it, with ``restored`` where that changed one."""
    change = ~needed & ~F.col("edited").eqNullSafe(F.col("source"))
    return rows.withColumn("restored", F.coalesce(change, F.lit(False))).withColumns(
        {c: F.when(F.coalesce(change, F.lit(False)), v).otherwise(F.col(c)) for c, v in (("draft", F.col("source")), ("edited", F.col("source")), ("emotion", F.lit("Narration")))}
    )
