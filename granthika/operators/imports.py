"""Turning imported text into chapters: divided words, front junk, wrapped lines, headings, suspicious openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from granthika.functions import text as X


def dehyphenate(text: Column) -> Column:
    """"re- cently" becomes "recently" where the text itself has that word, else "re-cently"."""
    known = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.lower(w)))
    pairs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]+- +[a-z]+)\b"), F.lit(1)))

    def fix(done: Column, pair: Column) -> Column:
        joined = F.regexp_replace(pair, "- +", "")
        low = F.lower(joined)
        written = F.when(F.array_contains(known, low) | F.array_contains(known, F.rtrim(low, F.lit("s"))), joined).otherwise(F.regexp_replace(pair, "- +", "-"))
        return F.regexp_replace(done, F.concat(F.lit("\\b"), pair, F.lit("\\b")), written)

    return F.aggregate(pairs, text, fix)


def is_front_junk(text: Column) -> Column:
    """No letters, fewer letters than other characters, or a short line that begins with a mark."""
    solid = F.regexp_replace(text, r"(?U)\s+", "")
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    short = ~solid.rlike(r"^[\p{L}\p{N}]") & (F.length(solid) < 8)
    return (F.length(solid) == 0) | (letters < 0.5 * F.length(solid)) | short


def drop_front_junk(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows from the first one on that is no junk."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_good", F.max(~is_front_junk(F.col("text"))).over(w)).where("_good").drop("_good")


def hard_wrapped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wrapped): at least three lines of 50 to 90 characters, 60 % of which end without end mark."""
    middle = F.length("text").between(50, 90)
    open_end = middle & ~F.col("text").rlike(r"[.!?\"'”’):;]$")
    counted = rows.groupBy(*keys).agg(F.count_if(middle).alias("n"), F.count_if(open_end).alias("o"))
    return counted.select(*keys, ((F.col("n") >= 3) & (F.col("o") >= 0.6 * F.col("n"))).alias("wrapped"))


def headings_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, heading) of the rows that look like chapter headings."""
    return rows.select(*keys, order, X.pattern_heading(F.col("text")).alias("heading")).where("heading is not null")


def split_at(rows: DataFrame, headings: DataFrame, keys: list[str], order: str, starts: DataFrame | None = None) -> DataFrame:
    """(keys, order, chapter_no, heading): where the headings (keys, heading_no, heading) stand, searched forward only.

    A heading is met by the first paragraph behind the one before that begins with its letters; a lone numeral by one that is
    nothing else. One that is not found leaves nothing to search for those behind it; one without letters is passed over. Both come
    out without place. ``starts`` (keys, start) names the first row to search, the first of all where it has none.
    """
    letters, key = X.letters_key(F.col("text")), X.heading_key(F.col("heading"))
    texts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.substring(letters, 1, 24).alias("key"), F.length(letters).alias("size")))).alias("texts"))
    numeral = F.trim("heading").rlike(X.ROMAN_ONLY)
    wanted = headings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("heading_no", "heading", key.alias("key"), numeral.alias("numeral")))).alias("wanted"))
    both = wanted.join(texts, keys, "left")
    both = both.withColumn("start", F.lit(0)) if starts is None else both.join(starts, keys, "left").withColumn("start", F.coalesce(F.col("start").cast("int"), F.lit(0)))
    start = F.struct(F.col("start").alias("at"), F.array().cast(f"array<struct<place:{rows.schema[order].dataType.simpleString()},no:int,heading:string>>").alias("found"))

    def step(state: Column, want: Column) -> Column:
        place = F.array_min(F.filter(F.transform("texts", lambda t, i: F.when((i >= state["at"]) & F.startswith(t["key"], want["key"]) & (~want["numeral"] | (t["size"] == F.length(want["key"]))), i)), lambda i: i.isNotNull()))
        row = F.struct(F.try_element_at("texts", place + 1)[order].alias("place"), want["heading_no"].cast("int").alias("no"), want["heading"].alias("heading"))
        lost = F.struct(F.lit(None).cast(rows.schema[order].dataType).alias("place"), want["heading_no"].cast("int").alias("no"), want["heading"].alias("heading"))
        return F.when(want["key"] == "", F.struct(state["at"].alias("at"), F.concat(state["found"], F.array(lost)).alias("found"))).otherwise(
            F.struct(F.coalesce(place + 1, F.size("texts")).alias("at"), F.concat(state["found"], F.array(row)).alias("found"))
        )

    found = both.select(*keys, F.explode(F.aggregate("wanted", start, step, lambda s: s["found"])).alias("f"))
    return found.select(*keys, F.col("f.place").alias(order), F.col("f.no").alias("chapter_no"), F.col("f.heading").alias("heading"))


def suspicious_openings(rows: DataFrame, keys: list[str], order: str, known: DataFrame) -> DataFrame:
    """(keys, opening): first words of chapters in capitals, whatever marks stand about them, that the ``known`` words (column word) lack."""
    word = F.regexp_replace(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " ")[0], "[^A-Za-z0-9]", "")
    first = rows.groupBy(*keys).agg(F.min_by("text", order).alias("text")).select(*keys, word.alias("opening")).where("opening rlike '^[A-Z0-9]{2,}$'")
    return first.join(known.select(F.upper("word").alias("opening")).distinct(), "opening", "left_anti").select(*keys, "opening")
