"""Glossary mining, vocabulary and keyed changes of a glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granthika.functions.glossary import glossary_key

# Words that are capitalised because they begin a sentence.
LEADING = (
    "The", "A", "An", "This", "That", "These", "Those", "His", "Her", "Its", "Their", "He", "She", "It", "They", "We", "You", "I", "But", "And", "So",
    "Every", "All", "Some", "My", "Your", "Our", "There", "Then", "When", "While", "If", "As",
)
WORD_EDGE_LEFT, WORD_EDGE_RIGHT = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"


def _matches(texts: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(f"{WORD_EDGE_LEFT}({pattern}){WORD_EDGE_RIGHT}"), F.lit(1))).alias("term"))


def acronyms(texts: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, term, frequency): words of two to six capitals that come ``least`` times or more for a key."""
    return _matches(texts, "[A-Z]{2,6}", keys).groupBy(*keys, "term").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def phrases(texts: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, term, frequency): runs of capitalised words, one leading sentence opener left off."""
    first, rest = F.split("term", " ", 2)[0], F.split("term", " ", 2)[1]
    cut = F.when(first.isin(*LEADING) & (F.coalesce(rest, F.lit("")) != ""), rest).otherwise(F.col("term"))
    found = _matches(texts, r"[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)+", keys).withColumn("term", cut)
    return found.groupBy(*keys, "term").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def repeated_capitals(texts: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, term, frequency): capitalised words that don't begin their sentence and belong to no accepted phrase."""
    sentence = F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("sentence")
    words = texts.select(*keys, sentence).select(*keys, F.regexp_extract_all("sentence", F.lit("([A-Za-z]+)"), F.lit(1)).alias("words")).withColumn("words", F.slice("words", F.lit(2), F.size("words")))
    named = words.select(*keys, F.explode("words").alias("term")).where("term rlike '^[A-Z]' and term <> upper(term) and length(term) > 1")
    taken = phrases(texts, keys, least).select(*keys, F.explode(F.split("term", r"\s+")).alias("term")).distinct()
    counted = named.groupBy(*keys, "term").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    return counted.join(taken, [*keys, "term"], "left_anti")


def glossary_candidates(texts: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """All three kinds, with their term_type."""
    kinds = (("acronym", acronyms), ("proper_noun_phrase", phrases), ("repeated_capitalized", repeated_capitals))
    parts = [find(texts, keys, least).withColumn("term_type", F.lit(kind)) for kind, find in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merge_candidates(glossary: DataFrame, candidates: DataFrame) -> DataFrame:
    """The glossary with ``candidates`` added: known keys gain frequency, new ones come in as pending.

    ``candidates``: source_term, term_type, frequency, first_seen_chapter, seq. Of several with one key the first by seq gives
    the spelling, type and chapter.
    """
    new = candidates.withColumn("key", glossary_key(F.col("source_term"))).groupBy("key").agg(
        F.sum("frequency").cast("int").alias("n"), F.min_by("source_term", "seq").alias("c_term"), F.min_by("term_type", "seq").alias("c_type"), F.min_by("first_seen_chapter", "seq").alias("c_chapter")
    )
    both = glossary.join(new, glossary.source_term_key == new.key, "full_outer")
    return both.select(
        F.coalesce("source_term_key", "key").alias("source_term_key"), F.coalesce("source_term", "c_term").alias("source_term"), "target_term",
        F.coalesce("term_type", "c_type").alias("term_type"), F.coalesce("status", F.lit("pending")).alias("status"),
        (F.coalesce("frequency", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("frequency"), F.coalesce("first_seen_chapter", "c_chapter").alias("first_seen_chapter"), "notes",
    )


def apply_reviews(glossary: DataFrame, reviews: DataFrame) -> DataFrame:
    """The glossary with the non-null fields of ``reviews`` (source_term_key, status, target_term, notes) put in; unknown keys change nothing."""
    r = reviews.groupBy("source_term_key").agg(F.max(F.struct("status", "target_term", "notes")).alias("r"))
    out = glossary.join(r, "source_term_key", "left")
    return out.withColumns({c: F.coalesce(F.col("r")[c], F.col(c)) for c in ("status", "target_term", "notes")}).drop("r")


def review_outcome(rows: DataFrame) -> DataFrame:
    """Review rows with ``imported`` and ``skip_reason``: unknown states and approvals without target are skipped."""
    known = F.coalesce(F.col("status").isin("pending", "approved", "rejected"), F.lit(False))
    empty = F.coalesce(F.trim("target_term"), F.lit("")) == ""
    reason = F.when(~known, "invalid status").when((F.col("status") == "approved") & empty, "approved without target")
    return rows.withColumn("skip_reason", reason).withColumn("imported", F.col("skip_reason").isNull())


def known_words(texts: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, word, n): lower-case words that come ``least`` times or more for a key."""
    word = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word")
    return texts.select(*keys, word).groupBy(*keys, F.lower("word").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _trigrams(word: Column) -> Column:
    """The distinct runs of three characters of a word; a shorter one is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3)))
    return F.array_distinct(runs)


def _runs(word: Column, sizes: list[int]) -> Column:
    """The runs of ``sizes`` characters of a word, each once."""

    def of(size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - size + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(size)))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *map(of, sizes)))


def relevant_terms(texts: DataFrame, glossary: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """Pairs of a text and a term of its key (columns ``on``) that it contains, whatever the case; ``key`` tells the texts of one ``on`` apart.

    A text that contains a term holds the term's longest word inside one of its own. So the distinct words of the texts meet the
    longest words of the terms by these's rarest run of three characters, the texts that have such a word meet the term, and what
    they say is compared last. No text meets a term with which it shares no such word. A blank term is in no text.
    """
    blank = r"(?U)\s+"
    words = texts.select(*on, *key, F.explode(F.array_distinct(F.split(F.lower("text"), blank))).alias("_word")).where("_word <> ''").distinct()
    terms = glossary.withColumn("_piece", F.array_max(F.transform(F.split(F.lower("source_term"), blank), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).where("_piece <> ''")
    pieces = terms.select(*on, "_piece").distinct().select(*on, "_piece", F.explode(_trigrams(F.col("_piece"))).alias("_run"))
    rarity = pieces.groupBy("_run").agg(F.count("*").alias("_often"))
    anchors = pieces.join(rarity, "_run").groupBy(*on, "_piece").agg(F.min_by("_run", F.struct("_often", "_run")).alias("_run"))
    sizes = sorted(r.n for r in anchors.select(F.length("_run").alias("n")).distinct().collect())  # of 1, 2 and 3
    vocabulary = words.select(*on, "_word").distinct().select(*on, "_word", F.explode(_runs(F.col("_word"), sizes)).alias("_run"))
    holding = vocabulary.join(anchors, [*on, "_run"]).where(F.contains("_word", F.col("_piece"))).select(*on, "_word", "_piece")
    met = words.join(holding, [*on, "_word"]).select(*on, *key, "_piece").distinct().join(terms, [*on, "_piece"]).drop("_piece")
    return texts.join(met, [*on, *key]).where(F.contains(F.lower("text"), F.lower("source_term")))
