"""The queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from granthika.session import table

from . import align, languages, leaks, lookalikes, mixing, pairs, pieces, scans, sentences, terms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PLACE = ["origin", "rec_id", "row_no"]


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows where there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


_WORDS = r"""list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\s]+', '', 'g'), '\s+'), lambda w: w <> '')"""


@query(
    "p8_found",
    rf"""
    with item as (select item_id, {_WORDS} as w from eval_items where text is not null),
    doc as (select doc_id, {_WORDS} as w from documents where text is not null),
    window_of_item as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as part
        from (select item_id, w, unnest(range(1, len(w) - 10)) as i from item)),
    window_of_doc as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as part
        from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from doc))
    select distinct item_id, doc_id from window_of_item join window_of_doc using (part)
    """,
)
def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.exact_leaks(leaks.find_leaks(table(spark, base, "eval_items"), table(spark, base, "documents")))


_TERMS = r"""with cleaned as (select id, nullif(trim(regexp_replace(lower(source_term), '[\s\p{Z}]+', ' ', 'g')), '') as term,
        book_id, coalesce(frequency, 0) as n, updated_at from glossary_terms),
    once as (select term, book_id, n from (select *, row_number() over (partition by id order by updated_at desc nulls last,
        term desc, book_id desc, n desc) as k from cleaned) where k = 1 and term is not null),
    counted as (select term, sum(n)::bigint as total, count(distinct book_id) as records from once group by term)"""


@query("p6_found", _TERMS + """
    select term, 'rare' as mark from counted where total < 3
    union all select term, 'common' from counted where records > 0.25 * (select count(distinct book_id) from glossary_terms)""")
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return terms.marked_terms(terms.term_frequencies(table(spark, base, "glossary_terms")))


@query("p6_frequencies", _TERMS + """
    select term, total, records, total < 3 as rare,
        records > 0.25 * (select count(distinct book_id) from glossary_terms) as common from counted""")
def p6_frequencies(spark: SparkSession, base: str) -> DataFrame:
    return terms.term_frequencies(table(spark, base, "glossary_terms"))


def _lookalike_texts(spark: SparkSession, base: str) -> DataFrame:
    paragraphs = table(spark, base, "paragraphs").where("kind = 'text'").select(F.lit("paragraphs").alias("origin"), F.col("para_id").alias("id"), "text")
    answers = table(spark, base, "qa_results").select(F.lit("qa_results").alias("origin"), F.col("qa_id").alias("id"), F.col("kannada_target").alias("text"))
    return paragraphs.unionByName(answers)


@query("p5_found")
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_lookalike_texts(spark, base))


@query("p5_classes")
def p5_classes(spark: SparkSession, base: str) -> DataFrame:
    """Every text's class of equal reading; its pairs are those of p5_found where a class has several stored texts."""
    return lookalikes.lookalike_classes(_lookalike_texts(spark, base))


def edited_rows(spark: SparkSession, base: str) -> DataFrame:
    """(origin, rec_id, row_no, text, target_language) of the edited texts of the batches."""
    batches = table(spark, base, "translated_batches").select("batch_id", "target_language", F.posexplode("rows").alias("at", "row"))
    return batches.select(F.lit("translated_batches").alias("origin"), F.col("batch_id").alias("rec_id"), (F.col("at") + 1).cast("int").alias("row_no"), F.col("row.edited").alias("text"), "target_language")


@query("p3_found")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    paragraphs = table(spark, base, "paragraphs").where("kind = 'text'")
    texts = paragraphs.select(F.lit("paragraphs").alias("origin"), F.col("para_id").alias("rec_id"), F.lit(0).alias("row_no"), "text").unionByName(edited_rows(spark, base).drop("target_language"))
    return sentences.split_sentences(texts, ["origin", "rec_id", "row_no"])


def _language_models(spark: SparkSession, base: str):
    documents = table(spark, base, "documents")
    total = documents.count()
    scripts = languages.read_scripts(table(spark, base, "target_languages"))
    batches = sentences.sampled_texts(edited_rows(spark, base), "text", 10_000)
    boundaries = sentences.BoundaryModel.fit(sentences.sampled_texts(documents, "text", 4_000, total) + batches)
    return languages.fit_languages(documents, boundaries, scripts, total=total), boundaries


def _labelled_texts(spark: SparkSession, base: str) -> DataFrame:
    """(origin, rec_id, row_no, filed, lang, confidence, whole, segments) of all documents and edited rows."""
    documents = table(spark, base, "documents")
    field, boundaries = _language_models(spark, base)
    filed = documents.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("rec_id"), F.lit(0).alias("row_no"), languages.label_language(F.col("lang")).alias("filed"), "text")
    rows = edited_rows(spark, base).withColumn("filed", languages.label_language(F.col("target_language"))).drop("target_language")
    return languages.label_languages(filed.unionByName(rows), [*_PLACE, "filed"], field, boundaries)


@query("p1_found")
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return languages.mislabelled(_labelled_texts(spark, base), _PLACE)


@query("p1_segments")
def p1_segments(spark: SparkSession, base: str) -> DataFrame:
    """A row for each segment, with its text's own language and confidence; a text without segment has one row."""
    labelled = _labelled_texts(spark, base)
    return labelled.select(*_PLACE, F.col("lang").alias("text_lang"), F.col("confidence").alias("text_confidence"), F.inline_outer("segments"))


@query("p10_split")
def p10_split(spark: SparkSession, base: str) -> DataFrame:
    documents = table(spark, base, "documents")
    settings = pieces.read_settings(table(spark, base, "split_settings"))
    return pieces.split_texts(documents, settings, ["doc_id"], total=documents.count())


@query("p9_mix")
def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_sources(table(spark, base, "documents"), table(spark, base, "mix_targets"))[0]


@query("p9_shares")
def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_sources(table(spark, base, "documents"), table(spark, base, "mix_targets"))[1]


@query("p7_found")
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return pairs.find_defects(table(spark, base, "qa_results"))


@query("p4_found")
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    batches = table(spark, base, "translated_batches")
    return align.align_batches(batches, *align.fit_alignment(batches))


@query("p2_found")
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    name = F.trim(F.regexp_replace(F.regexp_replace("epub", r"\.[A-Za-z0-9]+$", ""), r"[_\-.]+", " "))
    named = table(spark, base, "run_manifests").where("book_id is not null and epub is not null").select(F.col("book_id").alias("book"), F.array(name).alias("extra")).distinct()
    return scans.repair_scans(table(spark, base, "imported_chapters"), more_titles=named)
