"""The translation of books as one plan over paragraphs: batches, context, glossary, engines, checks, quality.

Context comes from source text only, so all batches are independent of each other and run side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from granthika.engines import interfaces as E
from granthika.functions import text as X, vectors as V
from granthika.functions.glossary import glossary_key
from granthika.operators import ordered as O, quality as Q
from granthika.operators.candidates import relevant_terms
from granthika.session import settle


@dataclass
class BookPlan:
    """Settings and engines of a run."""

    translator: Callable[[], E.Translator] = E.LetterTranslator
    editor: Callable[[], E.Editor] = E.PlainEditor
    back_translator: Callable[[], E.Translator] | None = None
    embedder: Callable[[], E.Embedder] = E.GramEmbedder
    batch_size: int = 20
    tail: int = 3
    preview: int | None = None
    passes: float = 0.85
    flags: float = 0.70
    excluded: list[str] = field(default_factory=list)


def translate(paragraphs: DataFrame, plan: BookPlan, glossary: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter_id, index, position, batch_no, source, draft, emotion, edited, prior_context) of the paragraphs.

    ``paragraphs``: book_id, chapter_id, chapter_ord, index, pos, kind, text. ``glossary`` (book_id, source_term, target_term) gives each batch
    the terms that it holds. ``done`` (book_id, chapter_id, index, source, …) holds rows of an earlier run: chapters whose sources are
    unchanged are taken from it. Every paragraph comes out once, or the run fails.
    """
    rows = paragraphs.where("text is not null").where(~F.col("chapter_id").isin(plan.excluded) if plan.excluded else F.lit(True))
    if plan.preview is not None:
        rows = rows.where(F.col("pos") < plan.preview)
    keys = ["book_id", "chapter_id"]
    numbered = O.batches(rows, keys, "index", plan.batch_size).withColumn("source", F.col("text"))
    todo, kept = numbered, None
    if done is not None:
        prints = lambda d: d.groupBy(*keys).agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("index", "source")))).alias("print"))
        same = prints(numbered).join(prints(done), [*keys, "print"], "left_semi").select(*keys)
        todo, kept = numbered.join(same, keys, "left_anti"), done.join(same, keys, "left_semi")
    context = O.rolling_context(todo, keys, plan.batch_size, plan.tail).select(*keys, "batch_no", "prior_context")
    drafted = E.translate_column(todo.withColumn("needed", X.needs_translation(F.col("source"))), plan.translator, "source", "draft", "needed")
    drafted = settle(drafted, "drafts")  # paid calls are not made twice
    ready = drafted.join(context, [*keys, "batch_no"])
    if glossary is not None:
        pairs = glossary.where("target_term is not null").select("book_id", glossary_key(F.col("source_term")).alias("term"), "target_term").groupBy("book_id", "term").agg(F.max("target_term").alias("target"))
        known = pairs.select("book_id", F.col("term").alias("source_term"), "term", "target")
        hits = relevant_terms(todo.select(*keys, "index", "batch_no", F.col("source").alias("text")), known, ["book_id"], ["chapter_id", "index"])
        terms = hits.groupBy(*keys, "batch_no").agg(F.map_from_entries(F.collect_set(F.struct("term", "target"))).alias("terms"))
        told = ready.join(terms, [*keys, "batch_no"], "left")  # for the editor only: what follows needs no terms
    else:
        told = ready
    wanted = ready.where("needed")
    edited = settle(E.edit_batches(told.where("needed").select(*keys, "batch_no", "position", "draft", "prior_context", *(["terms"] if glossary is not None else [])), plan.editor, [*keys, "batch_no"]), "edits")
    O.assert_aligned(wanted.select(*keys, "batch_no", "position"), edited, [*keys, "batch_no", "position"]).write.format("noop").mode("overwrite").save()
    out = ready.join(edited, [*keys, "batch_no", "position"], "left").select(
        *keys, "index", "position", "batch_no", "source", "draft", X.normal_emotion(F.col("emotion")).alias("emotion"), F.coalesce("edited", "source").alias("edited"), "prior_context"
    )
    return out if kept is None else out.unionByName(kept.select(*out.columns))


def evaluate(rows: DataFrame, plan: BookPlan) -> DataFrame:
    """``rows`` with back_translated, similarity_score and qa_class of each edited text."""
    back = E.translate_column(rows, plan.back_translator or plan.translator, "edited", "back_translated")
    both = E.embed_column(E.embed_column(back, plan.embedder, "source", "source_vector"), plan.embedder, "back_translated", "back_vector")
    scored = both.withColumn("similarity_score", V.cosine(F.col("source_vector"), F.col("back_vector"))).drop("source_vector", "back_vector")
    return Q.classify(scored, plan.passes, plan.flags)


def retry(rows: DataFrame, plan: BookPlan, second: Callable[[], E.Translator]) -> DataFrame:
    """``rows`` of ``evaluate`` with each RETRY row translated once more by ``second``; the new text stays only if it scores strictly better."""
    again = rows.where("qa_class = 'RETRY'").select("book_id", "chapter_id", "index", "source")
    new = evaluate(E.translate_column(again, second, "source", "edited"), plan)
    better = new.select("book_id", "chapter_id", "index", F.struct("edited", "back_translated", "similarity_score", "qa_class").alias("new"))
    joined = rows.join(better, ["book_id", "chapter_id", "index"], "left")
    take = F.coalesce(F.col("new.similarity_score") > F.col("similarity_score"), F.lit(False))
    return joined.withColumns({c: F.when(take, F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("edited", "back_translated", "similarity_score", "qa_class")}).drop("new")


def manifest(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(book_id, paragraphs_translated, paragraphs_total, preview, chapters) of a run."""
    done = rows.groupBy("book_id", "chapter_id").agg(F.count("*").alias("paragraphs"))
    total = paragraphs.where("text is not null").groupBy("book_id", "chapter_id").agg(F.min("chapter_ord").alias("chapter_ord"), F.count("*").alias("total_paragraphs"))
    both = total.join(done, ["book_id", "chapter_id"])
    item = F.struct("chapter_ord", F.col("chapter_id").alias("id"), "paragraphs", "total_paragraphs")
    return both.groupBy("book_id").agg(
        F.sum("paragraphs").alias("paragraphs_translated"), F.sum("total_paragraphs").alias("paragraphs_total"), F.bool_or(F.col("paragraphs") < F.col("total_paragraphs")).alias("preview"), F.array_sort(F.collect_list(item)).alias("chapters")
    )


