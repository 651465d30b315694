"""Translation sentence by sentence: paragraphs are taken apart, their sentences translated side by side and put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from granthika.engines import interfaces as E
from granthika.functions import text as X
from granthika.operators.ordered import assert_aligned
from granthika.session import settle


def token_windows(tokens: Column, size: int) -> Column:
    """An array of tokens in runs of ``size``; no token gives one empty run."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(tokens) - 1) / size).cast("int"), F.lit(0)))
    return F.transform(starts, lambda k: F.slice(tokens, k * size + 1, F.lit(size)))


def translate_by_sentence(rows: DataFrame, keys: list[str], translator: Callable[[], E.Translator], language: str, *, text: str = "text", out: str = "draft") -> DataFrame:
    """``rows`` with ``out``: the translations of the sentences of ``text``, joined by spaces in their order.

    The numeral of an English heading ("IV. THE MAP") is kept and put before the translation of the rest; a numeral alone stays alone. A
    text without sentence is empty, a null one null. ``keys`` tell the rows apart; each comes out once, or the run fails.
    """
    numeral = X.roman_heading(F.col(text)) if language == "eng_Latn" else F.lit(None).cast("struct<numeral:string,rest:string>")
    parted = rows.select(*keys, F.col(text).alias("_text"), numeral.alias("_head"))
    body = F.coalesce(F.col("_head.rest"), F.col("_text"))
    sentences = parted.where(F.trim(body) != "").select(*keys, F.posexplode(X.split_sentences(body, language)).alias("_no", "_sentence"))
    done = settle(E.translate_column(sentences, translator, "_sentence", "_done"), "sentences")  # paid calls are not made twice
    whole = done.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_done"))), lambda x: x["_done"]), " ").alias("_whole"))
    joined = parted.join(whole, keys, "left")
    written = F.when(F.col("_text").isNotNull(), F.trim(F.concat_ws(" ", F.col("_head.numeral"), F.coalesce("_whole", F.lit("")))))
    named = assert_aligned(rows.select(*keys), joined.select(*keys, written.alias(out)), keys)
    return rows.join(named, keys)
