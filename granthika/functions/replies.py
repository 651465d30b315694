"""Prompts for model engines and the parsing of their replies. A reply that doesn't fit its request is an error, never guessed at."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import normal_emotion


def numbered(texts: Column) -> Column:
    """"[P1] …" lines of an array of texts."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("]\n"), t)), "\n\n")


def glossary_block(terms: Column) -> Column:
    """"source = target" lines of a map, sorted by source; empty for none."""
    entries = F.array_sort(F.map_entries(terms))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n"), F.lit(""))


def edit_prompt(texts: Column, terms: Column, context: Column) -> Column:
    """What an editor is asked for a batch: glossary, context, numbered paragraphs."""
    block = glossary_block(terms)
    parts = F.array(
        F.when(block != "", F.concat(F.lit("Glossary:\n"), block)), F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Before:\n"), context)), F.concat(F.lit("Paragraphs:\n"), numbered(texts))
    )
    return F.array_join(F.array_compact(parts), "\n\n")


def json_reply(reply: Column, wanted: Column) -> Column:
    """The strings of a JSON array, alone or within other text; an error unless there are ``wanted``."""
    whole = F.from_json(F.trim(reply), "array<string>")
    inner = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<string>")
    parsed = F.when(F.size(F.filter(whole, lambda x: x.isNotNull())) > 0, whole).otherwise(inner)
    message = F.concat(F.lit("the reply has "), F.coalesce(F.size(parsed), F.lit(0)).cast("string"), F.lit(" texts for "), wanted.cast("string"))
    return F.when(F.coalesce(F.size(parsed) == wanted, F.lit(False)), parsed).otherwise(F.raise_error(message).cast("array<string>"))


def numbered_reply(reply: Column, wanted: Column) -> Column:
    """(emotion, text) of "[P1] EMOTION: … text" blocks in order of their numbers.

    The last block of a number counts; a block without emotion has the usual one. Missing and unexpected numbers are an error.
    """
    pattern = r"(?s)\[P(\d+)\]\s*(?:EMOTION:\s*([^\n]*)\n)?(.*?)(?=\s*\[P\d+\]|\s*$)"
    part = lambda k: F.regexp_extract_all(reply, F.lit(pattern), F.lit(k))
    blocks = F.arrays_zip(part(1).alias("n"), part(2).alias("e"), part(3).alias("t"))
    numbers = F.transform(blocks, lambda b: b["n"].cast("int"))
    asked = F.sequence(F.lit(1), F.greatest(wanted, F.lit(1)))
    missing, odd = F.array_except(asked, numbers), F.array_except(numbers, asked)
    good = (wanted > 0) & (F.size(missing) == 0) & (F.size(odd) == 0)
    last = F.transform(asked, lambda k: F.try_element_at(F.filter(blocks, lambda b: b["n"].cast("int") == k), F.lit(-1)))
    rows = F.transform(last, lambda b: F.struct(normal_emotion(b["e"]).alias("emotion"), F.trim(b["t"]).alias("text")))
    message = F.concat(F.lit("missing paragraphs "), F.to_json(missing), F.lit(", unexpected "), F.to_json(odd))
    return F.when(good, rows).otherwise(F.raise_error(message).cast("array<struct<emotion:string,text:string>>"))
