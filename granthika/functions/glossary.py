"""Column functions that put a glossary to use. Terms come as arrays of structs (source, target), best longest first."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def glossary_key(term: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(term), r"(?U)[\s\x1c-\x1f]+", " "))


def longest_first(terms: Column) -> Column:
    """Terms by falling length of ``source``, then by the text."""
    return F.array_sort(terms, lambda a, b: F.when(F.length(a["source"]) != F.length(b["source"]), F.length(b["source"]) - F.length(a["source"])).when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0))


def _literal(text: Column) -> Column:
    return F.concat(F.lit("(?iu)\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def force_terms(text: Column, terms: Column) -> Column:
    """Every term's source replaced by its target, whatever the case, in the order given; later terms see earlier targets."""
    return F.aggregate(terms, text, lambda done, t: F.regexp_replace(done, _literal(t["source"]), _quoted(t["target"])))


def _mask(number: Column) -> Column:
    return F.concat(F.lit("⟦DNT"), number.cast("string"), F.lit("⟧"))


def _numbered(names: Column) -> Column:
    return F.transform(names, lambda n, i: F.struct(i.alias("no"), n.alias("name")))


def mask_numbered(text: Column, names: Column) -> Column:
    """Protected names, structs (no, name), replaced by ⟦DNT0⟧, ⟦DNT1⟧ … in the order given."""
    return F.aggregate(names, text, lambda done, t: F.regexp_replace(done, _literal(t["name"]), _mask(t["no"])))


def unmask_numbered(text: Column, names: Column) -> Column:
    """Masks replaced by the names as listed."""
    return F.aggregate(names, text, lambda done, t: F.replace(done, _mask(t["no"]), t["name"]))


def mask_terms(text: Column, names: Column) -> Column:
    """Protected names replaced by ⟦DNT0⟧, ⟦DNT1⟧ …, numbered in the order given."""
    return mask_numbered(text, _numbered(names))


def unmask_terms(text: Column, names: Column) -> Column:
    """Masks replaced by the names as listed."""
    return unmask_numbered(text, _numbered(names))
