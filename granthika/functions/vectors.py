"""Vector functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is all zeros. Vectors of unequal length raise an error."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length")).cast("double")))


def l2_normalise(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a.cast("array<double>"), lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))


def mean_vector(a: Column) -> Column:
    """Mean of an array of vectors of one length."""
    first = a[0].cast("array<double>")
    total = F.aggregate(F.slice(a, 2, F.size(a)), first, lambda s, v: F.zip_with(s, v.cast("array<double>"), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(a))


def by_index(items: Column) -> Column:
    """The embeddings of an answer, structs (index, embedding), in the order of their index."""
    return F.transform(F.array_sort(items, lambda a, b: F.when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0)), lambda x: x["embedding"])
