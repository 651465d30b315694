"""References and their closure over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granthika.session import settle


def referenced(ids: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``ids`` (path, id) that a link (path, href) points at; a bare "#id" points into its own document."""
    cut = links.where("href like '%#%'").select(F.col("path").alias("origin"), F.regexp_extract("href", r"^([^#]*)#(.+)$", 1).alias("file"), F.regexp_extract("href", r"^([^#]*)#(.+)$", 2).alias("id"))
    folder = F.regexp_extract("origin", r"^(.*/)?[^/]*$", 1)
    target = F.when(F.col("file") == "", F.col("origin")).otherwise(F.concat(folder, F.col("file")))
    return ids.join(cut.select(target.alias("path"), "id").distinct(), ["path", "id"], "left_semi")


def closure(starts: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id): ``starts`` and all that edges (id, refines) lead to them, to any depth.

    Each round joins only the ids found in the round before; what was found is written, so no lineage grows. A cycle ends by itself.
    More than ``most_rounds`` levels are an error.
    """
    found = settle(starts.select("id").distinct(), "closure")
    fresh, all_found = found, found
    for _ in range(most_rounds):
        reached = edges.join(fresh.select(F.col("id").alias("refines")), "refines").select("id").distinct()
        fresh = settle(reached.join(all_found, "id", "left_anti"), "closure")
        if fresh.isEmpty():
            return all_found
        all_found = all_found.unionByName(fresh)
    raise ValueError(f"references are nested more than {most_rounds} deep")
