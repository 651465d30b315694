"""Back-translation quality: scores, classes, retries, summaries and review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def classify(rows: DataFrame, passes: float = 0.85, flags: float = 0.70) -> DataFrame:
    """``rows`` with ``qa_class`` by ``similarity_score``; both bounds are inclusive, a null score has no class."""
    if not 0 <= flags <= passes <= 1:
        raise ValueError("thresholds must be 0 <= flag <= pass <= 1")
    score = F.col("similarity_score")
    named = F.when(score >= passes, "PASS").when(score >= flags, "RETRY").when(score.isNotNull(), "FLAGGED_FOR_REVIEW")
    return rows.withColumn("qa_class", named)


def latest_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last check of each paragraph, by time and id."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("checked_at", "qa_id")).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in columns])


def best_attempt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The attempt to keep of each paragraph: a later one only where its score is strictly greater."""
    best = F.max_by(F.struct("qa_id", "kannada_target", "similarity_score"), F.struct(F.coalesce("similarity_score", F.lit(-1.0)), -F.col("qa_id")))
    return rows.groupBy(*keys).agg(best.alias("r"), F.count("*").alias("attempts")).select(*keys, "attempts", "r.qa_id", "r.similarity_score")


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each class and the mean score, 0 where there is none, rounded half to even to four places."""
    count = {c: F.count_if(F.col("qa_class") == c).alias(c.lower()) for c in ("PASS", "RETRY", "FLAGGED_FOR_REVIEW")}
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *count.values(), F.bround(F.coalesce(F.avg("similarity_score"), F.lit(0.0)), 4).alias("mean_score"))
