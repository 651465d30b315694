import pytest
from conftest import values
from pyspark.sql import functions as F

from granthika.operators import candidates, chapters, ordered, quality


def test_candidates(spark):
    rows = spark.createDataFrame([("b", "The NASA team. We saw Meera. Then Meera left with Ravi Kumar. The NASA NASA. See old Ravi Kumar and Ravi Kumar. And Meera.")], "book string, text string")
    found = values(candidates.glossary_candidates(rows, ["book"]), "term", "term_type", "frequency")
    assert found == [("Meera", "repeated_capitalized", 3), ("NASA", "acronym", 3), ("Ravi Kumar", "proper_noun_phrase", 3)]


def test_merge_and_review(spark):
    g = spark.createDataFrame([("ravi", "Ravi", None, "name", "pending", 2, "c1", None)], "source_term_key string, source_term string, target_term string, term_type string, status string, frequency int, first_seen_chapter string, notes string")
    c = spark.createDataFrame([("RAVI", "x", 3, "c2", 1), ("Meera", "name", 1, "c2", 2), ("meera ", "other", 4, "c3", 3)], "source_term string, term_type string, frequency int, first_seen_chapter string, seq int")
    merged = candidates.merge_candidates(g, c)
    assert values(merged, "source_term_key", "source_term", "term_type", "frequency", "status") == [("meera", "Meera", "name", 5, "pending"), ("ravi", "Ravi", "name", 5, "pending")]
    r = spark.createDataFrame([("ravi", "approved", "ರವಿ", None), ("nobody", "approved", "x", None)], "source_term_key string, status string, target_term string, notes string")
    assert values(candidates.apply_reviews(merged, r).select(F.col("source_term_key"), "status", F.coalesce("target_term", F.lit("")))) == [("meera", "pending", ""), ("ravi", "approved", "ರವಿ")]
    outcome = candidates.review_outcome(spark.createDataFrame([("approved", ""), ("approved", "x"), ("odd", "x"), (None, "x")], "status string, target_term string"))
    assert sorted(str(r.skip_reason) for r in outcome.collect()) == ["None", "approved without target", "invalid status", "invalid status"]


def test_context(spark):
    rows = spark.createDataFrame([("b", "c", i, f"t{i}") for i in range(5)], "book string, chapter string, pos int, text string")
    numbered = ordered.batches(rows, ["book", "chapter"], "pos", 2)
    out = values(ordered.rolling_context(numbered, ["book", "chapter"], 2, 1), "batch_no", "n", "prior_context")
    assert out == [(0, 2, ""), (1, 2, "t1"), (2, 1, "t3")]


def test_aligned(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert values(ordered.assert_aligned(a, a.withColumn("v", F.lit("x")), ["k"])) == [(1, "x"), (2, "x")]
    for other in ([(1,)], [(1,), (2,), (3,)], [(1,), (1,), (2,)]):
        with pytest.raises(Exception, match="out of step"):
            ordered.assert_aligned(a, spark.createDataFrame(other, "k int"), ["k"]).collect()


def test_chain(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 3, 6), ("b", 0, 4), ("b", 5, 8), ("c", 2, 3)], "k string, start int, end int")
    assert values(ordered.checkpoint_chain(spans, ["k"])) == [("a", 9, 2, True), ("b", 4, 1, False), ("c", 0, 0, False)]


def test_contents_and_torn(spark):
    lines = ["Preface", "CONTENTS", "PAGE", "The Start 1", "The Middle xii", "The End 30", "Body text."]
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(lines)], "book string, pos int, text string")
    assert values(ordered.contents_list(rows, ["book"], "pos", "text"), "title") == [("The End",), ("The Middle",), ("The Start",)]
    torn = spark.createDataFrame([("b", 1, "a", False), ("b", 2, "b", True), ("b", 3, "c", False)], "book string, pos int, text string, torn boolean")
    assert values(ordered.join_torn(torn, ["book"], "pos", "torn", "text"), "pieces", "text") == [(1, "c"), (2, "a b")]


def test_quality(spark):
    rows = spark.createDataFrame([(1, "b", 1, 0.85, "k"), (2, "b", 2, 0.70, "k"), (3, "b", 3, 0.69, "k"), (4, "b", 3, 0.69, "k"), (5, "b", 4, None, "k")], "qa_id long, book_id string, index int, similarity_score double, kannada_target string")
    classed = quality.classify(rows)
    assert [r.qa_class for r in classed.orderBy("qa_id").collect()] == ["PASS", "RETRY", "FLAGGED_FOR_REVIEW", "FLAGGED_FOR_REVIEW", None]
    assert values(quality.best_attempt(rows, ["book_id", "index"]), "index", "attempts", "qa_id") == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 1, 5)]
    s = quality.summary(classed, ["book_id"]).first()
    assert (s.total, s.retry, s.mean_score) == (5, 1, 0.7325)
    with pytest.raises(ValueError):
        quality.classify(rows, 0.5, 0.7)


def test_context_mode(spark):
    rows = [("n", i, f"Chapter {i}", "x") for i in range(3)] + [("s", i, f"Story {i}", "Once upon a time") for i in range(4)] + [("t", i, "Tale", "IV") for i in range(3)] + [("f", 0, "Preface", "x"), ("f", 1, "1", "x"), ("f", 2, None, "II")]
    out = values(chapters.context_mode(spark.createDataFrame(rows, "book_id string, chapter_ord int, title string, first_text string")), "book_id", "mode")
    assert out == [("f", "reset"), ("n", "carry"), ("s", "reset"), ("t", "carry")]


def test_slugs_and_diff(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, slug string")
    assert values(ordered.unique_slugs(rows, "slug", "id"), "unique_slug") == [("a",), ("a-2",), ("b",)]
    old = spark.createDataFrame([("b", "E: a(1,2): x")], "book_id string, message string")
    new = spark.createDataFrame([("b", "E: a(9,9): x"), ("b", "E: a(1,2): y")], "book_id string, message string")
    assert values(chapters.problem_diff(old, new)) == [("b", 1, 1)]
