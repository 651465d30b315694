import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from granthika.functions import glossary as G, text as X, vectors as V


def one(spark, value, make, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "needed"),
    [("7.", False), ("II", False), ("— 12 —", False), ("XIV.", False), ("xiv", False), ("MIX", False), ("CIVIL", True), ("Hello", True), ("", False), ("   ", False), ("ಕನ್ನಡ", True), ("12 ಪುಟ", True)],
)
def test_needs_translation(spark, text, needed):
    assert one(spark, text, X.needs_translation) is needed


@pytest.mark.parametrize(
    ("text", "language", "expected"),
    [
        ("He left. She stayed.", "eng_Latn", ["He left.", "She stayed."]),
        ("Dr. Watson came. He sat.", "eng_Latn", ["Dr. Watson came.", "He sat."]),
        ("It was I. He knew.", "eng_Latn", ["It was I.", "He knew."]),
        ("J. R. Smith spoke! Yes?", "eng_Latn", ["J. R. Smith spoke!", "Yes?"]),
        ("ಡಾ. ವಾಟ್ಸನ್ ಬಂದರು. ಅವರು ಕುಳಿತರು.", "kan_Knda", ["ಡಾ. ವಾಟ್ಸನ್ ಬಂದರು.", "ಅವರು ಕುಳಿತರು."]),
        ("ಕ್ರಿ.ಶ. 1811 ರಲ್ಲಿ। ನಂತರ.", "kan_Knda", ["ಕ್ರಿ.ಶ. 1811 ರಲ್ಲಿ।", "ನಂತರ."]),
        ("One. Two.", "fra_Latn", ["One. Two."]),
        ("   ", "eng_Latn", []),
    ],
)
def test_split_sentences(spark, text, language, expected):
    assert one(spark, text, lambda c: X.split_sentences(c, language)) == expected


def test_pack(spark):
    assert one(spark, ["aa", "bb", "c" * 9, "d"], lambda c: X.pack(c, 5), "x array<string>") == ["aa bb", "c" * 9, "d"]
    assert one(spark, [], lambda c: X.pack(c, 5), "x array<string>") == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab .", max_size=12), max_size=8))
def test_pack_keeps_all(spark, items):
    packed = one(spark, items, lambda c: X.pack(c, 7), "x array<string>")
    assert " ".join(packed) == " ".join(items)
    assert all(len(p) <= 7 or p in items for p in packed)


@pytest.mark.parametrize(("text", "ok"), [("a ⟦1⟧b⟦/1⟧", True), ("⟦1⟧a ⟦2⟧b⟦/2⟧⟦/1⟧", True), ("⟦1⟧a ⟦2⟧b⟦/1⟧⟦/2⟧", False), ("⟦1⟧a", False), ("⟦1⟧a⟦/1⟧⟦1⟧b⟦/1⟧", False), ("plain", True)])
def test_markers(spark, text, ok):
    assert one(spark, text, X.valid_markers) is ok


def test_small_functions(spark):
    assert one(spark, " a   b\tc ", X.collapse) == "a b c"
    assert one(spark, "a ⟦1⟧b⟦/1⟧  c", X.strip_markers) == "a b c"
    assert one(spark, "The Red-Headed League", X.letters_key) == "THEREDHEADEDLEAGUE"
    assert one(spark, "III. THE LEAGUE", X.roman_heading).asDict() == {"numeral": "III.", "rest": "THE LEAGUE"}
    assert one(spark, "I have seen", X.roman_heading) is None
    assert one(spark, "CHAPTER II The End", X.pattern_heading) == "CHAPTER II"
    assert one(spark, "PART 3", X.pattern_heading) == "PART 3"
    assert one(spark, "IV.", X.pattern_heading) == "IV"
    assert one(spark, "Word", X.pattern_heading) is None
    assert one(spark, "x" * 90, X.snippet) == "x" * 79 + "…"
    assert one(spark, " The Book! ", X.slug) == "the-book"
    assert one(spark, "ಕನ್ನಡ", X.slug) == "book"
    assert one(spark, "a<b & 'c'", X.html_escape) == "a&lt;b &amp; &#x27;c&#x27;"
    assert one(spark, "ERROR(RSC-005): a.xhtml(3,14): bad", X.message_key) == "ERROR(RSC-005): a.xhtml: bad"
    assert one(spark, "Calcutta, 1935 and 12345 or 2024.", X.years) == [1935, 2024]
    assert one(spark, "Translator’s Note.", X.front_matter_kind) == "Translator's Note"
    assert one(spark, " HAPPY ", X.normal_emotion) == "Happy"
    assert one(spark, None, X.normal_emotion) == "Narration"
    assert one(spark, "he said ,' ' so", X.fix_ocr) == "he said,' ' so"
    assert one(spark, "THE RED LEAGUE 12", X.is_header_candidate) is True
    assert one(spark, "xiv", X.is_page_number) is True


def test_glossary_functions(spark):
    rows = spark.createDataFrame([("Meera met the meera of Meera Bai", [("Meera", "ಮೀರಾ"), ("Meera Bai", "a$b\\c")])], "text string, terms array<struct<source:string,target:string>>")
    terms = G.longest_first(F.col("terms"))
    out = rows.select(G.force_terms(F.col("text"), terms).alias("f"), G.mask_terms(F.col("text"), terms["source"]).alias("m"), G.unmask_terms(G.mask_terms(F.col("text"), terms["source"]), terms["source"]).alias("u")).first()
    assert out.f == "ಮೀರಾ met the ಮೀರಾ of a$b\\c"
    assert out.m == "⟦DNT1⟧ met the ⟦DNT1⟧ of ⟦DNT0⟧"
    assert out.u == "Meera met the Meera of Meera Bai"


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [[1.0, 2.0], [3.0, 6.0]])], "a array<double>, b array<double>, m array<array<double>>")
    out = rows.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.array(F.lit(0.0), F.lit(0.0))), V.l2_normalise(F.col("a")), V.mean_vector(F.col("m"))).first()
    assert [round(out[0], 6), out[1], out[2], out[3]] == [0.96, 0.0, [0.6, 0.8], [2.0, 4.0]]
    with pytest.raises(Exception, match="length"):
        rows.select(V.cosine(F.col("a"), F.array(F.lit(1.0)))).collect()
