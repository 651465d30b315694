import random

import pytest
from conftest import values
from hypothesis import given, strategies as st

from granthika.llm import lookalikes as K, sentences as S


def test_forms():
    assert K.one_form("ｆｏｒ the ﬁne​st") == "for the finest"
    assert K.one_form("é ೇ") == K.one_form("é ೇ") and K.one_form("x² ５ ೫ ！") == "x² 5 ೫ !" and K.one_form("ﾠㅤaﾠ") == "a"
    assert K.one_form("a\nb") == "a\nb" and K.one_form("É") != K.one_form("E")


@given(st.text(max_size=40))
def test_one_form_is_stable(text):
    assert K.one_form(K.one_form(text)) == K.one_form(text)


@pytest.fixture(scope="module")
def shapes(spark):
    return K.shapes(spark)


def test_unmixed(shapes):
    unmixed = shapes.unmixed
    assert unmixed("yоunger", "LATIN") == ["younger"]
    assert unmixed("sіnсе", "LATIN") == ["since"]
    assert unmixed("мир", "LATIN") == [] and unmixed("plain", "LATIN") == []


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("naїve", "naïve"), ("noёl", "noël"), ("ｃόrd", "córd"), ("cafе\u0301", "café"), ("heӀӀo", "hello"), ("Ԍarden", "Garden"), ("Үukola", "Yukola"), ("ϲat", "cat"), ("օnly", "only"), ("ոight", "night"), ("sսn", "sun"),
        ("Ꭺpril", "April"), ("ⅰnk", "ink"), ("ⅿap", "map"), ("ⅳy", "ivy"), ("doɡ", "dog"), ("cɑt", "cat"), ("Ιnk", "Ink"), ("ｂо\u200bat", "boat"), ("ⲟnly", "only"), ("ᴏnly", "only"),
    ],
)
def test_unmixed_of_many_scripts(shapes, token, word):
    """None of these is in a table of this repository."""
    form = K.one_form(token)
    assert word == form or word in shapes.unmixed(form, "LATIN")


def test_unmixed_southern(shapes):
    class K:
        unmixed = staticmethod(shapes.unmixed)

    assert K.unmixed("ಎ\u0c02ದು", "KANNADA") == ["ಎ\u0c82ದು"] and K.unmixed("ఎ\u0c82త", "TELUGU") == ["ఎ\u0c02త"]
    assert K.unmixed("ದು\u0c03ಖ", "KANNADA") == ["ದು\u0c83ಖ"] and K.unmixed("\u0c05ವರು", "KANNADA") == ["ಅವರು"]
    assert K.unmixed("ക\u0c82", "MALAYALAM") == ["ക\u0d02"] and K.unmixed("ಕ\u0cc6\u0c42ಡ", "KANNADA") == ["ಕ\u0ccaಡ"]
    assert K.unmixed("\u0c15ಎ", "KANNADA") == [] and K.unmixed("abc", "KANNADA") == [] and K.unmixed("ಅ\u0c82", "LATIN") == []
    assert K.unmixed("cafе\u0301", "LATIN") == ["café"]


def test_pairs_southern(spark):
    rows = [("p", 1, "ಮನೆ ಎ\u0c82ದು"), ("p", 2, "ಮನೆ ಎ\u0c02ದು"), ("p", 3, "ಮನೆ ದ\u0c02ತ"), ("p", 4, "ಮನೆ ದಂತ."), ("p", 5, "ఎం ಕ"), ("p", 6, "ఎಂ ಕ")]
    df = spark.createDataFrame(rows, "origin string, id long, text string")
    assert values(K.lookalike_pairs(df)) == [("p", 1, 2)]
    assert {r.key: r.consistent for r in K.consistent_texts(df).collect()}[3] == "ಮನೆ ದ\u0c82ತ"


def test_pairs(spark):
    rows = [
        ("p", 1, "The younger brother"), ("p", 2, "The yоunger brother"), ("p", 3, "The younger brother"), ("p", 4, "The younger brother"), ("p", 5, "The Younger brother"), ("p", 6, "The younger brother."),
        ("q", 7, "The younger​ brother"), ("p", 8, None), ("p", 9, ""), ("p", None, "The yоunger brother"), ("p", 10, "12 ３"), ("p", 11, "12 3"), ("p", 12, "Zzоq"), ("p", 13, "Zzoq"), ("p", 2, "The yоunger brother"),
        ("p", 14, "x" * 200_000 + " y"), ("p", 15, "x" * 200_000 + " y"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "origin string, id long, text string, id_a string")
    want = [("p", 1, 2), ("p", 1, 3), ("p", 2, 3), ("p", 2, 4), ("p", 3, 4), ("p", 12, 13), ("p", 14, 15)]
    assert values(K.lookalike_pairs(df)) == sorted(want)
    assert values(K.lookalike_pairs(df, group_rows=1)) == sorted(want)  # every group is dealt over several tasks
    assert values(K.lookalike_pairs(df.limit(0))) == []
    classes = {(r.origin, r.id): (r.class_id, r.stored, r.rows) for r in K.lookalike_classes(df).collect()}
    assert classes["p", 3] == (1, 3, 4) and classes["p", 5] == (5, 1, 1) and classes["q", 7] == (7, 1, 1) and ("p", 9) not in classes and ("p", 10) not in classes
    assert K.lookalike_classes(df.limit(0)).count() == 0


def test_width_of_marks_is_no_other_mark(spark):
    rows = [("p", 1, "Who came?"), ("p", 2, "Who came？"), ("p", 3, "Who came!"), ("p", 4, "Who cаme？"), ("p", 5, "Who came²"), ("p", 6, "Who came2")]
    assert values(K.lookalike_pairs(spark.createDataFrame(rows, "origin string, id long, text string"))) == [("p", 1, 2), ("p", 1, 4), ("p", 2, 4)]


GOLD = [
    ("K. T. Yukola lived in the school until 1905. At night it rained.", ["K. T. Yukola lived in the school until 1905.", "At night it rained."]),
    ('"Leave the rope here. It is not yours!" said Payaki. He left.', ['"Leave the rope here. It is not yours!" said Payaki.', "He left."]),
    ('Payaki asked, "Who opened it? Was it Ramiku?" Nobody knew.', ['Payaki asked, "Who opened it? Was it Ramiku?"', "Nobody knew."]),
    ("Dr. Payaki paid 36.73 rupees for the box.It rained again. The end", ["Dr. Payaki paid 36.73 rupees for the box.", "It rained again.", "The end"]),
    ("no mark at all", ["no mark at all"]),
    ("one line\nanother line", ["one line", "another line"]),
    ("", []),
    ("  \n ", []),
    ("* * *", ["* * *"]),
]


@pytest.fixture(scope="module")
def model():
    rng, names, texts = random.Random(4), ["Payaki", "Yukola", "Ramiku", "Sesiji", "Nelicha"], []
    for i in range(1200):
        a, b = rng.sample(names, 2)
        said = [
            f"K. T. {a} lived in the school until {1800 + i % 90}.", f"Dr. {a} paid {i % 90}.{10 + i % 80} rupees for the box.", f'{a} asked, "Who opened the box? Was it {b}?"', f'"Leave the rope here. It is not yours!" said {a}.',
            "Nobody knew.", f"The box was found by {b}.", "It rained again.", f"{b} said no.", "At night it rained.", f"{a} left.",
        ]
        texts.append(("" if i % 9 == 0 else " ").join(rng.sample(said, rng.randrange(1, 5))))
    return S.BoundaryModel.fit(texts)


@pytest.mark.parametrize(("text", "want"), GOLD)
def test_gold(model, text, want):
    assert [text[a:b] for a, b in S.sentence_spans(text, model)] == want


@given(st.text(alphabet='aB .!?"“”\n。', max_size=60))
def test_spans_cover_the_text(text):
    spans = S.sentence_spans(text, S.BoundaryModel())
    covered = "".join(text[a:b] for a, b in spans)
    assert "".join(covered.split()) == "".join(text.split())
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_viterbi_needs_letters():
    assert S.viterbi([5.0, 5.0, 0.0], [True, False, True]) in ([True, False, True], [False, True, True])
    assert S.viterbi([1.0, 5.0, 0.0], [True, False, True]) == [False, True, True]


def test_viterbi_against_enumeration():
    import itertools

    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 6)
        scores, letters, moves = [rng.gauss(0, 2) for _ in range(n)] + [0.0], [rng.random() < 0.7 for _ in range(n + 1)], tuple(rng.gauss(0, 1) for _ in range(4))
        letters = [True] * (n + 1) if rng.random() < 0.4 else letters

        def value(tags):
            total, last, seen = 0.0, True, False
            for k, t in enumerate(tags):
                seen = seen or letters[k]
                if t and not seen and k < n:
                    return float("-inf")
                total += moves[(0 if last else 2) + (0 if t else 1)] + (scores[k] if t else 0.0)
                last, seen = t, seen and not t
            return total

        best = max(((*x, True) for x in itertools.product((False, True), repeat=n)), key=value)
        assert abs(value(S.viterbi(scores, letters, moves)) - value(best)) < 1e-9


def test_moves_are_learned():
    alternating = [[3.0, -3.0] * 6 for _ in range(50)]
    bb, bi, ib, ii = S.learned_moves(alternating, (0.0, 0.0, 0.0, 0.0))
    assert bi > 0.3 and ib > 0.3 and bb < 0 and ii < -0.3


def test_split_operator(spark, model):
    df = spark.createDataFrame([(1, "It rained again. Nobody knew.", "z"), (1, "It rained again. Nobody knew.", "z"), (2, None, "z"), (3, "", "z"), (4, "word " * 60_000, "z")], "k long, text string, sent_start string")
    assert values(S.split_sentences(df, ["k"], model=model)) == [(1, 0, 16), (1, 0, 16), (1, 17, 29), (1, 17, 29), (4, 0, 299_999)]
    assert values(S.split_sentences(df.limit(0), ["k"])) == []


def test_unmarked_tagger(model):
    train = [f"{n} gave {m} the {t}" for n in ("payaki", "yukola", "ramiku") for m in ("sesiji", "nelicha") for t in ("rope", "bell", "lamp", "boat")] * 4
    tagger = S.UnmarkedTagger.fit(train)
    held = ["ramikugavenelichathelamp", "payakigavesesijitherope", "yukolagavenelichathebell"]
    ends = tagger.cuts("".join(held))
    assert ends == [24, 24 + 23, 24 + 23 + 24]
