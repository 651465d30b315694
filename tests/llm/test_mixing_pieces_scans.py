import random

import numpy as np
import pytest
from conftest import values
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from granthika.llm import boosting, mixing, pieces, scans, sentences as S, tokens


def test_flight_keeps_totals():
    rng = random.Random(3)
    sizes = [float(rng.randrange(10, 900)) for _ in range(400)]
    pi = [rng.random() for _ in sizes]
    out = mixing.flight(pi, sizes, random.Random(1))
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - sum(pi)) < 1e-6 and abs(np.dot(out, sizes) - np.dot(pi, sizes)) < 1e-3


def test_draw_is_fair():
    hits = np.zeros(12)
    for seed in range(400):
        hits += np.round(mixing.flight([0.3] * 12, [10.0 * (k + 1) for k in range(12)], random.Random(seed)))
    assert abs(hits.sum() / 400 - 3.6) < 0.3 and (hits / 400 > 0.1).all()


def test_mix(spark):
    docs = [(i, "big" if i % 3 else "small", f"some words number {i} " * (1 + i % 5)) for i in range(600)]
    docs += [(1000, None, "x"), (1001, "other", "x"), (1002, "big", None), (None, "big", "x"), (1003, "big", ""), (1004, "big", "word " * 200)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, text string, repeats string")
    goals = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mix_sources(df, goals, block_rows=60)
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.repeats <= {"big": 1, "small": 2}[r.source] for r in rows)
    reached = {r.source: r.share_reached for r in shares.collect()}
    assert abs(reached["big"] - 0.4) < 0.01 and abs(reached["small"] - 0.6) < 0.01 and reached["gone"] == 0
    again, _ = mixing.mix_sources(df, goals, block_rows=60)
    assert values(again) == values(mix)
    empty, none = mixing.mix_sources(df.limit(0), goals)
    assert values(empty) == [] and all(r.tokens_used == 0 for r in none.collect())


def test_mix_of_tiny_blocks_raises_rather_than_drops(spark):
    rows = spark.createDataFrame([(i, "a", 10 + i % 7, 0.4) for i in range(60)], mixing._ROUND)
    done = mixing.balanced_draw(rows, block_rows=20)
    assert done.count() == 60 and {r.pi for r in done.collect()} == {0.0, 1.0}
    with pytest.raises(RuntimeError, match="undecided"):
        mixing.balanced_draw(rows, block_rows=1, most_rounds=1)


TEXT = "Chapter 1\n\n" + "\n\n".join(f"It rained on day {i}. Nobody came. “Who is there?” asked Dr. Payaki again." for i in range(40)) + "\n\nಮಳೆ ಬಂತು. " * 60 + "ಕ" * 400


def cut(text, limit, overlap):
    run = pieces._cut(tokens.Tokenizer(), S.BoundaryModel(), [("p", limit, overlap)], ["k"])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["k", "_text"])
    return [r for b in run(iter([batch])) for r in b.to_pylist()]


@pytest.mark.parametrize(("limit", "overlap"), [(64, 0), (64, 16), (20, 8), (5, 1), (300, 40)])
def test_pieces_round_trip(limit, overlap):
    rows, counter = cut(TEXT, limit, overlap), tokens.Tokenizer()
    joined = ""
    for r in rows:
        assert r["n_tokens"] <= limit and len(counter.lengths(r["piece"])) <= limit
        assert r["piece_start"] <= len(joined) < r["piece_end"] and r["piece"] == TEXT[r["piece_start"] : r["piece_end"]]
        joined += TEXT[len(joined) : r["piece_end"]]
    assert joined == TEXT and all(overlap - 3 <= r["shared_tokens"] <= overlap for r in rows[1:])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\nಕೋ。\U0001f600", min_size=1, max_size=200))
def test_pieces_of_any_text(text):
    rows, total = cut(text, 12, 4), len(tokens.Tokenizer().lengths(text))
    if total <= 12:
        assert rows == []
    else:
        assert rows[0]["piece_start"] == 0 and rows[-1]["piece_end"] == len(text) and all(a["piece_end"] >= b["piece_start"] for a, b in zip(rows, rows[1:], strict=False)) and max(r["n_tokens"] for r in rows) <= 12
        counter = tokens.Tokenizer()
        assert all(len(counter.lengths(r["piece"])) == r["n_tokens"] for r in rows)  # the piece's own tokens, not its share of the whole


def test_natural_cuts():
    ends = [TEXT[: r["piece_end"]].rstrip()[-1] for r in cut(TEXT, 64, 0) if r["piece_end"] < TEXT.index("ಕಕಕಕ")]
    assert set(ends) <= set(".?1")


def test_finer_levels_are_looked_for_only_where_units_are_too_long(monkeypatch):
    asked, real = [], pieces.sentence_spans
    monkeypatch.setattr(pieces, "sentence_spans", lambda text, model: asked.append(text) or real(text, model))
    assert len(cut("One. Two. Three.\n" * 20, 64, 0)) > 1 and asked == []  # lines are short enough
    assert len(cut("One. Two. Three. " * 40, 64, 0)) > 1 and len(asked) == 1


def test_split_operator(spark):
    df = spark.createDataFrame([(1, "word " * 30, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (1, "word " * 30, "x")], "k long, text string, piece string")
    out = values(pieces.split_texts(df, [("p", 20, 4)], ["k"]), "k", "piece_no", "n_tokens")
    assert len(out) == 2 * len(set(out)) and {r[0] for r in out} == {1} and max(r[2] for r in out) <= 20
    assert values(pieces.split_texts(df.limit(0), [("p", 20, 4)], ["k"])) == [] and values(pieces.split_texts(df, [], ["k"])) == []
    with pytest.raises(ValueError):
        pieces.split_texts(df, [("p", 5, 3)], ["k"])


def test_token_lengths_are_the_encoder_s():
    import base64

    import tiktoken

    with open(tokens.default_ranks(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter = tokens.Tokenizer()
    for text in (TEXT, " a  b\n\n c\t\td ", "don't I'll", "\x1ca \x1fb", "x" * 2000, ""):
        assert len(counter.lengths(text)) == len(encoding.encode_ordinary(text)) and sum(counter.lengths(text)) == len(text.encode())


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    model = boosting.BoostedTrees(trees=60).fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93
    assert boosting.BoostedTrees().fit(np.zeros((0, 4)), np.zeros(0)).predict(np.zeros((2, 4))).tolist() == [0.5, 0.5]


@pytest.mark.parametrize(("text", "page"), [("197", True), ("p. 196", True), ("- 216 -", True), ("[xxiv]", True), ("l34", True), ("2OO", True), ("Page liv", True), ("Once", False), ("THE END", False), ("1904 was", False), ("mix it", False)])
def test_page_numbers(text, page):
    assert scans.page_number(text) is page


def test_edits():
    assert scans._edits("drurn", "drum") == (1, 0) and scans._edits("rea5ons", "reasons") == (1, 0) and scans._edits("abc", "xyz") == (9.0, 9.0) and scans._edits("vvindows", "windows") == (1, 0)


def test_edits_of_long_words():
    assert scans._edits("deferminisfi(", "deterministic") == (3, 0) and scans._edits("x" * 50_000 + "rn", "x" * 50_000 + "m") == (1, 0) and scans._edits("ab" * 500, "ba" * 500) == (0, 2)
    assert scans._edits("a" * 3_000, "b" * 3_000) == (9.0, 9.0) and scans._edits("abcabcabcabc", "xyzxyzxyzxyz") == (9.0, 9.0)


@pytest.mark.parametrize("least", [0.25, 0.4, 0.7])
def test_alike_words_against_all_pairs(spark, least):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aben") for _ in range(rng.randrange(2, 9))) for _ in range(150)} | {"a" * 12, "ab" * 6, "hyper" * 9 + "active"})
    tokens = sorted({scans.misread_at_random(w, rng) for w in words} | {"aaaa", "b"})
    a, b = spark.createDataFrame([(w, 1) for w in tokens], "token string, n_token long"), spark.createDataFrame([(w, 2) for w in words], "word string, n_word long")
    want = sorted((t, w) for t in tokens for w in words if t != w and abs(len(t) - len(w)) <= 2 and scans.dice(t, w) >= least - 1e-12)
    assert values(scans._like(a, b, [], least), "token", "word") == want == values(scans._like(a, b, [], least, hot=3), "token", "word")
    both = scans._like(a.withColumn("book", F.lit("x")), b.withColumn("book", F.when(F.col("word") < "b", "x").otherwise("y")), ["book"], least)
    assert values(both, "token", "word") == [(t, w) for t, w in want if w < "b"]


def test_book_titles_keeps_every_repeated_line(spark):
    long = "The Very Long And Winding Account Of Every Single Person Who Ever Crossed The Bridge"
    lines = [f"The Red Map Number {x}" for x in ("One", "Two", "Three", "Four", "Five", "Six", "Seven")] + [long]
    rows = [(i, "b", i, "Other", [*lines, "he went home again", "He Went Home."]) for i in range(3)]
    df = spark.createDataFrame(rows, "import_id long, book_id string, chapter_no int, title string, paragraphs array<string>")
    assert scans.book_titles(df).first().extra == sorted(lines)


def test_long_running_header():
    title = "The Very Long And Winding Account Of Every Single Person Who Ever Crossed The Bridge"
    lines = scans.fit_lines([title, *(f"{a} {b} and {c}" for a in ("The Red Map", "The Old Bell", "The Lost Key") for b in ("of Home", "of War") for c in ("Payaki", "Sesiji", "Yukola"))])
    assert scans.furniture_of(["It rained and the", title.upper(), "river rose. The end."], [title], lines) == [[(False, False)], [(True, False)], [(False, False)]]


def test_line_pairs():
    paragraphs = [f"Payaki gave {n} ropes to Sesiji near the well, and nobody saw it." for n in range(200)]
    tears = scans.fit_tears(paragraphs)
    p = tears.predict(np.array([scans.tear_features(a, b) for a, b in (("He left the", "dog alone."), ("He left.", "The dog slept."))]))
    assert p[0] > 0.9 and p[1] < 0.3
    counts = {f"w{a}{b}r{c}": 2 + ord(a) % 9 for a in "abcdefgh" for b in "abcdefgh" for c in ("d", "den", "dening")} | {f"{'salt'[:k]}{a}-{'white'[:m]}{a}": 2 + ord(a) % 9 for a in "tmlo" for k in (1, 2, 3) for m in (1, 3, 5)}
    joins = scans.fit_joins(counts)
    q = joins.predict(np.array([scans.join_features("salt", "white", 0, 7, 3, 3), scans.join_features("sol", "dier", 7, 0, 0, 0)]))
    assert q[0] > 0.5 > q[1]


def test_scans(spark):
    body = ["The soldier mended the lamp near the harbour.", "Nobody recorded the reasons for the journey.", "The children laughed when the lamp was lighted."]
    rows = [(i, f"b{i % 6}", i, "The Red Map and Payaki", False, [body[i % 3], body[(i + 1) % 3]] * 3) for i in range(60)]
    scan = [
        "The sol-\ndier mended the larnp near the harbour.", "Nobody recorded the rea5ons for", "214   The Red Map and Payaki", "the journey.", "xii", None, "", "The children laughed when the salt- white lamp was lighted.",
    ]
    rows += [(100, "b1", 1, "The Red Map and Payaki", True, scan), (100, "b1", 1, "The Red Map and Payaki", True, scan), (101, "b1", 2, None, None, None), (None, "b1", 2, None, True, scan), (102, None, None, None, True, [])]
    rows += [(200 + i, f"b{i}", 9, None, False, ["The salt-white lamp was lighted."] * 2) for i in range(5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "import_id long, book_id string, chapter_no int, title string, ocr boolean, paragraphs array<string>, fixed string")
    got = values(scans.repair_scans(df))
    assert (100, 1, "hyphen_break", "soldier") in got and (100, 1, "misread", "lamp") in got and (100, 2, "misread", "reasons") in got
    assert (100, 3, "running_header", "") in got and (100, 3, "page_number", "") in got and (100, 4, "broken_paragraph", "") in got and (100, 5, "page_number", "") in got
    assert (100, 8, "hyphen_break", "salt-white") in got and {r[0] for r in got} == {100} and len(got) == 8
    assert values(scans.repair_scans(df.limit(0))) == []


def test_models_learn_from_all_rows(spark):
    rng = random.Random(3)
    examples = [([float(rng.random() < 0.5), float(k % 3)], int(k % 3 == 0), 1.0) for k in range(30_000)]
    model = boosting.fit_examples(spark.createDataFrame(examples, scans._EXAMPLES), 2, boosting.BoostedTrees())
    alone = boosting.BoostedTrees().fit(np.array([x for x, _, _ in examples]), np.array([y for _, y, _ in examples]))
    ask = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 2.0]])
    assert np.allclose(model.predict(ask), alone.predict(ask), atol=0.02)
    # a sample of 3,000 of these titles would miss the frame's exact share; it stands in 1,001 of 10,000
    titles = [f"the {a}{k} and {a}" for k, a in enumerate("abcdefghij" * 100)] + ["The One and X"] + [f"the and {k} of it" for k in range(8_999)]
    frames = scans.title_frames(spark.createDataFrame([(t,) for t in titles], "title string"), 10_000)
    assert frames == [("the", "and", None, "of", "it"), ("the", None, "and", None)]
    assert len(scans.title_frames(spark.createDataFrame([(t,) for t in titles], "title string"), 10_011)) == 1


def test_scans_broadcast_nothing(spark):
    rows = [(i, f"b{i % 6}", i, "The Red Map and Payaki", i % 2 == 0, ["The sol-\ndier mended the larnp near the harbour."] * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "import_id long, book_id string, chapter_no int, title string, ocr boolean, paragraphs array<string>")
    plan = scans.repair_scans(df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
