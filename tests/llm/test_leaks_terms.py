import random

import numpy as np
from conftest import values

from granthika.llm import leaks, terms


def brute_edits(pattern, text):
    """Least word edits of the pattern to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t or p == 0))
        row = new
    return min(row)


def test_myers_against_brute_force():
    rng = random.Random(1)
    patterns = [[rng.randrange(1, 5) for _ in range(6)] for _ in range(300)]
    texts = [[rng.randrange(0, 5) for _ in range(9)] for _ in range(300)]
    got = leaks.myers_words(np.array(patterns), np.array(texts), np.full(300, 9))
    assert got.tolist() == [brute_edits(p, t) for p, t in zip(patterns, texts, strict=True)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(6)]
    docs = []
    for d in range(80):
        text = [rng.choice(words) for _ in range(30)]
        if d % 2:
            part = items[d % 6][1].split()
            a = rng.randrange(8)
            cut = part[a : a + rng.randrange(9, 13)]
            if d % 3 == 0:
                cut[rng.randrange(len(cut))] = "other"
            text[5:5] = cut
        docs.append((d, " ".join(text)))
    want = set()
    for i, item in items:
        p = item.split()
        for d, doc in docs:
            t = doc.split()
            number = {w: k + 1 for k, w in enumerate(sorted(set(p)))}
            least = min(brute_edits([number[w] for w in p[k : k + 12]], [number.get(w, 0) for w in t]) for k in range(len(p) - 11))
            if least <= 1:
                want.add((i, d, least))
    got = leaks.find_leaks(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want
    split = leaks.find_leaks(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), index_limit=25)
    assert values(split) == values(got)


def test_leaks_edges(spark):
    text = "One, two three four five six seven eight nine ten eleven TWELVE!"
    items = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (None, text, "x"), (3, "", "x"), (4, "too short", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(7, "zero " + text.upper() + " end", 1), (7, "zero " + text, 2), (8, None, 3), (None, text, 4), (9, "", 5), (10, "word " * 50_000, 6), (11, "one two - three four five six seven eight nine ten eleven twelve", 7)], "doc_id long, text string, item_id long")
    assert values(leaks.find_leaks(items, docs)) == [(1, 7, 0), (1, 11, 0)]
    assert values(leaks.exact_leaks(leaks.find_leaks(items.limit(0), docs))) == []
    assert values(leaks.find_leaks(items, docs.limit(0))) == []


def test_terms(spark):
    schema = "id long, book_id string, source_term string, frequency int, updated_at timestamp, term string, total int"
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, "a", " Red  Map ", 1, at(1), "x", 0), (1, "a", "red map", 2, at(2), "x", 0), (2, "b", "RED MAP", None, at(1), "x", 0), (3, "c", "key", 9, at(1), "x", 0), (3, "c", "key", 9, at(1), "x", 0),
        (4, "d", "key", 1, None, "x", 0), (None, "e", "key", 1, at(1), "x", 0), (None, "e", "key", 1, at(1), "x", 0), (5, "f", None, 7, at(1), "x", 0), (6, None, "lone", 2, at(1), "x", 0), (7, "g", "   ", 3, at(1), "x", 0),
    ]
    df = spark.createDataFrame(rows, schema)
    want = [("key", 12, 3, False, True), ("lone", 2, 0, True, False), ("red map", 2, 2, True, True)]
    assert values(terms.term_frequencies(df)) == want
    assert values(terms.term_frequencies(df, leaf_rows=1)) == want  # every partition is split further
    assert values(terms.marked_terms(terms.term_frequencies(df))) == [("key", "common"), ("lone", "rare"), ("red map", "common"), ("red map", "rare")]
    assert values(terms.term_frequencies(df.limit(0))) == []


def test_terms_hot(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 500 as string) as book_id", "if(id % 3 = 0, 'hot', concat('t', id % 97)) as source_term", "1 as frequency", "timestamp'2024-01-01' as updated_at")
    got = {r.term: (r.total, r.records) for r in terms.term_frequencies(df, leaf_rows=200).collect()}
    want = {r.source_term: (r.n, r.b) for r in df.groupBy("source_term").agg({"*": "count"}).selectExpr("source_term", "`count(1)` as n").join(df.groupBy("source_term").agg({"book_id": "count"}), "source_term").selectExpr("source_term", "n", "0 as b").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got["hot"][1] == 500
