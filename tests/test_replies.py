import pytest
from conftest import values
from pyspark.sql import functions as F

from granthika.functions import replies as R
from granthika.operators import closure


def run(spark, reply, n, make):
    return spark.createDataFrame([(reply, n)], "reply string, n int").select(make(F.col("reply"), F.col("n")).alias("x")).first().x


def test_json_reply(spark):
    assert run(spark, '["a", "b"]', 2, R.json_reply) == ["a", "b"]
    assert run(spark, 'Here it is:\n["a", "b [x]"]\nDone.', 2, R.json_reply) == ["a", "b [x]"]
    for bad in ('["a"]', "nothing", None):
        with pytest.raises(Exception, match="texts for 2"):
            run(spark, bad, 2, R.json_reply)


def test_numbered_reply(spark):
    text = "[P1]\nEMOTION: happy\nFirst\nline\n\n[P2]\nSecond\n[P2]\nEMOTION: odd\nSecond again"
    assert [tuple(r) for r in run(spark, text, 2, R.numbered_reply)] == [("Happy", "First\nline"), ("Narration", "Second again")]
    for n in (1, 3):
        with pytest.raises(Exception, match="missing paragraphs"):
            run(spark, text, n, R.numbered_reply)


def test_prompt(spark):
    rows = spark.createDataFrame([(["a", "b"], {"y": "2", "x": "1"}, "ctx"), (["c"], None, None)], "t array<string>, g map<string,string>, c string")
    got = [r.p for r in rows.select(R.edit_prompt(F.col("t"), F.col("g"), F.col("c")).alias("p")).collect()]
    assert got == ["Glossary:\nx = 1\ny = 2\n\nBefore:\nctx\n\nParagraphs:\n[P1]\na\n\n[P2]\nb", "Paragraphs:\n[P1]\nc"]


def test_references(spark):
    ids = spark.createDataFrame([("t/a.xhtml", "n1"), ("t/a.xhtml", "n2"), ("t/b.xhtml", "n1")], "path string, id string")
    links = spark.createDataFrame([("t/b.xhtml", "a.xhtml#n2"), ("t/b.xhtml", "#n1"), ("t/b.xhtml", "a.xhtml"), ("t/b.xhtml", None)], "path string, href string")
    assert values(closure.referenced(ids, links)) == [("t/a.xhtml", "n2"), ("t/b.xhtml", "n1")]


def test_closure(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x"), ("a", "c")], "id string, refines string")
    assert values(closure.closure(spark.createDataFrame([("a",)], "id string"), edges)) == [("a",), ("b",), ("c",)]
    with pytest.raises(ValueError):
        closure.closure(spark.createDataFrame([("a",)], "id string"), edges, most_rounds=1)
