import zipfile

import pytest
from conftest import values
from pyspark.sql import functions as F

from granthika.engines import interfaces as E
from granthika.plans import book
from granthika.sinks import books
from granthika.sources import epub, texts
from granthika.streaming import arrivals


@pytest.fixture
def library(spark, tmp_path):
    rows = [("bk1", "A <Book>", 1, "One", 0, "Hello & welcome."), ("bk1", "A <Book>", 1, "One", 1, "Second."), ("bk1", "A <Book>", 2, None, 0, "Next."), ("bk2", None, 1, "Only", 0, "Text.")]
    df = spark.createDataFrame(rows, "book_id string, book_title string, chapter_ord int, chapter_title string, pos int, text string")
    out = tmp_path / "out"
    assert values(books.write_epubs(df, str(out)), "book_id", "files") == [("bk1", 2), ("bk2", 1)]
    return out


def test_epub_round_trip(spark, library):
    spark.dataSource.register(epub.EpubSource)
    df = spark.read.format("granthika_epub").option("path", str(library)).load()
    rows = values(df.where("kind = 'text'"), "chapter_ord", "chapter_title", "index", "text")
    assert rows == [(1, "One", 1, "Hello & welcome."), (1, "One", 2, "Second."), (1, "Only", 1, "Text."), (2, "Chapter 2", 1, "Next.")]
    meta = spark.read.format("granthika_epub").option("path", str(library)).option("view", "metadata").load()
    assert values(meta, "title") == [("A <Book>",), ("bk2",)]
    binary = epub.read_epub_binary(spark.read.format("binaryFile").load(f"{library}/*.epub"))
    assert values(binary, "text") == values(df, "text")
    with zipfile.ZipFile(library / "bk1.epub") as file:
        assert file.infolist()[0].filename == "mimetype" and file.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_blocks():
    html = b"""<html><head><title>T</title></head><body><h1>Head</h1><p><a id="x"></a>One <i>two</i> <b>three</b></p><div id="pg-header"><p>junk</p></div>
    <table><caption>Cap</caption><tr><td><p>cell</p></td><td>plain</td></tr></table><blockquote><p>inner</p></blockquote><p>&amp; end<br/>line</p></body></html>"""
    blocks, title = epub.read_blocks(html)
    rows = epub.paragraphs_of(blocks)
    assert title == "T"
    assert [(r[1], r[2]) for r in rows] == [("heading", "Head"), ("text", "One two three"), ("text", "Cap"), ("table_cell", "cell"), ("table_cell", "plain"), ("text", "inner"), ("text", "& end line")]
    assert rows[1][3] == "One ⟦2⟧two⟦/2⟧ ⟦3⟧three⟦/3⟧"
    assert [r[0] for r in rows] == [0, 1, 3, 5, 6, 8, 9]


def test_missing_file_is_an_error(tmp_path):
    path = tmp_path / "bad.epub"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
    with pytest.raises(FileNotFoundError):
        epub.book_rows(str(path), path.read_bytes(), "paragraphs", 1)


def test_plain_and_html(spark):
    df = spark.createDataFrame([(1, "a\r\nb\r\n\r\n c   d"), (2, "x\ny\n"), (3, ""), (4, None)], "k int, text string")
    assert values(texts.split_plain(df, "k")) == [(1, 0, "a b"), (1, 1, "c d"), (2, 0, "x"), (2, 1, "y")]
    pages = spark.createDataFrame([(1, "<nav>menu</nav><div><p>One<br>two</p><script>x</script><p>Three &amp; four</p></div>"), (2, None)], "k int, html string")
    assert values(texts.split_html(pages, "k")) == [(1, 0, "One"), (1, 1, "two"), (1, 2, "Three & four")]
    sample = spark.createDataFrame([(1, "[1] EN: Hello there.\n[1] KN: ನಮಸ್ಕಾರ.\n\n[2] EN: Go.\n[2] KN: ಹೋಗು.")], "k int, text string")
    assert values(texts.bilingual_sample(sample, "k"), "n", "en", "kn") == [(1, "Hello there.", "ನಮಸ್ಕಾರ."), (2, "Go.", "ಹೋಗು.")]


def test_checker_report(spark):
    text = "ERROR(RSC-005): a.xhtml(1,2): bad\nWARNING(X-1): b: odd\nMessages: 0 fatals / 1 error / 1 warning / 0 infos"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    row = texts.checker_report(df, "k").first()
    assert (row.fatals, row.errors, row.warnings, len(row.messages)) == (0, 1, 1, 2)
    with pytest.raises(Exception, match="summary"):
        texts.checker_report(spark.createDataFrame([(1, "nothing")], "k int, text string"), "k").collect()


def paragraphs(spark):
    rows = [("b", "c1", 1, i, i, "text", t) for i, t in enumerate(["Chapter One", "Hello Meera.", "12", None, "Bye."])]
    return spark.createDataFrame(rows, "book_id string, chapter_id string, chapter_ord int, index int, pos int, kind string, text string")


def test_plan(spark):
    source, plan = paragraphs(spark), book.BookPlan(batch_size=2)
    terms = spark.createDataFrame([("b", "Meera", "ಮೀರಾ")], "book_id string, source_term string, target_term string")
    out = book.translate(source, plan, terms)
    rows = {r["index"]: r for r in out.collect()}
    assert sorted(rows) == [0, 1, 2, 4]
    assert rows[2].edited == "12" and rows[1].edited == "ಕಕಕಕಕ ಕಕಕಕಕ." and rows[2].prior_context == "Chapter One Hello Meera."
    again = book.translate(source, plan, terms, done=out)
    assert values(again, "index", "edited") == values(out, "index", "edited")
    judged = book.evaluate(out, plan)
    better = book.retry(judged.withColumn("qa_class", F.lit("RETRY")), plan, lambda: E.LetterTranslator("x"))
    assert {r["index"] for r in better.collect()} == {0, 1, 2, 4}
    m = book.manifest(out, source).first()
    assert (m.paragraphs_translated, m.paragraphs_total, m.preview) == (4, 4, False)


class Short:
    def translate(self, texts, retry=False):
        return texts[:-1]


def test_wrong_count_fails(spark):
    with pytest.raises(Exception):  # noqa: B017 - Spark wraps the engine's error
        book.translate(paragraphs(spark), book.BookPlan(translator=Short)).collect()


def test_site_wav_review(spark, tmp_path):
    df = spark.createDataFrame([("bk", "B", 1, "One", 0, "a<b"), ("bk", "B", 2, "Two", 0, "c")], "book_id string, book_title string, chapter_ord int, chapter_title string, pos int, text string")
    assert values(books.write_sites(df, str(tmp_path)), "files") == [(3,)]
    assert "a&lt;b" in (tmp_path / "bk" / "chapter-0001.html").read_text() and "next" in (tmp_path / "bk" / "chapter-0001.html").read_text()
    sounds = E.narrate(df.withColumn("emotion", F.lit("Sad")), E.ToneNarrator, ["book_id", "chapter_ord", "pos"])
    assert values(books.write_narration(sounds, str(tmp_path)), "files") == [(2,)]
    assert (tmp_path / "bk.wav").read_bytes()[:4] == b"RIFF"
    g = spark.createDataFrame([("k", "K", "name", None, "pending", 3, "c", None), ("l", "L", "name", None, "approved", 9, "c", None)], texts.REVIEW)
    books.write_review(g, str(tmp_path / "review"))
    assert values(texts.read_review(spark, str(tmp_path / "review")), "source_term_key", "frequency") == [("k", 3)]


def test_arrivals(spark, library, tmp_path):
    seen = []
    for _ in range(2):
        arrivals.run_available(arrivals.epub_arrivals(spark, str(library)), lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 7


def test_wiki_pages_are_left_out(tmp_path):
    path = tmp_path / "w.epub"
    item = lambda i: f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", f'<package><metadata><source>https://kn.wikisource.org/x</source></metadata><manifest>{item("title")}{item("c1")}</manifest><spine><itemref idref="title"/><itemref idref="c1"/></spine></package>')
        for name in ("title", "c1"):
            z.writestr(f"{name}.xhtml", f"<html><body><p>{name}</p></body></html>")
    assert [r[8] for r in epub.book_rows(str(path), path.read_bytes(), "paragraphs", 1)] == ["c1"]
