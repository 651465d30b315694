import zipfile

import pytest
from conftest import values
from pyspark.sql import functions as F

from granthika.functions import audio
from granthika.operators import imports as I
from granthika.sinks import rewrite
from granthika.sources import checks


def test_dehyphenate(spark):
    rows = spark.createDataFrame([("He was re- cently seen, recently again, well- built.",), (None,)], "text string")
    assert [r.t for r in rows.select(I.dehyphenate(F.col("text")).alias("t")).collect()] == ["He was recently seen, recently again, well-built.", None]


def test_front_junk_and_wrapping(spark):
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(["* * *", "12 %%", ".x", "The start.", "!!"])], "k string, pos int, text string")
    assert values(I.drop_front_junk(rows, ["k"], "pos"), "pos") == [(3,), (4,)]
    line = "word " * 12
    wrapped = spark.createDataFrame([("a", line.strip())] * 4 + [("b", line.strip() + ".")] * 4, "k string, text string")
    assert values(I.hard_wrapped(wrapped, ["k"])) == [("a", True), ("b", False)]


def test_split_at(spark):
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(["CHAPTER I", "Text.", "CHAPTER II", "More.", "CHAPTER IV"])], "k string, pos int, text string")
    assert values(I.headings_of(rows, ["k"], "pos")) == [("b", 0, "CHAPTER I"), ("b", 2, "CHAPTER II"), ("b", 4, "CHAPTER IV")]
    wanted = spark.createDataFrame([("b", 1, "Chapter II"), ("b", 2, "Chapter III"), ("b", 3, "Chapter IV")], "k string, heading_no int, heading string")
    out = {(r.chapter_no, r.pos) for r in I.split_at(rows, wanted, ["k"], "pos").collect()}
    assert out == {(1, 2), (2, None), (3, None)}


def test_openings(spark):
    rows = spark.createDataFrame([("a", 0, "ONCE upon"), ("b", 0, "QNCE upon"), ("c", 0, "Once")], "k string, pos int, text string")
    assert values(I.suspicious_openings(rows, ["k"], "pos", spark.createDataFrame([("once",)], "word string"))) == [("b", "QNCE")]


def test_audio(spark):
    rows = spark.createDataFrame([([0.0, 0.5, -0.25], "Sad"), ([0.0, 0.0], None)], "s array<double>, e string")
    out = rows.select(audio.normalise_peak(F.col("s")).alias("s"), audio.pace(F.col("e")).alias("p"), audio.resample(2, 4)(F.col("s")).alias("r")).collect()
    assert out[0].s == [0.0, 0.9, -0.45] and out[1].s == [0.0, 0.0] and [r.p for r in out] == [0.9, 1.0] and len(out[0].r) == 6


PAGE = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>T</title></head><body id="b"><h1>Head &amp; more</h1>\n<p class="x">One <i id="q">two</i>.</p><table><tr><td><p>cell</p></td></tr></table><img src="a.png"/></body></html>'


def make(path, page=PAGE, stored=True, png=b"\x89PNG\r\n\x1a\n"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="E/p.opf"/></rootfiles></container>')
        z.writestr("E/p.opf", '<package version="3.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:language>en</dc:language></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("E/a.xhtml", page)
        z.writestr("E/a.png", png)
    return path.read_bytes()


def test_rewrite(spark, tmp_path):
    data = make(tmp_path / "in.epub")
    out = rewrite.translate_epub(data, {"a": {0: "ಶೀರ್ಷಿಕೆ <1>", 1: "ಒಂದು ⟦1⟧ಎರಡು⟦/1⟧.", 3: "ಕೋಶ"}}, "kn")
    (tmp_path / "out.epub").write_bytes(out)
    with zipfile.ZipFile(tmp_path / "out.epub") as z, zipfile.ZipFile(tmp_path / "in.epub") as source:
        page = z.read("E/a.xhtml").decode()
        assert "<h1>ಶೀರ್ಷಿಕೆ &lt;1&gt;</h1>" in page and '<p class="x">ಒಂದು <i id="q">ಎರಡು</i>.</p>' in page and "<td><p>ಕೋಶ</p></td>" in page
        assert z.infolist()[0].filename == "mimetype" and b">kn<" in z.read("E/p.opf") and z.read("E/a.png") == source.read("E/a.png")
    assert "⟦" not in rewrite.translate_document(PAGE.encode(), {1: "x ⟦/1⟧y⟦1⟧"}).decode()
    for bad in ({"a": {9: "x"}}, {"zz": {0: "x"}}, {"a": {2: "outer"}}):
        with pytest.raises(ValueError):
            rewrite.translate_epub(data, bad, "kn")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in.epub"))
    texts = files.select("path").selectExpr("path", "'a' as chapter_id", "0 as index", "'ಹೊಸ' as text")
    assert values(rewrite.write_translations(files, texts, str(tmp_path / "t"), "kn"), "blocks") == [(1,)]
    assert (tmp_path / "t" / "in.kn.epub").exists()


def test_checks(spark, tmp_path):
    assert checks.problems_of("p", make(tmp_path / "good.epub")) == []
    bad = make(tmp_path / "bad.epub", '<html><body id="x"><p id="x">a</p><p id="y"/><p id="y"/></body></html>', False, b"GIF89a")
    assert [(r[1], r[2]) for r in checks.problems_of("p", bad)] == [(1, "mimetype"), (2, "E/a.png"), (4, "E/a.xhtml")]
    assert checks.problems_of("p", b"no zip")[0][1] == 0
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.epub")
    assert [r[0] for r in values(checks.epub_problems(files), "check_no")] == [1, 2, 4]
    assert values(checks.epub_features(files), "documents", "tables", "images", "duplicate_ids") == [(1, 0, 0, 2), (1, 1, 1, 0)]
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (1600).to_bytes(4, "big") + (2400).to_bytes(4, "big") + b"\x08\x02\0\0\0crc!" + b"\0\0\0\x05tEXtkey\0vcrc!" + b"\0\0\0\0IDATcrc!"
    assert checks.is_generated_cover("x/12_34-cover.png", "image/png", png) and not checks.is_generated_cover("cover.png", "image/png", png)
    assert checks.has_png_text(png, b"key") and not checks.has_png_text(png, b"other")
