import re

import pytest
from conftest import values
from pyspark.sql import functions as F

from granthika.engines import interfaces as E
from granthika.functions import audio, glossary, text as X, vectors
from granthika.operators import assembly as A, candidates, chapters, imports, library, ordered as O
from granthika.plans import sentences as P
from granthika.sources import epub, texts


def chapters_of(result):
    out = {}
    for r in sorted(result[0].collect(), key=lambda r: (r.k, r.chapter_no, r.place if r.place is not None else -1)):
        out.setdefault((r.k, r.chapter_no, r.title), []).extend([r.text] if r.text is not None else [])
    return out


def warned(result):
    return sorted(r.message for r in result[1].collect())


def test_scanned_text(spark):
    text = (
        "~ ' ^\n\nTHE RED MAP\n\n12\n\nHe was re- cently seen in the sal-\nted field , and the\n\nTHE RED MAP\n\nriver rose. It was recently cold.\n\nxiv\n\n"
        "THE RED MAP\n\n''Come'' ''in'' said he.\n\nl2\n\nThe end came.\n\n---\n\nNobody knew the re- turn way."
    )
    rows, dropped = A.scanned_paragraphs(spark.createDataFrame([("b", text), ("n", None), ("e", "")], "k string, text string"), "k")
    got = [r.text for r in sorted(rows.collect(), key=lambda r: r.pos)]
    assert got == ["THE RED MAP", "He was recently seen in the sal-ted field, and the river rose. It was recently cold.", '"Come" "in" said he.', "The end came.", "Nobody knew the re-turn way."]
    assert values(dropped) == [("b", 2)]
    known, _ = A.scanned_paragraphs(spark.createDataFrame([("b", text)], "k string, text string"), "k", words=spark.createDataFrame([("Salted",), ("return",)], "word string"))
    assert {"Nobody knew the return way."} <= {r.text for r in known.collect()}


def test_divided_words_only_whole(spark):
    rows = spark.createDataFrame([("b", 0, "the re- cent and re- cently and well- knowns")], "k string, pos int, text string")
    known = spark.createDataFrame([("b", "recently"), ("b", "wellknown"), ("c", "recent")], "k string, word string")
    assert A.join_divided(rows, known, "k").first().text == "the re-cent and recently and wellknowns"


def test_chapters_by_contents(spark):
    text = "My Book\n\nContents\n\nPAGE\n\nThe First Day .... 1\n\nThe Second Day 9\n\nThe Lost Day xii\n\nPreface text.\n\nThe First Day\n\nIt rained.\n\nTHE SECOND DAY\n\nQNCE it snowed. It rained."
    got = A.import_texts(spark.createDataFrame([("b", text, False)], "k string, text string, ocr boolean"), "k")
    assert chapters_of(got) == {
        ("b", 0, "Front matter"): ["My Book", "Contents", "PAGE", "The First Day .... 1", "The Second Day 9", "The Lost Day xii", "Preface text."],
        ("b", 1, "The First Day"): ["It rained."], ("b", 2, "The Second Day"): ["QNCE it snowed. It rained."],
    }
    assert warned(got) == ['Chapter "The Second Day" starts with "QNCE it snowed. …" — check the first word.', 'Heading "The Lost Day" was not found in the text.']


def test_chapters_by_given_and_looks(spark):
    long = "Chapter Two: and then " + "the river rose and fell again " * 6
    text = f"CHAPTER I\n\nOne.\n\nII\n\nTwo.\n\nIIX marks\n\nBOOK 3\n\n{long}\n\nLast."
    df = spark.createDataFrame([("b", text, False)], "k string, text string, ocr boolean")
    looks = chapters_of(A.import_texts(df, "k"))
    assert [k[2] for k in looks] == ["CHAPTER I", "II", "BOOK 3"] and looks["b", 2, "II"] == ["Two.", "IIX marks"]
    given = spark.createDataFrame([("b", 1, "***"), ("b", 2, "chapter two"), ("b", 3, "Nowhere"), ("b", 4, "Last")], "k string, heading_no int, heading string")
    got = A.import_texts(df, "k", headings=given)
    assert [k[2] for k in chapters_of(got)] == ["Front matter", "chapter two"]
    assert chapters_of(got)["b", 1, "chapter two"][0].startswith("and then the river") and len(warned(got)) == 3
    empty = A.import_texts(df.limit(0), "k")
    assert chapters_of(empty) == {} and warned(empty) == []
    bare = A.import_texts(spark.createDataFrame([("b", "CHAPTER I\n\nCHAPTER II", False)], "k string, text string, ocr boolean"), "k")
    assert chapters_of(bare) == {("b", 1, "CHAPTER I"): [], ("b", 2, "CHAPTER II"): []}


def test_numeral_headings_and_headings_without_letters(spark):
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(["IVORY was sold.", "I", "Text.", "II."])], "k string, pos int, text string")
    wanted = spark.createDataFrame([("b", 1, "I"), ("b", 2, "1"), ("b", 3, "II")], "k string, heading_no int, heading string")
    assert {(r.chapter_no, r.pos) for r in imports.split_at(rows, wanted, ["k"], "pos").collect()} == {(1, 1), (2, None), (3, 3)}


def test_openings_behind_quotes(spark):
    rows = spark.createDataFrame([("a", 0, '"QNCE upon'), ("b", 0, "“THE day"), ("c", 0, "A day"), ("d", 0, None)], "k string, pos int, text string")
    assert values(imports.suspicious_openings(rows, ["k"], "pos", spark.createDataFrame([("the",)], "word string"))) == [("a", "QNCE")]


def test_html_container_and_wrapped_lines(spark):
    wrapped = "<br>".join(["The quick brown fox went over the long bridge and so"] * 4) + "<br><br>The end."
    pages = spark.createDataFrame([(1, f"<html><body><nav>menu</nav><div><div><span>{wrapped}</span></div></div></body></html>"), (2, '<body><p>Site</p><span property="sioc:content">One<br/>two</span></body>'), (3, "<body><div>Intro <p>x</p><table><tr><td>a<td>b</table></div></body>"), (4, None), (5, "")], "k int, html string")
    line = "The quick brown fox went over the long bridge and so"
    assert values(texts.split_html(pages, "k")) == [(1, 0, " ".join([line] * 4)), (1, 1, "The end."), (2, 0, "One"), (2, 1, "two"), (3, 0, "x"), (3, 1, "a"), (3, 2, "b")]
    got = A.import_html(pages, "k")
    assert len(got[0].collect()) == 7


def test_glossary_join_against_all_pairs(spark):
    words = ["Red Map", "red", "map of", "ap", "a", "The Old  Bell", " ring", "x", "ಹಗ್ಗ", "", "ed ma"]
    lines = ["The RED map of strings", "a bell", "the old  bell rang", "ಹಗ್ಗವನ್ನು", "", None, "MAP", "ring", "so ring"]
    texts_ = spark.createDataFrame([(b, i, t) for b in "pq" for i, t in enumerate(lines)], "book_id string, para_id int, text string")
    terms = spark.createDataFrame([("p", w) for w in words] + [("r", "red")], "book_id string, source_term string")
    want = sorted(("p", i, w) for i, t in enumerate(lines) for w in words if t is not None and w.strip() and w.lower() in t.lower())
    got = candidates.relevant_terms(texts_, terms, ["book_id"], ["para_id"])
    assert values(got, "book_id", "para_id", "source_term") == want and values(candidates.relevant_terms(texts_.limit(0), terms, ["book_id"], ["para_id"])) == []


def test_glossary_key_collapses_first(spark):
    rows = spark.createDataFrame([("\t Red   MAP\n",), ("red map",), (None,)], "t string")
    assert [r.k for r in rows.select(glossary.glossary_key(F.col("t")).alias("k")).collect()] == ["red map", "red map", None]


def test_unique_slugs_of_families(spark):
    rows = [(1, "x"), (2, "x"), (3, "x-2"), (4, "x-2"), (5, "y"), (6, "y"), (7, "x"), (8, "z-2")]
    used, want = set(), []
    for i, s in rows:  # one after another
        n, name = 2, s
        while name in used:
            name, n = f"{s}-{n}", n + 1
        used.add(name)
        want.append((i, s, name))
    assert values(O.unique_slugs(spark.createDataFrame(rows, "run_id int, slug string"), "slug", "run_id")) == want


def test_resume_compares_texts(spark):
    paragraphs = spark.createDataFrame([("b", "c", i, t) for i, t in enumerate(["one", "two", "three"])] + [("b", "d", 0, "x"), ("b", "d", 0, "x")], "book_id string, chapter_id string, pos int, text string")
    row = lambda *s: [{"source": x, "edited": "e"} for x in s]
    batches = [("b", "c", 0, 1, row("old")), ("b", "c", 0, 2, row("one", "two")), ("b", "c", 2, 3, row("three")), ("b", "c", 0, 3, row("one")), ("b", "d", 0, 1, row("x")), ("b", "e", 0, 1, None)]
    df = spark.createDataFrame(batches, "book_id string, chapter_id string, start int, end int, rows array<struct<source:string,edited:string>>")
    marked = O.fitting_spans(df, paragraphs, ["book_id", "chapter_id"])
    assert values(marked, "chapter_id", "start", "end", "fits") == [("c", 0, 1, False), ("c", 0, 2, True), ("c", 0, 3, False), ("c", 2, 3, True), ("d", 0, 1, False), ("e", 0, 1, False)]
    chain = O.checkpoint_chain(marked.select("book_id", "chapter_id", "start", "end", "fits"), ["book_id", "chapter_id"])
    assert values(chain) == [("b", "c", 3, 2, True), ("b", "d", 0, 0, False), ("b", "e", 0, 0, False)]


def test_restored_and_assigned(spark):
    rows = spark.createDataFrame([("7.", "d", "on the 7th", "Sad"), ("7.", "7.", "7.", "Narration"), ("Go.", "d", "e", "Sad")], "source string, draft string, edited string, emotion string")
    assert values(O.restored(rows, X.needs_translation(F.col("source")))) == [("7.", "7.", "7.", "Narration", False), ("7.", "7.", "7.", "Narration", True), ("Go.", "d", "e", "Sad", False)]
    spans = spark.createDataFrame([("c", 0, 2), ("c", 2, 3)], "k string, start int, end int")
    flat = spark.createDataFrame([("c", i, t) for i, t in enumerate("xyz")], "k string, place int, edited string")
    assert values(O.assign_edited(spans, flat, ["k"])) == [("c", 0, 2, 0, "x"), ("c", 0, 2, 1, "y"), ("c", 2, 3, 2, "z")]
    with pytest.raises(Exception, match="out of step"):
        O.assign_edited(spans, flat.where("place < 2"), ["k"]).collect()
    flags = spark.createDataFrame([("c", 0, True, True), ("c", 1, False, True), ("c", 2, True, False), ("c", 3, True, True)], "k string, pos int, wanted boolean, heading boolean")
    assert [r[-1] for r in values(O.heading_numbers(flags, ["k"], "pos", "wanted", "heading"))] == [1, None, None, 3]


def test_edition_notes(spark):
    rows = [
        ("a", 1, "c1", "Preface", 0, "Copyright 1950 by X"), ("a", 1, "c1", "Preface", 1, "Foreword."), ("a", 2, "c2", None, 0, "Printed 1960, again 1970"), ("a", 2, "c2", None, 99, "1980"),
        ("b", 1, "c1", "Introduction", 0, "An old book of 1850."), ("c", 1, "c1", None, 0, "All rights reserved"), ("d", 1, "c1", None, 0, "x"), ("d", 9, "c9", "Notes", 70, "© 1800"), ("e", 1, "c1", None, 0, "y"),
    ]
    df = spark.createDataFrame(rows, "book_id string, chapter_ord int, chapter_id string, chapter_title string, pos int, text string")
    dates = spark.createDataFrame([("e", "1960"), ("d", "1999-03-01"), ("b", None)], "book_id string, date string")
    got = {r.book_id: r for r in chapters.edition_notes(df, 2024, dates=dates).collect()}
    assert got["a"].front_matter == ["Preface", "Foreword"] and [tuple(y)[:2] for y in got["a"].recent_years] == [("Preface", 1950), ("c2", 1960)] and got["a"].recent_notice and got["a"].needs_review
    assert got["b"].front_matter == ["Introduction"] and not got["b"].needs_review and got["c"].recent_notice and got["c"].needs_review
    assert got["d"].front_matter == ["Notes"] and len(got["d"].notices) == 1 and not got["d"].recent_notice and not got["d"].needs_review and got["e"].edition_year == 1960 and got["e"].needs_review


def test_small_functions(spark):
    one = spark.createDataFrame([("/x/Book.EPUB/EPUB\\ch1.xhtml", "The Project Library eBook of Tales, by X", "a lib B LIB c", "data:audio/x;base64,AAEC", "anger")], "p string, t string, m string, a string, e string")
    row = one.select(
        X.archive_path(F.col("p")).alias("p"), X.clean_title(F.col("t"), F.lit("Book"), "The Project Library eBook of ", ", by X$", "library").alias("t"), X.clean_title(F.col("t"), F.lit("Book"), "zz", "zz", "library").alias("u"),
        X.mentions(F.col("m"), "lib", 4).alias("m"), audio.payload_bytes(F.col("a")).alias("a"), X.emotion_phrase(F.col("e")).alias("e"), X.preview_label(F.lit(3), F.lit(9)).alias("l"), X.emotion_phrase(F.lit(None)).alias("n"),
    ).first()
    text = "a lib B LIB c"
    want = [text[(s := max(0, (e := min(len(text), max(0, (m.start() + m.end()) // 2 - 2) + 4)) - 4)) : e] for m in re.finditer("lib", text, re.I)]
    assert (row.p, row.t, row.u, row.e, row.l, row.n) == ("EPUB/ch1.xhtml", "Tales", "Book", "an angry tone", "Preview: 3 of 9 paragraphs translated", "a clear narration tone") and row.m == want and bytes(row.a) == b"\0\1\2"
    v = spark.createDataFrame([([(1, [2.0]), (0, [1.0])],)], "x array<struct<index:int,embedding:array<double>>>")
    assert v.select(vectors.by_index(F.col("x")).alias("x")).first().x == [[1.0], [2.0]]
    w = spark.createDataFrame([(list("abcde"),), ([],)], "t array<string>").select(P.token_windows(F.col("t"), 2).alias("w")).collect()
    assert [r.w for r in w] == [[["a", "b"], ["c", "d"], ["e"]], [[]]]


def test_translation_by_sentence(spark):
    class Shout(E.Translator):
        def translate(self, texts, **_):
            return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "It rained. Dr. Payaki left."), (2, "IV. THE map"), (3, "IX."), (4, ""), (5, None)], "k int, text string")
    got = P.translate_by_sentence(rows, ["k"], Shout, "eng_Latn")
    assert values(got.select("k", "draft")) == [(1, "IT RAINED. DR. PAYAKI LEFT."), (2, "IV. THE MAP"), (3, "IX."), (4, ""), (5, None)]


def test_library(spark):
    files = spark.createDataFrame([("/b/two.epub",), ("/b/f1.epub",), ("/x/one.epub",), ("/b/bad.epub",)], "path string")
    meta = spark.createDataFrame([("/b/two.epub", "Zed", None), ("/b/f1.epub", " ", "Ann"), ("/x/one.epub", "alpha", "Bo")], "path string, title string, creator string")
    assert [(r.title, r.creator, r.readable) for r in library.shelf(files, meta).collect()] == [("alpha", "Bo", True), ("bad", "Unknown author", False), ("f1", "Ann", True), ("Zed", "Unknown author", True)]
    runs = spark.createDataFrame([("r1", "/x/one.epub"), ("r2", "/gone/two.epub"), ("f1", None), ("none", "no.epub")], "folder string, epub string")
    assert values(library.source_files(runs, files, "/b/")) == [("f1", "/b/f1.epub"), ("none", None), ("r1", "/x/one.epub"), ("r2", "/b/two.epub")]
    saved = spark.createDataFrame([("f", "a", "Old"), ("f", "b", "Kept"), ("f", "c", None), ("f", "d", "Old d")], "folder string, id string, title string")
    now = spark.createDataFrame([("f", "a", "New"), ("f", "d", None)], "folder string, id string, title string")
    assert values(library.chapter_titles(saved, now)) == [("f", "a", "New"), ("f", "b", "Kept"), ("f", "c", "c"), ("f", "d", "d")]
    sections = spark.createDataFrame([("b", "x", 3), ("b", "y", 4)], "book_id string, chapter_id string, paragraphs int")
    skip = lambda *x: spark.createDataFrame([("b", i) for i in x], "book_id string, chapter_id string")
    assert values(library.without_sections(sections, skip("y"))) == [("b", "x", 3)]
    for wrong, said in ((skip("q"), "no such section"), (skip("x", "y"), "no section is left")):
        with pytest.raises(Exception, match=said):
            library.without_sections(sections, wrong).collect()
    assert values(library.selected_totals(sections.withColumn("selected", F.col("chapter_id") == "x"))) == [("b", 2, 1, 3)]
    checks = spark.createDataFrame([("c", 3, "FLAGGED_FOR_REVIEW"), ("c", 1, "FLAGGED_FOR_REVIEW"), ("c", 3, "FLAGGED_FOR_REVIEW"), ("c", 2, "PASS")], "chapter string, at int, status string")
    assert values(library.flagged_places(checks, ["chapter"], "at")) == [("c", [1, 3])]
    assert library.one_copy(spark.createDataFrame([("a", 1, "p"), ("a", 1, "o"), ("a", 2, "q")], "name string, length int, path string")).count() == 2


def test_titles_of_chapters():
    def title(body, label=None, head="Book"):
        return epub.chapter_title(epub.read_document(f"<html><head><title>{head}</title></head><body>{body}</body></html>".encode()), label)

    assert title("<p>x</p>", "Label") == "Label" and title("<p>x</p>") is None and title("<h1>One</h1>", "Label") == "One"
    assert title("<h1> </h1><h2>Two</h2>", "Label") == "Label" and title("<h4>Low</h4>") == "Low" and title("<svg><title>Pic</title></svg><h1>One</h1>", "Label") == "Pic"


def test_contents_of_an_epub(tmp_path):
    import zipfile

    nav = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><a href="a.xhtml">Start</a></nav><nav epub:type="toc"><ol><li><a href="t/../a.xhtml#x">One  <b>day</b></a></li><li><a href="a.xhtml">Again</a></li></ol></nav><nav epub:type="page-list"><a href="b.xhtml">1</a></nav></body></html>'
    ncx = "<ncx><navMap><navPoint><navLabel><text>Old one</text></navLabel><content src='a.xhtml'/></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src='b.xhtml'/></navPoint></navMap></ncx>"
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", '<package><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest></package>')
        z.writestr("nav.xhtml", nav)
        z.writestr("toc.ncx", ncx)
    assert epub.Book((tmp_path / "x.epub").read_bytes()).labels() == {"a.xhtml": "One day", "b.xhtml": "Two"}


def test_entities_are_refused_wherever_they_stand():
    for data in (b"<!DOCTYPE a [<!-- " + b"x" * 9_000 + b" --><!ENTITY e 'x'>]><a/>", "<?xml version='1.0' encoding='utf-16'?><!DOCTYPE a [<!ENTITY e 'x'>]><a/>".encode("utf-16")):
        with pytest.raises(ValueError, match="entity"):
            epub._xml(data)
    assert epub._xml(b"<a><!-- <!ENTITY e 'x'> --></a>").tag == "a"


def test_hollow_boilerplate():
    from granthika.sinks.strip import hollow_document

    page = (
        '<html><body><p id="a">Keep &amp; all</p><div id="pg-header" class="x"><h2>The Library<!-- c --></h2><ul><a id="k"></a><li>one <b id="q">two</b></li><li/></ul><p>x<br/>y</p><i id="z">end</i></div>'
        '<p>More</p><section class="pg-boilerplate"><div id="pg-footer"><p>Licence</p></div></section><p>Last</p></body></html>'
    )
    out = hollow_document(page.encode()).decode()
    tags = lambda text: [b["tag"] for b in epub.read_blocks(text.encode())[0]]
    ids = lambda text: sorted(re.findall(r'id="([^"]+)"', text))
    assert tags(out) == tags(page) and ids(out) == ids(page)
    for gone in ("Library", "one", "two", "<b id", "<i id", "Licence", "<!--", "<br"):
        assert gone not in out
    assert '<p id="a">Keep &amp; all</p>' in out and "<p>More</p>" in out and out.endswith("<p>Last</p></body></html>") and '<ul><li><span id="k"></span>' in out
    plain = b"<html><body><p>x</p></body></html>"
    assert hollow_document(plain) is plain
