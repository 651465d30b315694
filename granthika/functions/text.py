"""Column functions on paragraph, heading and file-name text. All of them stay in the JVM; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Shapes of numerals, headings and scan noise that results must agree on.
ROMAN = r"M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
NUMBERED_CHAPTER = r"(?i)^ch(?:apter|\.)\s*(?:\d+|[ivxlcdm]+)\b"
BARE_NUMBER = r"(?i)^(?:\d+|[ivxlcdm]+)\.?$"
FRONT_MATTER = r"(?i)^(?:the\s+)?(?:preface|introduction|table\s+of\s+contents|contents|dedication|front\s+matter)\b"
PAGE_NUMBER = r"^[\divxlIl]{1,4}$"
QUOTE_JUNK = r"''|'\^|\^'|\*'|'<|'\*"
END_PUNCTUATION = ".!?\"'”’:;)—"
CHAPTER_MARKER = r"(?i)^((?:CHAPTER|CHAP\.?)\s+(?:[IVXL]+|\d+)\.?)(?:\s+\S.*)?$"
BOOK_MARKER = r"(?i)^((?:BOOK|PART)\s+\d+\.?)(?:\s+\S.*)?$"
ROMAN_ONLY = r"^[IVXL]+\.?$"
CONTENTS_HEADING = r"(?i)^(?:table\s+of\s+contents|contents)$"
CONTENTS_ENTRY = r"^(.{2,}?)\s+[0-9ivxlIVXL]{1,5}\.?$"
EMOTION_PHRASES = {
    "Command": "a commanding tone", "Anger": "an angry tone", "Narration": "a clear narration tone", "Conversation": "a conversational tone", "Disgust": "a disgusted tone",
    "Fear": "a fearful tone", "Happy": "a happy tone", "Neutral": "a neutral tone", "Proper Noun": "a clear, deliberate tone", "News": "a news-reading tone",
    "Sad": "a sad tone", "Surprise": "a surprised tone",
}
YEAR = r"(?<![\p{L}\p{N}_])(1[5-9][0-9][0-9]|20[0-9][0-9])(?![\p{L}\p{N}_])"
COPYRIGHT = r"(?i)copyright|©|\(c\)\s*[0-9]{4}|all rights reserved"
EMOTIONS = ("Neutral", "Happy", "Sad", "Anger", "Fear", "Surprise", "Disgust", "Command", "Conversation", "Narration", "News", "Proper Noun")
FRONT_MATTER_KINDS = {
    "preface": "Preface", "foreword": "Foreword", "introduction": "Introduction", "introductory note": "Introductory Note", "prefatory note": "Prefatory Note",
    "editor's note": "Editor's Note", "editor's preface": "Editor's Preface", "translator's note": "Translator's Note", "translator's preface": "Translator's Preface",
    "publisher's note": "Publisher's Note", "note on the text": "Note on the Text", "notes": "Notes", "bibliographical note": "Bibliographical Note",
    "acknowledgements": "Acknowledgements", "acknowledgments": "Acknowledgements",
}
_KANNADA_SYLLABLE = r"(?:[ಅ-ಔ]|[ಕ-ಹೞ](?:್[ಕ-ಹೞ])*[ಾ-ೌ]?[ಂ-ಃ]?)"
ENGLISH_ABBREVIATION = r"(?<![\p{L}\p{N}_])(?!I\.)[A-Z][a-z]{0,2}\.$"
KANNADA_ABBREVIATION = rf"(?:^|\s)(?:{_KANNADA_SYLLABLE}\.)+$"


def collapse(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def strip_markers(text: Column) -> Column:
    """The text without inline markers ⟦1⟧ … ⟦/1⟧, collapsed."""
    return collapse(F.regexp_replace(text, r"⟦/?[0-9]+⟧", ""))


def letters_key(text: Column) -> Column:
    """Latin letters only, in upper case: what headers and headings are compared by."""
    return F.regexp_replace(F.upper(text), "[^A-Z]", "")


def heading_key(text: Column) -> Column:
    return F.substring(letters_key(text), 1, 24)


def needs_translation(text: Column) -> Column:
    """False for blank text, digits, punctuation and at most one Roman numeral."""
    bare = F.trim(text)
    nothing = rf"^[^\p{{L}}]*(?:(?:{ROMAN})|(?:{ROMAN.lower().replace('(?:', '(?:')}))?[^\p{{L}}]*$"
    return (bare != "") & ~bare.rlike(nothing)


def keep_paragraph(text: Column) -> Column:
    """More than one character and a letter or underscore among them."""
    return (F.length(text) > 1) & text.rlike(r"[\p{L}\p{Nl}_]")


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def is_header_candidate(line: Column) -> Column:
    """At most 60 characters with three letters or more, nine tenths of them capitals."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", ""))
    return (F.length(line) <= 60) & (letters >= 3) & (capitals >= 0.9 * letters)


def fix_ocr(text: Column) -> Column:
    """Quote junk to quotes, no space before punctuation, one space between quotes, collapsed."""
    out = F.regexp_replace(text, QUOTE_JUNK, '"')
    out = F.regexp_replace(out, r"(?U)\s+([,.;:!?])", "$1")
    return collapse(F.regexp_replace(out, r'(?U)"\s+"', '" "'))


def ends_sentence(text: Column) -> Column:
    return F.array_contains(F.split(F.lit(END_PUNCTUATION), ""), F.right(text, F.lit(1)))


def is_chapter_heading(title: Column) -> Column:
    """"Chapter 5", "Ch. IV …", or a bare number or numeral."""
    bare = F.trim(title)
    return bare.rlike(NUMBERED_CHAPTER) | bare.rlike(BARE_NUMBER)


def is_front_matter(title: Column) -> Column:
    return F.trim(title).rlike(FRONT_MATTER)


def roman_heading(text: Column) -> Column:
    """Struct (numeral, rest) of "III. TITLE"; null for other text."""
    bare = F.trim(text)
    numeral = F.regexp_extract(bare, rf"^({ROMAN})\.(?:\s+.*)?$", 1)
    rest = F.trim(F.regexp_extract(bare, rf"^{ROMAN}\.(?:\s+(.*))?$", 1))
    return F.when(numeral != "", F.struct(F.concat(numeral, F.lit(".")).alias("numeral"), rest.alias("rest")))


def pattern_heading(text: Column) -> Column:
    """The marker of "CHAPTER II …", "PART 3 …" or a lone numeral; null for other text."""
    bare = F.trim(text)
    chapter = F.regexp_extract(bare, CHAPTER_MARKER, 1)
    part = F.regexp_extract(bare, BOOK_MARKER, 1)
    roman = F.when(bare.rlike(ROMAN_ONLY), F.rtrim(bare, F.lit(".")))
    return F.coalesce(F.nullif(F.trim(chapter), F.lit("")), F.nullif(F.trim(part), F.lit("")), roman)


def snippet(text: Column, most: int = 80) -> Column:
    """Collapsed, cut to ``most`` characters with an ellipsis as the last."""
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by hyphens; "book" if nothing is left."""
    cut = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(cut != "", cut).otherwise(F.lit("book"))


def safe_name(title: Column, most: int = 80) -> Column:
    """A file name of word characters, hyphens and underscores."""
    kept = F.trim(F.regexp_replace(title, r"[^\p{L}\p{N}_ \-]", ""))
    return F.substring(F.regexp_replace(kept, r"\s+", "_"), 1, most)


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def output_name(stem: Column, preview: Column, language: Column, suffix: str) -> Column:
    return F.concat(stem, F.lit("."), language, F.when(preview, F.lit(".preview")).otherwise(F.lit("")), F.lit(suffix))


def message_key(message: Column) -> Column:
    """A checker's message without line and column."""
    return F.regexp_replace(message, r"\([0-9]+,[0-9]+\):", ":")


def years(text: Column) -> Column:
    """All years from 1500 to 2099 that stand alone in the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def front_matter_kind(text: Column) -> Column:
    """The kind of a front-matter heading, by its normalised wording; null for other text."""
    bare = F.rtrim(F.regexp_replace(collapse(text), "[‘’]", "'"), F.lit(".:;,·…!?\"'“”"))
    table = F.create_map(*[F.lit(x) for pair in FRONT_MATTER_KINDS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(bare)))


def normal_emotion(tag: Column) -> Column:
    """One of the known emotions, whatever the case and spacing, else Narration."""
    table = F.create_map(*[F.lit(x) for e in EMOTIONS for x in (e.lower(), e)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(tag))), F.lit("Narration"))


def emotion_phrase(tag: Column) -> Column:
    """How a voice that takes a style in words is told of an emotion; unknown ones are narrated."""
    table = F.create_map(*[F.lit(x) for pair in EMOTION_PHRASES.items() for x in pair])
    return F.try_element_at(table, normal_emotion(tag))


def edition_year(date: Column) -> Column:
    """The year of a date that is nothing but four digits; null for all else, as a date with day and month tells when a file was made."""
    return F.when(F.trim(date).rlike("^[0-9]{4}$"), F.trim(date).cast("int"))


def preview_label(done: Column, total: Column) -> Column:
    return F.format_string("Preview: %d of %d paragraphs translated", done, total)


def archive_path(raw: Column) -> Column:
    """The path inside the archive that a checker's message names behind the archive's own path, with forward slashes."""
    return F.replace(F.regexp_replace(raw, r"(?i)^.*?\.epub[/\\](.*)$", "$1"), F.lit("\\"), F.lit("/"))


def clean_title(title: Column, fallback: Column, prefix: str, suffix: str, mention: str) -> Column:
    """A title without a library's ``prefix`` and ``suffix`` (patterns); ``fallback`` where it still has the ``mention``."""
    bare = F.regexp_replace(F.regexp_replace(title, f"(?i)^(?:{prefix})", ""), suffix, "")
    return F.when(F.contains(F.lower(bare), F.lit(mention.lower())), fallback).otherwise(bare)


def mentions(text: Column, word: str, around: int = 80) -> Column:
    """For each place where ``word`` stands in the text, whatever the case, the ``around`` characters in whose middle it is."""
    n, half = len(word), around // 2
    pieces = F.split(F.lower(text), word.lower())
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.length(x))
    starts = F.aggregate(lengths, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)) + n, F.lit(0)) + x)))

    def cut(at: Column) -> Column:
        end = F.least(F.length(text), F.greatest(F.lit(0), at + n // 2 - half) + around)
        return F.substring(text, F.greatest(F.lit(0), end - around) + 1, F.lit(around))

    return F.transform(starts, cut)


def split_sentences(text: Column, language: str) -> Column:
    """Sentences by end mark and space; a piece that ends in an abbreviation takes the next one on.

    ``language`` "eng_Latn" or "kan_Knda"; text in others stays whole.
    """
    if language not in ("eng_Latn", "kan_Knda"):
        return F.array(text)
    mark, abbreviation = (r"(?<=[.!?])\s+", ENGLISH_ABBREVIATION) if language == "eng_Latn" else (r"(?<=[.!?।॥])\s+", KANNADA_ABBREVIATION)
    pieces = F.filter(F.transform(F.split(F.trim(text), mark), lambda p: F.trim(p)), lambda p: p != "")
    empty = F.array().cast("array<string>")

    def take(done: Column, piece: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, piece)))
        return F.when((F.size(done) > 0) & F.coalesce(last.rlike(abbreviation), F.lit(False)), joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, empty, take)


def pack(items: Column, limit: int, joiner: str = " ") -> Column:
    """Consecutive strings joined greedily while the result has at most ``limit`` characters; a longer one stays alone."""
    empty = F.array().cast("array<string>")

    def take(done: Column, item: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce(F.length(last) + len(joiner) + F.length(item) <= limit, F.lit(False))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(joiner, last, item)))
        return F.when(fits, joined).otherwise(F.concat(done, F.array(item)))

    return F.aggregate(items, empty, take)


def words(text: Column) -> Column:
    """Runs of Latin letters in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.lower(w))


def valid_markers(text: Column) -> Column:
    """Whether inline markers nest, close and open once each; text without markers is valid."""
    marks = F.regexp_extract_all(text, F.lit("⟦(/?[0-9]+)⟧"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("seen"), F.lit(True).alias("ok"))

    def step(state: Column, mark: Column) -> Column:
        closes, name = mark.startswith("/"), F.regexp_replace(mark, "^/", "")
        depth = F.size(state["open"])
        top = F.try_element_at(state["open"], F.lit(-1))
        good_open = ~F.array_contains(state["seen"], name)
        good_close = F.coalesce(top == name, F.lit(False))
        return F.when(
            closes, F.struct(F.slice(state["open"], 1, F.greatest(depth - 1, F.lit(0))).alias("open"), state["seen"].alias("seen"), (state["ok"] & good_close).alias("ok"))
        ).otherwise(F.struct(F.concat(state["open"], F.array(name)).alias("open"), F.concat(state["seen"], F.array(name)).alias("seen"), (state["ok"] & good_open).alias("ok")))

    return F.aggregate(marks, start, step, lambda s: s["ok"] & (F.size(s["open"]) == 0))
