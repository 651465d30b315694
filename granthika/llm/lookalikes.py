"""Texts that look the same but are stored with different characters (problem 5).

Two steps. Forms: width of characters, composed and combining forms, invisible characters and ligatures go to one form;
that touches no digit forms, case, accents, kinds of punctuation or line breaks. Look-alikes: the dominant script of every
token that mixes scripts is found, its foreign letters are replaced by the dominant script's letters of the same shape, and the
replacement stands only where the result is a word of the collection's vocabulary. Which letters share a shape is taken from
the public Unicode confusables (UTS 39) in the ICU library that comes with Spark, for the letters of all scripts.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from granthika.session import settle

# Letters and signs of the Telugu, Kannada and Malayalam scripts that share a shape, in this order; a blank stands for none.
# The public confusables have only some of them.
_SOUTHERN = ("TELUGU", "KANNADA", "MALAYALAM")
_TWINS = "ంಂം ఃಃഃ అಅ  ఆಆ  ఇಇ  ఌಌ  ఒಒ  ఓಓ  ఔಔ  గಗ  జಜ  ఞಞ  టಟ  ఠಠ  డಡ  ఢಢ  ణಣ  థಥ  దದ  ధಧ  నನ  బಬ  భಭ  యಯ  రರ  ఱಱ  లಲ  ళಳ  ిಿ  ుು  ూೂ  ృೃ  ౄೄ "
# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "Ǉ": "LJ", "Ǌ": "NJ"}
# Characters without width or ink.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\uffa0\ufeff"
# Spaces of other widths.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _form_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): None for c in INVISIBLE} | {c: None for c in (*range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000))}
    table |= {ord(c): " " for c in SPACES} | {ord(a): b for a, b in LIGATURES.items()}
    for code in range(0xFF01, 0xFFEF):  # the block of full- and half-width forms
        plain = unicodedata.normalize("NFKC", chr(code))
        if code not in table and plain != chr(code):
            table[code] = None if plain in INVISIBLE else plain
    return table


_FORMS = _form_table()
_SCRIPTS: dict[str, str] = {}


def one_form(text: str) -> str:
    """``text`` with one form for width, composition, invisible characters and ligatures."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_FORMS))


def script_of(char: str) -> str:
    """Script of a letter, letter number or script's own sign by the first word of its Unicode name; empty for all else.

    Phonetic letters are a script of their own: no word in Latin letters is written with them.
    """
    known = _SCRIPTS.get(char)
    if known is None:
        kind = unicodedata.category(char)
        known = unicodedata.name(char, "").split(" ")[0] if kind[0] in "LM" or kind == "Nl" else ""
        if known in ("COMBINING", "VARIATION", "MODIFIER"):  # these signs go with any script
            known = ""
        elif known == "LATIN" and ("\u0250" <= char <= "\u02af" or "\u1d00" <= char <= "\u1d7f" or "\uab30" <= char <= "\uab6f"):
            known = "PHONETIC"
        if len(_SCRIPTS) < 200_000:
            _SCRIPTS[char] = known
    return known


class Shapes:
    """Which letters and signs of all scripts share a shape.

    ``shape`` maps a character to what stands for its shape; ``letters`` a script and a shape to that script's characters
    of this shape, the usual ones first.
    """

    def __init__(self, skeletons: dict[str, str]) -> None:
        self.shape = dict(skeletons)
        for i in range(0, len(_TWINS), 4):
            same = [c for c in _TWINS[i : i + 3] if c != " "]
            for c in same[1:]:
                self.shape[c] = self.shape.get(same[0], same[0])
        self.letters: dict[str, dict[str, list[str]]] = {}
        for c in sorted({*self.shape, *filter(str.isalpha, map(chr, range(128))), *self.shape.values()}):
            script = script_of(c) if len(c) == 1 else ""
            if script and unicodedata.category(c) != "Nl":
                self.letters.setdefault(script, {}).setdefault(self.shape.get(c, c), []).append(c)

    def twins(self, char: str, script: str) -> list[str]:
        """The characters of ``script`` with the shape of ``char``, those of its case first; a long shape may be several of them."""
        shape = self.shape.get(char, char)
        known = self.letters.get(script, {})
        found = known.get(shape)
        if not found:
            return [shape] if len(shape) > 1 and all(script_of(c) == script for c in shape) else []
        return sorted(found, key=lambda c: (c.isupper() != char.isupper(), not c.isascii(), c))

    def unmixed(self, token: str, home: str) -> list[str]:
        """The token written wholly in its dominant script, then, if that differs, in ``home``, the script of its text.

        Dominant is the script of most letters; on a tie ``home``, then Latin. Accents stay where they are: letters are replaced
        below them. A script is left out where a foreign letter has no twin in it. Where a letter has twins of both cases the
        one of its own case comes first. A token of one other script counts as foreign to its text.
        """
        token = unicodedata.normalize("NFD", token)
        counts: dict[str, int] = {}
        for c in token:
            s = script_of(c)
            if s:
                counts[s] = counts.get(s, 0) + 1
        if not counts or set(counts) == {home}:
            return []
        dominant = max(counts, key=lambda s: (counts[s], s == home, s == "LATIN"))
        out = []
        for target in dict.fromkeys([dominant, home] if len(counts) > 1 else [home]):
            first, second = [], []
            for c in token:
                s = script_of(c)
                same = [c] if s in ("", target) else self.twins(c, target)
                if not same:
                    break
                first.append(same[0])
                second.append(next((x for x in same if x.isupper() != same[0].isupper()), same[0]))
            else:
                out += [unicodedata.normalize("NFC", "".join(x)) for x in (first, second)]
        return list(dict.fromkeys(out))


_SHAPES: list[Shapes] = []


def shapes(spark: SparkSession) -> Shapes:
    """The shapes of the letters and signs of all scripts but the ideographic ones, by ICU's table of confusables (once in a process)."""
    if not _SHAPES:
        solid = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0xF900, 0xFB00), (0x17000, 0x18D09), (0x20000, 0xE0000))  # Han, Hangul, Tangut
        codes, at = [], 0x41
        for lo, hi in (*solid, (sys.maxunicode, 0)):
            codes += range(at, lo)
            at = hi
        chars = [c for c in map(chr, codes) if script_of(c)]
        checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        found = checker.getSkeleton("\n".join(chars)).split("\n")
        pairs = {c: unicodedata.normalize("NFC", x) for c, x in zip(chars, found, strict=True)}
        _SHAPES.append(Shapes({c: x for c, x in pairs.items() if x != c}))
    return _SHAPES[0]


_WRITINGS: dict[tuple[str, str], list[str]] = {}


def _writings(token: str, home: str, known: Shapes) -> list[str]:
    """``known.unmixed`` without the token itself, looked up for tokens met before."""
    got = _WRITINGS.get((token, home))
    if got is None:
        if len(_WRITINGS) >= 200_000:
            _WRITINGS.clear()
        got = _WRITINGS[token, home] = [x for x in known.unmixed(token, home) if x != token]
    return got


def core(token: str) -> tuple[int, int]:
    """Bounds of the token without punctuation at its ends."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or unicodedata.category(token[a])[0] == "M"):
        a += 1
    while b > a and not (token[b - 1].isalnum() or unicodedata.category(token[b - 1])[0] == "M"):
        b -= 1
    return a, b


def _repairs(form: str, known: Shapes) -> list[dict]:
    scripts = {script_of(c) for c in set(unicodedata.normalize("NFD", form))} - {""}
    if len(scripts) < 2:  # one script has no look-alikes
        return []
    counts: dict[str, int] = {}
    for c in form:
        s = script_of(c)
        if s:
            counts[s] = counts.get(s, 0) + 1
    home, out = max(counts, key=counts.get), []
    for token in form.split():
        if home == "LATIN" and token.isascii():
            continue
        a, b = core(token)
        out += [{"raw": token[a:b], "rank": k, "repaired": x} for k, x in enumerate(_writings(token[a:b], home, known))]
    return out


_MIXED = T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("repaired", T.StringType())]))


def _analyse(known: Shapes):
    @F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("mixed", _MIXED)]))
    def analyse(texts: pd.Series) -> pd.DataFrame:
        forms = [None if t is None else one_form(t) for t in texts]
        return pd.DataFrame({"form": forms, "mixed": [[] if f is None else _repairs(f, known) for f in forms]})

    return analyse


@F.pandas_udf(T.StringType())
def _apply(forms: pd.Series, repairs: pd.Series) -> pd.Series:
    def one(form: str, known) -> str:
        table = {x["raw"]: x["repaired"] for x in known}
        out, at = [], 0
        for token in form.split():
            start = form.index(token, at)
            a, b = core(token)
            out += [form[at : start + a], table.get(token[a:b], token[a:b]), token[b:]]
            at = start + len(token)
        return unicodedata.normalize("NFC", "".join([*out, form[at:]]))

    return pd.Series([one(f, k) for f, k in zip(forms, repairs, strict=True)])


def _vocabulary(forms: DataFrame) -> DataFrame:
    """The words, without punctuation at the ends, as often as they come."""
    word = F.explode(F.split("form", r"\s+")).alias("w")
    return forms.select(word).select(F.regexp_replace("w", r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "").alias("w")).where("w <> ''")


def consistent_texts(texts: DataFrame, *, text_col: str = "text", key_col: str = "id", keep_text: bool = True) -> DataFrame:
    """(key, text, consistent): every row of ``texts`` with its text, unless ``keep_text`` is off, in the one consistent form.

    A null text has a null form, an empty one an empty form; repeated rows come out as often as they came in; other
    columns are ignored. ASCII texts are their own form and never leave the JVM. The vocabulary holds the words of
    all texts that are free of foreign look-alikes; it is never collected: the few distinct mixed tokens meet it in a join.
    """
    base = texts.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    keep = ["key", "text"] if keep_text else ["key"]
    plain = base.where(r"text is null or not text rlike '[^\\x00-\\x7f]'").select(*keep, F.col("text").alias("form"))
    other = base.where(r"text rlike '[^\\x00-\\x7f]'").withColumn("a", _analyse(shapes(texts.sparkSession))("text")).select(*keep, "a.form", "a.mixed")
    other = settle(other, "lookalike-forms")  # five readers follow, and the analysis is the dear part
    clean = other.where("size(mixed) = 0").select(*keep, "form")
    mixed = other.where("size(mixed) > 0")
    # written, so that its size is known when the joins with all words are planned: small, it is sent to them, else both are shuffled
    tokens = settle(mixed.select(F.explode("mixed").alias("m")).select("m.raw", "m.repaired").distinct(), "lookalike-tokens")
    words = _vocabulary(plain.select("form").unionByName(clean.select("form")).where("form is not null"))
    own = _vocabulary(mixed.select("form"))  # the clean words of texts that also hold mixed ones
    own = own.join(tokens.select(F.col("raw").alias("w")).distinct(), "w", "left_anti")
    wanted = tokens.select(F.col("repaired").alias("w")).distinct()
    vocabulary = words.unionByName(own).join(wanted, "w", "left_semi").distinct()
    known = tokens.join(vocabulary.withColumnRenamed("w", "repaired"), "repaired", "left_semi")
    exploded = mixed.select("form", F.explode("mixed").alias("m")).select("form", "m.raw", "m.rank", "m.repaired").distinct()
    best = exploded.join(known, ["raw", "repaired"]).groupBy("form", "raw").agg(F.min_by("repaired", "rank").alias("repaired"))
    repairs = best.groupBy("form").agg(F.collect_set(F.struct("raw", "repaired")).alias("repairs"))
    repaired = repairs.select("form", _apply("form", "repairs").alias("consistent"))
    done = mixed.select(*keep, "form").join(repaired, "form", "left").select(*keep, F.coalesce("consistent", "form").alias("consistent"))
    rest = plain.unionByName(clean).select(*keep, F.col("form").alias("consistent"))
    return done.unionByName(rest)


def _marks(texts: DataFrame) -> DataFrame:
    """(origin, id, f1, f2, t) of the rows with id and letter: two hashes of the consistent form and one of the stored text."""
    keyed = texts.where("id is not null and text is not null").select(F.struct("origin", "id", F.xxhash64("text").alias("t")).alias("id"), "text")
    forms = consistent_texts(keyed, keep_text=False).where(r"consistent rlike '\\p{L}'")
    return forms.select("key.origin", "key.id", F.xxhash64("consistent").alias("f1"), F.xxhash64(F.lit(7), "consistent").alias("f2"), "key.t").distinct()


def lookalike_pairs(texts: DataFrame, *, group_rows: int = 5_000) -> DataFrame:
    """(origin, id_a, id_b), id_a < id_b: rows of one origin whose texts differ as stored but read the same.

    ``texts`` has origin, id, text. Rows without id, text or letter give no pair; of rows repeated whole one counts. Only
    fingerprints travel: two 64-bit hashes of the consistent form and one of the stored text, kept where a form has
    several stored texts. A form with more than ``group_rows`` rows is dealt over several tasks: one side of its rows is
    split, the other repeated for each part.
    """
    marks, group = _marks(texts), ["origin", "f1", "f2"]
    several = marks.groupBy(*group).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    rows = marks.join(several.select(*group, F.ceil(F.col("n") / group_rows).cast("int").alias("parts")), group)
    a = rows.select(*group, F.col("id").alias("id_a"), F.col("t").alias("t_a"), F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int").alias("part"))
    b = rows.select(*group, F.col("id").alias("id_b"), F.col("t").alias("t_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, [*group, "part"]).where("id_a < id_b and t_a <> t_b").select("origin", "id_a", "id_b").distinct()


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(origin, id, class_id, stored, rows): for each row with id and letter the least id that reads the same, and how many
    stored texts and rows its class has.

    The whole answer in one row for each row of ``texts``, where the pairs of a class would grow with its square. Null ids and
    texts and texts without letter are in no class; of rows repeated whole one counts.
    """
    marks, group = _marks(texts), ["origin", "f1", "f2"]
    classes = marks.groupBy(*group).agg(F.min("id").alias("class_id"), F.count_distinct("t").alias("stored"), F.count("*").alias("rows"))
    return marks.join(classes, group).select("origin", "id", "class_id", "stored", "rows")
