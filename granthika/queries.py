"""The queries of the core engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from granthika.functions import glossary, text as X, vectors as V
from granthika.operators import assembly, candidates, chapters, imports, ordered, quality
from granthika.plans import book
from granthika.session import table
from granthika.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows where there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


_L, _R = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"
_WORDS = r"list_filter(string_split_regex(text, '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,6}'))"


@query("acronym_candidates", f"select source, term, count(*) as frequency from (select source, unnest({_WORDS}) as term from documents where text is not null) group by source, term having count(*) >= 3")
def acronym_candidates(spark: SparkSession, base: str) -> DataFrame:
    return candidates.acronyms(table(spark, base, "documents").where("text is not null"), ["source"])


_TOKENS = r"""tokens as (select k_id, {key}, unnest(range(1, len(t) + 1)) as i, unnest(t) as tok from (select row_number() over () as k_id, {key}, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+') as t from paragraphs where text is not null)),
    flags as (select *, regexp_full_match(tok, '[A-Z][a-zA-Z]*') as good, regexp_full_match(tok, '\s+') as gap, lag(tok, 2) over w as two_back, lag(tok) over w as back from tokens window w as (partition by k_id order by i)),
    runs as (select *, sum((not good and not gap or good and not coalesce(regexp_full_match(back, '\s+') and regexp_full_match(two_back, '[A-Z][a-zA-Z]*'), false))::int) over (partition by k_id order by i) as run from flags),
    spans as (select k_id, {key}, run, min(i) filter (good) as a, max(i) filter (good) as b, count_if(good) as n from runs group by all having count_if(good) >= 2),
    found as (select s.{key}, string_agg(r.tok, '' order by r.i) as term from spans s join runs r on r.k_id = s.k_id and r.i between s.a and s.b group by s.k_id, s.run, s.{key}),
    phrases as (select {key}, term, count(*) as frequency from (select {key}, case when list_contains([{leading}], split_part(term, ' ', 1)) and instr(term, ' ') > 0 and substr(term, instr(term, ' ') + 1) <> '' then substr(term, instr(term, ' ') + 1) else term end as term from found) group by all having count(*) >= 3)""".format(key="book_id", leading=", ".join(f"'{w}'" for w in candidates.LEADING))


@query("phrase_candidates", f"with {_TOKENS} select book_id, term, frequency from phrases")
def phrase_candidates(spark: SparkSession, base: str) -> DataFrame:
    return candidates.phrases(table(spark, base, "paragraphs").where("text is not null"), ["book_id"])


@query(
    "glossary_candidates",
    rf"""with {_TOKENS},
    acronyms as (select book_id, tok as term, count(*) as frequency from tokens where regexp_full_match(tok, '[A-Z]{{2,6}}') group by all having count(*) >= 3),
    sentences as (select book_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as s from paragraphs where text is not null),
    words as (select book_id, unnest(regexp_extract_all(s, '[A-Za-z]+')[2:]) as term from sentences),
    taken as (select distinct book_id, unnest(string_split_regex(term, '\s+')) as term from phrases),
    named as (select book_id, term, count(*) as frequency from words where regexp_matches(term, '^[A-Z]') and term <> upper(term) and length(term) > 1 group by all having count(*) >= 3)
    select *, 'acronym' as term_type from acronyms union all select *, 'proper_noun_phrase' from phrases union all select *, 'repeated_capitalized' from named anti join taken using (book_id, term)""",
)
def glossary_candidates(spark: SparkSession, base: str) -> DataFrame:
    return candidates.glossary_candidates(table(spark, base, "paragraphs").where("text is not null"), ["book_id"])


@query(
    "known_words",
    """select book_id, word, count(*) as n from (select book_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from paragraphs where text is not null)
    group by book_id, word having count(*) >= 2""",
)
def known_words(spark: SparkSession, base: str) -> DataFrame:
    return candidates.known_words(table(spark, base, "paragraphs").where("text is not null"), ["book_id"])


_KEY = r"array_to_string(list_filter(string_split_regex(lower(source_term), '[\s\p{Z}]+'), lambda w: w <> ''), ' ')"


@query(
    "glossary_merge",
    f"""select {_KEY} as source_term_key, sum(coalesce(frequency, 0))::bigint as frequency, arg_min(term_type, id * 1000000000000 + epoch(updated_at)::bigint) as term_type, count(*) as rows_merged
    from glossary_terms where source_term is not null group by 1""",
)
def glossary_merge(spark: SparkSession, base: str) -> DataFrame:
    terms = table(spark, base, "glossary_terms").where("source_term is not null").withColumn("source_term_key", glossary.glossary_key(F.col("source_term")))
    order = F.struct("id", "updated_at")
    return terms.groupBy("source_term_key").agg(F.sum(F.coalesce("frequency", F.lit(0)).cast("long")).alias("frequency"), F.min_by("term_type", order).alias("term_type"), F.count("*").alias("rows_merged"))


@query(
    "glossary_relevant",
    f"""with g as (select distinct book_id, {_KEY} as term from glossary_terms where source_term is not null)
    select book_id, para_id, term from paragraphs join g using (book_id) where contains(lower(text), term)""",
)
def glossary_relevant(spark: SparkSession, base: str) -> DataFrame:
    terms = table(spark, base, "glossary_terms").where("source_term is not null").select("book_id", glossary.glossary_key(F.col("source_term")).alias("source_term")).distinct()
    found = candidates.relevant_terms(table(spark, base, "paragraphs").select("book_id", "para_id", "text"), terms, ["book_id"], ["para_id"])
    return found.select("book_id", "para_id", F.col("source_term").alias("term"))


_APPROVED = f"""pairs as (select book_id, trim(source_term) as source, trim(target_term) as target from (select *, row_number() over (partition by book_id, {_KEY} order by updated_at desc, id desc) as k
        from glossary_terms where source_term is not null and target_term is not null and status = 'approved') where k = 1),
    listed as (select *, row_number() over (partition by book_id order by length(source) desc, source, target) as no from pairs)"""


@query(
    "glossary_forced",
    f"""with recursive {_APPROVED},
    texts as (select book_id, para_id, text, (select count(*) from listed l where l.book_id = p.book_id) as n from paragraphs p where text is not null),
    walk as (select book_id, para_id, text as forced, 0::bigint as done, n from texts where n > 0
        union all select w.book_id, w.para_id, regexp_replace(w.forced, regexp_escape(l.source), replace(l.target, chr(92), chr(92) || chr(92)), 'gi'), w.done + 1, w.n from walk w join listed l on l.book_id = w.book_id and l.no = w.done + 1)
    select para_id, forced from walk where done = n""",
)
def glossary_forced(spark: SparkSession, base: str) -> DataFrame:
    pairs = table(spark, base, "glossary_terms").where("source_term is not null and target_term is not null and status = 'approved'")
    last = ordered.first_delivery(pairs.withColumn("key", glossary.glossary_key(F.col("source_term"))), ["book_id", "key"], [F.desc("updated_at"), F.desc("id")])
    terms = last.select("book_id", F.trim("source_term").alias("source_term"), F.trim("source_term").alias("source"), F.trim("target_term").alias("target"))
    rows = table(spark, base, "paragraphs").where("text is not null").select("book_id", "para_id", "text").join(terms.select("book_id").distinct(), "book_id", "left_semi")
    hits = candidates.relevant_terms(rows, terms, ["book_id"], ["para_id"]).groupBy("para_id").agg(glossary.longest_first(F.collect_list(F.struct("source", "target"))).alias("terms"))
    forced = F.when(F.col("terms").isNull(), F.col("text")).otherwise(glossary.force_terms(F.col("text"), F.col("terms")))
    return rows.join(hits, "para_id", "left").select("para_id", forced.alias("forced"))


@query(
    "glossary_masked",
    """with recursive names as (select distinct book_id, trim(source_term) as name from glossary_terms where source_term is not null),
    listed as (select *, row_number() over (partition by book_id order by length(name) desc, name) - 1 as no from names),
    texts as (select book_id, para_id, text, (select count(*) from listed l where l.book_id = p.book_id) as n from paragraphs p where text is not null),
    walk as (select book_id, para_id, text as masked, 0::bigint as done, n from texts where n > 0
        union all select w.book_id, w.para_id, regexp_replace(w.masked, regexp_escape(l.name), '⟦DNT' || l.no || '⟧', 'gi'), w.done + 1, w.n from walk w join listed l on l.book_id = w.book_id and l.no = w.done),
    back as (select book_id, para_id, masked, masked as restored, 0::bigint as done, n from walk where done = n
        union all select b.book_id, b.para_id, b.masked, replace(b.restored, '⟦DNT' || l.no || '⟧', l.name), b.done + 1, b.n from back b join listed l on l.book_id = b.book_id and l.no = b.done)
    select para_id, masked, restored from back where done = n""",
)
def glossary_masked(spark: SparkSession, base: str) -> DataFrame:
    names = table(spark, base, "glossary_terms").where("source_term is not null").select("book_id", F.trim("source_term").alias("name")).distinct()
    number = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc(F.length("name")), "name")) - 1
    terms = names.select("book_id", F.col("name").alias("source_term"), "name", number.alias("no"))
    rows = table(spark, base, "paragraphs").where("text is not null").select("book_id", "para_id", "text").join(terms.select("book_id").distinct(), "book_id", "left_semi")
    hits = candidates.relevant_terms(rows, terms, ["book_id"], ["para_id"]).groupBy("para_id").agg(F.array_sort(F.collect_list(F.struct("no", "name"))).alias("names"))
    marked = rows.join(hits, "para_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<struct<no:int,name:string>>"))).withColumn("masked", glossary.mask_numbered(F.col("text"), F.col("names")))
    return marked.select("para_id", "masked", glossary.unmask_numbered(F.col("masked"), F.col("names")).alias("restored"))


_ROMAN = "M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"


@query(
    "needs_translation",
    rf"""select para_id, trim(text) <> '' and not (regexp_full_match(trim(text), '[^\p{{L}}]*({_ROMAN})?[^\p{{L}}]*') or regexp_full_match(trim(text), '[^\p{{L}}]*({_ROMAN.lower()})?[^\p{{L}}]*')) as needed
    from paragraphs where text is not null""",
)
def needs_translation(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "paragraphs").where("text is not null").select("para_id", X.needs_translation(F.col("text")).alias("needed"))


@query(
    "text_forms",
    r"""select para_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) as collapsed,
    regexp_replace(upper(replace(replace(replace(replace(replace(text, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[^A-Z]', '', 'g') as letters, length(text) > 1 and regexp_matches(text, '[\p{L}\p{Nl}_]') as kept,
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html from paragraphs where text is not null""",
)
def text_forms(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("text")
    return table(spark, base, "paragraphs").where("text is not null").select("para_id", X.collapse(t).alias("collapsed"), X.letters_key(t).alias("letters"), X.keep_paragraph(t).alias("kept"), X.html_escape(t).alias("html"))


@query(
    "marked_texts",
    r"""select para_id, trim(regexp_replace(regexp_replace(marked_text, '⟦/?[0-9]+⟧', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) as plain,
    len(regexp_extract_all(marked_text, '⟦/?[0-9]+⟧'))::int as marks,
    len(regexp_extract_all(marked_text, '⟦[0-9]+⟧')) = len(list_distinct(regexp_extract_all(marked_text, '⟦[0-9]+⟧'))) and list_sort(regexp_extract_all(marked_text, '⟦([0-9]+)⟧', 1)) = list_sort(regexp_extract_all(marked_text, '⟦/([0-9]+)⟧', 1))
    and regexp_full_match(regexp_replace(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(marked_text, '⟦/?[0-9]+⟧'), ''), '⟦[0-9]+⟧⟦/[0-9]+⟧', '', 'g'), '⟦[0-9]+⟧⟦/[0-9]+⟧', '', 'g'), '⟦[0-9]+⟧⟦/[0-9]+⟧', '', 'g'), '') as valid from paragraphs where marked_text is not null""",
)
def marked_texts(spark: SparkSession, base: str) -> DataFrame:
    m = F.col("marked_text")
    count = F.size(F.regexp_extract_all(m, F.lit("(⟦/?[0-9]+⟧)"), F.lit(1)))
    return table(spark, base, "paragraphs").where("marked_text is not null").select("para_id", X.strip_markers(m).alias("plain"), count.alias("marks"), X.valid_markers(m).alias("valid"))


@query(
    "sentence_pieces",
    r"""select para_id, len(list_filter(string_split(regexp_replace(trim(text), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::int as pieces from paragraphs where text is not null""",
)
def sentence_pieces(spark: SparkSession, base: str) -> DataFrame:
    pieces = F.filter(F.split(F.trim("text"), r"(?<=[.!?])\s+"), lambda p: p != "")
    return table(spark, base, "paragraphs").where("text is not null").select("para_id", F.size(pieces).alias("pieces"))


_SENTENCES = r"""pieces as (select para_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as p from paragraphs where text is not null),
    placed as (select para_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as piece from pieces),
    told as (select *, lag(regexp_matches(piece, '(^|[^\p{L}\p{N}_])[A-Z][a-z]{0,2}\.$') and not regexp_matches(piece, '(^|[^\p{L}\p{N}_])I\.$')) over (partition by para_id order by i) as goes_on from placed),
    parted as (select *, sum((not coalesce(goes_on, false))::int) over (partition by para_id order by i) - 1 as no from told),
    sentences as (select para_id, no::int as no, string_agg(piece, ' ' order by i) as sentence from parted group by all)"""


@query("sentence_merge", f"with {_SENTENCES} select * from sentences")
def sentence_merge(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "paragraphs").where("text is not null")
    return rows.select("para_id", F.posexplode(X.split_sentences(F.col("text"), "eng_Latn")).alias("no", "sentence"))


@query(
    "narration_chunks",
    f"""with recursive {_SENTENCES},
    walk as (select para_id, 0 as i, sentence as chunk, 0 as no from sentences where no = 0
        union all select w.para_id, w.i + 1, case when length(w.chunk) + 1 + length(s.sentence) <= 200 then w.chunk || ' ' || s.sentence else s.sentence end, case when length(w.chunk) + 1 + length(s.sentence) <= 200 then w.no else w.no + 1 end
        from walk w join sentences s on s.para_id = w.para_id and s.no = w.i + 1)
    select para_id, no, arg_max(chunk, i) as chunk from walk group by para_id, no""",
)
def narration_chunks(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "paragraphs").where("text is not null")
    return rows.select("para_id", F.posexplode(X.pack(X.split_sentences(F.col("text"), "eng_Latn"), 200)).alias("no", "chunk"))


_DELIVERED = "(select * from (select *, row_number() over (partition by book_id, chapter_id, index order by loaded_at desc, para_id desc) as k from paragraphs) where k = 1)"


def delivered(spark: SparkSession, base: str) -> DataFrame:
    """The paragraphs as last delivered."""
    return ordered.first_delivery(table(spark, base, "paragraphs"), ["book_id", "chapter_id", "index"], [F.desc("loaded_at"), F.desc("para_id")])


@query("last_delivery", f"select book_id, chapter_id, index, para_id, text from {_DELIVERED}")
def last_delivery(spark: SparkSession, base: str) -> DataFrame:
    return delivered(spark, base).select("book_id", "chapter_id", "index", "para_id", "text")


@query(
    "paragraph_batches",
    f"""select book_id, chapter_id, batch_no, count(*) as paragraphs, min(index) as first_index, max(index) as last_index from
    (select *, ((row_number() over (partition by book_id, chapter_id order by index) - 1) // 20)::int as batch_no from {_DELIVERED}) group by all""",
)
def paragraph_batches(spark: SparkSession, base: str) -> DataFrame:
    return ordered.batches(delivered(spark, base), ["book_id", "chapter_id"], "index", 20).groupBy("book_id", "chapter_id", "batch_no").agg(F.count("*").alias("paragraphs"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))


@query(
    "rolling_context",
    f"""with p as (select *, row_number() over (partition by book_id, chapter_id order by index) - 1 as position from {_DELIVERED} where text is not null),
    b as (select *, (position // 20)::int as batch_no, row_number() over (partition by book_id, chapter_id, position // 20 order by position desc) as back from p),
    e as (select book_id, chapter_id, batch_no, count(*)::int as n, string_agg(text, ' ' order by position) filter (back <= 3) as tail from b group by all)
    select book_id, chapter_id, batch_no, n, coalesce(lag(tail) over (partition by book_id, chapter_id order by batch_no), '') as prior_context from e""",
)
def rolling_context(spark: SparkSession, base: str) -> DataFrame:
    rows = ordered.batches(delivered(spark, base).where("text is not null"), ["book_id", "chapter_id"], "index", 20)
    return ordered.rolling_context(rows, ["book_id", "chapter_id"], 20, 3)


@query(
    "chapter_tail_carry",
    f"""with p as (select *, row_number() over (partition by book_id, chapter_ord order by pos desc, index desc, para_id desc) as back from {_DELIVERED} where text is not null),
    e as (select book_id, chapter_ord, string_agg(text, ' ' order by pos, text) filter (back <= 3) as tail from p group by all)
    select book_id, chapter_ord, coalesce(lag(tail) over (partition by book_id order by chapter_ord), '') as incoming_context from e""",
)
def chapter_tail_carry(spark: SparkSession, base: str) -> DataFrame:
    return ordered.carried_tail(delivered(spark, base).where("text is not null"), "book_id", "chapter_ord", 3)


def chapters_of(spark: SparkSession, base: str) -> DataFrame:
    """(book_id, chapter_ord, chapter_id, title, first_text) of the delivered chapters."""
    place = F.struct("pos", "index", "para_id")
    return delivered(spark, base).groupBy("book_id", "chapter_ord", "chapter_id").agg(F.max("chapter_title").alias("title"), F.min_by("text", place).alias("first_text"))


@query(
    "context_mode",
    f"""with c as (select book_id, chapter_ord, chapter_id, max(chapter_title) as title, first(text order by pos, index, para_id) as first_text from {_DELIVERED} group by all),
    m as (select *, coalesce(trim(title), '') <> '' as titled,
        coalesce(regexp_matches(trim(title), '(?i)^(the\\s+)?(preface|introduction|table\\s+of\\s+contents|contents|dedication|front\\s+matter)\\b'), false) as front,
        coalesce(regexp_matches(trim(title), '(?i)^ch(apter|\\.)\\s*([0-9]+|[ivxlcdm]+)\\b') or regexp_matches(trim(title), '(?i)^([0-9]+|[ivxlcdm]+)\\.?$'), false) as numbered,
        coalesce(regexp_matches(trim(first_text), '(?i)^ch(apter|\\.)\\s*([0-9]+|[ivxlcdm]+)\\b') or regexp_matches(trim(first_text), '(?i)^([0-9]+|[ivxlcdm]+)\\.?$'), false) as opens from c)
    select book_id, chapters, numbered, case when chapters >= 3 and numbered / chapters >= 0.6 then 'carry' else 'reset' end as mode from
    (select book_id, count(*) as chapters, count_if(numbered or (titled and opens))::bigint as numbered from m where not front group by book_id)""",
)
def context_mode(spark: SparkSession, base: str) -> DataFrame:
    return chapters.context_mode(chapters_of(spark, base))


@query(
    "chapter_navigation",
    f"""with c as (select book_id, chapter_ord, min(chapter_id) as chapter_id from {_DELIVERED} group by all)
    select book_id, chapter_ord, chapter_id, lag(chapter_id) over w as previous, lead(chapter_id) over w as next from c window w as (partition by book_id order by chapter_ord)""",
)
def chapter_navigation(spark: SparkSession, base: str) -> DataFrame:
    rows = delivered(spark, base).groupBy("book_id", "chapter_ord").agg(F.min("chapter_id").alias("chapter_id"))
    return ordered.neighbours(rows, ["book_id"], "chapter_ord", "chapter_id")


@query(
    "heading_shapes",
    rf"""select para_id, nullif(regexp_extract(trim(text), '^({_ROMAN})\.(\s+.*)?$', 1), '') || '.' as numeral,
    regexp_matches(trim(text), '(?i)^ch(apter|\.)\s*([0-9]+|[ivxlcdm]+)\b') or regexp_matches(trim(text), '(?i)^([0-9]+|[ivxlcdm]+)\.?$') as chapter_like
    from paragraphs where kind = 'heading' and text is not null""",
)
def heading_shapes(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "paragraphs").where("kind = 'heading' and text is not null")
    return rows.select("para_id", X.roman_heading(F.col("text"))["numeral"].alias("numeral"), X.is_chapter_heading(F.col("text")).alias("chapter_like"))


@query(
    "preview_limit",
    f"""with p as (select book_id, chapter_id, count_if(pos < 10) as kept, count(*) as total from {_DELIVERED} group by all)
    select book_id, sum(kept)::bigint as translated, sum(total)::bigint as total, bool_or(kept < total) as preview from p group by book_id""",
)
def preview_limit(spark: SparkSession, base: str) -> DataFrame:
    return chapters.preview(delivered(spark, base), 10)


@query(
    "excluded_chapters",
    f"""with x as (select distinct book_id, unnest(exclude_ids) as chapter_id from run_manifests)
    select book_id, chapter_id, count(*) as paragraphs from {_DELIVERED} anti join x using (book_id, chapter_id) group by all""",
)
def excluded_chapters(spark: SparkSession, base: str) -> DataFrame:
    excluded = table(spark, base, "run_manifests").select("book_id", F.explode("exclude_ids").alias("chapter_id")).distinct()
    return chapters.select_chapters(delivered(spark, base), excluded).groupBy("book_id", "chapter_id").agg(F.count("*").alias("paragraphs"))


@query(
    "duplicate_keys",
    "select book_id, chapter_id, index, count(*) as n, min(para_id) as first_id from paragraphs group by all having count(*) > 1",
)
def duplicate_keys(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "paragraphs").groupBy("book_id", "chapter_id", "index").agg(F.count("*").alias("n"), F.min("para_id").alias("first_id")).where("n > 1")


@query(
    "edition_years",
    rf"""with p as (select book_id, text from {_DELIVERED} where chapter_ord <= 3 and pos < 60 and length(text) <= 120),
    y as (select book_id, unnest(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '1[5-9][0-9][0-9]|20[0-9][0-9]'))) as year from p)
    select book_id, count(*) as years, count_if(year::int >= 1929)::bigint as recent, max(year::int) as last_year from y group by book_id""",
)
def edition_years(spark: SparkSession, base: str) -> DataFrame:
    rows = delivered(spark, base).where("chapter_ord <= 3 and pos < 60 and length(text) <= 120").select("book_id", F.explode(X.years(F.col("text"))).alias("year"))
    return rows.groupBy("book_id").agg(F.count("*").alias("years"), F.count_if(F.col("year") >= 1929).alias("recent"), F.max("year").alias("last_year"))


_KINDS = "map {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in X.FRONT_MATTER_KINDS.items()) + "}"
_BARE = r"""lower(trim(rtrim(regexp_replace(trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g')), '[‘’]', '''', 'g'), '.:;,·…!?"''“”')))"""


@query(
    "edition_notes",
    rf"""with p as (select *, dense_rank() over (partition by book_id order by chapter_ord) as nth, {_KINDS}[{_BARE.format("chapter_title")}] as title_kind from {_DELIVERED} where text is not null),
    o as (select *, list_transform(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '1[5-9][0-9][0-9]|20[0-9][0-9]')), lambda w: w::int) as years from p where title_kind is not null or (nth <= 3 and pos < 60)),
    k as (select book_id, chapter_ord, pos, 0 as n, title_kind as kind from o union all select book_id, chapter_ord, pos, 1, {_KINDS}[{_BARE.format("text")}] from o where length(text) <= 60),
    f as (select book_id, kind, min((chapter_ord, pos, n)) as first from k where kind is not null group by all),
    y as (select book_id, chapter_ord, pos, list_filter(years, lambda y: y >= 1929 and y <= 2024)[1] as year from o where length(text) <= 120),
    y5 as (select *, row_number() over (partition by book_id order by chapter_ord, pos) as k from y where year is not null),
    c as (select book_id, list_filter(years, lambda y: y <= 2024) as years from o where regexp_matches(text, '(?i)copyright|©|\(c\)\s*[0-9]{{4}}|all rights reserved')),
    cc as (select book_id, count(*) as n, coalesce(max(list_max(years)) >= 1929, bool_or(len(years) = 0)) as recent from c group by book_id)
    select b.book_id, coalesce((select string_agg(kind, '|' order by first) from f where f.book_id = b.book_id), '') as front_matter, coalesce((select string_agg(year::varchar, '|' order by k) from y5 where y5.book_id = b.book_id and k <= 5), '') as years,
    least(coalesce(cc.n, 0), 5)::int as notices, coalesce(recent, false) as recent_notice, coalesce(recent, false) or exists (select 1 from y5 where y5.book_id = b.book_id) as needs_review
    from (select distinct book_id from p) b left join cc using (book_id)""",
)
def edition_notes(spark: SparkSession, base: str) -> DataFrame:
    notes = chapters.edition_notes(delivered(spark, base).where("text is not null"), 2024)
    years = F.array_join(F.transform("recent_years", lambda y: y["year"].cast("string")), "|")
    return notes.select("book_id", F.array_join("front_matter", "|").alias("front_matter"), years.alias("years"), F.size("notices").alias("notices"), "recent_notice", "needs_review")


_LATEST = "(select * from (select *, row_number() over (partition by book_id, chapter, paragraph_index order by checked_at desc, qa_id desc) as k from qa_results) where k = 1)"


@query(
    "qa_classes",
    "select qa_id, case when similarity_score >= 0.85 then 'PASS' when similarity_score >= 0.70 then 'RETRY' when similarity_score is not null then 'FLAGGED_FOR_REVIEW' end as qa_class from qa_results",
)
def qa_classes(spark: SparkSession, base: str) -> DataFrame:
    return quality.classify(table(spark, base, "qa_results")).select("qa_id", "qa_class")


@query(
    "qa_summary",
    f"""select book_id, count(*) as total, count_if(similarity_score >= 0.85)::bigint as pass, count_if(similarity_score >= 0.70 and similarity_score < 0.85)::bigint as retry, count_if(similarity_score < 0.70)::bigint as flagged_for_review
    from {_LATEST} group by book_id""",
)
def qa_summary(spark: SparkSession, base: str) -> DataFrame:
    latest = quality.latest_check(table(spark, base, "qa_results"), ["book_id", "chapter", "paragraph_index"])
    return quality.summary(quality.classify(latest), ["book_id"]).drop("mean_score")


@query("qa_means", f"select book_id, round(avg(similarity_score), 4) as mean_score from {_LATEST} group by book_id")
def qa_means(spark: SparkSession, base: str) -> DataFrame:
    latest = quality.latest_check(table(spark, base, "qa_results"), ["book_id", "chapter", "paragraph_index"])
    return quality.summary(quality.classify(latest), ["book_id"]).select("book_id", F.round("mean_score", 4).alias("mean_score"))


@query(
    "qa_best_attempt",
    """select book_id, chapter, paragraph_index, attempts, qa_id, similarity_score from (select *, count(*) over w as attempts, row_number() over (w order by coalesce(similarity_score, -1) desc, qa_id) as k
    from qa_results window w as (partition by book_id, chapter, paragraph_index)) where k = 1""",
)
def qa_best_attempt(spark: SparkSession, base: str) -> DataFrame:
    return quality.best_attempt(table(spark, base, "qa_results"), ["book_id", "chapter", "paragraph_index"])


@query(
    "review_chapters",
    f"select book_id, chapter, count(*) as to_review from {_LATEST} where similarity_score < 0.85 group by all",
)
def review_chapters(spark: SparkSession, base: str) -> DataFrame:
    latest = quality.latest_check(table(spark, base, "qa_results"), ["book_id", "chapter", "paragraph_index"])
    flagged = quality.classify(latest).where("qa_class in ('RETRY', 'FLAGGED_FOR_REVIEW')")
    return flagged.groupBy("book_id", "chapter").agg(F.count("*").alias("to_review"))


@query(
    "qa_on_paragraphs",
    f"""select p.book_id, p.chapter_id, p.index, q.similarity_score from (select distinct book_id, chapter_id, index from paragraphs) p
    left join {_LATEST} q on p.book_id = q.book_id and p.chapter_id = q.chapter and p.index = q.paragraph_index""",
)
def qa_on_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    latest = quality.latest_check(table(spark, base, "qa_results"), ["book_id", "chapter", "paragraph_index"])
    checks = latest.select("book_id", F.col("chapter").alias("chapter_id"), F.col("paragraph_index").alias("index"), "similarity_score")
    return table(spark, base, "paragraphs").select("book_id", "chapter_id", "index").distinct().join(checks, ["book_id", "chapter_id", "index"], "left")


@query(
    "vector_cosines",
    """select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def vector_cosines(spark: SparkSession, base: str) -> DataFrame:
    vectors = table(spark, base, "embeddings").select("vec_id", "embedding")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    "emotions",
    """select batch_id, row_no::int as row_no, coalesce(e, 'Narration') as emotion from (select batch_id, unnest(range(1, len(rows) + 1)) as row_no, unnest(rows).emotion as tag from translated_batches)
    left join (select unnest(['Neutral', 'Happy', 'Sad', 'Anger', 'Fear', 'Surprise', 'Disgust', 'Command', 'Conversation', 'Narration', 'News', 'Proper Noun']) as e) on lower(e) = lower(trim(tag))""",
)
def emotions(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "translated_batches").select("batch_id", F.posexplode("rows").alias("k", "row"))
    return rows.select("batch_id", (F.col("k") + 1).alias("row_no"), X.normal_emotion(F.col("row.emotion")).alias("emotion"))


@query(
    "batch_coordinates",
    """with r as (select batch_id, book_id, chapter_id, paragraph_start, unnest(range(0, len(rows))) as k from translated_batches),
    w as (select book_id, chapter_id, pos, min(index) as index from paragraphs group by all)
    select batch_id, r.book_id, r.chapter_id, (k + 1)::int as row_no, (paragraph_start + k)::int as pos, w.index from r left join w on r.book_id = w.book_id and r.chapter_id = w.chapter_id and r.paragraph_start + k = w.pos""",
)
def batch_coordinates(spark: SparkSession, base: str) -> DataFrame:
    return chapters.batch_coordinates(table(spark, base, "translated_batches"), table(spark, base, "paragraphs"))


@query(
    "checkpoint_chain",
    """with recursive now as (select book_id, chapter_id, pos, min(text) as text, count(*) as n from paragraphs group by all),
    r as (select batch_id, book_id, chapter_id, paragraph_start as a, paragraph_end as b, unnest(range(0, len(rows))) as k, unnest(rows).source as source from translated_batches),
    s as (select distinct r.book_id, r.chapter_id, a, b from r left join now on now.book_id = r.book_id and now.chapter_id = r.chapter_id and now.pos = a + k
        group by batch_id, r.book_id, r.chapter_id, a, b having b > a and count(*) = b - a and bool_and(coalesce(now.text = source and now.n = 1, false))),
    f as (select book_id, chapter_id, a, min(b) as b from s group by all),
    walk as (select distinct book_id, chapter_id, 0 as reach, 0 as steps from translated_batches
        union all select walk.book_id, walk.chapter_id, f.b, steps + 1 from walk join f on walk.book_id = f.book_id and walk.chapter_id = f.chapter_id and f.a = walk.reach)
    select book_id, chapter_id, max(reach)::int as reached, max(steps)::int as steps, max(reach) = any_value(final) as complete from walk
    join (select book_id, chapter_id, max(paragraph_end) as final from translated_batches group by all) using (book_id, chapter_id) group by book_id, chapter_id""",
)
def checkpoint_chain(spark: SparkSession, base: str) -> DataFrame:
    keys = ["book_id", "chapter_id"]
    saved = table(spark, base, "translated_batches").select(*keys, F.col("paragraph_start").alias("start"), F.col("paragraph_end").alias("end"), "rows")
    fitting = ordered.fitting_spans(saved, table(spark, base, "paragraphs").select(*keys, "pos", "text"), keys)
    return ordered.checkpoint_chain(fitting.select(*keys, "start", "end", "fits"), keys)


@query(
    "translation_progress",
    """with last as (select * from (select *, row_number() over (partition by book_id, chapter_id, paragraph_start order by written_at desc, batch_id desc) as k from translated_batches) where k = 1)
    select book_id, sum(len(rows))::bigint as rows, sum(len(list_filter(rows, lambda r: r.edited is null)))::bigint as unedited, count(distinct chapter_id) as chapters from last group by book_id""",
)
def translation_progress(spark: SparkSession, base: str) -> DataFrame:
    last = ordered.first_delivery(table(spark, base, "translated_batches"), ["book_id", "chapter_id", "paragraph_start"], [F.desc("written_at"), F.desc("batch_id")])
    return last.groupBy("book_id").agg(F.sum(F.size("rows")).alias("rows"), F.sum(F.size(F.filter("rows", lambda r: r["edited"].isNull()))).alias("unedited"), F.count_distinct("chapter_id").alias("chapters"))


@query(
    "library",
    """select book_id, run_id, epub, coalesce(preview, false) as preview, round(paragraphs_translated / nullif(paragraphs_total, 0), 6) as covered, len(chapters)::int as chapters
    from (select *, row_number() over (partition by book_id order by started_at desc, run_id desc) as k from run_manifests) where k = 1""",
)
def library(spark: SparkSession, base: str) -> DataFrame:
    last = ordered.first_delivery(table(spark, base, "run_manifests"), ["book_id"], [F.desc("started_at"), F.desc("run_id")])
    covered = F.round(F.try_divide(F.col("paragraphs_translated").cast("double"), F.col("paragraphs_total").cast("double")), 6)
    return last.select("book_id", "run_id", "epub", F.coalesce("preview", F.lit(False)).alias("preview"), covered.alias("covered"), F.size("chapters").alias("chapters"))


@query(
    "unique_slugs",
    """with s as (select run_id, coalesce(nullif(trim(regexp_replace(lower(epub), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'book') as slug from run_manifests where epub is not null)
    select run_id, slug, case when k = 1 then slug else slug || '-' || k end as unique_slug from (select *, row_number() over (partition by slug order by run_id) as k from s)""",
)
def unique_slugs(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "run_manifests").where("epub is not null").select("run_id", X.slug(F.col("epub")).alias("slug"))
    return ordered.unique_slugs(rows, "slug", "run_id")


@query(
    "problem_diff",
    """with m as (select book_id, run_id, regexp_replace(p.message, '\\([0-9]+,[0-9]+\\):', ':', 'g') as key, row_number() over (partition by book_id, run_id) as x, dense_rank() over (partition by book_id order by started_at desc, run_id desc) as back
        from (select book_id, run_id, started_at, unnest(source_problems) as p from run_manifests)),
    o as (select distinct book_id, key from m where back = 2)
    select m.book_id, count_if(o.key is not null)::bigint as inherited, count_if(o.key is null)::bigint as new from m left join o on m.book_id = o.book_id and m.key = o.key where back = 1 group by m.book_id""",
)
def problem_diff(spark: SparkSession, base: str) -> DataFrame:
    runs = table(spark, base, "run_manifests").select("book_id", "run_id", "started_at", F.explode("source_problems").alias("p")).select("book_id", "run_id", "started_at", "p.message")
    back = F.dense_rank().over(Window.partitionBy("book_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    ranked = runs.withColumn("back", back)
    return chapters.problem_diff(ranked.where("back = 2"), ranked.where("back = 1"))


@query(
    "target_scripts",
    """select l.key, count(*) as batches, sum(len(rows))::bigint as rows from translated_batches b join target_languages l on b.target_language = l.key group by l.key""",
)
def target_scripts(spark: SparkSession, base: str) -> DataFrame:
    languages = table(spark, base, "target_languages").select("key")
    rows = table(spark, base, "translated_batches").select("target_language", "rows").join(languages, F.col("target_language") == F.col("key"))  # Spark broadcasts the languages if they are few
    return rows.groupBy("key").agg(F.count("*").alias("batches"), F.sum(F.size("rows")).alias("rows"))


_LINES = "(select import_id, place, unnest(range(1, len(parts) + 1)) as line_no, unnest(parts) as line from (select import_id, unnest(range(1, len(paragraphs) + 1)) as place, string_split(unnest(paragraphs), chr(10)) as parts from imported_chapters))"


def import_lines(spark: SparkSession, base: str) -> DataFrame:
    """(import_id, place, line_no, line) of the scanned chapters."""
    rows = table(spark, base, "imported_chapters").select("import_id", F.posexplode("paragraphs").alias("p", "text")).where("text is not null")
    lines = rows.select("import_id", (F.col("p") + 1).alias("place"), F.posexplode(F.split("text", "\n")).alias("l", "line"))
    return lines.select("import_id", "place", (F.col("l") + 1).alias("line_no"), "line")


@query(
    "page_lines",
    f"select import_id, count(*) as lines, count_if(regexp_matches(trim(line), '^[0-9ivxlIl]{{1,4}}$'))::bigint as page_numbers from {_LINES} group by import_id",
)
def page_lines(spark: SparkSession, base: str) -> DataFrame:
    return import_lines(spark, base).groupBy("import_id").agg(F.count("*").alias("lines"), F.count_if(X.is_page_number(F.trim("line"))).alias("page_numbers"))


@query(
    "running_headers",
    f"""with h as (select i.book_id, regexp_replace(upper(line), '[^A-Z]', '', 'g') as key, line from {_LINES} join imported_chapters i using (import_id)
        where length(line) <= 60 and length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 and length(regexp_replace(line, '[^A-Z]', '', 'g')) >= 0.9 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')))
    select book_id, key, count(*) as n from h group by all having count(*) >= 3""",
)
def running_headers(spark: SparkSession, base: str) -> DataFrame:
    books = table(spark, base, "imported_chapters").select("import_id", "book_id")
    heads = import_lines(spark, base).where(X.is_header_candidate(F.col("line"))).join(books, "import_id")
    return heads.groupBy("book_id", X.letters_key(F.col("line")).alias("key")).agg(F.count("*").alias("n")).where("n >= 3")


_SCANNED = r"""l as (select import_id, row_number() over () as g, place, line_no, trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g')) as line from (select import_id, place, line_no, line from __LINES__)),
    c as (select *, length(line) <= 60 and length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 and length(regexp_replace(line, '[^A-Z]', '', 'g')) >= 0.9 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')) as head, regexp_replace(upper(line), '[^A-Z]', '', 'g') as key
        from l where not regexp_full_match(line, '[0-9ivxlIl]{1,4}'))""".replace("__LINES__", _LINES)


@query(
    "first_headers",
    f"""with {_SCANNED}
    select import_id, place::int as place, line_no::int as line_no, line from (select *, count(*) over (partition by import_id, key) as n, row_number() over (partition by import_id, key order by place, line_no) as k from c where head) where n >= 3 and k > 1""",
)
def first_headers(spark: SparkSession, base: str) -> DataFrame:
    """The repeated running headers that are left out of imports."""
    lines = import_lines(spark, base).withColumn("line", X.collapse(F.col("line"))).withColumn("no", F.struct("place", "line_no"))
    kept = assembly.without_page_numbers(lines.select("import_id", F.col("no").alias("line_no"), "line"))
    return assembly.first_headers(kept, "import_id").where("dropped").select("import_id", "line_no.place", F.col("line_no.line_no").alias("line_no"), "line")


def imported_texts(spark: SparkSession, base: str) -> DataFrame:
    """(import_id, text, ocr): each import as one text, its elements parted by blank lines."""
    return table(spark, base, "imported_chapters").select("import_id", F.array_join("paragraphs", "\n\n").alias("text"), F.coalesce("ocr", F.lit(True)).alias("ocr"))


@query("import_chapters")
def import_chapters(spark: SparkSession, base: str) -> DataFrame:
    """Every paragraph of the assembled imports with its chapter."""
    return assembly.import_texts(imported_texts(spark, base), "import_id")[0]


@query("import_warnings")
def import_warnings(spark: SparkSession, base: str) -> DataFrame:
    return assembly.import_texts(imported_texts(spark, base), "import_id")[1]


@query(
    "ocr_repaired",
    r"""with r as (select import_id, unnest(range(0, len(paragraphs))) as place, unnest(paragraphs) as text from imported_chapters),
    f as (select import_id, place, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '__QUOTES__', '"', 'g'), '[\s\p{Z}]+([,.;:!?])', '\1', 'g'), '"[\s\p{Z}]+"', '" "', 'g'), '[\s\p{Z}]+', ' ', 'g')) as text from r where text is not null),
    k as (select * from f where length(text) > 1 and regexp_matches(text, '[\p{L}\p{Nl}_]')),
    t as (select *, coalesce(not regexp_matches(right(lag(text) over (partition by import_id order by place), 1), '[__ENDS__]') and regexp_matches(text, '^[\p{Ll},;]'), false) as torn from k),
    i as (select *, sum((not torn)::int) over (partition by import_id order by place) as island from t)
    select import_id, island::bigint as island, count(*)::int as pieces, string_agg(text, ' ' order by place) as text from i group by import_id, island""".replace("__QUOTES__", X.QUOTE_JUNK.replace("'", "''")).replace("__ENDS__", X.END_PUNCTUATION.replace("'", "''")),
)
def ocr_repaired(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "imported_chapters").select("import_id", F.posexplode("paragraphs").alias("place", "text")).where("text is not null")
    fixed = rows.select("import_id", "place", X.fix_ocr(F.col("text")).alias("text")).where(X.keep_paragraph(F.col("text")))
    last = F.lag("text").over(Window.partitionBy("import_id").orderBy("place"))
    torn = F.coalesce(~X.ends_sentence(last) & F.col("text").rlike(r"^[\p{Ll},;]"), F.lit(False))
    return ordered.join_torn(fixed.withColumn("torn", torn), ["import_id"], "place", "torn", "text")


@query(
    "event_fold",
    """select user_id, event_type, count(*) as events, max(ts) as last_ts, arg_max(event_id, (ts, event_id)) as last_event from events group by user_id, event_type""",
)
def event_fold(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query(
    "plan_translate",
    f"""select book_id, chapter_id, index, text as source, ((row_number() over (partition by book_id, chapter_id order by index) - 1) // 20)::int as batch_no from {_DELIVERED} where text is not null""",
)
def plan_translate(spark: SparkSession, base: str) -> DataFrame:
    terms = table(spark, base, "glossary_terms").where("source_term is not null")
    return book.translate(delivered(spark, base), book.BookPlan(), terms).select("book_id", "chapter_id", "index", "source", "batch_no")


@query("plan_quality")
def plan_quality(spark: SparkSession, base: str) -> DataFrame:
    done = book.translate(delivered(spark, base), book.BookPlan())
    return book.evaluate(done, book.BookPlan()).select("book_id", "chapter_id", "index", F.round("similarity_score", 6).alias("similarity_score"), "qa_class")


@query(
    "event_windows",
    "select date_trunc('hour', ts) as start, event_type, count(*) as events, round(sum(value), 4) as value from events group by all",
)
def event_windows(spark: SparkSession, base: str) -> DataFrame:
    counted = arrivals.event_counts(table(spark, base, "events"))
    return counted.select("start", "event_type", "events", F.round("value", 4).alias("value"))


@query(
    "heading_markers",
    r"""with t as (select para_id, trim(text) as line from paragraphs where kind = 'heading'),
    m as (select para_id, coalesce(nullif(regexp_extract(line, '(?i)^((CHAPTER|CHAP\.?)\s+([IVXL]+|[0-9]+)\.?)(\s+\S.*)?$', 1), ''), nullif(regexp_extract(line, '(?i)^((BOOK|PART)\s+[0-9]+\.?)(\s+\S.*)?$', 1), ''),
    case when regexp_matches(line, '^[IVXL]+\.?$') then rtrim(line, '.') end) as heading from t) select para_id, heading from m where heading is not null""",
)
def heading_markers(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "paragraphs").where("kind = 'heading'")
    return rows.select("para_id", X.pattern_heading(F.col("text")).alias("heading")).where("heading is not null")


@query(
    "hard_wrapped",
    f"""with c as (select import_id, count_if(length(line) between 50 and 90) as n, count_if(length(line) between 50 and 90 and not regexp_matches(line, '[.!?"''”’):;]$')) as o from {_LINES} group by import_id)
    select import_id, n >= 3 and o >= 0.6 * n as wrapped from c""",
)
def hard_wrapped(spark: SparkSession, base: str) -> DataFrame:
    return imports.hard_wrapped(import_lines(spark, base).withColumnRenamed("line", "text"), ["import_id"])


@query(
    "dehyphenated",
    r"""with recursive t as (select import_id, array_to_string(paragraphs, chr(10)) as text from imported_chapters where paragraphs is not null),
    w as (select distinct import_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from t),
    pairs as (select distinct import_id, unnest(regexp_extract_all(text, '\b([A-Za-z]+- +[a-z]+)\b', 1)) as pair from t),
    judged as (select p.import_id, pair, exists (select 1 from w where w.import_id = p.import_id and w.word in (lower(regexp_replace(pair, '- +', '')), rtrim(lower(regexp_replace(pair, '- +', '')), 's'))) as known from pairs p),
    fixes as (select *, row_number() over (partition by import_id order by pair) as k from judged),
    walk as (select import_id, text, 0::bigint as k from t union all
        select walk.import_id, regexp_replace(text, '\b' || pair || '\b', regexp_replace(pair, '- +', case when known then '' else '-' end), 'g'), walk.k + 1 from walk join fixes on fixes.import_id = walk.import_id and fixes.k = walk.k + 1)
    select import_id, arg_max(text, k) as text from walk group by import_id""",
)
def dehyphenated(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "imported_chapters").select("import_id", F.array_join("paragraphs", "\n").alias("text"))
    return rows.select("import_id", imports.dehyphenate(F.col("text")).alias("text"))


@query(
    "suspicious_openings",
    r"""with f as (select book_id, chapter_id, first(text order by index, para_id) as text from paragraphs where text is not null group by all),
    o as (select book_id, chapter_id, array_to_string(list_filter(string_split(list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda w: w <> '')[1], ''), lambda c: regexp_full_match(c, '[A-Za-z0-9]')), '') as opening from f),
    k as (select upper(word) as word from (select lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from paragraphs where kind = 'text') group by 1 having count(*) >= 2)
    select book_id, chapter_id, opening from o where regexp_full_match(opening, '[A-Z0-9]{2,}') and opening not in (select word from k)""",
)
def suspicious_openings(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "paragraphs").where("text is not null").withColumn("place", F.struct("index", "para_id"))
    known = candidates.known_words(rows.where("kind = 'text'").withColumn("all", F.lit(1)), ["all"])
    return imports.suspicious_openings(rows, ["book_id", "chapter_id"], "place", known)
