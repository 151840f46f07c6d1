"""Queries over sources and languages: formats, parsers, words and trailers, corrections, folding, stems, numerals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages
from ..session import scratch
from ..sources import copy, formats, texts
from .registry import long, n, query
from .stemming import whole_stem

# -- formats


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def file_view(t):
    return formats.view(t("orders"), ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'", [F.col("o_totalprice").desc(), "o_orderkey"], 100)


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"values\", CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM documents" for c in ("doc_id", "lang", "source", "n_chars"))


@query(_STATS)
def file_stats(t):
    return formats.stats(t("documents").select("doc_id", "lang", "source", "n_chars"))


@query("""SELECT 'id' AS rule, count(*) FILTER (WHERE NOT coalesce(doc_id >= 0, false)) AS found FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE NOT coalesce(lang IN ('en', 'fr'), false)) FROM documents
UNION ALL SELECT 'length', count(*) FILTER (WHERE NOT coalesce(n_chars = length(text), false)) FROM documents""")
def file_validation(t):
    return formats.validate(t("documents"), {"id": "doc_id >= 0", "lang": "lang IN ('en', 'fr')", "length": "n_chars = length(text)"})


@query("""SELECT 'n_nationkey' AS "column", CASE WHEN bool_and(regexp_matches(CAST(n_nationkey AS VARCHAR), '^(0|-?[1-9][0-9]{0,17})$')) THEN 'integer' ELSE 'text' END AS type FROM nation UNION ALL
SELECT 'n_name', CASE WHEN bool_and(regexp_matches(n_name, '^(0|-?[1-9][0-9]{0,17})$')) THEN 'integer' ELSE 'text' END FROM nation UNION ALL SELECT 'n_regionkey', CASE WHEN bool_and(regexp_matches(CAST(n_regionkey AS VARCHAR), '^(0|-?[1-9][0-9]{0,17})$')) THEN 'integer' ELSE 'text' END FROM nation
UNION ALL SELECT 'key', 'versekey' UNION ALL SELECT 'flag', 'boolean' UNION ALL SELECT 'props', 'json' UNION ALL SELECT 'nothing', 'text'""")
def type_inference(t):
    df = t("nation")
    made = [F.concat(F.col("n_nationkey").cast("string"), F.lit(".1a:2")).alias("key"), F.when(F.col("n_regionkey") > 1, "t").otherwise("f").alias("flag"), F.lit('{"k": 1}').alias("props"), F.lit(None).cast("string").alias("nothing")]
    return formats.infer(df.select(*[F.col(c).cast("string").alias(c) for c in df.columns], *made))


@query("SELECT o_custkey, o_orderkey, chr(92) || chr(9) || chr(10) || chr(13) || o_orderstatus || chr(92) || 'n' AS value, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS maybe FROM orders")
def copy_escapes(t):
    """Fields escaped as COPY text and read again."""
    value = F.concat(F.lit("\\\t\n\r"), "o_orderstatus", F.lit("\\n"))
    maybe = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority"))
    rows = t("orders").select("o_custkey", "o_orderkey", texts.escaped(value).alias("v"), texts.escaped(maybe).alias("m"))
    return rows.filter(~F.col("v").rlike("[\t\n\r]")).select("o_custkey", "o_orderkey", texts.unescaped(F.col("v")).alias("value"), texts.unescaped(F.col("m")).alias("maybe"))


@query("""SELECT doc_id, '#' || lang || chr(1) || chr(92) AS tag, CASE WHEN doc_id % 3 > 0 THEN text END AS text, doc_id % 2 = 0 AS flag, chr(92) || 'N' AS note FROM documents""")
def copy_file(t):
    """A table written as COPY text and read again: rows that begin with #, control characters, nulls, texts of many lines."""
    docs = t("documents")
    path = scratch(docs.sparkSession, "copy")
    rows = docs.select(F.concat(F.lit("#"), "lang", F.lit("\x01\\")).alias("tag"), "doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("text"), (F.col("doc_id") % 2 == 0).alias("flag"), F.lit("\\N").alias("note"))
    copy.write_copy(rows, path, {"product": "documents", "sources": "one\ntwo"})
    return copy.read_copy(docs.sparkSession, path, "tag string, doc_id long, text string, flag boolean, note string")


# -- texts of several formats, made from the documents: a source is a book, a hundred ids a chapter

_VERSES = r"""SELECT source AS book, CAST(doc_id // 100 + 1 AS INTEGER) AS chapter, CAST(doc_id % 100 + 1 AS VARCHAR) AS verse, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{M}0-9 ,.;]+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents WHERE source IS NOT NULL"""


def _plain(t):
    rows = t("documents").filter("source IS NOT NULL")
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L}\p{M}0-9 ,.;]+", " "), r"\s+", " "))
    return rows.select("source", F.expr("doc_id div 100 + 1").alias("chapter"), (F.col("doc_id") % 100 + 1).alias("verse"), F.coalesce(text, F.lit("")).alias("text"))


def _files(t, verse, chapter, book):
    """One text a chapter of a book, of a hundred verses at most."""
    in_chapter = _plain(t).groupBy("source", "chapter").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("verse", verse.alias("v")))), lambda x: x["v"]), "").alias("v"))
    return in_chapter.withColumn("c", chapter).select(book.alias("value"))


def _s(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


c = F.col


@query(f"SELECT book, chapter, verse, coalesce(text, '') AS text FROM ({_VERSES})")
def usfm_texts(t):
    verse = _s("\\v ", c("verse"), " \\w ", c("text"), "|strong=\"H1\"\\w*\\f + \\ft a note\\f*\n")
    return texts.verses(_files(t, verse, _s("\\c ", c("chapter"), "\n\\s A heading\n\\p\n", c("v")), _s("\\id ", c("source"), " made up\n\\h name\n", c("c"))), "usfm")


@query(f"SELECT book, chapter, verse, coalesce(text, '') AS text FROM ({_VERSES})")
def osis_texts(t):
    ref = _s(c("source"), ".", c("chapter"), ".", c("verse"))
    verse = F.when(c("verse") % 2 == 0, _s("<verse osisID=\"", ref, "\">", c("text"), "<note>a note</note></verse>")).otherwise(_s("<verse sID=\"", ref, "\"/>", c("text"), "<title>no text</title><verse eID=\"", ref, "\"/>"))
    chapter = _s("<chapter>", c("v"), "</chapter>")
    return texts.verses(_files(t, verse, chapter, _s("<osis xmlns=\"http://www.bibletechnologies.net/2003/OSIS/namespace\"><div type=\"book\">", c("c"), "</div></osis>")), "osis")


@query(f"SELECT book, chapter, verse, coalesce(text, '') AS text FROM ({_VERSES})")
def tei_texts(t):
    verse = _s("<ab n=\"", c("verse"), "\">", c("text"), "<note>a note</note></ab>")
    chapter = _s("<div type=\"chapter\" n=\"", c("chapter"), "\">", c("v"), "</div>")
    return texts.verses(_files(t, verse, chapter, _s("<TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><text><div type=\"book\" n=\"", c("source"), "\">", c("c"), "</div></text></TEI>")), "tei")


# -- words


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+(?:[''’\-][\p{L}\p{M}\p{N}]+)*')) AS words, regexp_replace(text, '^[^\p{L}\p{M}\p{N}]+', '') AS assembled FROM documents""")
def text_assembly(t):
    """Words and trailers of every text give it back from its first word on."""
    rows = t("documents").select("doc_id", texts.words(F.col("text")).alias("w"))
    return rows.select("doc_id", long(F.size("w")).alias("words"), texts.assembled(F.col("w")).alias("assembled"))


@query(r"""SELECT doc_id, trim(string_agg(CASE WHEN regexp_matches(x, '[ (\[{<«“‘]$') THEN x ELSE x || ' ' END, '' ORDER BY k), ' ') AS joined FROM (SELECT doc_id, unnest(range(0, len(p))) AS k, regexp_replace(unnest(p), '[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g') AS x FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+[^a-z]*') AS p FROM documents)) GROUP BY 1""")
def word_separation(t):
    pieces = F.regexp_extract_all("text", F.lit("[a-z]+[^a-z]*"), F.lit(0))
    rows = t("documents").select("doc_id", pieces.alias("p")).filter("size(p) > 0")
    parts = F.transform("p", lambda x: F.concat(F.regexp_extract(x, "^[a-z]+", 0), texts.separated(F.regexp_extract(x, "(?s)^[a-z]+([^a-z]*)$", 1))))
    return rows.select("doc_id", F.trim(F.array_join(parts, "")).alias("joined"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 THEN 'put right' ELSE p_name END AS p_name, CASE WHEN p_partkey % 10 = 1 THEN 'applied' WHEN p_partkey % 10 = 2 THEN 'outdated' END AS correction FROM part""")
def declared_corrections(t):
    part = t("part").select("p_partkey", "p_name")
    fixes = part.filter("p_partkey % 10 IN (1, 2)").select("p_partkey", F.when(F.col("p_partkey") % 10 == 1, F.col("p_name")).otherwise("an older text").alias("was"), F.lit("put right").alias("now"))
    return texts.corrected(part, fixes, ["p_partkey"], "p_name")


@query("""SELECT l_orderkey, l_returnflag AS surface, 'G' || l_partkey AS number, count(*) AS words FROM lineitem GROUP BY 1, 2, 3 UNION ALL SELECT l_orderkey, l_returnflag, 'H' || l_suppkey, count(*) FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3""")
def tagged_words(t):
    """A text of tagged words for each order, and the numbers read from it."""
    word = _s(c("l_returnflag"), "<G", c("l_partkey"), ">", F.when(c("l_linestatus") == "F", _s("<H", c("l_suppkey"), ">")).otherwise(F.lit("")))
    text = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(word), "  ").alias("text"))
    rows = text.select("l_orderkey", F.explode(texts.tagged(F.col("text"))).alias("w"))
    return rows.select("l_orderkey", "w.surface", F.explode("w.numbers").alias("number")).groupBy("l_orderkey", "surface", "number").agg(n().alias("words"))


# -- languages

_FORMS = r"(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS form FROM documents WHERE lang = '{0}')"


def _forms(t, language):
    return t("documents").filter(c("lang") == language).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("form")).distinct()


def _without_sql(word, endings):
    return f"nullif(regexp_extract({word}, '^(.{{3,}}?)(?:{'|'.join(endings)})$', 1), '')"


def _by_plural_sql(word, plural, endings, accents):
    own = [e for e in endings if e.endswith("s")]
    return f"coalesce(translate({_without_sql(word, own)}, '{accents[0]}', '{accents[1]}'), translate({_without_sql(plural, endings)}, '{accents[0]}', '{accents[1]}'), {plural})"


def stems_sql(language, forms):
    """form, stem of a SELECT of forms by the rules of a language."""
    if language == "fr":
        return f"WITH f AS ({forms}), p AS (SELECT form, regexp_replace(form, '^(.{{3,}})[sx]$', '\\1') AS plural FROM f) SELECT form, {_by_plural_sql('form', 'plural', languages.FRENCH, ('éèêàâîïôûùç', 'eeeaaiiouuc'))} AS stem FROM p"
    if language == "es":
        return f"WITH f AS ({forms}), p AS (SELECT form, {_enclitic_sql('form')} AS verb FROM f) SELECT form, coalesce(translate({_without_sql('verb', languages.SPANISH)}, 'áéíóú', 'aeiou'), verb) AS stem FROM p"
    if language == "de":
        return f"WITH f AS ({forms}), {_german_sql()}"
    return f"WITH f AS ({forms}) SELECT form, {whole_stem('form')} AS stem FROM f"


@query(f"WITH f AS {_FORMS.format('fr')}, p AS (SELECT form, regexp_replace(form, '^(.{{3,}})[sx]$', '\\1') AS plural FROM f) SELECT form, {_by_plural_sql('form', 'plural', languages.FRENCH, ('éèêàâîïôûùç', 'eeeaaiiouuc'))} AS stem FROM p")
def stems_french(t):
    return languages.stem(_forms(t, "fr"), "form", "fr")


@query(f"WITH f AS {_FORMS.format('es')}, p AS (SELECT form, regexp_replace(form, '^(.{{3,}})s$', '\\1') AS plural FROM f) SELECT form, {_by_plural_sql('form', 'plural', languages.PORTUGUESE, ('áàâãéêíóôõúç', 'aaaaeeiooouc'))} AS stem FROM p")
def stems_portuguese(t):
    return languages.stem(_forms(t, "es"), "form", "pt")


def _enclitic_sql(word):
    cases = ""
    for pronoun in languages.SPANISH_ENCLITICS:
        verb = f"left({word}, length({word}) - {len(pronoun)})"
        fits = f"{word} LIKE '%{pronoun}' AND length({word}) - {len(pronoun)} >= 3"
        cases += f" WHEN {fits} AND regexp_matches({verb}, '[óéíá]$') THEN {verb} WHEN {fits} AND (regexp_matches({verb}, '[áéí].*ndo$') OR (regexp_matches({verb}, '[áéíóú]') AND regexp_matches({verb}, '(o|on)$'))) THEN translate({verb}, 'áéíóú', 'aeiou')"
    return f"CASE {cases} ELSE {word} END"


@query(f"WITH f AS {_FORMS.format('es')}, p AS (SELECT form, {_enclitic_sql('form')} AS verb FROM f) SELECT form, coalesce(translate({_without_sql('verb', languages.SPANISH)}, 'áéíóú', 'aeiou'), verb) AS stem FROM p")
def stems_spanish(t):
    return languages.stem(_forms(t, "es"), "form", "es")


def _german_sql():
    v = "aeiouyäöü"
    case = "regexp_extract(x, '^.*?(ern|em|er|en|es|e|s)$', 1)"
    verb = "regexp_extract(x, '^.*?(est|en|er|st)$', 1)"
    return f"""m AS (SELECT form, regexp_replace(regexp_replace(replace(form, 'ß', 'ss'), '([{v}])u([{v}])', '\\1U\\2', 'g'), '([{v}])y([{v}])', '\\1Y\\2', 'g') AS x FROM f),
r AS (SELECT form, x, CASE WHEN regexp_matches(x, '^.*?[{v}][^{v}]') THEN greatest(3, length(regexp_extract(x, '^.*?[{v}][^{v}]'))) ELSE length(x) END AS r FROM m),
a AS (SELECT form, x, r, {case} AS e, left(x, length(x) - length({case})) AS s FROM r),
b AS (SELECT form, r, CASE WHEN e = '' OR length(s) < r THEN x WHEN e = 's' THEN CASE WHEN regexp_matches(s, '[bdfghklmnrt]$') THEN s ELSE x END WHEN e IN ('e', 'en', 'es') AND s LIKE '%niss' THEN left(s, length(s) - 1) ELSE s END AS x FROM a),
d AS (SELECT form, r, x, {verb} AS e, left(x, length(x) - length({verb})) AS s FROM b)
SELECT form, translate(lower(CASE WHEN e = '' OR length(s) < r THEN x WHEN e = 'st' THEN CASE WHEN length(s) > 3 AND regexp_matches(s, '[bdfghklmnt]$') THEN s ELSE x END ELSE s END), 'äöü', 'aou') AS stem FROM d"""


@query(f"WITH f AS {_FORMS.format('de')}, {_german_sql()}")
def stems_german(t):
    return languages.stem(_forms(t, "de"), "form", "de")


@query(r"""SELECT DISTINCT w AS name, regexp_replace(translate(replace(lower(regexp_replace(w, '(.)[''’]s$', '\1')), 'ß', 'ss'), 'àâäçéèêëîïôöùûüÿáíóúñ', 'aaaceeeeiioouuuyaioun'), '[^\p{L}\p{Nd}]', '', 'g') AS folded FROM (SELECT unnest(regexp_extract_all(text, '\p{Lu}\p{L}*(?:[''’-]\p{L}+)?')) AS w FROM documents)""")
def name_folding(t):
    rows = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}*(?:['’-]\p{L}+)?"), F.lit(0))).alias("name")).distinct()
    return rows.withColumn("folded", languages.fold_name(c("name")))


@query(r"SELECT form, nfc_normalize(form) AS nfc FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) || chr(769) AS form FROM documents)")
def normal_forms(t):
    """Words with an acute put on their last letter, composed."""
    rows = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).distinct()
    return rows.select(F.concat("w", F.lit("\u0301")).alias("form")).withColumn("nfc", languages.normal(c("form"), "NFC"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber % 3 = 0 THEN 1000 ELSE 0 END) AS BIGINT) AS thousands, count(*) AS numerals FROM lineitem GROUP BY 1""")
def numerals_counted(t):
    """Lines as numerals; every third a thousand of its own, after a conjunction."""
    values = F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda k: F.struct(F.when(k % 3 == 0, 1000).otherwise(0).alias("value"), F.lit(True).alias("added")))
    return t("lineitem").groupBy("l_orderkey").agg(values.alias("v")).select("l_orderkey", languages.composed_number(c("v")).alias("thousands"), long(F.size("v")).alias("numerals"))


@query("SELECT o_orderkey, (o_custkey % 9 + 1) * 100 + o_custkey % 90 + 10 AS number FROM orders")
def numerals_composed(t):
    """A unit before a hundred multiplies it; a ten after a conjunction adds."""
    k = c("o_custkey")
    item = lambda value, added: F.struct(long(value).alias("value"), F.lit(added).alias("added"))
    return t("orders").select("o_orderkey", languages.composed_number(F.array(item(k % 9 + 1, False), item(F.lit(100), False), item(k % 90 + 10, True))).alias("number"))


_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхійклмнопярстувшыуз"


@query(f"""WITH f AS (SELECT DISTINCT translate(unnest(regexp_extract_all(lower(text), '[a-z]+')), '{_LATIN}', '{_CYRILLIC}') AS form FROM documents)
SELECT form, CASE WHEN length(form) >= 4 THEN coalesce(nullif(regexp_extract(form, '^(.{{3,}}?)(?:{'|'.join(languages.SLAVIC)})$', 1), ''), form) ELSE form END AS paradigm FROM f""")
def paradigm_groups(t):
    """Every form of the documents in Cyrillic letters, with what is left of it without a Slavic ending."""
    forms = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("form")).distinct()
    return languages.paradigms(forms.select(F.translate("form", _LATIN, _CYRILLIC).alias("form")))
