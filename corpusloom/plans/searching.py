"""Queries over search: ranking with phrases, joints and scope, relaxation, tiers, suggestions, snippets, unspaced text, paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search
from ..operators.index import Index
from ..session import LINE
from .reading import stems_sql
from .registry import ALL, n, query
from .stemming import stem_sql, whole_stem  # noqa: F401

TOKENS = "(SELECT doc_id, source, unnest(range(0, len(w))) AS position, unnest(w) AS token FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))"


WORDS = r"(SELECT doc_id, source, lang, unnest(range(0, len(w))) AS position, unnest(w) AS token FROM (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '[\p{L}\p{M}]+') AS w FROM documents))"
LANGUAGES = ("en", "de", "fr", "es")


def forms_sql(typed=()):
    """CTEs: tok, all words; st (lang, form, stem) of all forms of each language and of the typed words."""
    also = "".join(f" UNION SELECT '{w}'" for w in typed)
    by_language = " UNION ALL ".join(f"SELECT '{x}' AS lang, form, stem FROM ({stems_sql(x, f'SELECT DISTINCT token AS form FROM tok WHERE lang = {chr(39)}{x}{chr(39)}{also}')})" for x in LANGUAGES)
    return f"tok AS MATERIALIZED (SELECT * FROM {WORDS}), st AS MATERIALIZED ({by_language})"


def ranked_sql(terms, required, phrases=(), scope="true", joints=()):
    """terms: (word, typed in a phrase); required: numbers of terms; phrases: lists of numbers of terms; joints: numbers of joint words."""
    typed = ", ".join(f"({k}, '{w}', {str(p).lower()}, {str(k in joints).lower()})" for k, (w, p) in enumerate(terms))
    inside = lambda which: f"(SELECT DISTINCT doc_id FROM (SELECT doc_id, position - list_position([{', '.join(map(str, which))}], term) AS i FROM h WHERE tier <= 1 AND term IN ({', '.join(map(str, which))}) GROUP BY 1, 2 HAVING count(DISTINCT term) = {len(which)}))"
    count, need = len(required), f"term IN ({', '.join(map(str, required))})"
    half = (count + 1) // 2 if count >= 3 else count
    stands = "".join(f" AND doc_id IN {inside(p)}" for p in phrases)
    return f"""WITH {forms_sql([w for w, _ in terms])}, q(term, typed, quoted, jointly) AS (VALUES {typed}),
m AS MATERIALIZED (SELECT f.lang, f.form AS token, term, CASE WHEN f.form = typed THEN 0 WHEN quoted OR jointly THEN NULL WHEN f.stem = a.stem THEN 1 WHEN starts_with(f.form, typed) THEN 2 WHEN length(typed) >= 3 AND contains(f.form, typed) THEN 3 END AS tier FROM st f, q JOIN st a ON a.form = q.typed WHERE a.lang = f.lang),
h AS MATERIALIZED (SELECT doc_id, position, term, tier FROM tok JOIN m ON m.token = tok.token AND m.lang = tok.lang WHERE tier IS NOT NULL AND {scope}),
p AS (SELECT doc_id, term, min(tier) AS tier, min(position) AS low, max(position) AS high FROM h GROUP BY 1, 2),
held AS (SELECT doc_id, count(*) FILTER (WHERE {need}) AS held, count(*) AS terms, CAST(sum(tier) AS BIGINT) AS tiers, CAST(max(high) FILTER (WHERE {need}) - min(low) FILTER (WHERE {need}) AS BIGINT) AS span FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT *, {len(terms)} > 1 AND doc_id IN {inside(range(len(terms)))} AS phrase FROM held WHERE true{stands}), w AS (SELECT coalesce(max(CASE WHEN held = {count} THEN 1 ELSE 0 END), 0) AS whole FROM f)
SELECT doc_id, phrase, held, terms, tiers, span, whole = 0 AS partial FROM f, w WHERE held >= CASE WHEN whole = 1 THEN {count} ELSE {half} END"""


def documents_index(t):
    """The stored index of all documents, each folded and stemmed by its own language."""
    return Index.once(t("documents").select("doc_id", "lang", "text"), "doc_id")


@query(f"WITH {forms_sql()} SELECT lang AS language, form, stem, count(*) AS occurrences, count(DISTINCT doc_id) AS segments FROM tok JOIN st USING (lang) WHERE form = token GROUP BY 1, 2, 3")
def index_forms(t):
    """The form statistics of the index, in four languages."""
    return documents_index(t).forms.select("language", "form", "stem", "occurrences", "segments")


@query(f"SELECT lang AS language, token AS form, doc_id AS key, string_agg(position, ' ' ORDER BY position) AS positions FROM {WORDS} GROUP BY 1, 2, 3")
def index_postings(t):
    """Where each form stands in each document, as the index keeps it."""
    return documents_index(t).postings.select("language", "form", "key", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


@query(ranked_sql([("of", False), ("the", False)], [0, 1]))
def search_rank(t):
    return documents_index(t).search("of the", "doc_id")


@query(ranked_sql([("zzqx", False), ("with", False), ("from", False)], [0, 1, 2]))
def search_relaxed(t):
    return documents_index(t).search("zzqx, with from!", "doc_id")


@query(ranked_sql([("license", False), ("the", True), ("mit", True), ("under", False), ("and", False)], [0, 1, 2, 3], [[1, 2]], "source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 20)", joints=[4]))
def search_phrases_in_scope(t):
    """A quoted phrase, a joint word, and a scope of sources."""
    docs = t("documents").select("doc_id", "source")
    large = docs.groupBy("source").agg(n().alias("k")).filter("k >= 20").select("source")
    return documents_index(t).search("license “the MIT” under and", "doc_id", joints=("and", "or"), scope=docs.join(large, "source", "left_semi"))


@query(ranked_sql([("für", False), ("und", False), ("schö", False)], [0, 2], scope="tok.lang = 'de'", joints=[1]))
def search_german(t):
    """Words with umlauts, a joint word of the language."""
    return documents_index(t).search("Für und schö", "doc_id", only="de")


@query(ranked_sql([("éque", False), ("réau", False)], [0, 1]))
def search_accents(t):
    """Accented words in every language, by the stems of each."""
    return documents_index(t).search("Éque, réau", "doc_id")


@query(f"SELECT doc_id FROM {WORDS} WHERE token IN ('with', 'from', 'this') GROUP BY 1 HAVING count(DISTINCT token) = 3")
def search_all_terms(t):
    terms = search.parse("“with” “from” “this”")  # as typed only
    return documents_index(t).hits(terms).groupBy(F.col("key").alias("doc_id")).agg(F.countDistinct("term").alias("k")).filter("k = 3").select("doc_id")


@query(f"""WITH h AS (SELECT doc_id, position - CASE token WHEN 'of' THEN 0 ELSE 1 END AS island, token FROM {WORDS} WHERE token IN ('of', 'the'))
SELECT doc_id, count(*) AS places FROM (SELECT doc_id, island FROM h GROUP BY 1, 2 HAVING count(DISTINCT token) = 2) GROUP BY 1""")
def search_phrase(t):
    hits = documents_index(t).hits(search.parse("“of the”"))
    found = hits.groupBy(F.col("key").alias("doc_id"), (F.col("position") - F.col("term")).alias("island")).agg(F.countDistinct("term").alias("k")).filter("k = 2")
    return found.groupBy("doc_id").agg(n().alias("places"))


@query(f"""WITH {forms_sql(['tion'])} SELECT f.lang AS language, f.form, CASE WHEN f.form = 'tion' THEN 0 WHEN f.stem = a.stem THEN 1 WHEN starts_with(f.form, 'tion') THEN 2 WHEN contains(f.form, 'tion') THEN 3 END AS tier FROM st f JOIN st a ON a.lang = f.lang AND a.form = 'tion'
WHERE (f.stem = a.stem OR contains(f.form, 'tion')) AND (f.lang, f.form) IN (SELECT (lang, token) FROM tok)""")
def form_tiers(t):
    """The forms that a typed word answers, and how near they are to it, in each language."""
    return documents_index(t).resolved(search.parse("tion")).select("language", "form", "tier")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), '100% of_') OR contains(lower(text), 'mit license')")
def like_escaped(t):
    docs = t("documents").select("doc_id", "text")
    return docs.filter(search.containing(F.col("text"), "100% of_") | search.containing(F.col("text"), "MIT License")).select("doc_id")


# -- spellings

_TRI = "(SELECT {0} AS w, list_distinct([substr('  ' || lower({0}) || ' ', i, 3) FOR i IN range(1, length({0}) + 2)]) AS g FROM {1})"


@query(f"""WITH q AS {_TRI.format('a', "(VALUES ('STANDARD TIN'), ('PROMO BRASS')) v(a)")}, w AS {_TRI.format('p_type', '(SELECT DISTINCT p_type FROM part)')}
SELECT asked, word, similarity, distance FROM (SELECT q.w AS asked, w.w AS word, round(len(list_intersect(q.g, w.g)) / (len(q.g) + len(w.g) - len(list_intersect(q.g, w.g))), 6) AS similarity, CAST(levenshtein(lower(q.w), lower(w.w)) AS BIGINT) AS distance FROM q, w)
WHERE similarity >= 0.3 OR distance <= 2""")
def trigram_neighbours(t):
    return search.neighbours(t("part").select(F.col("p_type").alias("word")).distinct(), ["STANDARD TIN", "PROMO BRASS"])


_ASKED = ["lisense", "thatun", "ononset", "inuran", "the", "hehaly", "arantion", "nucht", "fürr", "écue"]


@query(f"""WITH {forms_sql(_ASKED)}, f AS (SELECT lang, token AS form, count(*) AS occurrences FROM tok GROUP BY 1, 2), sf AS MATERIALIZED (SELECT lang, form, stem, occurrences, list_distinct([substr('  ' || form || ' ', i, 3) FOR i IN range(1, length(form) + 2)]) AS g FROM f JOIN st USING (lang, form)),
wt AS (SELECT lang, stem, sum(occurrences) AS weight FROM sf GROUP BY 1, 2), a0(asked) AS (VALUES {', '.join(f"('{a}')" for a in _ASKED)}), a AS (SELECT lang, asked, stem AS astem, list_distinct([substr('  ' || asked || ' ', i, 3) FOR i IN range(1, length(asked) + 2)]) AS ag FROM a0 JOIN st ON form = asked),
q AS (SELECT a.*, coalesce(weight, 0) AS own FROM a LEFT JOIN wt ON wt.lang = a.lang AND wt.stem = astem WHERE coalesce(weight, 0) <= 25), k AS (SELECT q.lang, asked, astem, own, form, stem, occurrences, len(list_intersect(g, ag)) / (len(g) + len(ag) - len(list_intersect(g, ag))) AS likeness FROM q JOIN sf ON q.lang = sf.lang AND form <> asked),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, asked ORDER BY likeness DESC, occurrences DESC, form) AS place FROM k WHERE likeness >= 0.3),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, asked ORDER BY levenshtein(asked, form), place) AS r FROM r WHERE place <= 30 AND stem <> astem AND levenshtein(asked, form) <= CASE WHEN length(asked) <= 4 THEN 1 ELSE 2 END
AND NOT (least(length(asked), length(form)) >= greatest(length(asked), length(form)) - 2 AND left(asked, greatest(length(asked), length(form)) - 2) = left(form, greatest(length(asked), length(form)) - 2))
AND (own = 0 OR contains(form, asked) OR regexp_replace(form, '[aeiouy]', '', 'g') = regexp_replace(asked, '[aeiouy]', '', 'g')))
SELECT c.lang AS language, asked, form, CAST(own AS BIGINT) AS printed, CAST(weight AS BIGINT) AS weight FROM c JOIN wt ON wt.lang = c.lang AND wt.stem = c.stem WHERE r = 1 AND (own = 0 OR weight >= 2 * own)""")
def spelling_suggestions(t):
    return search.suggestions(documents_index(t).forms, _ASKED)


# -- what a page shows


@query(r"""SELECT conv_id, turn, trim(array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+'), lambda p: CASE WHEN lower(p) IN ('the', 'and', 'of') THEN '<em>' || p || '</em>' ELSE replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END), '')) AS snippet FROM conversations WHERE text IS NOT NULL""")
def snippets(t):
    marked = F.array(*[F.lit(w) for w in ("the", "and", "of")])
    return t("conversations").filter("text IS NOT NULL").select("conv_id", "turn", search.snippet(F.col("text"), marked).alias("snippet"))


@query(r"""WITH r AS (SELECT doc_id, run, regexp_extract_all(s, '[a-z]+') AS w FROM (SELECT doc_id, unnest(range(0, len(p))) AS run, unnest(p) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z ]+') AS p FROM documents))),
e AS (SELECT doc_id, run, position, word, sum(length(word)) OVER (PARTITION BY doc_id, run ORDER BY position) AS after FROM (SELECT doc_id, run, unnest(range(0, len(w))) AS position, unnest(w) AS word FROM r)),
o AS (SELECT doc_id, run, unnest(list_filter(range(1, length(line) - 1), lambda p: substr(line, p, 3) = 'eth')) AS p FROM (SELECT doc_id, run, array_to_string(w, '') AS line FROM r) WHERE contains(line, 'eth'))
SELECT DISTINCT doc_id, run, position, word FROM e JOIN o USING (doc_id, run) WHERE p <= after AND p + 2 > after - length(word)""")
def search_unspaced(t):
    """Words as if printed without spaces; an occurrence may begin inside one word and end in the next, never over punctuation."""
    runs = t("documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z ]+"), F.lit(0))).alias("run", "s"))
    words = runs.select("doc_id", F.col("run").cast("long").alias("run"), F.regexp_extract_all("s", F.lit("[a-z]+"), F.lit(0)).alias("w")).filter("size(w) > 0")
    return search.unspaced(words, ["doc_id", "run"], "w", "eth")


@query("SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 40 OFFSET 80")
def offset_page(t):
    return search.page(t("customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc_nulls_last(), "c_custkey"], 40, 3)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 20")
def last_page(t):
    """A page beyond the end is the last one."""
    return search.page(t("nation").select("n_nationkey"), ["n_nationkey"], 10, 99).select("n_nationkey")


@query(f"SELECT {ALL} FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY {ALL} LIMIT 50")
def keyset_page(t):
    rows = t("lineitem").select(*LINE)
    return search.keyset(rows, LINE, (100, 2, 2**40, 0), 50)


@query(f"SELECT {ALL} FROM lineitem WHERE (l_orderkey, l_linenumber) < (100, 2) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 50")
def keyset_page_before(t):
    return search.keyset(t("lineitem").select(*LINE), LINE, (100, 2, -1, 0), 50, before=True)


@query("""SELECT number, row_number() OVER (ORDER BY CASE left(number, 1) WHEN 'H' THEN 0 WHEN 'G' THEN 1 ELSE 2 END, TRY_CAST(regexp_extract(number, '^[A-Za-z]+([0-9]+)', 1) AS BIGINT) NULLS LAST, number) AS place FROM (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'G' ELSE 'X' END || CASE WHEN p_size = 20 THEN 'a' ELSE CAST(p_size AS VARCHAR) END AS number FROM part)""")
def natural_order(t):
    letter = F.when(F.col("p_size") % 3 == 0, "H").when(F.col("p_size") % 3 == 1, "G").otherwise("X")
    numbers = t("part").select(F.concat(letter, F.when(F.col("p_size") == 20, "a").otherwise(F.col("p_size").cast("string"))).alias("number")).distinct()
    return numbers.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*search.natural(F.col("number")))).cast("long"))  # some fifty numbers


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_totalprice END NULLS LAST, o_orderkey) AS place FROM orders")
def nulls_last_order(t):
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(price.asc_nulls_last(), "o_orderkey")).cast("long").alias("place"))
