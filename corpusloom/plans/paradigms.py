"""Queries over Slavic paradigms: the documents' words in Cyrillic letters, divided every way and brought together where divisions meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import slavic
from .reading import _CYRILLIC, _LATIN
from .registry import n, query


def _list(values) -> str:
    return ", ".join(f"('{v}')" for v in values)


def _any(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _divided(forms: str) -> str:
    """SQL of form, kind, stem over a table of forms."""
    stems = lambda kind, values: f"SELECT form, '{kind}' AS kind, left(form, length(form) - length(e)) AS stem FROM {forms}, (VALUES {_list(values)}) x(e) WHERE suffix(form, e) AND length(form) - length(e) >= 3"
    verbs = f"SELECT form, form AS verb FROM {forms} UNION ALL SELECT form, left(form, length(form) - 2) FROM {forms} WHERE right(form, 2) IN ({_any(slavic.REFLEXIVE)})"
    rests = f"""SELECT form, left(verb, length(verb) - length(e)) AS rest FROM ({verbs}), (VALUES {_list(slavic.VERB + slavic.VERB_AFTER_VOWEL)}) x(e) WHERE suffix(verb, e) AND length(verb) > length(e)
AND (e NOT IN ({_any(slavic.PAST)}) OR contains('{slavic.PAST_VOWELS}', verb[-length(e) - 1])) AND (e NOT IN ({_any(slavic.VERB_AFTER_VOWEL)}) OR contains('{slavic.VOWELS}', verb[-length(e) - 1]))"""
    roots = f"SELECT form, 'verb' AS kind, left(rest, length(rest) - length(h)) AS stem FROM ({rests}), (VALUES (''), {_list(slavic.THEMES)}) y(h) WHERE suffix(rest, h) AND (length(rest) - length(h) >= 3 OR (h = '' AND length(rest) = 2 AND contains('{slavic.SHORT_ROOT_ENDS}', right(rest, 1))))"
    return f"SELECT DISTINCT * FROM ({stems('noun', slavic.NOUN + slavic.NOUN_RUSSIAN)} UNION ALL {stems('adjective', slavic.ADJECTIVE + slavic.ADJECTIVE_RUSSIAN)} UNION ALL {roots})"


def _sql(table: str) -> str:
    return f"SELECT DISTINCT translate(unnest(regexp_extract_all(lower(text), '[a-z]+')), '{_LATIN}', '{_CYRILLIC}') AS form FROM {table}"


def _forms(t, table: str):
    words = t(table).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("form")).distinct()
    return words.select(F.translate("form", _LATIN, _CYRILLIC).alias("form"))


@query(f"WITH f AS MATERIALIZED ({_sql('documents')}) SELECT kind, stem, count(*) AS forms, min(form) AS first FROM ({_divided('f')}) GROUP BY 1, 2 HAVING count(*) > 1")
def paradigm_hypotheses(t):
    """Stems that several forms of the documents share in one paradigm."""
    return slavic.divided(_forms(t, "documents")).groupBy("kind", "stem").agg(n().alias("forms"), F.min("form").alias("first")).filter("forms > 1")


@query(f"""WITH f AS MATERIALIZED ({_sql('documents')}), a AS MATERIALIZED ({_sql('benchmark')}), df AS MATERIALIZED ({_divided('f')}), da AS MATERIALIZED ({_divided('a')})
SELECT asked, count(*) AS forms, min(form) AS first, max(form) AS last FROM (SELECT da.form AS asked, df.form FROM da JOIN df USING (kind, stem) UNION SELECT form, form FROM a WHERE form IN (SELECT form FROM f)) GROUP BY 1""")
def paradigm_forms(t):
    """For every word of the benchmark the documents' forms of it: how many, the first and the last."""
    met = slavic.forms_of(_forms(t, "benchmark"), _forms(t, "documents"))
    return met.groupBy("asked").agg(n().alias("forms"), F.min("form").alias("first"), F.max("form").alias("last"))
