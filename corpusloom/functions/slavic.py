"""Forms of one word in Russian and Ukrainian: every way a form divides into a stem and an ending, by paradigm, and forms that share one.

A form is no key of its word: it is read as a noun's, an adjective's and a verb's at once, with each ending it may have, and two forms
belong together where they share a stem in one paradigm. Divisions are tried by the ending's length, so a form costs a few look-ups in short
lists; forms meet by an equality of (kind, stem).

Defined cases: forms are folded (lower case, no apostrophes) before; a null or empty form has no divisions; one shorter than a stem may be
has none either and is its own only form; repeated forms count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings by paradigm, those of Russian alone, vowels between a verb's root and its ending.
NOUN = ["", "а", "я", "о", "е", "є", "у", "ю", "і", "ї", "и", "ь", "й", "ом", "ем", "єм", "ою", "ею", "єю", "ей", "ам", "ям", "ами", "ями", "ах", "ях", "ів", "їв", "ові", "еві", "єві", "ью", "ьми"]
NOUN_RUSSIAN = ["ы", "ов", "ев", "ой", "ём"]
ADJECTIVE = ["ий", "ій", "їй", "ого", "его", "ього", "ому", "ему", "ьому", "им", "ім", "їм", "их", "іх", "їх", "ими", "іми", "їми", "ую", "юю", "ою", "ьою", "ої", "ьої", "ей", "а", "я", "е", "є", "і", "ї", "у", "ю", "о"]
ADJECTIVE_RUSSIAN = ["ый", "ой", "ая", "яя", "ое", "ее", "ые", "ие", "ым", "ых", "ыми", "ы"]
VERB = ["ти", "ть", "чь", "єш", "еш", "иш", "їш", "ешь", "ишь", "ємо", "емо", "имо", "їмо", "єте", "ете", "ите", "їте", "ють", "уть", "ять", "ать", "ют", "ут", "ят", "ат", "ет", "ит", "ем", "им", "в", "ла", "ло", "ли", "л", "йте", "іть", "ім", "імо", "ймо", "ючи", "учи", "ачи", "ячи", "вши", "вшись"]
VERB_AFTER_VOWEL = ["ю", "є", "е", "й"]
PAST = ["в", "л", "ла", "ло", "ли"]
THEMES = ["а", "я", "и", "і", "ї", "е", "є", "у", "ю", "о"]
VOWELS, PAST_VOWELS, SHORT_ROOT_ENDS = "аеиоуыэюяіїєё", "аяеєиіїуюы", "аеиоуыэюяіїєёь"
REFLEXIVE = ["ся", "сь"]
SHORTEST, SHORTEST_ROOT = 3, 2

DIVISIONS = "array<struct<kind:string,stem:string>>"


def _in(value: Column, values) -> Column:
    return value.isin(*values)


def _declined(word: Column, kind: str, endings: list[str]) -> Column:
    """The stems of one paradigm whose rest is one of its endings."""
    lengths = sorted({len(e) for e in endings})
    ways = [F.when((F.length(word) - k >= SHORTEST) & _in(F.right(word, F.lit(k)) if k else F.lit(""), endings), F.struct(F.lit(kind).alias("kind"), F.substring(word, F.lit(1), F.length(word) - k).alias("stem"))) for k in lengths]
    return F.array_compact(F.array(*ways))


def _conjugated(word: Column) -> Column:
    """The roots of a verb: an ending that only verbs have, then a theme vowel or none."""
    ways = []
    for k in sorted({len(e) for e in VERB + VERB_AFTER_VOWEL}):
        end, rest = F.right(word, F.lit(k)), F.substring(word, F.lit(1), F.length(word) - k)
        last = F.right(rest, F.lit(1))
        told = _in(end, VERB) & (~_in(end, PAST) | _in(last, PAST_VOWELS)) | (_in(end, VERB_AFTER_VOWEL) & _in(last, VOWELS))
        told = told & (F.length(word) > k)
        root = F.substring(rest, F.lit(1), F.length(rest) - 1)
        bare = (F.length(rest) >= SHORTEST) | ((F.length(rest) >= SHORTEST_ROOT) & _in(last, SHORT_ROOT_ENDS))
        verb = lambda stem: F.struct(F.lit("verb").alias("kind"), stem.alias("stem"))
        ways += [F.when(told & bare, verb(rest)), F.when(told & _in(last, THEMES) & (F.length(root) >= SHORTEST), verb(root))]
    return F.array_compact(F.array(*ways))


def divisions(form: str | Column, russian: str | Column | bool) -> Column:
    """Distinct (kind, stem) of a folded form; russian: whether the endings of Russian alone are read too (a column or a constant)."""
    word, also = F.col(form) if isinstance(form, str) else form, F.lit(russian) if isinstance(russian, bool) else F.col(russian) if isinstance(russian, str) else russian
    none = F.array().cast(DIVISIONS)
    back = F.when(_in(F.right(word, F.lit(2)), REFLEXIVE), F.substring(word, F.lit(1), F.length(word) - 2))
    parts = [_declined(word, "noun", NOUN), F.when(also, _declined(word, "noun", NOUN_RUSSIAN)), _declined(word, "adjective", ADJECTIVE), F.when(also, _declined(word, "adjective", ADJECTIVE_RUSSIAN)), _conjugated(word), F.when(back.isNotNull(), _conjugated(back))]
    return F.array_distinct(F.concat(*[F.coalesce(p.cast(DIVISIONS), none) for p in parts]))


def divided(forms: DataFrame, form: str = "form", russian: str | bool = True) -> DataFrame:
    """form, kind, stem: every division of each distinct form."""
    each = forms.select(form, *([russian] if isinstance(russian, str) else [])).filter(F.col(form) != "").distinct()
    return each.select(form, F.explode(divisions(form, russian)).alias("d")).select(form, "d.kind", "d.stem").distinct()


def forms_of(asked: DataFrame, forms: DataFrame, russian: bool = True) -> DataFrame:
    """asked, form: the forms of a text that belong to each asked form, itself among them where the text has it.

    Asked forms are few beside the text's; only stems that one of them has are looked at.
    """
    wanted = divided(asked.select(F.col("form").alias("asked")), "asked", russian)
    own = divided(forms, "form", russian)
    met = wanted.join(own, ["kind", "stem"]).select("asked", "form")
    same = asked.select(F.col("form").alias("asked")).join(forms.select("form"), F.col("asked") == F.col("form"), "left_semi").select("asked", F.col("asked").alias("form"))
    return met.unionByName(same).distinct()
