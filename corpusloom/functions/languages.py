"""Folding, normal forms and stems by language, as column expressions but for normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as english

# -- letters (fixed values)

ACCENTED = "àáâãäåāăąçćčèéêëēėęěìíîïīįñńňòóôõöøōőùúûüūůűýÿšśžźżłđďťřľĺёґ"
PLAIN = "aaaaaaaaaccceeeeeeeeiiiiiinnnoooooooouuuuuuuyysszzzlddtrllег"
GREEK_PLAIN = {"α": "Άάἀἁἂἃἄἅἆἇὰᾀᾁᾂᾃᾄᾅᾆᾇᾰᾱᾲᾳᾴᾶᾷ", "ε": "Έέἐἑἒἓἔἕὲ", "η": "Ήήἠἡἢἣἤἥἦἧὴᾐᾑᾒᾓᾔᾕᾖᾗῂῃῄῆῇ", "ι": "ΊίΐϊΪἰἱἲἳἴἵἶἷὶῐῑῒῖῗ", "ο": "Όόὀὁὂὃὄὅὸ", "υ": "ΎύΰϋΫὐὑὒὓὔὕὖὗὺῠῡῢῦῧ", "ω": "Ώώὠὡὢὣὤὥὦὧὼᾠᾡᾢᾣᾤᾥᾦᾧῲῳῴῶῷ", "ρ": "ῤῥῬ", "σ": "ς"}
ELISION = "ʼʻ’‘'"
#: Words that a query may leave out, by language, each with its spellings (fixed values).
JOINTS = {"uk": [["і", "й"], ["у", "в"], ["та"]], "ru": [["и"], ["в", "во"]], "en": [["and"], ["the"], ["a"], ["an"]], "de": [["und"]], "fr": [["et"]], "es": [["y", "e"]], "pt": [["e"]]}
#: Codes of three letters.
CODES = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "por": "pt", "rus": "ru", "ukr": "uk", "ara": "ar", "heb": "he"}


def bare_greek(word: Column) -> Column:
    """Lower case without accents, breathings and iota subscript; final sigma as sigma, elision marks dropped."""
    out = F.regexp_replace(F.lower(word), f"[\\u0300-\\u036F{ELISION}]", "")
    for plain, marked in GREEK_PLAIN.items():
        out = F.translate(out, marked.lower(), plain * len(marked))
    return out


def fold(word: Column, language: str = "") -> Column:
    """Hebrew and Aramaic without points, Greek bare, Arabic without marks and with plain alif, others in lower case."""
    if language in ("he", "hbo", "arc"):
        return F.regexp_replace(word, "[\\u0591-\\u05C7]", "")
    if language in ("grc", "el"):
        return bare_greek(word)
    if language in ("ar", "arb"):
        return F.translate(F.regexp_replace(word, "[\\u0640\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E4\\u06E7\\u06E8\\u06EA-\\u06ED]", ""), "ٱ", "ا")
    return F.lower(word)


def fold_by(word: Column, language: Column) -> Column:
    """The fold of a word by the language beside it."""
    return F.when(language.isin("he", "heb", "hbo", "arc"), fold(word, "hbo")).when(language.isin("grc", "el"), fold(word, "grc")).when(language.isin("ar", "ara", "arb"), fold(word, "arb")).otherwise(F.lower(word))


def fold_name(name: Column) -> Column:
    """Letters and digits only, lower case, without points, accents and diacritics; sharp s as ss; a possessive s goes."""
    bare = bare_greek(fold(F.regexp_replace(name, "(.)['’]s$", "$1"), "hbo"))
    return F.regexp_replace(F.translate(F.replace(bare, F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), r"[^\p{L}\p{Nd}]", "")


def normal(word: Column, form: str = "NFC") -> Column:
    """A Unicode normal form; Spark has no built-in one."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else unicodedata.normalize(form, w))

    return run(word)


# -- stems

#: Endings by language, longest first (fixed values).
FRENCH = ["eraient", "iraient", "assions", "issions", "assent", "issent", "erions", "irions", "issons", "assiez", "èrent", "irent", "eriez", "iriez", "erons", "irons", "eront", "iront", "aient", "erait", "irait", "erais", "irais", "issez", "ions", "erai", "irai", "âmes", "îmes", "âtes", "îtes", "iez", "ons", "ent", "ait", "ais", "ant", "era", "ira", "ez", "ée", "er", "ir", "ât", "ît", "é", "a", "e"]
SPANISH = ["aríamos", "eríamos", "iríamos", "iéramos", "iésemos", "áramos", "ásemos", "ábamos", "asteis", "isteis", "ierais", "ieseis", "aríais", "eríais", "iríais", "aremos", "eremos", "iremos", "íamos", "arían", "erían", "irían", "aréis", "eréis", "iréis", "abais", "ieron", "iendo", "yendo", "ieran", "iesen", "arías", "erías", "irías", "aban", "aron", "eron", "ando", "aran", "asen", "arán", "erán", "irán", "aría", "ería", "iría", "iera", "iese", "aste", "iste", "amos", "emos", "imos", "íais", "ados", "idos", "adas", "idas", "aba", "ían", "ará", "erá", "irá", "aré", "eré", "iré", "ara", "ase", "ado", "ido", "ada", "ida", "áis", "éis", "ió", "ía", "ar", "er", "ir", "an", "en", "as", "es", "os", "ó", "é", "í", "a", "e", "o"]
PORTUGUESE = ["aríamos", "eríamos", "iríamos", "ássemos", "êssemos", "íssemos", "áramos", "êramos", "íramos", "ávamos", "aremos", "eremos", "iremos", "íamos", "assem", "essem", "issem", "ariam", "eriam", "iriam", "aram", "eram", "iram", "avam", "arão", "erão", "irão", "aria", "eria", "iria", "ando", "endo", "indo", "amos", "emos", "imos", "arei", "erei", "irei", "asse", "esse", "isse", "ava", "iam", "ará", "erá", "irá", "ado", "ido", "ada", "ida", "ais", "eis", "ou", "eu", "iu", "am", "em", "ar", "er", "ir", "ia", "a", "e", "o"]
GERMAN_CASE, GERMAN_VERB = ["ern", "em", "er", "en", "es", "e", "s"], ["est", "en", "er", "st"]
FRENCH_ELIDED = ["qu", "l", "d", "j", "m", "t", "s", "n", "c"]
PORTUGUESE_CLITICS = ["me", "te", "se", "nos", "vos", "lhe", "lhes", "o", "a", "os", "as", "lo", "la", "los", "las", "no", "na", "nas", "hei", "has", "ha", "há", "hemos", "heis", "hão", "ia", "ias", "iamos", "ieis", "iam"]
SPANISH_ENCLITICS = ["selas", "selos", "sela", "selo", "les", "los", "las", "nos", "le", "lo", "la", "me", "te", "se", "os"]


def without(word: Column, endings: list[str], keep: int = 3) -> Column:
    """The word without the longest ending that leaves ``keep`` letters; null if there is none. The lazy group finds the longest."""
    pattern = f"^(.{{{keep},}}?)(?:{'|'.join(endings)})$"
    return F.when(word.rlike(pattern), F.regexp_extract(word, pattern, 1))


def stem_french(word: Column) -> Column:
    lower = F.replace(F.lower(word), F.lit("’"), F.lit("'"))
    lower = F.regexp_replace(lower, f"^(?:{'|'.join(FRENCH_ELIDED)})'(.+)$", "$1")
    plural = F.regexp_replace(lower, "^(.{3,})[sx]$", "$1")
    folded = lambda c: F.translate(c, "éèêàâîïôûùç", "eeeaaiiouuc")
    return F.coalesce(folded(without(lower, [e for e in FRENCH if e.endswith("s")])), folded(without(plural, FRENCH)), plural)


def stem_portuguese(word: Column) -> Column:
    lower = F.regexp_replace(F.lower(word), f"^([^-]+)(?:-(?:{'|'.join(PORTUGUESE_CLITICS)}))+$", "$1")
    plural = F.regexp_replace(lower, "^(.{3,})s$", "$1")
    folded = lambda c: F.translate(c, "áàâãéêíóôõúç", "aaaaeeiooouc")
    return F.coalesce(folded(without(lower, [e for e in PORTUGUESE if e.endswith("s")])), folded(without(plural, PORTUGUESE)), plural)


def stem_spanish(word: Column) -> Column:
    lower, plain = F.lower(word), lambda c: F.translate(c, "áéíóú", "aeiou")
    out = lower
    # a pronoun comes off where an accent shows that it was put on; from the shortest ending on, so that the longest decides
    for pronoun in reversed(SPANISH_ENCLITICS):
        verb = F.regexp_extract(lower, f"^(.{{3,}}){pronoun}$", 1)
        bare = F.when(verb.rlike("[óéíá]$"), verb).when(verb.rlike("[áéí].*ndo$") | verb.rlike("[áéíóú].*(?:o|on)$") | verb.rlike("[áéíóú]on$"), plain(verb))
        out = F.when((verb != "") & bare.isNotNull(), bare).otherwise(out)
    return F.coalesce(plain(without(out, SPANISH)), out)


def stem_german(df: DataFrame, word: str, name: str) -> DataFrame:
    """A case ending, then a verb ending off, both only behind the first consonant after a vowel and three letters; umlauts as plain vowels."""
    vowels = "aeiouyäöü"
    marked = F.replace(F.lower(word), F.lit("ß"), F.lit("ss"))
    for letter in "uy":  # a u or y between vowels is a consonant
        marked = F.regexp_replace(marked, f"([{vowels}]){letter}(?=[{vowels}])", f"$1{letter.upper()}")
    first = F.length(F.regexp_extract("_x", f"^.*?[{vowels}][^{vowels}]", 0))
    df = df.withColumn("_x", marked).withColumn("_from", F.when(first > 0, F.greatest(first, F.lit(3))).otherwise(F.length("_x")))
    for endings in (GERMAN_CASE, GERMAN_VERB):
        found = F.regexp_extract("_x", f"^.*?({'|'.join(endings)})$", 1)
        df = df.withColumn("_e", found).withColumn("_s", F.expr("left(_x, length(_x) - length(_e))"))
        cut = F.when((F.col("_e") == "") | (F.length("_s") < F.col("_from")), F.col("_x"))
        if endings is GERMAN_CASE:
            cut = cut.when(F.col("_e") == "s", F.when(F.col("_s").rlike("[bdfghklmnrt]$"), F.col("_s")).otherwise(F.col("_x")))
            cut = cut.when(F.col("_e").isin("e", "en", "es") & F.endswith("_s", F.lit("niss")), F.expr("left(_s, length(_s) - 1)"))
        else:
            cut = cut.when(F.col("_e") == "st", F.when((F.length("_s") > 3) & F.col("_s").rlike("[bdfghklmnt]$"), F.col("_s")).otherwise(F.col("_x")))
        df = df.withColumn("_x", cut.otherwise(F.col("_s"))).drop("_e", "_s")
    return df.withColumn(name, F.translate(F.lower("_x"), "äöü", "aou")).drop("_x", "_from")


def stem(df: DataFrame, word: str, language: str, name: str = "stem") -> DataFrame:
    """The stem of a word by the rules of its language: English, German, French, Spanish, Portuguese or Greek; others are folded only."""
    if language == "en":
        return english.stem(df, word, name)
    if language == "de":
        return stem_german(df, word, name)
    by = {"fr": stem_french, "es": stem_spanish, "pt": stem_portuguese}.get(language, lambda w: fold(w, language))
    return df.withColumn(name, by(F.col(word)))


#: Languages that ``stem`` has rules for; words of others are folded.
STEMMED = ("en", "de", "fr", "es", "pt")


def stem_by(df: DataFrame, word: str, language: str, name: str = "stem") -> DataFrame:
    """The stem of a folded word by the language beside it, in one pass: the rules of each language see the words of that language alone."""
    code = F.col(language)
    for long, short in CODES.items():
        code = F.when(F.col(language) == long, short).otherwise(code)
    out = df.withColumn("_code", code)
    for short in STEMMED:
        out = stem(out.withColumn(f"_word_{short}", F.when(F.col("_code") == short, F.col(word))), f"_word_{short}", short, f"_stem_{short}")
    helpers = ["_code", *(f"_{x}_{short}" for x in ("word", "stem") for short in STEMMED)]
    return out.withColumn(name, F.coalesce(*[f"_stem_{short}" for short in STEMMED], word)).drop(*helpers)


def joint(word: str, language: str | None) -> list[str] | None:
    """The spellings of a joint word of a language, the typed one among them; null for any other word."""
    return next((list(group) for group in JOINTS.get(CODES.get(language or "", language or ""), []) if word in group), None)


#: Endings of Russian and Ukrainian paradigms, longest first (fixed values).
SLAVIC = ["иями", "ями", "ами", "ией", "иям", "ием", "иях", "ого", "его", "ому", "ему", "ыми", "ими", "ові", "ах", "ях", "ов", "ев", "ів", "ей", "ой", "ий", "ый", "ам", "ям", "ом", "ем", "ою", "ею", "ия", "ию", "ие", "ии", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я", "і", "ї", "є"]


def paradigms(forms: DataFrame, form: str = "form") -> DataFrame:
    """forms with paradigm: what is left of a word of four letters and more without its longest ending, if that is three letters."""
    lower = F.translate(F.lower(form), "ё", "е")
    bare = F.when(F.length(lower) >= 4, without(lower, SLAVIC))
    return forms.withColumn("paradigm", F.coalesce(bare, lower))


def composed_number(values: Column) -> Column:
    """The number that numerals in a row name; values: array of (value, added: stands after a conjunction).

    A thousand or more multiplies what stands before it, a hundred the unit right before it; the rest adds up.
    """
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("last"))

    def step(s, x):
        v = x["value"].cast("long")
        big = (v >= 1000) & ~x["added"] & (s["group"] > 0)
        hundred = (v == 100) & ~x["added"] & s["last"].between(1, 9)
        total = F.when(big, s["total"] + s["group"] * v).otherwise(s["total"])
        group = F.when(big, 0).when(hundred, s["group"] + s["last"] * 99).otherwise(s["group"] + v)
        return F.struct(total.alias("total"), group.cast("long").alias("group"), v.alias("last"))

    return F.aggregate(values, start, step, lambda s: s["total"] + s["group"])
