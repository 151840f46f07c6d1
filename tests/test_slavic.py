"""Divisions of Slavic forms against the rule in plain Python, and words whose forms are known."""

import random

from corpusloom.functions import slavic as s


def plain(word, russian):
    """The rule, ending by ending."""
    out = set()
    if not word:
        return out
    for kind, endings in (("noun", s.NOUN + s.NOUN_RUSSIAN * russian), ("adjective", s.ADJECTIVE + s.ADJECTIVE_RUSSIAN * russian)):
        out |= {(kind, word[: len(word) - len(e)]) for e in endings if word.endswith(e) and len(word) - len(e) >= 3}
    for verb in [word] + [word[:-2]] * word.endswith(("ся", "сь")):
        for e in s.VERB + s.VERB_AFTER_VOWEL:
            rest = verb[: len(verb) - len(e)]
            if not verb.endswith(e) or not rest or (e in s.PAST and rest[-1] not in s.PAST_VOWELS) or (e in s.VERB_AFTER_VOWEL and rest[-1] not in s.VOWELS):
                continue
            for theme in ["", *s.THEMES]:
                root = rest[: len(rest) - len(theme)]
                if rest.endswith(theme) and (len(root) >= 3 or (not theme and len(root) >= 2 and root[-1] in s.SHORT_ROOT_ENDS)):
                    out.add(("verb", root))
    return out


def test_divisions_equal_the_rule(spark):
    rng = random.Random(2)
    ends = sorted(set(s.NOUN + s.NOUN_RUSSIAN + s.ADJECTIVE + s.ADJECTIVE_RUSSIAN + s.VERB + s.VERB_AFTER_VOWEL))
    words = {"", "я", "бути", "був", "дати", "свет", "свят", "сила", "стол", "любов", "вшись"}
    while len(words) < 1500:
        words.add("".join(rng.choice("абвдеклсьтияюєї") for _ in range(rng.randint(0, 4))) + rng.choice(["", "а", "и", "ю"]) + rng.choice(ends) + rng.choice(["", "", "ся", "сь"]))
    df = spark.createDataFrame([(w, k % 2 == 0) for k, w in enumerate(sorted(words))] + [(None, True)], "form string, ru boolean")
    for r in df.select("form", "ru", s.divisions("form", "ru").alias("d")).collect():
        assert {tuple(x) for x in r.d} == (plain(r.form, r.ru) if r.form else set()), r.form


def test_forms_of_one_word(spark):
    text = "заповіт заповіти заповіту заповітом світ світи світити світила земля землю землі завіт завітати завітаю буває бути був любов любові".split()
    forms = spark.createDataFrame([(w,) for w in text] * 2 + [("",), (None,)], "form string")
    asked = spark.createDataFrame([(w,) for w in ("заповіт", "земля", "завіт", "світити", "бути", "є", "нема")], "form string")
    got = {}
    for r in s.forms_of(asked, forms, russian=False).collect():
        got.setdefault(r.asked, set()).add(r.form)
    assert got["заповіт"] == {"заповіт", "заповіти", "заповіту", "заповітом"} and got["земля"] == {"земля", "землю", "землі"}
    assert got["завіт"] == {"завіт"}  # a noun does not reach a verb of its letters
    assert {"світити", "світила"} <= got["світити"] and {"бути", "був"} <= got["бути"] and "є" not in got and "нема" not in got


def test_no_forms(spark):
    none = spark.createDataFrame([], "form string")
    assert s.forms_of(none, none).collect() == [] and s.divided(none).collect() == []
