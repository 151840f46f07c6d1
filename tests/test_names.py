"""Name consensus: stated cases, and a plain implementation over a whole table."""

import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import names
from corpusloom.plans import catalogue
from corpusloom.session import tables

LENIENT = (1, 0.1, 0.05)


@pytest.fixture
def consensus(spark):
    def read(text, entities, namesakes=(), kinds=None):
        words = [(verse, k, w) for verse, line in text for k, w in enumerate(line.split())]
        named = [(e, (kinds or {}).get(e, "person"), v) for e, verses in entities.items() for v in verses]
        frames = spark.createDataFrame(words, "verse int, word int, surface string"), spark.createDataFrame(named, "entity string, kind string, verse int"), spark.createDataFrame(list(namesakes), "entity string, other string")
        findings, claims = names.read(*frames)
        surface = {(v, k): w for v, k, w in words}
        by = {r.entity: r for r in findings.collect()}
        good = {r.entity for r in names.accepted(findings, *LENIENT).collect()}
        claimed = defaultdict(list)
        for r in claims.orderBy("verse", "word").collect():
            if r.entity in good:
                claimed[r.entity].append((r.verse, surface[r.verse, r.word]))
        return by, claimed

    return read


def test_words_are_compared_without_marks(spark):
    cases = {"وَلِإِبْرَاهِيمَ": "ولابراهيم", "Ἀβραὰμ": "αβρααμ", "Μωυσῆς": "μωυσησ", "Abraham's": "abrahams", "Авраамові": "авраамові", "아브라함이라": "아브라함이라", "दाऊद": "दाऊद"}
    df = spark.createDataFrame(list(cases.items()), "s string, want string").withColumn("got", names.folded(F.col("s")))
    assert {r.s: r.got for r in df.collect()} == cases
    got = {r.f: r.c for r in spark.createDataFrame([("авраамові",), ("ог",), ("я",)], "f string").withColumn("c", names.cores(F.col("f"))).collect()}
    assert "авраам" in got["авраамові"] and "ав" not in got["авраамові"] and got["ог"] == ["ог"] and got["я"] == []


def test_a_name_in_every_case(consensus):
    text = [(101, "І сказав Бог Авраамові"), (102, "І пішов Авраам"), (103, "І дав Авраамові сина"), (104, "І встав Авраам рано"), (105, "І сказав Він Авраама"), (201, "І пішов народ"), (202, "І сказав цар"), (203, "І встав пророк рано")]
    found, claimed = consensus(text, {"abraham": [101, 102, 103, 104, 105]})
    r = found["abraham"]
    assert (r.core, sorted(r.forms), r.coverage, r.specificity) == ("авраам", sorted(["авраам", "авраамові", "авраама"]), 1, 1)
    assert [w for _, w in claimed["abraham"]] == ["Авраамові", "Авраам", "Авраамові", "Авраам", "Авраама"]


def test_two_spellings_share_a_core_and_namesakes_do_not_count_against(consensus):
    text = [(101, "and Abram went"), (102, "and Abram said"), (103, "thy name shall be Abraham"), (104, "and Abraham rose"), (201, "and the people went")]
    assert sorted(consensus(text, {"a": [101, 102, 103, 104]})[0]["a"].forms) == ["abraham", "abram"]
    text = [(101, "and Saul the king went"), (102, "and Saul said"), (103, "and Saul slept"), (201, "and Saul who is Paul preached"), (202, "and Saul went to Tarsus"), (203, "and Paul said")]
    found, claimed = consensus(text, {"saul": [101, 102, 103], "paul": [201, 202, 203]}, [("saul", "paul")])
    assert found["saul"].core == "saul" and found["saul"].specificity == 1 and len(claimed["saul"]) == 3


def test_equal_names_are_not_guessed_between(consensus):
    text = [(101, "and Mahlon and Chilion went"), (102, "and Mahlon and Chilion died"), (201, "and the people went")]
    found, claimed = consensus(text, {"m": [101, 102], "c": [101, 102]})
    assert found["m"].margin == 0 and found["c"].margin == 0 and not claimed


def test_a_word_of_two_namesakes_names_neither(consensus):
    text = [(101, "Mary stood by"), (102, "Mary the mother wept"), (103, "Mary Magdalene and Mary the mother came"), (201, "Magdalene saw"), (202, "Mary Magdalene ran")]
    _, claimed = consensus(text, {"mother": [101, 102, 103], "magdalene": [103, 201, 202]}, [("mother", "magdalene"), ("magdalene", "mother")])
    assert not [w for w in claimed["mother"] if w == (103, "Mary")]


def test_words_in_lower_case_are_no_names(consensus):
    text = [(101, "Joram the reed rose"), (102, "a reed Joram spoke"), (103, "Joram a reed"), (201, "Nobody came"), (202, "Joram other")]
    assert consensus(text, {"j": [101, 102, 103]})[0]["j"].core == "joram"
    assert consensus(text, {"j": [101, 102, 103]}, kinds={"j": "object"})[0]["j"].core == "reed"


def test_empty_tables_and_entities_without_words(consensus):
    found, claimed = consensus([(1, "one")], {"a": [9]})
    assert found == {} and not claimed
    found, claimed = consensus([(1, "x")], {"a": [1]})
    assert found["a"].core is None and found["a"].margin == 0 and not claimed


def plain(words, entities, namesakes):
    """The rules one by one."""
    marks = re.compile("[̀-֑ͯ-ׇ]")
    fold = lambda s: re.sub(r"[\W_]", "", marks.sub("", s.lower()))
    verses, upper, lower, count = defaultdict(set), Counter(), Counter(), Counter()
    tokens = defaultdict(list)
    for verse, at, surface in words:
        form = fold(surface)
        if not form:
            continue
        verses[form].add(verse)
        tokens[verse].append((at, form, surface[0]))
        count[form] += 1
        upper[form] += unicodedata.category(surface[0]) == "Lu"
        lower[form] += unicodedata.category(surface[0]) == "Ll"
    marked = upper.total() >= 0.02 * (upper.total() + lower.total())
    mine, kinds = defaultdict(set), {}
    for e, kind, v in entities:
        if e is not None and v in tokens:
            mine[e].add(v)
            kinds[e] = kind
    rivals_of = defaultdict(set)
    for e, o in namesakes:
        rivals_of[e].add(o)
    read = {}
    for e, own in mine.items():
        excluded = set().union(*[mine.get(o, set()) for o in rivals_of[e]]) - own
        here = Counter(f for v in own for f in {x[1] for x in tokens[v]})
        particular = {f: n for f, n in here.items() if n / (len(verses[f]) - len(verses[f] & excluded)) >= 0.5 and not (kinds[e] == "person" and marked and lower[f] and upper[f] < 0.5 * count[f])}
        by = defaultdict(set)
        for f in particular:
            n = len(f)
            if n < 3:
                if n == 2:
                    by[f].add(f)
                continue
            for size in range(max(3, n - 4, (n + 1) // 2), n + 1):
                for at in range(n - size + 1):
                    by[f[at : at + size]].add(f)
        for core in by:
            if len(core) < 3:
                by[core] |= {f for f in particular if f.startswith(core) and len(f) - len(core) <= 2}
        scored = []
        for core, types in by.items():
            lead = min(types, key=lambda f: (-particular[f], f))
            types = frozenset(f for f in types if lead in f or f in lead or (f.startswith(core) and lead.startswith(core)) or (f.endswith(core) and lead.endswith(core)))
            printed = set().union(*[verses[f] for f in types]) - excluded
            reached = len(printed & own)
            scored.append((reached / len(own) * (reached / len(printed) if printed else 0), core, types, reached))
        scored.sort(key=lambda s: (-s[0], -len(s[1]), s[1]))
        best = max([s for s in scored if s[0] >= scored[0][0] - 0.01], key=lambda s: len(s[1]), default=None)
        rival = next((s[0] for s in scored if best and not s[2] & best[2]), 0)
        read[e] = (best, (best[0] - rival) if best else 0, particular, here)
    claims = set()
    for e, (best, _, particular, _) in read.items():
        for v in mine[e] if best else ():
            others = [o for o in mine if o != e and v in mine[o]]
            for at, form, letter in tokens[v]:
                if form not in best[2] or (kinds[e] == "person" and marked and unicodedata.category(letter) == "Ll"):
                    continue

                def blocks(o, form=form, e=e, particular=particular):
                    if o in rivals_of[e]:
                        return form in read[o][2] or read[o][3][form] * 2 >= len(mine[o])
                    if kinds[o] == kinds[e]:
                        return bool(read[o][0]) and form in read[o][0][2]
                    return form in read[o][2] and read[o][2][form] * len(mine[e]) >= particular[form] * len(mine[o])

                if not any(map(blocks, others)):
                    claims.add((e, v, at))
    return {e: (b[1], tuple(sorted(b[2])), b[3], round(b[0], 9), round(m, 9)) if b else None for e, (b, m, _, _) in read.items()}, claims


def test_consensus_over_a_whole_table(spark):
    words, entities, namesakes = catalogue.consensus_inputs(tables(spark, "/root/testdata/sf0.001"))
    want, wanted = plain([tuple(r) for r in words.collect()], [tuple(r) for r in entities.collect()], [tuple(r) for r in namesakes.collect()])
    findings, claims = names.read(words, entities, namesakes)
    got = {r.entity: (r.core, tuple(r.forms), r.covered, round(r.score, 9), round(r.margin, 9)) if r.core else None for r in findings.collect()}
    assert got == want
    assert {tuple(r) for r in claims.collect()} == wanted and wanted


def compared(findings, claims):
    return {r.entity: (r.core, tuple(r.forms), r.covered, round(r.score, 9), round(r.margin, 9)) if r.core else None for r in findings.collect()}, sorted(tuple(r) for r in claims.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounds_leave_the_exact_best_and_rival(spark, seed):
    rng = random.Random(seed)
    parts = ["ab", "ra", "ham", "is", "ac", "o", "mi", "él", "sa"]
    vocabulary = ["".join(rng.choices(parts, k=rng.choice([1, 2, 2, 3, 4]))) for _ in range(90)]
    words = [(v, k, w.title() if rng.random() < 0.6 else w) for v in range(70) for k, w in enumerate(rng.choices(vocabulary, weights=range(1, 91), k=rng.choice([1, 6, 12])))]
    entities = [(f"e{k}", "person" if k < 4 else "people", v) for k in range(7) for v in range(70) if rng.random() < 0.04 * (k + 1)]
    # some words are those of an entity
    words += [(v, 100 + k, rng.choice(vocabulary[int(e[1]) :: 7]).title()) for e, _, v in entities for k in range(2)]
    words = [(v, k, w) for k, (v, _, w) in enumerate(words)]
    namesakes = [("e0", "e1"), ("e5", "e0"), ("e2", "e2"), ("e4", "nobody")]
    want, wanted = plain(words, entities, namesakes)
    frames = spark.createDataFrame(words, "verse int, word int, surface string"), spark.createDataFrame(entities, "entity string, kind string, verse int"), spark.createDataFrame(namesakes, "entity string, other string")
    got, claims = compared(*names.read(*frames))
    assert got == want and claims == sorted(wanted) and claims


def test_texts_give_the_same_as_words(spark):
    t = tables(spark, "/root/testdata/sf0.001")
    inputs = catalogue.consensus_inputs(t)
    assert compared(*names.read(*inputs, catalogue.consensus_texts(t))) == compared(*names.read(*inputs))
    lines = ["Ἀβραὰμ ЁЖ", "one\ntwo Two", "", "Éa éa ÉA", "Saul\n"]
    df = spark.createDataFrame([(x.split(" "),) for x in lines], "s array<string>")
    one = names.folded_all(df, "s", "all").withColumn("each", F.array_distinct(F.filter(F.transform("s", names.folded), lambda f: f != "")))
    assert all(r["all"] == r["each"] for r in one.collect())


@pytest.mark.parametrize("name", ["name_claims", "name_findings"])
def test_few_clusters_meet_their_verses(spark, name):
    """Bytes shuffled for the names of a table against those of its texts (40 times them when all clusters met their verses)."""
    bus, store = spark._jsc.sc().listenerBus(), spark._jsc.sc().statusStore()

    def shuffled():
        bus.waitUntilEmpty(30_000)
        time.sleep(0.5)
        return store.executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    text = tables(spark, "/root/testdata/sf0.01")("documents").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < shuffled() - before < 27 * text
