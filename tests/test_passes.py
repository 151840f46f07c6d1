"""The merge's passes on small cases, and the contest of two pairs against a plain loop over a whole table."""

import pytest

from corpusloom.operators import merge, passes
from corpusloom.plans import passing
from corpusloom.session import tables

ROW = "key string, pair string, method string, source string, relation string, confidence double, tier string, run int, support boolean, laid boolean, book int, source_words array<long>, target_words array<long>, status string"
RULING = "pair string, action string, source_words array<long>, target_words array<long>, source string, relation string"


def row(key, method, a, b, confidence=None, source="s", tier=None, run=None, laid=False, support=False, relation=None, pair="p", book=1):
    relation = relation or ("renders" if a and b else "expands" if a else "omits")
    return (key, pair, method, source, relation, confidence, tier, run, support, laid, book, a, b, None)


@pytest.fixture
def run(spark):
    def decide(rows, rulings=()):
        df, ruled = spark.createDataFrame(rows, ROW), spark.createDataFrame(list(rulings), RULING)
        return {r.key: r for r in passes.decided(df, ruled).collect()}

    return decide


def test_methods_on_the_same_words_are_one_link(run):
    got = run([row("a", "composed", [1], [1], 0.98), row("b", "strong", [1], [1], 0.7)])
    assert got["a"].settles and not got["b"].settles and got["b"].status is None and got["a"].link_rank == 60


def test_refusals(run):
    got = run(
        [row("a", "composed", [1], [1], 0.98, "SIL.Machine ibm4"), row("b", "strong", [1], [1], 0.5), row("c", "stated", [2, 3], [2], source="Berean"), row("d", "stated", [2, 3], [2], source="other"), row("e", "stated", [3], [9], source="Berean")],
        [("p", "refuse", [1], [1], "SIL.Machine", "renders"), ("p", "refuse", [3], [], "Berean", None), ("q", "refuse", [2, 3], [2], None, None)],
    )
    assert got["a"].status == "refused-by ruling" and got["b"].status is None
    assert got["c"].status == "narrowed-by ruling" and got["c/ruling"].source_words == [2] and got["c/ruling"].status is None
    assert got["d"].status is None and got["e"].status == "refused-by ruling"


def test_accepted_shapes(run):
    got = run(
        [row("a", "stated", [1], [1]), row("b", "aligner", [1], [2], 0.4), row("c", "evidentia", [5], [5], 0.9, tier="safe", run=1), row("d", "evidentia", [6], [6], 0.9, tier="safe", run=2)],
        [("p", "accept", [1], [2], None, "renders"), ("p", "accept", [9], [9], None, None), ("p", "accept", [9], [9], "again", None), ("p", "accept", [5], [5], None, None)],
    )
    assert got["b"].link_rank == merge.RANKS["pinned"] and got["b"].settles
    made = {k: r for k, r in got.items() if r.method == "ruling"}
    assert sorted(r.source_words for r in made.values()) == [[5], [9]] and all(r.settles for r in made.values())
    assert got["c"].status == "superseded-by run 2"  # so its shape stands as a ruling


def test_newer_runs_supersede_in_their_books_and_tiers(run):
    got = run([row("a", "evidentia", [1], [1], tier="safe", run=1), row("b", "evidentia", [2], [2], tier="safe", run=3), row("c", "evidentia", [3], [3], tier="attached", run=1), row("d", "evidentia", [4], [4], tier="safe", run=1, book=2), row("e", "evidentia", [5], [5], run=1), row("f", "evidentia", [6], [6])])
    assert {k: r.status for k, r in got.items()} == {"a": "superseded-by run 3", "b": None, "c": None, "d": None, "e": None, "f": None}


def test_verdicts_of_absence_narrow_laid_numbers_only(run):
    def rows(laid):
        return [row("a", "strong", [1, 2], [1], 0.95, laid=laid), row("b", "evidentia", [1], [], tier="safe", run=14), row("c", "strong", [3], [2, 3], 0.95, laid=laid), row("d", "evidentia", [], [3], tier="safe", run=14), row("e", "strong", [4], [4], 0.95, laid=laid), row("f", "evidentia", [4], [], tier="safe", run=14)]

    got = run(rows(True))
    assert (got["a"].status, got["c"].status, got["e"].status) == ("narrowed-by evidentia", "narrowed-by evidentia", "withdrawn-by evidentia")
    assert got["a/evidentia"].source_words == [2] and got["c/evidentia"].target_words == [2] and "e/evidentia" not in got
    assert all(r.status is None for r in run(rows(False)).values())
    assert run(rows(True), [("p", "accept", [1, 2], [1], None, None)])["a"].status is None


def test_absences_of_verdicts_give_way_but_to_the_aligner(run):
    got = run([row("a", "evidentia", [], [1], tier="safe"), row("b", "stated", [1], [1]), row("c", "evidentia", [5], [], tier="safe"), row("d", "aligner", [5], [5], 0.9), row("e", "lexical", [5], [5], 0.6), row("f", "evidentia", [], [4], tier="safe"), row("g", "aligner", [4], [4], 0.6), row("h", "stated", [], [7])])
    assert got["a"].link_rank == 0 and got["c"].link_rank == 0 and got["f"].link_rank == merge.EVIDENCE_ABSENCE and got["h"].link_rank == merge.STATED_ABSENCE


def test_rows_that_only_support_are_no_link_alone(run):
    got = run([row("a", "strong", [1], [1], 0.9, support=True), row("b", "strong", [2], [2], 0.9, support=True), row("c", "composed", [2], [2], 0.5), row("d", "strong", [3], [3], 0.9, support=True)], [("p", "accept", [3], [3], None, None)])
    assert (got["a"].status, got["b"].status, got["d"].status) == ("unsupported", None, None)


def test_other_relations_of_a_shape_are_withdrawn_by_its_method(run):
    got = run([row("a", "stated", [1], [1]), row("b", "aligner", [1], [1], 0.9, relation="equals")])
    assert got["b"].status == "withdrawn-by stated"


def test_links_between_verses_that_nothing_joins(spark):
    rows = [row(k, m, [a], [b], 0.9) for k, m, a, b in (("a", "aligner", 1, 11), ("b", "aligner", 1, 12), ("c", "stated", 1, 12), ("d", "composed", 2, 12), ("e", "aligner", 3, 12), ("f", "aligner", 4, 11))]
    decided = passes.shaped(spark.createDataFrame(rows, ROW), spark.createDataFrame([], RULING))
    verse_of = spark.createDataFrame([("source", 1, 1, 1), ("source", 2, 2, 5), ("source", 3, 3, None), ("source", 4, 4, 4), ("target", 11, 21, 1), ("target", 12, 22, 2)], "side string, word long, verse long, address long")
    joined = spark.createDataFrame([(22, 2)], "verse long, other long")  # the other way round
    got = {r.key: r.status for r in passes.crossing(decided, verse_of, joined).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": None, "e": None, "f": "withdrawn-by unjoined-verses"}


def test_rulings_with_nulls_and_empty_tables(run, spark):
    empty = spark.createDataFrame([], ROW)
    assert passes.decided(empty, spark.createDataFrame([], RULING)).count() == 0
    assert len(run([], [("p", "accept", [1], [1], None, None)])) == 1


def test_decided_twice_gives_the_same_rows(spark):
    t = tables(spark, "/root/testdata/sf0.001")
    once, again = (sorted(map(str, passing.merge_decided(t).collect())) for _ in range(2))
    assert once == again and any("narrowed" in r for r in once)


def test_contests_of_two_pairs_follow_the_ranks(spark):
    t = tables(spark, "/root/testdata/sf0.001")
    links = passing.contests_of(t)
    rows = sorted(links.collect(), key=lambda r: (-r.rank, r.absence, r.pair, r.link))
    held, kept, want = {}, set(), {}
    for r in rows:  # in order: a kept opponent that came before withdraws a link
        winners = [k for w in r.words for k in held.get(w, []) if k.pair != r.pair and k.absence != r.absence]
        if winners:
            first = min(winners, key=lambda k: (-k.rank, k.absence, k.pair, k.link))
            want[r.link] = f"withdrawn-by {first.method} in {first.pair}"
            continue
        kept.add(r.link)
        for w in r.words:
            held.setdefault(w, []).append(r)
    got = {r.link: r.status for r in passes.against(links).collect()}
    assert got == {r.link: want.get(r.link) for r in rows} and want
