"""What the findings of round 3 mended, on small tables."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import evidence, graph, index, passages, passes, spans
from corpusloom.session import by_segment, kept


def test_a_doubled_accented_letter_is_undoubled(spark):
    words = spark.createDataFrame([("oupaéé",), ("dieenerßß",), ("plann",), ("agree",), ("aab",)], "w string")
    got = [r["s"] for r in words.select(text.stemmed(F.col("w")).alias("s")).collect()]
    assert got == ["oupaé", "dieenerß", "plan", "agre", "aab"]


def test_known_renderings_meet_within_segments(spark):
    rows = [(k, p, w) for k, ws in enumerate(["anna went home", "ann wants bread", "bread and annals"]) for p, w in enumerate(ws.split())]
    source, target = spark.createDataFrame(rows, "seg long, position long, lemma string"), spark.createDataFrame([(1 - s, p, w) for s, p, w in rows], "seg long, position long, form string")
    known = spark.createDataFrame([("ann", "anna", 0.5), ("ann", "annals", 0.5), ("anna", "ann", 1.0), ("want", "went", 1.0)], "form string, lemma string, share double")
    met = evidence.meeting(source, target, lambda w: F.left(w, F.lit(3)))
    assert {tuple(r) for r in met.select("seg", "lemma", "form").collect()} == {(0, "anna", "ann"), (1, "ann", "anna")}
    got, want = evidence.known_among(met, known), evidence.known_rendering_evidence(source, target, known)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 2


def test_components_join_all_customers_on_long_paths(spark, tmp_path):
    spark.range(1, 41).selectExpr("id AS c_custkey", "0 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = {tuple(r) for r in entry.queries()["components_min_label"](spark, str(tmp_path)).collect()}
    assert got == {(v, 1) for v in range(1, 42)}


def test_reigns_round_halves_as_a_cast_does(spark, tmp_path):
    spark.createDataFrame([(1, 2.5), (1, 6.5), (6, 3.5), (6, 8.0)], "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in entry.queries()["reigns_synchronism"](spark, str(tmp_path)).collect()] == [(1, 6, 3, 1, 2)]


def test_segments_are_taken_apart_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(index, "SLICE", 2)
    rows = [(1, "en", "b a b"), (2, "en", None), (3, "en", ""), (4, None, "a"), (5, "en", "c a"), (6, "hbo", "ְ a")]
    got = {tuple(r[:3]): r["positions"] for r in index.grouped(spark.createDataFrame(rows, "k long, lang string, text string").coalesce(1), "k").collect()}
    assert got == {("en", "b", 1): [0, 2], ("en", "a", 1): [1], (None, "a", 4): [0], ("en", "c", 5): [0], ("en", "a", 5): [1], ("hbo", "a", 6): [1]}


def test_closure_goes_up_from_new_pairs_and_on_by_doubling(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(0, 4), (20, 21), (21, 20)], "child long, parent long")
    want = None
    for levels in (1, 3, 24):  # 1 and 3 leave longer paths and the cycle to the doubling
        got = {tuple(r) for r in graph.closure(edges, levels).collect()}
        assert want is None or got == want
        want = got
    assert (0, 9, 6) in want and (20, 20, 2) in want and len(want) == 45 + 4


def test_seeds_count_segments_not_places(spark):
    rows = [("x", 1, 0), ("x", 1, 7), ("x", 2, 3), ("y", 1, 1), ("y", 1, 2)] + [("z", k, 5) for k in range(5)]
    grams = spark.createDataFrame(rows, "gram string, seg long, position long")
    assert {tuple(r) for r in passages.seeds(grams, grams).collect()} == {(1, 0, 2, 3), (1, 7, 2, 3)}


def test_passes_within_segments_exchange_nothing(spark):
    rows = spark.createDataFrame([(1, "a", "p", "strong", "s", "renders", 0.9, None, None, False, True, 1, [10, 11], [10], None), (1, "b", "p", "evidentia", "s", "expands", None, "safe", 1, False, False, 1, [10], [], None), (2, "c", "p", "stated", "s", "renders", None, None, None, False, False, 1, [20], [20], None)], "segment long, key string, pair string, method string, source string, relation string, confidence double, tier string, run int, support boolean, laid boolean, book int, source_words array<long>, target_words array<long>, status string")
    rulings = spark.createDataFrame([(2, "p", "refuse", [20], [20], None, None), (1, "p", "accept", [12], [12], None, None)], "segment long, pair string, action string, source_words array<long>, target_words array<long>, source string, relation string")
    with by_segment(spark, 3) as dealt:
        held = dealt.keep(rows), dealt.keep(rulings)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = passes.narrowed(passes.refused(*held), held[1])._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        got = {r["key"]: (r["segment"], r["status"]) for r in dealt.result(passes.decided(*held, keep=dealt.keep)).collect()}
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plain = {r["key"]: r["status"] for r in passes.decided(rows.drop("segment"), rulings.drop("segment")).collect()}
    assert {k: s for k, (_, s) in got.items()} == plain and plain["c"] == "refused-by ruling" and plain["a"] == "narrowed-by evidentia" and got["ruling:p|12|12"] == (1, None)


def test_spans_of_very_many_runs_nest(spark):
    nodes = {"c": ("clause", 1), "a": ("group", 2), "ab": ("group", 4), "x": ("group", 3)}
    kinds = F.array(*[F.struct(F.when(F.col("id") % step == 0, node).alias("node"), F.lit(kind).alias("kind")) for node, (kind, step) in nodes.items()])
    words = spark.range(40_000).select(F.lit(1).alias("text"), F.col("id").alias("slot"), F.explode(kinds).alias("k")).select("text", "slot", "k.*").filter("node IS NOT NULL")
    rows = kept(spans.spans_of(words))
    got = {r["node"]: r["parent"] for r in spans.nested(rows, {"group": "clause"}, ("group",)).select("node", "parent").collect()}
    assert got == {"c": None, "a": "c", "ab": "a", "x": "c"}


def test_spans_meet_their_words_once(spark):
    rows = spark.createDataFrame([(1, "c1", "clause", [(1, 2)]), (1, "c2", "clause", [(3, 3)])], "text long, node string, kind string, runs array<struct<first: long, last: long>>")
    words = spark.createDataFrame([(1, 1, "the", "the "), (1, 2, None, "x "), (1, 3, None, "y ")], "text long, slot long, form string, surface string")
    found = spans.find(rows, words, "clause", None, "the")
    assert [tuple(r) for r in found.collect()] == [(1, "c1", 2, "the x")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_translations_lie_in_parts_that_grow_with_the_words(spark, monkeypatch):
    parts, write = [], evidence.kept
    monkeypatch.setattr(evidence, "BUCKET", 3)
    monkeypatch.setattr(evidence, "kept", lambda df, name: parts.append((name, df.rdd.getNumPartitions())) or write(df, name))
    words = [(seg, at, s, t) for seg, (a, b) in enumerate([("x x y", "u v v"), ("x", "u"), ("y z x x", "v w u u"), ("z z", "w v")]) for at, (s, t) in enumerate(zip(a.split(), b.split()))] * 2
    df = spark.createDataFrame(words, "seg long, source_at long, source string, target string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r["source"], r["target"]): r["p"] for r in evidence.translation_table(df.select("seg", "source_at", "source"), df.select("seg", "target"), 2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dict(parts)["translation-pairs"] == len(words) // 3 + 1
    table = None
    for _ in range(2):
        counts = {}
        for seg in range(4):
            own = [w for w in words if w[0] == seg]
            length = len({w[1] for w in own})
            for t in [w[3] for w in own]:
                total = sum(table[w[2], t] if table else 1.0 for w in own)
                for w in own:
                    counts[w[2], t] = counts.get((w[2], t), 0.0) + (table[w[2], t] if table else 1.0) / total * len(own) / length
        table = {k: c / sum(x for (s, _), x in counts.items() if s == k[0]) for k, c in counts.items()}
    assert {k: round(p, 9) for k, p in got.items()} == {k: round(p, 9) for k, p in table.items()}


def test_contests_within_segments_need_no_rounds(spark):
    rows = [(k // 8, f"{k // 8}|{k}", "ab"[k * 7 % 5 % 2], ["strong", "evidentia", None][k % 3], k % 5 % 2 == 0, k * 11 % 4, [k // 8 * 10 + k % 3, k // 8 * 10 + k * 5 % 4]) for k in range(160)]
    rows += [(99, "99|0", None, "strong", True, 9, [1]), (99, "99|1", "a", "strong", None, 9, [1]), (99, "99|2", "a", "strong", False, None, [990]), (99, "99|3", "b", "strong", True, 9, [None, 990]), (99, "99|4", "b", "strong", True, 9, None)]
    links = kept(spark.createDataFrame(rows, "segment long, link string, pair string, method string, absence boolean, rank long, words array<long>"))
    found = passes.against(links)
    assert found.columns == [*links.drop("segment").columns, "status"]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["link"]: r["status"] for r in found.collect()}
    assert got == {r["link"]: r["status"] for r in passes.against(links.drop("segment")).collect()} and sum(s is not None for s in got.values()) > 10
