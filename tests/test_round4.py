"""What the findings of round 4 mended, on small tables."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import passages, quality, spans, timeline


@pytest.mark.parametrize("block", [2, 10_000])
def test_reigns_of_all_kings_meet_in_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(timeline, "BLOCK", block)
    reigns = {1: (0, 9), 2: (9, 12), 3: (3, 3), 4: (13, 20), 5: (0, 9), 6: (2, 30), 7: (10, 10), 8: (None, None), 11: (3, 4)}
    rows = [(k, None if v is None else float(v)) for k, vs in reigns.items() for v in vs] + [(None, 1.0), (None, 40.0)]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    want = set()
    for a, (s, u) in reigns.items():
        for b, (x, y) in reigns.items():
            if a < b and None not in (s, x) and s <= y and x <= u:
                want.add((a, b, max(s, x) - s + 1, max(s, x) - x + 1, min(u, y) - max(s, x)))
    got = [tuple(r) for r in entry.queries()["reigns_synchronism"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (1, 2, 10, 1, 0) in want and (1, 3, 4, 1, 0) in want


def test_discounts_are_added_in_the_order_of_the_rows(spark, tmp_path):
    rows = [("A", "F", 1, x) for x in (0.05, 0.09, 0.01, 0.01)] + [("A", "F", 2, x) for x in (0.01, 0.01, 0.02, 0.0)]
    for at, some in enumerate((rows[:1], rows[1:])):  # tasks of their own, whose sums would make the mean less than 0.04
        spark.createDataFrame(some, "l_returnflag string, l_linestatus string, l_orderkey long, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet" / f"part={at}"))
    got = [tuple(r) for r in entry.queries()["pairing"](spark, str(tmp_path)).collect()]
    assert got == [("A", "F", 2, 1, "2")]


def test_states_are_dealt_by_key_once(spark):
    """Whatever comes after that lies where it is; examples and counts alone are gathered."""
    rows = [("s", g, k, v, i) for g, k, v, i in [("g", 1, "x", 1), ("g", 1, "x", 2), ("h", None, None, 3), ("g", 2, "y", None), ("g", 2, None, 4)]]
    after = [("s", g, k, v, i) for g, k, v, i in [("g", 1, "x", 2), ("h", None, "n", 3), ("h", None, None, 3), ("h", 2, "z", None), ("g", 2, None, 5), ("g", 3, None, None)]]
    a, b = (spark.createDataFrame(x, "scope string, group string, key long, value string, id long") for x in (rows, after))
    found = quality.difference_groups(a, b)
    got = {tuple(r)[1:] for r in found.collect()}
    # equal values match off in the order of their ids: 1 meets 2, and the second is left over
    assert got == {("g", "id-only", 2, "1  1 -> 2\n2  4 -> 5"), ("g", "only-before", 1, "1  x"), ("g -> h", "changed", 1, "2  y  =>  z"), ("h", "only-after", 1, "  n"), ("g", "only-after", 1, "3  ")}
    plain = lambda df: df.select("key", "value", "id")
    plan = quality.keyed_comparison(plain(a), plain(b))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert text.count("Join") == 0


def test_grams_are_dealt_as_hashes(spark, monkeypatch):
    written = []
    monkeypatch.setattr(passages, "kept", lambda df, name: written.append(df) or df)
    rows = [("x y", 1, 0), ("x y", 2, 3), ("y", 1, 1), (None, 1, 2), (None, 2, 2)] + [("z", k, 5) for k in range(5)]
    grams = spark.createDataFrame(rows, "gram string, seg long, position int")
    assert {tuple(r) for r in passages.seeds(grams, grams).collect()} == {(1, 0, 2, 3)}
    assert "string" not in [kind for _, kind in written[0].dtypes]
    other = grams.select("gram", (F.col("seg") + 10).alias("seg"), "position")
    assert {tuple(r) for r in passages.seeds(grams, other).collect()} == {(1, 0, 11, 0), (1, 0, 12, 3), (2, 3, 11, 0), (2, 3, 12, 3)}


def test_spans_are_put_together_where_their_text_lies(spark, tmp_path, monkeypatch):
    plans, write = [], session.kept
    monkeypatch.setattr(session, "kept", lambda df, name="kept": plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    texts = [(1, "One the. Two the, a the b, c. Three the."), (2, None), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {tuple(r) for r in entry.queries()["spans_with_a_word"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {(1, "c1", 2, "Two the"), (1, "c2", 3, "a the b")}
    # a reused exchange is named beside what it reuses
    assert plans[-1].count("Exchange hashpartitioning") - plans[-1].count("ReusedExchange") == 1


def test_parents_are_found_once_before_spans_nest(spark, monkeypatch):
    written, write = [], spans.kept
    monkeypatch.setattr(spans, "kept", lambda df, name: written.append(name) or write(df, name))
    run = "runs array<struct<first: long, last: long>>"
    rows = spark.createDataFrame([(1, "c", "clause", [(1, 9)]), (1, "a", "group", [(1, 2), (5, 6)]), (1, "ab", "group", [(1, 1), (6, 6)])], f"text long, node string, kind string, {run}")
    got = {r["node"]: r["parent"] for r in spans.nested(rows, {"group": "clause"}, ("group",)).collect()}
    assert got == {"c": None, "a": "c", "ab": "a"} and written == ["parents"]
