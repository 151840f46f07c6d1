"""Nested spans by the rule itself, and feature files over blocks."""

import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from corpusloom.operators import spans
from corpusloom.sources import fabric

SPAN = "text long, node long, kind string, runs array<struct<first:bigint,last:bigint>>"


def runs(slots):
    out = []
    for s in sorted(slots):
        if out and out[-1][1] == s - 1:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def plain(rows, above, within):
    """Parents by sets of slots."""
    out, sets = {}, {(t, n): set(s) for t, n, _, s in rows}
    for t, n, kind, s in rows:
        over = sorted((len(q), m) for u, m, k, q in rows if u == t and k == above.get(kind) and s and min(s) in q)
        out[t, n] = over[0][1] if over and s <= sets[t, over[0][1]] else None
    first = dict(out)
    for t, n, kind, s in rows:
        if kind in within and first[t, n] is not None:
            more = sorted((len(q), m) for u, m, k, q in rows if u == t and k == kind and first[t, m] == first[t, n] and len(q) > len(s) and s <= q)
            out[t, n] = more[0][1] if more else first[t, n]
    return out


def test_parents_equal_the_rule(spark):
    rng, rows = random.Random(4), []
    for text in range(12):
        for node in range(40):
            kind = rng.choice(["sentence", "clause", "phrase", "half"])
            start, size = rng.randrange(30), rng.choice([1, 2, 3, 6, 15, 30])
            slots = {s for s in range(start, start + size) if kind == "sentence" or rng.random() < 0.8}
            rows.append((text, node, kind, slots))
    above = {"clause": "sentence", "phrase": "clause"}
    df = spark.createDataFrame([(t, n, k, runs(s)) for t, n, k, s in rows], SPAN)
    got = spans.nested(df, above, ("phrase",)).collect()
    assert {(r.text, r.node): r.parent for r in got} == plain(rows, above, ("phrase",)) and len(got) == len(rows)
    kinds = {(t, n): k for t, n, k, _ in rows}
    assert all(r.parent_kind == (kinds[r.text, r.parent] if r.parent is not None else None) for r in got)
    for r in got:
        like = sorted((min(s), -len(s), n) for t, n, k, s in rows if t == r.text and k == r.kind and s)
        assert r.position == (like.index((r.first, -r.words, r.node)) + 1 if r.words else None)


def test_equal_spans_stay_siblings_and_split_spans_need_all_words(spark):
    rows = [(1, 1, "clause", [(1, 9)]), (1, 2, "phrase", [(2, 4)]), (1, 3, "phrase", [(2, 4)]), (1, 4, "phrase", [(2, 2), (4, 4)]), (1, 5, "phrase", [(2, 2), (10, 10)]), (1, 6, "phrase", [])]
    got = {r.node: r.parent for r in spans.nested(spark.createDataFrame(rows, SPAN), {"phrase": "clause"}, ("phrase",)).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 2, 5: None, 6: None}


def test_no_spans_and_search(spark):
    assert spans.nested(spark.createDataFrame([], SPAN), {"phrase": "clause"}, ("phrase",)).collect() == []
    df = spark.createDataFrame([(1, 1, "phrase", [(1, 1), (3, 3)], "Pred"), (1, 2, "phrase", [(2, 2)], "NA"), (1, 3, "clause", [(1, 3)], None)], SPAN + ", f string")
    df = df.withColumn("features", spans.features_of(function="f", depth=F.lit(0)))
    assert [r.features for r in df.orderBy("node").collect()] == [{"function": "Pred", "depth": "0"}, {"depth": "0"}, {"depth": "0"}]
    words = spark.createDataFrame([(1, 1, "a", "A "), (1, 2, "b", "b, "), (1, 3, "c", "c.")], "text long, slot long, form string, surface string")
    said = lambda **by: sorted((r.node, r.words, r.preview) for r in spans.find(df, words, **by).collect())
    assert said(kind="phrase", feature=("function", "Pred")) == [(1, 2, "A c.")]
    assert said(form="b") == [(2, 1, "b,"), (3, 3, "A b, c.")] and said(kind="phrase", feature=("function", "NA")) == []


def read(lines):
    """The rule: an implicit line counts on from the line before it."""
    at, single, wide = 0, {}, []
    for line in lines:
        spec, tab, value = line.partition("\t")
        if not tab:
            at += 1
            single.setdefault(at, line)
            continue
        first, _, last = spec.partition("-")
        at = int(last or first)
        if last:
            wide.append((int(first), at, value))
        else:
            single.setdefault(at, value)
    return lambda node: single[node] if node in single else next((v for a, b, v in wide if a <= node <= b), None)


def test_features_over_many_blocks(spark, tmp_path):
    rng, lines, at = random.Random(9), [], 0
    for k in range(400):
        how = rng.random()
        if how < 0.75:
            at, line = at + 1, rng.choice(["", "wa", "wört", "x-y"])
        elif how < 0.9:
            at += rng.randint(1, 3)
            line = f"{at}\tone\ttab {k}"
        else:
            line, at = f"{at + 1}-{at + 2600}\twide {k}", at + 2600
        lines.append(line)
    for name in ("lang.tf", "other.tf"):
        (tmp_path / name).write_text("@node\n@valueType=str\n@description=a = b\r\n\n" + "\n".join(lines if name == "lang.tf" else ["only", "7\tseven", "eight"]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        coded = fabric.features(spark, str(tmp_path))
        held = coded.filter("file = 'lang'")
        assert held.count() == 400 and held.select("place.block").distinct().count() > 5
        nodes = spark.range(0, at + 5).withColumnRenamed("id", "node")
        rule = read(lines)
        assert {r.node: r.value for r in fabric.valued(nodes, held).collect()} == {n: rule(n) for n in range(at + 5)}
        assert sorted((r.first, r.value) for r in coded.filter("file = 'other'").collect()) == [(1, "only"), (7, "seven"), (8, "eight")]
        about = {(r.file, r.key): r.value for r in fabric.head(spark, str(tmp_path)).collect()}
        assert about["lang", "kind"] == "node" and about["other", "description"] == "a = b" and len(about) == 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text", ["@node\n\nx\n4-2\ty\n", "@node\n\nseven\ty\n", "@node\n@valueType=str\n", "no head\n\nx\n"])
def test_bad_files_are_refused(spark, tmp_path, text):
    (tmp_path / "bad.tf").write_text(text)
    with pytest.raises(SparkRuntimeException, match="no valid"):
        fabric.features(spark, str(tmp_path / "bad.tf")).collect()


def test_runs_and_written_features(spark, tmp_path):
    df = spark.createDataFrame([("1-3,7",), ("5",), ("4, 1-2,3",), ("3-1",), ("x",), ("1-2-3",)], "v string")
    assert [None if r.r is None else [tuple(x) for x in r.r] for r in df.select(fabric.runs(F.col("v")).alias("r")).collect()] == [[(1, 3), (7, 7)], [(5, 5)], [(1, 4)], None, None, None]
    rows = [(n, None if n % 11 == 0 else "a\tb" if n % 7 == 0 else f"v{n // 4}") for n in range(100)]
    given = spark.createDataFrame(rows, "node long, value string")
    fabric.write_features(given, str(tmp_path / "out"), author="nobody")
    assert sorted(map(tuple, fabric.valued(given.select("node"), fabric.features(spark, str(tmp_path / "out"))).collect())) == sorted(rows)
