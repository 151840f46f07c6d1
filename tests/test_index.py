"""The positional index of forms and search over it, in several scripts; what was mended in sources, building and comparison."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import languages
from corpusloom.operators import build, quality, search
from corpusloom.operators.index import Index
from corpusloom.sources import copy, formats, texts

TEXTS = [
    (1, "de", "Für die Straße und den Weg"),
    (2, "de", "für den Weg, die STRASSE"),
    (3, "grc", "Ἐν ἀρχῇ ἦν ὁ λόγος"),
    (4, "ru", "В начале было Слово, и Слово было у Бога"),
    (5, "hbo", "בְּרֵאשִׁית בָּרָא אֱלֹהִים"),
    (6, "en", "In the beginning was the Word"),
    (7, "en", "the words of the wise and their dark sayings"),
    (8, "es", "padre e hijo"),
    (9, "es", "padre y madre"),
    (10, None, "λόγος"),
    (11, "en", ""),
    (12, "en", None),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    segments = spark.createDataFrame(TEXTS, "k long, lang string, text string")
    return Index.build(segments, "k", str(tmp_path_factory.mktemp("index") / "i"), parts=3)


@pytest.mark.parametrize(
    ("typed", "only", "found"),
    [
        ("für", None, [1, 2]),
        ("Straße", "de", [1, 2]),
        ("weg strasse", "de", [2, 1]),
        ("λογος", "grc", [3]),
        ("ΛΌΓΟΣ", "grc", [3]),
        ("ЛОГОС", "ru", []),
        ("слово", "ru", [4]),
        ("בראשית", "hbo", [5]),
        ("words", "en", [7, 6]),
        ("“the word”", "en", [6]),
        ("“the words”", "en", [7]),
        ("padre y", "es", [9, 8]),
        ("λόγος", None, [3, 10]),
        ("", None, []),
    ],
)
def test_search_in_its_script(index, typed, only, found):
    assert [r.k for r in index.search(typed, "k", only).collect()] == found


def test_index_counts(index):
    forms = {(r.language, r.form): r for r in index.forms.collect()}
    assert forms["en", "the"].occurrences == 4 and forms["en", "the"].segments == 2 and forms["grc", "λογοσ"].segments == 1
    assert index.postings.filter("form = 'the' AND key = 6").first().positions == [1, 4]


def test_searches_read_the_ranges_of_their_forms_alone(index):
    plan = index.hits(search.parse("слово"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part", "[part") or "part#" in plan.split("PartitionFilters")[1]
    assert "PushedFilters: [" in plan and "form" in plan.split("PushedFilters")[1]


def test_an_index_is_built_anew_when_its_files_change(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "en", "one")], "k long, lang string, text string").write.parquet(path)
    read = lambda: spark.read.parquet(path)
    first = Index.once(read(), "k")
    assert Index.once(read(), "k") is first
    spark.createDataFrame([(2, "en", "two")], "k long, lang string, text string").write.mode("append").parquet(path)
    assert [r.k for r in Index.once(read(), "k").search("two", "k").collect()] == [2]


def test_more_forms_than_are_listed(spark, monkeypatch):
    segments = spark.createDataFrame([(k, "en", f"word{'abcdefghij'[k % 10]}{'klmno'[k % 5]}") for k in range(100)], "k long, lang string, text string")
    plain = sorted(r.k for r in Index.of(segments, "k").search("word", "k").collect())
    for listed, sent in ((3, 100), (3, 2)):
        monkeypatch.setattr("corpusloom.operators.index.LISTED", listed)
        monkeypatch.setattr("corpusloom.operators.index.BROADCAST", sent)
        assert sorted(r.k for r in Index.of(segments, "k").search("word", "k").collect()) == plain == list(range(100))


def test_joint_words_by_language():
    assert languages.joint("й", "ukr") == ["і", "й"] and languages.joint("y", "es") == ["y", "e"] and languages.joint("of", "en") is None and languages.joint("und", None) is None


def test_copy_text_keeps_rows_that_begin_like_comments(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [("#tag", "x", 1, True), ("a\x01b", "\\N", None, None), ("\\t\t\\\\n\n\r", None, 3, False), ("", "# x", 4, True)]
    df = spark.createDataFrame(rows, "a string, b string, n long, f boolean")
    copy.write_copy(df, path, {"product": "x\ny", "rows-of": "3"})
    assert sorted(map(tuple, copy.read_copy(spark, path, "a string, b string, n long, f boolean").collect())) == sorted(rows)
    assert sorted(map(tuple, formats.read_any(spark, path, "tsv").select("a").collect())) == sorted((r[0],) for r in rows)


def test_heads_of_copy_text(spark, tmp_path):
    file = tmp_path / "one.tsv"
    file.write_text("# product x\n# rows 3\na\tb\n#1\t\\\\N\n2\t\\N\n", encoding="utf-8")
    assert sorted(map(tuple, copy.read_copy(spark, str(file), "a string, b string").collect())) == [("#1", "\\N"), ("2", None)]
    with pytest.raises(ValueError, match="3 rows and the file holds 2"):
        copy.read_copy(spark, str(file), "a string, b string", check_rows=True)
    assert copy.read_copy(spark, str(file), "a string NOT NULL, b string, later long").count() == 2  # a column that the file has not yet
    for schema in ("a string, c string", "b string, a string", "a string, b string, later long NOT NULL"):
        with pytest.raises(Exception, match="expected"):
            copy.read_copy(spark, str(file), schema).collect()
    file.write_text("a\tb\n1\t2\t3\n", encoding="utf-8")
    with pytest.raises(Exception, match="3 fields where 2"):
        copy.read_copy(spark, str(file), "a string, b string").collect()


def test_copy_text_in_many_blocks(spark, tmp_path):
    path = str(tmp_path / "big.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("# head\nk\tt\n" + "".join(f"{k}\t#{'x' * 50}\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = copy.read_copy(spark, path, "k long, t string")
        assert got.rdd.getNumPartitions() > 5 and got.agg(F.count("*"), F.sum("k")).first()[:] == (20_000, 199_990_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_conversion_infers_types(spark, tmp_path):
    formats.write_any(spark.createDataFrame([("1", "t", "x"), ("-7", None, "2")], "n string, f string, s string"), str(tmp_path / "a"), "tsv")
    formats.convert(spark, str(tmp_path / "a"), "tsv", str(tmp_path / "b"), "parquet", inferred=True)
    got = spark.read.parquet(str(tmp_path / "b"))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "boolean", "string"] and sorted(map(tuple, got.collect()), key=str) == [(-7, None, "2"), (1, True, "x")]
    assert formats.check_schema(got, spark.createDataFrame([], "n int, f boolean, s string").schema) == ["column 0: n is bigint, expected int"]


def test_osis_verses_without_end_milestones():
    text = '<osis><chapter><verse sID="Gen.1.1" osisID="Gen.1.1"/>one <verse sID="Gen.1.2" osisID="Gen.1.2"/>two<verse eID="Gen.1.2"/><verse osisID="Gen.1.3">three</verse><verse sID="Gen.1.4"/>four</chapter></osis>'
    assert list(texts.osis(text)) == [("Gen", 1, "1", "one"), ("Gen", 1, "2", "two"), ("Gen", 1, "3", "three"), ("Gen", 1, "4", "four")]


def test_parts_with_null_keys_move(spark):
    stood = spark.createDataFrame([(None, 1, "old"), ("a", 1, "same"), ("b", 2, "gone")], "text string, pair int, v string")
    now = spark.createDataFrame([(None, 1, "new"), ("a", 1, "same"), (None, 3, "fresh")], "text string, pair int, v string")
    moved = build.parts_moved(build.digest(stood, ["text", "pair"]), build.digest(now, ["text", "pair"]), ["text", "pair"])
    assert sorted(map(tuple, moved.collect()), key=str) == [("b", 2, "gone"), (None, 1, "moved"), (None, 3, "new")]
    assert sorted(map(tuple, build.apply_moved(stood, now, moved, ["text", "pair"]).collect()), key=str) == sorted(map(tuple, now.collect()), key=str)


def test_null_values_equal_themselves(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, None, 2), (None, "x", 3), (None, None, None)], "key long, value string, id long")
    assert quality.keyed_comparison(rows, rows).count() == 0
    other = spark.createDataFrame([(1, None, 1), (1, "y", 2), (None, "x", 4), (None, None, None)], "key long, value string, id long")
    assert sorted(map(tuple, quality.keyed_comparison(rows, other).collect()), key=str) == [(1, "changed", None, "y"), (None, "id-only", "x", "x")]


def test_comparisons_gathered_equal_one(spark):
    schema = "scope string, group string, key string, value string, id long"
    kjv = [("K", "strong", k, v, 1) for k, v in (("a", "x"), ("b", "y"), ("c", "z"))], [("K", "strong", k, v, 1) for k, v in (("a", "x"), ("b", "w"), ("d", "z"))]
    web = [("W", "strong", "a", "x", 1), ("W", "strong", "e", "y", 1)], [("W", "strong", "a", "x", 2), ("W", "weak", "e", "v", 1)]
    groups = lambda a, b: sorted(map(tuple, quality.difference_groups(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()))
    whole = groups(kjv[0] + web[0], kjv[1] + web[1])
    assert whole == sorted(groups(*kjv) + groups(*web))
    assert ("K", "strong", "changed", 1, "b  y  =>  w") in whole and ("W", "strong", "id-only", 1, "a  1 -> 2") in whole and ("W", "strong -> weak", "changed", 1, "e  y  =>  v") in whole
