"""Publishing part by part: what is rewritten, keys that are null, runs that are lost."""

import glob
import os

from corpusloom.operators import publish

SCHEMA = "text string, pair int, v string"
BY = ["text", "pair"]


def test_only_moved_parts_are_written_and_lost_runs_leave_the_state_before(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(None, 1, "old"), ("a", 1, "same"), ("a", 1, "same"), ("a", None, None), ("b", 2, "gone")]
    then = [(None, 1, "new"), ("a", 1, "same"), ("a", 1, "same"), ("a", None, None), (None, None, "fresh")]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    rows = lambda: sorted((tuple(r)[:3] for r in publish.published(spark, path).collect()), key=str)
    assert {r.state for r in publish.publish(frame(first), path, BY).collect()} == {"new"} and rows() == sorted(first, key=str)
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}
    moved = publish.publish(frame(then), path, BY)
    assert sorted(map(tuple, moved.collect()), key=str) == [("b", 2, "gone"), (None, 1, "moved"), (None, None, "new")]
    assert rows() == sorted(then, key=str) and all(os.stat(f).st_mtime_ns == at for f, at in files.items())
    assert sorted((tuple(r)[:3] for r in publish.published(spark, path).filter("run = 2").collect()), key=str) == [(None, 1, "new"), (None, None, "fresh")]
    # a run that wrote data and part of a manifest before it was lost
    spark.createDataFrame([("z", 9, "half", "x")], f"{SCHEMA}, part string").write.partitionBy("part").parquet(f"{path}/data/run=3")
    os.makedirs(f"{path}/manifest/run=3")
    assert rows() == sorted(then, key=str)
    assert publish.publish(frame(then), path, BY).count() == 0 and rows() == sorted(then, key=str) and publish.runs(spark, path) == (4, 4)
    assert "data/run=3" in publish.swept(spark, path) and rows() == sorted(then, key=str)
    publish.publish(frame(first[:1]), path, BY)
    assert rows() == first[:1]
