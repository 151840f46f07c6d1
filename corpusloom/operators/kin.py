"""Family relations: directions folded, siblings, in-laws, descendants, and what no family can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Relations that state parenthood: from the child, and from the parent (fixed values).
OF_CHILD, OF_PARENT = ["son of", "daughter of"], ["father of", "mother of"]


def parents(relations: DataFrame) -> DataFrame:
    """parent, child of relations (a, type, b) that are stated from either end; each pair once."""
    up = relations.filter(F.col("type").isin(OF_CHILD)).select(F.col("b").alias("parent"), F.col("a").alias("child"))
    down = relations.filter(F.col("type").isin(OF_PARENT)).select(F.col("a").alias("parent"), F.col("b").alias("child"))
    return up.unionByName(down).distinct()


def folded(relations: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """One row for each relation, from its first end by name of the type: rows that say the same from the other end are counted with it."""
    turn = F.col("type").isin(list(inverse))
    names = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    rows = relations.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.get(F.array(names[F.col("type")]), F.lit(0))).otherwise(F.col("type")).alias("type"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
    return rows.groupBy("a", "type", "b").agg(F.count("*").alias("stated"))


def siblings(parent: DataFrame) -> DataFrame:
    """a < b who share a parent, with the number shared: full siblings share two."""
    return parent.withColumnRenamed("child", "a").join(parent.withColumnRenamed("child", "b"), "parent").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).withColumn("kind", F.when(F.col("shared") >= 2, "full").otherwise("half"))


def in_laws(parent: DataFrame) -> DataFrame:
    """a, b: a parent of one of two people who have a child together, and the other of them; parents of both are none."""
    couples = parent.withColumnRenamed("parent", "x").join(parent.withColumnRenamed("parent", "y"), "child").filter("x <> y").select("x", "y").distinct()
    found = couples.join(parent.withColumnRenamed("child", "x").withColumnRenamed("parent", "a"), "x").select("a", F.col("y").alias("b")).distinct()
    return found.join(parent.select(F.col("parent").alias("a"), F.col("child").alias("b")), ["a", "b"], "left_anti").filter("a <> b")


def descendants(parent: DataFrame, sex: DataFrame) -> DataFrame:
    """person, depth, people, men, women: descendants of each person by the least depth at which they stand. sex: person, sex."""
    reach = graph.closure(parent.select("child", "parent"))
    of = reach.join(sex.withColumnRenamed("person", "child"), "child", "left")
    return of.groupBy(F.col("ancestor").alias("person"), "depth").agg(F.count("*").alias("people"), F.count_if(F.col("sex") == "male").alias("men"), F.count_if(F.col("sex") == "female").alias("women"))


def two_parents(parent: DataFrame, sex: DataFrame, which: str = "male") -> DataFrame:
    """child, first, second: two parents of one sex, neither the other's forebear."""
    own = parent.join(sex.filter(F.col("sex") == which).select(F.col("person").alias("parent")), "parent", "left_semi")
    pairs = own.withColumnRenamed("parent", "first").join(own.withColumnRenamed("parent", "second"), "child").filter("second > first")
    line = graph.closure(parent.select("child", "parent")).select("child", "ancestor")
    one_way = line.select(F.col("child").alias("first"), F.col("ancestor").alias("second"))
    other = line.select(F.col("ancestor").alias("first"), F.col("child").alias("second"))
    return pairs.join(one_way, ["first", "second"], "left_anti").join(other, ["first", "second"], "left_anti").select("child", "first", "second")


def impossible(parent: DataFrame, sibling: DataFrame, sex: DataFrame) -> DataFrame:
    """rule, found: own forebears within two steps, parents and siblings at once, mothers of a man and of his child. sibling: a, b."""
    up = parent.select(F.col("parent").alias("p"), F.col("child").alias("c"))
    two = up.alias("x").join(up.alias("y"), F.col("x.c") == F.col("y.p")).select(F.col("x.p").alias("p"), F.col("y.c").alias("c"))
    own = up.unionByName(two).filter("p = c").select("p").distinct()
    both = sibling.select("a", "b").unionByName(sibling.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at_once = up.join(both, (F.col("p") == F.col("a")) & (F.col("c") == F.col("b")), "left_semi").select(F.least("p", "c"), F.greatest("p", "c")).distinct()
    women = sex.filter("sex = 'female'").select(F.col("person").alias("p"))
    mother = up.join(women, "p", "left_semi")
    grand = mother.alias("m").join(up.alias("g"), F.col("m.c") == F.col("g.p")).select(F.col("m.p").alias("p"), F.col("m.c").alias("man"), F.col("g.c").alias("c"))
    thrice = grand.join(mother, ["p", "c"], "left_semi").distinct()
    rule = lambda name, df: df.agg(F.count("*").alias("found")).select(F.lit(name).alias("rule"), "found")
    return rule("own forebear", own).unionByName(rule("parent and sibling", at_once)).unionByName(rule("mother of man and child", thrice))
