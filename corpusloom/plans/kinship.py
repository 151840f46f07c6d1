"""Queries over family graphs; customers stand in for people, arithmetic on their keys for who is whose parent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..operators import graph, kin
from .registry import long, n, query

#: Every person has a parent of each sex among the smaller keys, stated from the child for odd keys and from the parent for even ones.
_PARENT = "(SELECT DISTINCT c_custkey // 3 + c_custkey % 2 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 3 UNION SELECT DISTINCT c_custkey // 4 + 1, c_custkey FROM customer WHERE c_custkey > 3)"
_SEX = "(SELECT c_custkey AS person, CASE c_nationkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS sex FROM customer)"


def _relations(t):
    c = t("customer").filter("c_custkey > 3").select("c_custkey", F.explode(F.array(F.expr("c_custkey div 3 + c_custkey % 2"), F.expr("c_custkey div 4 + 1"))).alias("parent"))
    odd = F.col("c_custkey") % 2 == 1
    return c.select(F.when(odd, F.col("c_custkey")).otherwise(F.col("parent")).alias("a"), F.when(odd, "son of").otherwise("father of").alias("type"), F.when(odd, F.col("parent")).otherwise(F.col("c_custkey")).alias("b"))


def _parents(t):
    return kin.parents(_relations(t))


def _sex(t):
    return t("customer").select(F.col("c_custkey").alias("person"), F.when(F.col("c_nationkey") % 2 == 0, "male").otherwise("female").alias("sex"))


@query(f"SELECT parent, child FROM {_PARENT}")
def kin_parents(t):
    return _parents(t)


@query(f"SELECT parent AS a, 'father of' AS type, child AS b, CASE WHEN child // 3 + child % 2 = child // 4 + 1 THEN 2 ELSE 1 END AS stated FROM {_PARENT}")
def kin_folded(t):
    return kin.folded(_relations(t), {"son of": "father of"}).withColumn("stated", F.col("stated").cast("int"))


@query(f"SELECT x.child AS a, y.child AS b, count(*) AS shared, CASE WHEN count(*) >= 2 THEN 'full' ELSE 'half' END AS kind FROM {_PARENT} x JOIN {_PARENT} y ON x.parent = y.parent AND x.child < y.child GROUP BY 1, 2")
def kin_siblings(t):
    return kin.siblings(_parents(t))


@query(f"""WITH p AS {_PARENT}, c AS (SELECT DISTINCT x.parent AS x, y.parent AS y FROM p x JOIN p y ON x.child = y.child AND x.parent <> y.parent)
SELECT DISTINCT p.parent AS a, c.y AS b FROM c JOIN p ON p.child = c.x WHERE p.parent <> c.y AND NOT EXISTS (SELECT 1 FROM p q WHERE q.parent = p.parent AND q.child = c.y)""")
def kin_in_laws(t):
    return kin.in_laws(_parents(t))


@query(f"""WITH RECURSIVE p AS {_PARENT}, r(child, ancestor, depth) AS (SELECT child, parent, 1 FROM p UNION SELECT r.child, p.parent, depth + 1 FROM r JOIN p ON p.child = r.ancestor), d AS (SELECT child, ancestor, min(depth) AS depth FROM r GROUP BY 1, 2)
SELECT ancestor AS person, CAST(depth AS BIGINT) AS depth, count(*) AS people, count(*) FILTER (WHERE sex = 'male') AS men, count(*) FILTER (WHERE sex = 'female') AS women FROM d LEFT JOIN {_SEX} s ON s.person = d.child GROUP BY 1, 2""")
def kin_descendants(t):
    return kin.descendants(_parents(t), _sex(t))


@query(f"""WITH RECURSIVE p AS {_PARENT}, m AS (SELECT p.* FROM p JOIN {_SEX} s ON s.person = p.parent WHERE sex = 'male'), r(child, ancestor) AS (SELECT child, parent FROM p UNION SELECT r.child, p.parent FROM r JOIN p ON p.child = r.ancestor)
SELECT a.child, a.parent AS first, b.parent AS second FROM m a JOIN m b ON a.child = b.child AND b.parent > a.parent WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.child = a.parent AND r.ancestor = b.parent) OR (r.child = b.parent AND r.ancestor = a.parent))""")
def kin_two_fathers(t):
    return kin.two_parents(_parents(t), _sex(t))


@query(f"""WITH p AS (SELECT * FROM {_PARENT} UNION SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey % 50 = 0), s AS (SELECT DISTINCT c_custkey AS a, c_custkey // 3 + c_custkey % 2 AS b FROM customer WHERE c_custkey % 20 = 7),
o AS (SELECT DISTINCT parent FROM p WHERE parent = child UNION SELECT DISTINCT x.parent FROM p x JOIN p y ON y.parent = x.child WHERE y.child = x.parent), m AS (SELECT p.* FROM p JOIN {_SEX} x ON person = parent WHERE sex = 'female')
SELECT 'own forebear' AS rule, count(*) AS found FROM o UNION ALL SELECT 'parent and sibling', count(*) FROM (SELECT DISTINCT least(parent, child), greatest(parent, child) FROM p WHERE EXISTS (SELECT 1 FROM s WHERE (a = parent AND b = child) OR (a = child AND b = parent)))
UNION ALL SELECT 'mother of man and child', count(*) FROM (SELECT DISTINCT m.parent, m.child AS man, g.child FROM m JOIN p g ON g.parent = m.child JOIN m k ON k.parent = m.parent AND k.child = g.child)""")
def kin_impossible(t):
    """With relations put in that no family can have."""
    c = t("customer")
    wrong = c.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("parent"), F.expr("c_custkey div 2").alias("child"))
    brothers = c.filter("c_custkey % 20 = 7").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 3 + c_custkey % 2").alias("b"))
    return kin.impossible(_parents(t).unionByName(wrong).distinct(), brothers, _sex(t))


_BLOCKS = "(SELECT c_custkey AS a, c_custkey // 25 * 25 + c_nationkey AS b FROM customer)"


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {_BLOCKS} UNION SELECT b, a FROM {_BLOCKS}), r(v, u) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT v AS vertex, dense_rank() OVER (ORDER BY m) AS component FROM (SELECT v, min(u) AS m FROM r GROUP BY 1 HAVING count(DISTINCT u) > 1)""")
def components_ordinal(t):
    """Components of all customers' edges, numbered by the order of their least members."""
    found = graph.components(t("customer").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 25 * 25 + c_nationkey").alias("b")))
    numbers = numbered(found.select("component").distinct(), ["component"], "ordinal")
    return found.join(numbers, "component").select("vertex", F.col("ordinal").alias("component"))
