"""Queries over the merge of claims: precedence, one link a shape, competition, stale rows, annotations, chained numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..session import LINE
from .registry import ALL, long, query

_METHODS = ["manual", "strong", "composed", "aligner", "stated", "evidentia", "names", "possessive", "ruling", "lexical", "model", "rule"]
_METHOD = "CASE (l_linenumber + l_suppkey) % 12 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_METHODS)) + " END"
_TIER = "CASE l_partkey % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'attached' END"
_C = "CASE WHEN l_discount > 0 THEN 10 * l_discount END"


def _rank_sql(method, c, tier, laid):
    """The precedence as its description gives it, highest first."""
    return f"""CAST(CASE WHEN {method} IN ('manual', 'ruling') THEN 100 WHEN {method} = 'stated' THEN 90 WHEN {method} = 'strong' AND {c} >= 0.9 AND NOT {laid} THEN 85 WHEN {method} = 'evidentia' AND {tier} = 'safe' THEN 80
WHEN {method} = 'evidentia' AND {tier} = 'attached' THEN 79 WHEN {method} = 'evidentia' THEN 78 WHEN {method} = 'names' THEN 77 WHEN {method} IN ('possessive', 'rule') THEN 76 WHEN {method} = 'model' THEN 65 WHEN {method} = 'composed' THEN 60
WHEN {method} = 'strong' AND {c} >= 0.9 THEN 55 WHEN {method} = 'strong' AND {c} >= 0.7 THEN 50 WHEN {method} = 'aligner' THEN 40 WHEN {method} = 'strong' THEN 30 WHEN {method} = 'lexical' THEN 20 ELSE 0 END AS BIGINT)"""


_CLAIMS = f"""(SELECT *, {_rank_sql('method', 'c', 'tier', 'laid')} AS rank FROM (SELECT *, {_METHOD} AS method, {_TIER} AS tier, l_partkey % 4 = 0 AS laid, {_C} AS c FROM lineitem))"""


def _claims(t):
    df = t("lineitem").withColumn("method", F.expr(_METHOD)).withColumn("tier", F.expr(_TIER)).withColumn("laid", F.col("l_partkey") % 4 == 0).withColumn("c", F.expr(_C))
    return df.withColumn("rank", long(merge.rank(F.col("method"), F.col("c"), F.col("tier"), F.col("laid"))))


@query(f"SELECT {ALL}, method, tier, laid, rank FROM {_CLAIMS}")
def method_precedence(t):
    """The rank of every claim."""
    return _claims(t).select(*LINE, "method", "tier", "laid", "rank")


@query(f"""WITH w AS (SELECT *, l_partkey % 3 AS a, l_suppkey % 2 AS b, CASE WHEN l_linestatus = 'F' THEN 'renders' ELSE 'equals' END AS relation FROM {_CLAIMS}),
o AS (SELECT *, row_number() OVER w AS r, first(relation) OVER w AS top, first(method) OVER w AS by_method FROM w WINDOW w AS (PARTITION BY l_orderkey, a, b ORDER BY rank DESC, coalesce(c, 2) DESC, method, l_returnflag, l_linenumber || '|' || l_partkey || '|' || l_suppkey))
SELECT {ALL}, rank, CASE WHEN r = 1 THEN 'settles' WHEN relation = top THEN 'claims' ELSE 'withdrawn:' || by_method END AS status FROM o""")
def one_link_a_shape(t):
    """What became of every claim of a shape."""
    key = F.concat_ws("|", "l_linenumber", "l_partkey", "l_suppkey")
    rows = _claims(t).select(*LINE, (F.col("l_partkey") % 3).alias("a"), (F.col("l_suppkey") % 2).alias("b"), "rank", F.col("c").alias("confidence"), "method", F.col("l_returnflag").alias("source"), F.when(F.col("l_linestatus") == "F", "renders").otherwise("equals").alias("relation"), key.alias("key"))
    return merge.one_link_a_shape(rows, ["l_orderkey", "a", "b"], "key").select(*LINE, "rank", "status")


@query()
def compete_greedy(t):
    rows = _claims(t).select(F.col("l_orderkey").alias("segment"), F.concat_ws("|", *LINE).alias("key"), (F.col("l_partkey") % 7).alias("a"), (F.col("l_suppkey") % 5).alias("b"), "rank")
    return merge.compete(rows, "segment")


def link_candidates(t):
    """Links of up to two words a side; one in eight lines states an absence."""
    words = lambda c, k: F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col(c) % k, (F.col(c) + 1) % k)).otherwise(F.array(F.col(c) % k))
    relation = F.when(F.col("l_suppkey") % 8 == 0, "omits").when(F.col("l_suppkey") % 8 == 1, "expands").otherwise("renders")
    rows = _claims(t).withColumn("relation", relation)
    return rows.select(F.col("l_orderkey").alias("segment"), F.concat_ws("|", *LINE).alias("key"), words("l_partkey", 5).alias("source"), words("l_suppkey", 4).alias("target"), "relation", long(merge.standing_rank(F.col("method"), F.col("relation"), F.col("rank"))).alias("rank"), F.col("c").alias("confidence"))


@query()
def merge_competition(t):
    """Sequential by its rule, so without SQL; tested against a plain implementation over the whole table."""
    return merge.compete_links(link_candidates(t))


@query(f"""SELECT {ALL}, CASE WHEN n.o_orderkey IS NULL THEN 'lost' WHEN md5(CAST(n.o_custkey AS VARCHAR)) <> md5(CAST(l_suppkey % 50 + o.o_custkey - o.o_custkey % 7 AS VARCHAR)) THEN 'stale' ELSE 'current' END AS status
FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') n ON n.o_orderkey = l_orderkey""")
def stale_rows(t):
    """Whether the segment that each row was made from is still as it was then."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    made = t("lineitem").select(*LINE).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = made.select(*LINE, F.col("l_orderkey").alias("segment"), F.md5((F.col("l_suppkey") % 50 + F.col("o_custkey") - F.col("o_custkey") % 7).cast("string")).alias("hash"))
    now = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("segment"), F.md5(F.col("o_custkey").cast("string")).alias("hash"))
    return merge.stale(rows, now, ["segment"]).select(*LINE, "status")


@query("""WITH r AS (SELECT l_partkey, l_suppkey, rank() OVER (PARTITION BY l_partkey ORDER BY coalesce(nullif(l_discount, 0), 2) DESC) AS r FROM lineitem)
SELECT l_partkey, CASE WHEN min(l_suppkey) = max(l_suppkey) THEN min(l_suppkey) END AS answer, count(*) AS claims FROM r WHERE r = 1 GROUP BY 1""")
def settle_claims(t):
    claims = t("lineitem").select("l_partkey", "l_suppkey", F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.lit(2.0)).alias("c"))
    return merge.settle(claims, ["l_partkey"], "l_suppkey", F.col("c").desc())


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey AS entity, l_returnflag = 'N' AS own, CAST(l_linestatus = 'F' AS INTEGER) AS standing, coalesce(nullif(l_discount, 0), 1) AS c FROM lineitem),
m AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS claims, lead(entity) OVER w AS e2, lead(own) OVER w AS o2, lead(standing) OVER w AS s2, lead(c) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY own DESC, standing DESC, c DESC, entity))
SELECT l_orderkey, l_linenumber, CASE WHEN e2 IS NULL OR own <> o2 OR standing <> s2 OR c <> c2 OR entity = e2 THEN entity END AS entity, claims FROM m WHERE r = 1""")
def annotation_settling(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entity"), (F.col("l_returnflag") == "N").alias("own"), (F.col("l_linestatus") == "F").cast("int").alias("standing"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("confidence"))
    return merge.annotate(rows, ["l_orderkey", "l_linenumber"], "entity")


_PICK = """SELECT text, word, number, hops + 1 AS hops, other_text || ' ' || other AS lender FROM (SELECT l.text, l.word, k.number, k.hops, l.other_text, l.other, row_number() OVER (PARTITION BY l.text, l.word ORDER BY CASE WHEN l.other_text = 't1' THEN 0 ELSE 1 END, coalesce(l.confidence, 1) DESC, k.hops, coalesce(carried, 0), k.number, l.other_text, l.other) AS r
FROM l JOIN w ON w.text = l.text AND w.word = l.word AND w.number IS NULL JOIN {0} k ON k.text = l.other_text AND k.word = l.other LEFT JOIN rare ON rare.text = l.other_text AND rare.number = k.number WHERE l.text = '{1}') WHERE r = 1"""


@query(f"""WITH w AS (SELECT 't' || (c_nationkey % 3 + 1) AS text, c_custkey AS word, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 11 = 0 THEN 'own' END AS number FROM customer),
l AS (SELECT DISTINCT a.text, a.word, b.text AS other_text, b.word AS other, CASE WHEN b.word % 5 = 0 THEN NULL ELSE round(1.0 / (1 + b.word % 4), 4)::DOUBLE END AS confidence FROM w a JOIN w b ON b.word IN (a.word + 1, a.word + 2, a.word + 5) WHERE a.text <> b.text),
rare AS (SELECT text, number, count(*) AS carried FROM w WHERE number IS NOT NULL GROUP BY 1, 2), k0 AS (SELECT text, word, number, 0 AS hops, NULL::VARCHAR AS lender FROM w WHERE number IS NOT NULL),
k1 AS (SELECT * FROM k0 UNION ALL {_PICK.format('k0', 't1')}), k2 AS (SELECT * FROM k1 UNION ALL {_PICK.format('k1', 't2')}), k3 AS (SELECT * FROM k2 UNION ALL {_PICK.format('k2', 't3')}) SELECT * FROM k3""")
def chained_numbers(t):
    c = t("customer")
    own = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 11 == 0, "own")
    words = c.select(F.concat(F.lit("t"), (F.col("c_nationkey") % 3 + 1).cast("string")).alias("text"), F.col("c_custkey").alias("word"), own.alias("number"))
    other = words.select(F.col("text").alias("other_text"), F.col("word").alias("other"))
    reach = words.select("text", "word", F.explode(F.array(*[F.col("word") + k for k in (1, 2, 5)])).alias("other")).join(other, "other").filter("text <> other_text")
    joined = reach.withColumn("confidence", F.when(F.col("other") % 5 != 0, F.round(1.0 / (1 + F.col("other") % 4), 4)))
    return merge.chained_numbers(words, joined, ["t1", "t2", "t3"], ["t1"])
