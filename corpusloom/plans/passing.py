"""Queries over the merge's passes: rows made from line items, rulings from orders; one query a pass, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passes
from ..session import LINE, by_segment
from .merging import _METHOD
from .registry import query

_KEY = "l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey"
_RELATION = "CASE WHEN l_suppkey % 8 = 0 THEN 'omits' WHEN l_suppkey % 8 = 1 THEN 'expands' ELSE 'renders' END"
_TWO = "l_linenumber % 2 = 0"
_SOURCE = f"CASE WHEN {_RELATION} = 'omits' THEN [] WHEN {_TWO} AND l_partkey % 5 < 4 THEN [l_orderkey * 10 + l_partkey % 5, l_orderkey * 10 + l_partkey % 5 + 1] ELSE [l_orderkey * 10 + l_partkey % 5] END"
_TARGET = f"CASE WHEN {_RELATION} = 'expands' THEN [] WHEN {_TWO} AND l_suppkey % 4 < 3 THEN [l_orderkey * 10 + l_suppkey % 4, l_orderkey * 10 + l_suppkey % 4 + 1] ELSE [l_orderkey * 10 + l_suppkey % 4] END"
_ROWS = f"""e0 AS MATERIALIZED (SELECT min({_KEY}) AS key, l_orderkey % 3 AS pair, {_METHOD} AS method, l_returnflag AS source, {_RELATION} AS relation, max(CASE WHEN l_discount > 0 THEN 10 * l_discount END) AS confidence, CASE l_partkey % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'attached' END AS tier,
max(l_partkey % 4) AS run, bool_and(l_partkey % 6 = 0) AS support, min(l_partkey % 4) = 0 AS laid, l_orderkey % 20 AS book, {_SOURCE} AS source_words, {_TARGET} AS target_words, CAST(NULL AS VARCHAR) AS status FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag)"""
_RULINGS = """u AS MATERIALIZED (SELECT o_orderkey % 3 AS pair, CASE WHEN o_custkey % 3 = 2 THEN 'accept' ELSE 'refuse' END AS action, CASE WHEN o_custkey % 7 = 1 THEN [] ELSE [o_orderkey * 10 + o_custkey % 5] END AS source_words,
CASE WHEN o_custkey % 7 = 2 THEN [] ELSE [o_orderkey * 10 + o_custkey % 4] END AS target_words, CASE WHEN o_custkey % 2 = 0 OR o_custkey % 7 IN (1, 2) THEN CASE o_custkey % 3 WHEN 0 THEN 'R' ELSE 'N' END END AS source, CASE WHEN o_custkey % 11 = 0 THEN 'renders' END AS relation FROM orders
WHERE o_custkey % 3 < 2 OR o_custkey % 7 NOT IN (1, 2))"""
_STANDS = "status IS NULL"
_SHAPE = "pair || '|' || array_to_string(source_words, ' ') || '|' || array_to_string(target_words, ' ')"
_SHOWN = "key, method, relation, array_to_string(source_words, ' ') AS source_words, array_to_string(target_words, ' ') AS target_words, status"


def rows_of(t, parts=None):
    """A row for each distinct line: links of up to two words a side, absences, verdicts with runs, laid numbers."""
    lines = t("lineitem").select(*LINE, "l_returnflag", "l_discount")
    lines = lines.repartition(parts, "l_orderkey") if parts else lines  # an order's rows are then made where they stay
    made = lines.withColumn("relation", F.expr(_RELATION)).withColumn("method", F.expr(_METHOD)).withColumn("tier", F.expr("CASE l_partkey % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'attached' END"))
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "method", "relation", "tier"]
    one = made.groupBy(*by).agg(F.max(F.when(F.col("l_discount") > 0, 10 * F.col("l_discount"))).alias("confidence"))

    def words(column, k, bare):
        at = F.col("l_orderkey") * 10 + F.col(column) % k
        two = (F.col("l_linenumber") % 2 == 0) & (F.col(column) % k < k - 1)
        return F.when(F.col("relation") == bare, F.array().cast("array<long>")).when(two, F.array(at, at + 1)).otherwise(F.array(at))

    return one.select(
        F.col("l_orderkey").alias("segment"), F.concat_ws("|", *LINE).alias("key"), (F.col("l_orderkey") % 3).alias("pair"), "method", F.col("l_returnflag").alias("source"), "relation", "confidence", "tier", (F.col("l_partkey") % 4).alias("run"),
        (F.col("l_partkey") % 6 == 0).alias("support"), (F.col("l_partkey") % 4 == 0).alias("laid"), (F.col("l_orderkey") % 20).alias("book"), words("l_partkey", 5, "omits").alias("source_words"), words("l_suppkey", 4, "expands").alias("target_words"), F.lit(None).cast("string").alias("status"))


def rulings_of(t):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    none = F.array().cast("array<long>")
    rows = t("orders").filter((k % 3 < 2) | ~(k % 7).isin(1, 2))
    source = F.when((k % 2 == 0) | (k % 7).isin(1, 2), F.when(k % 3 == 0, "R").otherwise("N"))
    return rows.select(o.alias("segment"), (o % 3).alias("pair"), F.when(k % 3 == 2, "accept").otherwise("refuse").alias("action"), F.when(k % 7 == 1, none).otherwise(F.array(o * 10 + k % 5)).alias("source_words"), F.when(k % 7 == 2, none).otherwise(F.array(o * 10 + k % 4)).alias("target_words"), source.alias("source"), F.when(k % 11 == 0, "renders").alias("relation"))


def _shown(rows, *more):
    text = lambda c: F.array_join(F.transform(c, lambda w: w.cast("string")), " ").alias(c)
    return rows.select("key", "method", "relation", text("source_words"), text("target_words"), "status", *more)


def _passed(t, passed, *more):
    """What passed(rows, rulings, keep) gives of all rows and rulings, which are dealt by order and stay so."""
    lines = t("lineitem")
    with by_segment(lines.sparkSession, lines.count()) as dealt:
        rows, rulings = dealt.keep(rows_of(t, dealt.buckets), "merge-rows"), dealt.keep(rulings_of(t), "merge-rulings")
        return dealt.result(_shown(passed(rows, rulings, dealt.keep), *more), "merge")


def _without_sql(name, rows, lost, refused, narrowed, suffix):
    """CTE name: rows that words were taken from (lost: key, side, word)."""
    return f"""{name}_l AS MATERIALIZED (SELECT key, coalesce(list(DISTINCT word) FILTER (WHERE side = 'source'), []) AS sl, coalesce(list(DISTINCT word) FILTER (WHERE side = 'target'), []) AS tl FROM ({lost}) GROUP BY key),
{name}_n AS MATERIALIZED (SELECT r.*, list_filter(source_words, lambda w: NOT list_contains(coalesce(sl, []), w)) AS s2, list_filter(target_words, lambda w: NOT list_contains(coalesce(tl, []), w)) AS t2 FROM {rows} r LEFT JOIN {name}_l USING (key)),
{name}_m AS MATERIALIZED (SELECT *, {_STANDS} AND (len(s2) < len(source_words) OR len(t2) < len(target_words)) AS less, (len(s2) = 0 AND len(source_words) > 0) OR (len(t2) = 0 AND len(target_words) > 0) AS bare FROM {name}_n),
{name} AS MATERIALIZED (SELECT * EXCLUDE (s2, t2, less, bare) REPLACE (CASE WHEN less AND bare THEN '{refused}' WHEN less THEN '{narrowed}' ELSE status END AS status) FROM {name}_m
UNION ALL SELECT * EXCLUDE (s2, t2, less, bare) REPLACE (key || '{suffix}' AS key, s2 AS source_words, t2 AS target_words, CAST(NULL AS VARCHAR) AS status) FROM {name}_m WHERE less AND NOT bare)"""


_FITS = "(coalesce(u.source, '') = '' OR starts_with(e.source, u.source)) AND (coalesce(u.relation, '') = '' OR e.relation = u.relation)"
_REFUSED = f"""e1 AS MATERIALIZED (SELECT e.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.action = 'refuse' AND u.pair = e.pair AND u.source_words = e.source_words AND u.target_words = e.target_words AND len(u.source_words) > 0 AND len(u.target_words) > 0 AND {_FITS}) THEN 'refused-by ruling' END AS status) FROM e0 e), """ + _without_sql("e2", "e1", f"""
SELECT e.key, 'source' AS side, word FROM (SELECT *, unnest(source_words) AS word FROM e1 WHERE {_STANDS}) e JOIN u ON u.pair = e.pair AND u.action = 'refuse' AND len(u.target_words) = 0 AND list_contains(u.source_words, e.word) AND {_FITS}
UNION ALL SELECT e.key, 'target', word FROM (SELECT *, unnest(target_words) AS word FROM e1 WHERE {_STANDS}) e JOIN u ON u.pair = e.pair AND u.action = 'refuse' AND len(u.source_words) = 0 AND list_contains(u.target_words, e.word) AND {_FITS}""", "refused-by ruling", "narrowed-by ruling", "/ruling")
_SUPERSEDED = f"""v AS MATERIALIZED (SELECT pair, coalesce(tier, '') AS tier, book, max(run) AS newest FROM e2 WHERE {_STANDS} AND method = 'evidentia' GROUP BY ALL),
e3 AS MATERIALIZED (SELECT e.* REPLACE (CASE WHEN {_STANDS} AND method = 'evidentia' AND run < newest THEN 'superseded-by run ' || newest ELSE status END AS status) FROM e2 e LEFT JOIN v ON v.pair = e.pair AND v.tier = coalesce(e.tier, '') AND v.book = e.book)"""
_ACCEPTED = f"acc AS MATERIALIZED (SELECT DISTINCT {_SHAPE} AS shape FROM u WHERE action = 'accept')"
_PINNED = f"""{_ACCEPTED}, e4 AS MATERIALIZED (SELECT * FROM e3 UNION ALL BY NAME SELECT DISTINCT ON (key) 'ruling:' || {_SHAPE} AS key, pair, 'ruling' AS method, 'a ruling' AS source, 'renders' AS relation, false AS support, false AS laid, source_words, target_words FROM u
WHERE action = 'accept' AND {_SHAPE} NOT IN (SELECT {_SHAPE} FROM e3 WHERE {_STANDS}))"""
_NARROWED = f"""ab AS MATERIALIZED (SELECT DISTINCT pair, 'target' AS side, unnest(target_words) AS word FROM e4 WHERE {_STANDS} AND method = 'evidentia' AND relation = 'omits' UNION SELECT DISTINCT pair, 'source', unnest(source_words) FROM e4 WHERE {_STANDS} AND method = 'evidentia' AND relation = 'expands'),
la AS MATERIALIZED (SELECT * FROM e4 WHERE {_STANDS} AND method = 'strong' AND laid AND relation = 'renders' AND {_SHAPE} NOT IN (SELECT shape FROM acc)), """ + _without_sql("e5", "e4", """
SELECT key, side, word FROM (SELECT key, pair, 'source' AS side, unnest(source_words) AS word FROM la UNION ALL SELECT key, pair, 'target', unnest(target_words) FROM la) JOIN ab USING (pair, side, word)""", "withdrawn-by evidentia", "narrowed-by evidentia", "/evidentia")
_RANK = """CASE WHEN method IN ('manual', 'ruling') THEN 100 WHEN method = 'stated' THEN 90 WHEN method = 'strong' AND coalesce(confidence, 0) >= 0.9 AND NOT laid THEN 85 WHEN method = 'evidentia' THEN CASE tier WHEN 'safe' THEN 80 WHEN 'attached' THEN 79 ELSE 78 END WHEN method = 'names' THEN 77
WHEN method IN ('possessive', 'rule') THEN 76 WHEN method = 'model' THEN 65 WHEN method = 'composed' THEN 60 WHEN method = 'strong' AND coalesce(confidence, 0) >= 0.9 THEN 55 WHEN method = 'strong' AND coalesce(confidence, 0) >= 0.7 THEN 50 WHEN method = 'aligner' THEN 40 WHEN method = 'strong' THEN 30 WHEN method = 'lexical' THEN 20 ELSE 0 END"""
_SHAPED = f"""e6 AS MATERIALIZED (SELECT *, first(relation) OVER w AS top_relation, first(method) OVER w AS top_method, first(rank) OVER w AS top_rank, row_number() OVER w = 1 AS heads FROM (SELECT *, {_SHAPE} AS shape, CAST({_RANK} AS BIGINT) AS rank FROM e5)
WINDOW w AS (PARTITION BY shape, {_STANDS} ORDER BY rank DESC, coalesce(confidence, 2) DESC, method, source, key)),
e7 AS MATERIALIZED (SELECT * EXCLUDE (top_relation, top_method, top_rank, heads) REPLACE (CASE WHEN {_STANDS} AND relation <> top_relation THEN 'withdrawn-by ' || top_method ELSE status END AS status), {_STANDS} AND heads AS settles, shape IN (SELECT shape FROM acc) AS pinned,
CAST(CASE WHEN shape IN (SELECT shape FROM acc) THEN 1000 WHEN top_relation IN ('omits', 'expands') AND top_method IN ('stated', 'manual', 'ruling') THEN greatest(95, top_rank) WHEN top_relation IN ('omits', 'expands') AND top_method = 'evidentia' THEN 41 ELSE top_rank END AS BIGINT) AS link_rank FROM e6)"""
_UNSUPPORTED = f"e8 AS MATERIALIZED (SELECT e.* REPLACE (CASE WHEN {_STANDS} AND shape IN (SELECT shape FROM e7 WHERE {_STANDS} GROUP BY shape HAVING bool_and(support) AND NOT bool_or(pinned)) THEN 'unsupported' ELSE status END AS status) FROM e7 e)"
_WAY = f"""cl AS MATERIALIZED (SELECT * FROM e8 WHERE {_STANDS} AND settles AND shape IN (SELECT shape FROM e8 WHERE {_STANDS} AND relation = 'renders' GROUP BY shape HAVING NOT bool_and(method = 'aligner'))),
ct AS MATERIALIZED (SELECT pair, 'omits' AS relation, unnest(target_words) AS word FROM cl UNION SELECT pair, 'expands', unnest(source_words) FROM cl),
e9 AS MATERIALIZED (SELECT e.* REPLACE (CASE WHEN {_STANDS} AND shape IN (SELECT shape FROM (SELECT shape, pair, relation, unnest(CASE relation WHEN 'omits' THEN target_words ELSE source_words END) AS word FROM e8 WHERE {_STANDS} AND settles AND method = 'evidentia' AND relation <> 'renders' AND NOT pinned) JOIN ct USING (pair, relation, word)) THEN 0 ELSE link_rank END AS link_rank) FROM e8 e)"""
_ALL = [_ROWS, _RULINGS, _REFUSED, _SUPERSEDED, _PINNED, _NARROWED, _SHAPED, _UNSUPPORTED, _WAY]


def _upto(k, select):
    return f"WITH {', '.join(_ALL[:k])} {select}"


@query(_upto(3, f"SELECT {_SHOWN} FROM e2"))
def merge_refused(t):
    """Shapes and words that rulings refuse."""
    return _passed(t, lambda rows, rulings, _: passes.refused(rows, rulings))


@query(_upto(4, f"SELECT {_SHOWN} FROM e3"))
def merge_superseded(t):
    """Verdicts that a newer run replaces in its books and tiers."""
    return _passed(t, lambda rows, rulings, keep: passes.superseded(keep(passes.refused(rows, rulings))))


def _pinned(rows, rulings, keep):
    return passes.pinned(passes.superseded(keep(passes.refused(rows, rulings))), rulings)


@query(_upto(5, f"SELECT {_SHOWN} FROM e4"))
def merge_pinned(t):
    """Accepted shapes that no standing row proposes."""
    return _passed(t, _pinned)


@query(_upto(6, f"SELECT {_SHOWN} FROM e5"))
def merge_narrowed(t):
    """Laid numbers without the words that verdicts call absent."""
    return _passed(t, lambda rows, rulings, keep: passes.narrowed(keep(_pinned(rows, rulings, keep)), rulings))


@query(_upto(9, f"SELECT {_SHOWN}, rank, link_rank, settles FROM e9"))
def merge_decided(t):
    """All passes before the competition: rows, their statuses and the rank of their links."""
    return _passed(t, lambda rows, rulings, keep: passes.decided(rows, rulings, keep=keep), "rank", "link_rank", "settles")


@query("WITH e0 AS (SELECT l_returnflag || l_linestatus AS source, min(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS key, max(CASE WHEN l_discount > 0 THEN 10 * l_discount END) AS confidence, CASE WHEN l_suppkey % 2 = 0 THEN 'composed' ELSE 'aligner' END AS method FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus), f(source, least) AS (VALUES ('RF', 0.35::DOUBLE), ('NO', 0.6::DOUBLE)) SELECT key, CASE WHEN method = 'composed' AND confidence < least THEN 'under-floor ' || least END AS status FROM e0 LEFT JOIN f USING (source)")
def merge_floors(t):
    """Composed rows under the floor set by hand for their readings."""
    rows = t("lineitem").groupBy(*LINE, "l_returnflag", "l_linestatus").agg(F.max(F.when(F.col("l_discount") > 0, 10 * F.col("l_discount"))).alias("confidence"))
    rows = rows.select(F.concat_ws("|", *LINE).alias("key"), F.concat("l_returnflag", "l_linestatus").alias("source"), F.when(F.col("l_suppkey") % 2 == 0, "composed").otherwise("aligner").alias("method"), "confidence", F.lit(None).cast("string").alias("status"))
    floors = t("lineitem").sparkSession.createDataFrame([("RF", 0.35), ("NO", 0.6)], "source string, least double")
    return passes.floored(rows, floors).select("key", "status")


_CROSS = f"""c0 AS MATERIALIZED (SELECT min({_KEY}) AS key, {_METHOD} AS method, 'renders' AS relation, CAST(NULL AS VARCHAR) AS status, [l_partkey] AS source_words, [l_suppkey] AS target_words, l_partkey || '>' || l_suppkey AS shape FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
mc AS (SELECT shape FROM c0 GROUP BY shape HAVING bool_and(method IN ('aligner', 'composed'))), j AS (SELECT DISTINCT ps.p_partkey % 40 AS v, 1000 + s_suppkey % 40 AS o FROM part ps, supplier WHERE ps.p_partkey % 7 = s_suppkey % 7 AND s_suppkey % 2 = 0)"""


@query(f"""WITH {_CROSS} SELECT key, CASE WHEN shape IN (SELECT shape FROM mc) AND source_words[1] % 9 > 0 AND source_words[1] % 13 <> target_words[1] % 13 AND NOT EXISTS (SELECT 1 FROM j WHERE v = source_words[1] % 40 AND o = 1000 + target_words[1] % 40) THEN 'withdrawn-by unjoined-verses' END AS status FROM c0""")
def merge_crossing(t):
    """Machine links between verses that no verse link joins; every ninth part has no address."""
    rows = t("lineitem").withColumn("method", F.expr(_METHOD)).groupBy(*LINE, "method").agg(F.count("*").alias("n"))
    rows = rows.select(F.concat_ws("|", *LINE).alias("key"), "method", F.lit("renders").alias("relation"), F.lit(None).cast("string").alias("status"), F.array("l_partkey").alias("source_words"), F.array("l_suppkey").alias("target_words"), F.concat_ws(">", "l_partkey", "l_suppkey").alias("shape"), F.lit(True).alias("settles"))
    p, s = t("part").select("p_partkey"), t("supplier").select("s_suppkey")
    verse_of = p.select(F.lit("source").alias("side"), F.col("p_partkey").alias("word"), (F.col("p_partkey") % 40).alias("verse"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_partkey") % 13).alias("address"))
    verse_of = verse_of.unionByName(s.select(F.lit("target").alias("side"), F.col("s_suppkey").alias("word"), (1000 + F.col("s_suppkey") % 40).alias("verse"), (F.col("s_suppkey") % 13).alias("address")))
    a = p.select((F.col("p_partkey") % 7).alias("k"), (F.col("p_partkey") % 40).alias("verse")).distinct()
    b = s.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") % 7).alias("k"), (1000 + F.col("s_suppkey") % 40).alias("other")).distinct()
    return passes.crossing(rows, verse_of, a.join(b, "k").select("verse", "other").distinct()).select("key", "status")


@query()
def merge_against(t):
    """Absences and renderings of two pairs the other way round; sequential by rank, so tested against a plain loop over a whole table."""
    return passes.against(contests_of(t, F.col("l_orderkey").alias("segment")))


def contests_of(t, *more):
    """A link for each distinct line: its two words by part and supplier within the order."""
    rows = t("lineitem").withColumn("method", F.expr(_METHOD)).select(*LINE, "method").distinct()
    word = lambda c, k: F.col("l_orderkey") * 100 + F.col(c) % k
    return rows.select(F.concat_ws("|", *LINE).alias("link"), F.when(F.col("l_linenumber") % 2 == 0, "a-b").otherwise("b-a").alias("pair"), "method", (F.col("l_suppkey") % 3 == 0).alias("absence"), (F.col("l_partkey") % 5).alias("rank"), F.array_distinct(F.array(word("l_partkey", 4), word("l_suppkey", 6))).alias("words"), *more)
