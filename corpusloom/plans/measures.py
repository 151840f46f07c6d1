"""Queries over quality measures, integrity, differences of texts, indexes and incremental building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.numbering import numbered
from ..operators import build, differences, publish, timeline
from ..session import scratch
from .registry import long, n, query

c = F.col


# -- measures


@query("""SELECT o_custkey % 40 AS book, o_orderpriority AS text, count(*) AS words, count(*) FILTER (WHERE l_discount = 0) AS claimed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
HAVING count(*) >= 20 AND count(*) FILTER (WHERE l_discount = 0) < 0.08 * count(*)""")
def unaligned_books(t):
    j = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(t("lineitem").select("l_orderkey", "l_discount"), c("o_orderkey") == c("l_orderkey"))
    per = j.groupBy((c("o_custkey") % 40).alias("book"), c("o_orderpriority").alias("text")).agg(n().alias("words"), F.count_if(c("l_discount") == 0).alias("claimed"))
    return per.filter("words >= 20 AND claimed < 0.08 * words")


@query("""WITH s AS (SELECT l_returnflag AS a, l_linestatus AS b, l_orderkey AS verse, avg(l_discount) AS mean, count(*) AS links FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2, 3)
SELECT a, b, count(*) AS verses, count(*) FILTER (WHERE links >= 3 AND mean < 0.04) AS weak, array_to_string(list(verse ORDER BY round(mean, 9), verse) FILTER (WHERE links >= 3 AND mean < 0.04)[1:3], ',') AS worst FROM s GROUP BY 1, 2""")
def pairing(t):
    # a sum of doubles depends on its order: discounts are added in the order of the files' rows, as the SQL does on one thread, however rows are split over tasks
    at = F.struct(c("_metadata.file_path").alias("file"), c("_metadata.row_index").alias("row"), c("l_discount").alias("x"))
    rows = t("lineitem").filter("l_discount > 0").select(c("l_returnflag").alias("a"), c("l_linestatus").alias("b"), c("l_orderkey").alias("verse"), at.alias("at"))
    s = rows.groupBy("a", "b", "verse").agg(F.sort_array(F.collect_list("at")).alias("all"), n().alias("links"))
    s = s.select("a", "b", "verse", "links", (F.aggregate("all", F.lit(0.0), lambda total, r: total + r["x"]) / c("links")).alias("mean"))
    weak = (c("links") >= 3) & (c("mean") < 0.04)
    # the worst three by a bounded window, not by gathering all weak ones
    marked = s.withColumn("place", F.row_number().over(Window.partitionBy("a", "b", weak).orderBy(F.round("mean", 9), "verse")))
    few = F.sort_array(F.collect_list(F.when(weak & (c("place") <= 3), F.struct("place", "verse"))))
    out = marked.groupBy("a", "b").agg(n().alias("verses"), F.count_if(weak).alias("weak"), few.alias("few"))
    return out.select("a", "b", "verses", "weak", F.when(F.size("few") > 0, F.array_join(F.transform("few", lambda x: x["verse"].cast("string")), ",")).alias("worst"))


@query("""SELECT o_orderpriority AS text, count(*) FILTER (WHERE l_returnflag = 'R') AS omits, count(*) FILTER (WHERE l_returnflag = 'A') AS expands, count(DISTINCT o_orderkey) FILTER (WHERE l_returnflag <> 'N') AS segments FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def absence(t):
    j = t("orders").select("o_orderkey", "o_orderpriority").join(t("lineitem").select("l_orderkey", "l_returnflag"), c("o_orderkey") == c("l_orderkey"))
    return j.groupBy(c("o_orderpriority").alias("text")).agg(F.count_if(c("l_returnflag") == "R").alias("omits"), F.count_if(c("l_returnflag") == "A").alias("expands"), F.countDistinct(F.when(c("l_returnflag") != "N", c("o_orderkey"))).alias("segments"))


@query("""WITH v AS (SELECT l_partkey, s_nationkey, l_returnflag AS answer, count(*) AS votes FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3), e AS (SELECT l_partkey, s_nationkey, answer FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, s_nationkey ORDER BY votes DESC, answer) AS r FROM v) WHERE r = 1),
m AS (SELECT l_partkey, answer, count(*) AS k, sum(count(*)) OVER (PARTITION BY l_partkey) AS total FROM e GROUP BY 1, 2)
SELECT l_partkey, max(k) AS most, CAST(any_value(total) AS BIGINT) AS editions, CASE WHEN 2 * max(k) > any_value(total) THEN arg_max(answer, k) END AS answer FROM m GROUP BY 1""")
def vote_of_editions(t):
    """Each edition (nation) has one vote for a word, its commonest answer; more than half of the editions decide."""
    j = t("lineitem").select("l_partkey", "l_suppkey", c("l_returnflag").alias("answer")).join(t("supplier").select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
    votes = j.groupBy("l_partkey", "s_nationkey", "answer").agg(n().alias("votes"))
    own = votes.withColumn("r", F.row_number().over(Window.partitionBy("l_partkey", "s_nationkey").orderBy(c("votes").desc(), "answer"))).filter("r = 1")
    per = own.groupBy("l_partkey", "answer").agg(n().alias("k"))
    out = per.groupBy("l_partkey").agg(F.max("k").alias("most"), F.sum("k").alias("editions"), F.max_by("answer", "k").alias("answer"))
    return out.withColumn("answer", F.when(2 * c("most") > c("editions"), c("answer")))


@query("SELECT claims, count(*) AS links FROM (SELECT l_orderkey, l_partkey, count(*) AS claims FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def agreement(t):
    return t("lineitem").groupBy("l_orderkey", "l_partkey").agg(n().alias("claims")).groupBy("claims").agg(n().alias("links"))


@query("SELECT c_mktsegment, labelled, count(*) AS addresses, CAST(sum(verses) AS BIGINT) AS verses FROM (SELECT c_mktsegment, c_nationkey, bool_or(c_acctbal < 0) AS labelled, count(*) AS verses FROM customer GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1, 2")
def shared_addresses(t):
    s = t("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.bool_or(c("c_acctbal") < 0).alias("labelled"), n().alias("verses")).filter("verses > 1")
    return s.groupBy("c_mktsegment", "labelled").agg(n().alias("addresses"), F.sum("verses").alias("verses"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def stranded_anti(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("o_custkey")
    return t("customer").select("c_custkey", "c_mktsegment").join(urgent, c("c_custkey") == c("o_custkey"), "left_anti")


@query("""WITH x AS (SELECT p_brand, p_type, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE ('0x' || substr(md5(p_brand), 1, 8))::BIGINT % 3 = 0 GROUP BY 1, 2), kept AS (SELECT p_brand, p_type, CASE WHEN k % 5 = 0 THEN k + 1 ELSE k END AS k FROM x WHERE k % 7 <> 0)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.p_type, b.p_type) AS p_type, a.k AS kept, b.k AS counted FROM kept a FULL JOIN x b ON a.p_brand = b.p_brand AND a.p_type = b.p_type WHERE a.k IS DISTINCT FROM b.k""")
def index_recount(t):
    """An index with faults put in against its recount, on a hash sample of its keys."""
    part = t("part").filter(keys.sampled(c("p_brand"), 3)).select("p_partkey", "p_brand", "p_type")
    counted = t("lineitem").select("l_partkey").join(part, c("l_partkey") == c("p_partkey")).groupBy("p_brand", "p_type").agg(n().alias("counted"))
    kept = counted.filter("counted % 7 <> 0").select("p_brand", "p_type", F.when(c("counted") % 5 == 0, c("counted") + 1).otherwise(c("counted")).alias("kept"))
    return kept.join(counted, ["p_brand", "p_type"], "full").filter(~c("kept").eqNullSafe(c("counted")))


_ORPHANS = [("line without order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("line without part", "lineitem", "l_partkey", "part", "p_partkey"), ("line without supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("order without customer", "orders", "o_custkey", "customer", "c_custkey"), ("customer without nation", "customer", "c_nationkey", "nation", "n_nationkey"), ("supplier without nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("nation without region", "nation", "n_regionkey", "region", "r_regionkey"), ("label without document", "labels", "doc_id", "documents", "doc_id"), ("order without line", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("document without label", "documents", "doc_id", "labels", "doc_id")]
_TWICE = [("order twice", "orders", "o_orderkey"), ("customer twice", "customer", "c_custkey"), ("document twice", "documents", "doc_id"), ("text twice", "documents", "text"), ("page twice", "pages", "page_id"), ("turn twice", "conversations", "conv_id, turn"), ("line twice", "lineitem", "l_orderkey, l_linenumber")]
_BROKEN = [("discount outside 0..1", "lineitem", "l_discount BETWEEN 0 AND 1"), ("tax outside 0..1", "lineitem", "l_tax BETWEEN 0 AND 1"), ("quantity not positive", "lineitem", "l_quantity > 0"), ("price not positive", "lineitem", "l_extendedprice > 0"), ("unknown status", "orders", "o_orderstatus IN ('F', 'O', 'P')"), ("balance below zero", "customer", "c_acctbal >= 0"), ("length unlike the text", "documents", "n_chars = length(text)"), ("role unknown", "conversations", "role IN ('user', 'assistant', 'system')"), ("empty name", "part", "p_name <> ''"), ("text without words", "documents", "text <> ''")]


@query(" UNION ALL ".join([f"SELECT '{r}' AS rule, count(*) AS found FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {b}.{y} = {a}.{x})" for r, a, x, b, y in _ORPHANS] + [f"SELECT '{r}', count(*) FROM (SELECT {k} FROM {a} GROUP BY {k} HAVING count(*) > 1)" for r, a, k in _TWICE] + [f"SELECT '{r}', count(*) FILTER (WHERE NOT coalesce({rule}, false)) FROM {a}" for r, a, rule in _BROKEN]))
def integrity_zero_checks(t):
    """27 checks: rows without what they refer to, keys that come twice, conditions that do not hold; one scan a table for the last."""
    rule = lambda name, df: df.agg(n().alias("found")).select(F.lit(name).alias("rule"), "found")
    found = [rule(r, t(a).select(c(x).alias("k")).join(t(b).select(c(y).alias("k")), "k", "left_anti")) for r, a, x, b, y in _ORPHANS]
    found += [rule(r, t(a).groupBy(*k.split(", ")).agg(n().alias("k")).filter("k > 1")) for r, a, k in _TWICE]
    for table in dict.fromkeys(a for _, a, _ in _BROKEN):
        facts = [F.struct(F.lit(r).alias("rule"), F.count_if(~F.coalesce(F.expr(condition), F.lit(False))).alias("found")) for r, a, condition in _BROKEN if a == table]
        found.append(t(table).agg(F.array(*facts).alias("f")).select(F.explode("f").alias("x")).select("x.rule", "x.found"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query("""WITH i AS (SELECT (SELECT count(*) FROM lineitem WHERE l_discount > 1) + (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS faults),
b AS (SELECT o_custkey % 40 AS book, count(*) AS words, count(*) FILTER (WHERE l_discount >= 0.03) AS aligned FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), s AS (SELECT sum(aligned) / sum(words) AS share FROM b WHERE aligned > 0)
SELECT CAST(faults AS BIGINT) AS faults, round(share, 6) AS share, faults = 0 AND share >= 0.60 AS passes FROM i, s""")
def quality_gate(t):
    """Fails if an integrity check found something, or the aligned share over books that alignment has reached is under 0.60."""
    line = t("lineitem").select("l_orderkey", "l_discount")
    known = t("orders").select("o_orderkey", "o_custkey")
    lost = line.join(known, c("l_orderkey") == c("o_orderkey"), "left_anti").agg(n().alias("lost"))
    wrong = line.agg(F.count_if(c("l_discount") > 1).alias("wrong"))
    book = line.join(known, c("l_orderkey") == c("o_orderkey")).groupBy((c("o_custkey") % 40).alias("book")).agg(n().alias("words"), F.count_if(c("l_discount") >= 0.03).alias("aligned"))
    share = book.filter("aligned > 0").agg((F.sum("aligned") / F.sum("words")).alias("s"))
    one = lost.crossJoin(wrong).crossJoin(share).withColumn("faults", c("lost") + c("wrong"))  # one row each
    return one.select("faults", F.round("s", 6).alias("share"), ((c("faults") == 0) & (c("s") >= 0.60)).alias("passes"))


# -- differences of texts: a user's turn against the answer, linked where the same word stands at most three places off


_W = "SELECT conv_id * 1000 + turn - {1} AS seg, unnest(range(0, len(w))) AS position, unnest(w) AS word FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE role = '{0}')"
_DEGREES = f"""WITH a AS ({_W.format('user', 0)}), b AS ({_W.format('assistant', 1)}), l AS (SELECT a.seg, a.position AS left_at, a.word AS lw, b.word AS rw, CASE WHEN abs(a.position - b.position) = 0 THEN NULL ELSE 1.0 / (1 + abs(a.position - b.position)) END AS confidence
FROM a JOIN b ON a.seg = b.seg AND left(a.word, 2) = left(b.word, 2) AND abs(a.position - b.position) <= 3), k AS (SELECT seg, left_at, CASE min(CASE WHEN lw = rw THEN 0 WHEN left(lw, 5) = left(rw, 5) THEN 1 WHEN left(lw, 3) = left(rw, 3) THEN 2 WHEN coalesce(confidence, 1) >= 0.5 THEN 3 ELSE 4 END) WHEN 0 THEN 'Same' WHEN 1 THEN 'Form' WHEN 2 THEN 'Lemma' WHEN 3 THEN 'Linked' ELSE 'Unsure' END AS degree FROM l GROUP BY 1, 2),
g AS (SELECT DISTINCT seg FROM l), e AS (SELECT DISTINCT seg FROM b)
SELECT a.seg, a.position, CASE WHEN k.degree IS NOT NULL THEN k.degree WHEN length(a.word) <= 2 THEN 'Absent' WHEN g.seg IS NOT NULL THEN 'Unmatched' ELSE 'Unlinked' END AS degree FROM a LEFT JOIN k ON k.seg = a.seg AND k.left_at = a.position LEFT JOIN g ON g.seg = a.seg WHERE a.seg IN (SELECT seg FROM e)"""


def _turns(t, role, back):
    turns = t("conversations").filter(c("role") == role)
    return turns.select((c("conv_id") * 1000 + c("turn") - back).alias("seg"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("position", "word")).withColumn("position", long("position"))


def _degrees(t):
    a, b = _turns(t, "user", 0), _turns(t, "assistant", 1)
    pair = a.withColumn("k", F.left("word", F.lit(2))).withColumnRenamed("position", "left_at").join(b.select("seg", c("position").alias("right_at"), F.left("word", F.lit(2)).alias("k")), ["seg", "k"])
    off = F.abs(c("left_at") - c("right_at"))
    linked = pair.filter(off <= 3).select("seg", "left_at", "right_at", F.when(off > 0, 1.0 / (1 + off)).alias("confidence"))
    lemma = lambda w, k: F.left(w, F.lit(k))
    left = a.withColumn("form", lemma("word", 5)).withColumn("lemma", lemma("word", 3))
    right = b.withColumn("form", lemma("word", 5)).withColumn("lemma", lemma("word", 3))
    absent = a.filter("length(word) <= 2").select("seg", "position")
    both = left.join(b.select("seg").distinct(), "seg", "left_semi")
    return differences.degrees(both, right, linked, absent)


@query(_DEGREES)
def word_differences(t):
    return _degrees(t).select("seg", "position", "degree")


@query(f"SELECT seg // 10000 AS chapter, count(*) FILTER (WHERE degree = 'Same') AS same, count(*) FILTER (WHERE degree IN ('Form', 'Lemma')) AS akin, count(*) FILTER (WHERE degree IN ('Absent', 'Unmatched', 'Unlinked')) AS without, count(*) AS words FROM ({_DEGREES}) GROUP BY 1")
def chapter_differences(t):
    d = c("degree")
    return _degrees(t).groupBy(F.expr("seg div 10000").alias("chapter")).agg(F.count_if(d == "Same").alias("same"), F.count_if(d.isin("Form", "Lemma")).alias("akin"), F.count_if(d.isin("Absent", "Unmatched", "Unlinked")).alias("without"), n().alias("words"))


@query()
def moved_words(t):
    """Sequential by its rule (the nearest pair first), so without SQL; tested against a plain implementation."""
    a, b = _turns(t, "user", 0), _turns(t, "assistant", 1)
    return differences.moved(a.filter("length(word) >= 2"), b.filter("length(word) >= 2"))


# -- indexes


@query("""SELECT p_brand, p_type, l_returnflag, count(*) AS places, array_to_string(list(l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey), ',') AS orders, array_to_string(list(l_linenumber ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey), ',') AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""")
def rendering_places(t):
    """Parallel arrays, one row for each number, rendering and witness."""
    j = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(t("part").select("p_partkey", "p_brand", "p_type"), c("l_partkey") == c("p_partkey"))
    lists = j.groupBy("p_brand", "p_type", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    side = lambda name: F.array_join(F.transform("x", lambda p: p[name].cast("string")), ",")
    return lists.select("p_brand", "p_type", "l_returnflag", long(F.size("x")).alias("places"), side("l_orderkey").alias("orders"), side("l_linenumber").alias("lines"))


@query("SELECT c_nationkey AS record, c_mktsegment AS spelling, count(*) AS occurrences, count(DISTINCT o_orderpriority) AS texts, min(o_orderkey) AS first_place FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def record_spellings(t):
    j = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(t("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), c("c_custkey") == c("o_custkey"))
    return j.groupBy(c("c_nationkey").alias("record"), c("c_mktsegment").alias("spelling")).agg(n().alias("occurrences"), F.countDistinct("o_orderpriority").alias("texts"), F.min("o_orderkey").alias("first_place"))


@query("SELECT o_custkey % 40 AS book, l_returnflag AS text, count(*) AS words, count(*) FILTER (WHERE l_discount > 0) AS linked, count(DISTINCT l_orderkey) AS verses, count(DISTINCT l_orderkey) FILTER (WHERE l_discount > 0) AS reached FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def book_reach(t):
    j = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select("l_orderkey", "l_returnflag", "l_discount"), c("o_orderkey") == c("l_orderkey"))
    linked = c("l_discount") > 0
    return j.groupBy((c("o_custkey") % 40).alias("book"), c("l_returnflag").alias("text")).agg(n().alias("words"), F.count_if(linked).alias("linked"), F.countDistinct("l_orderkey").alias("verses"), F.countDistinct(F.when(linked, c("l_orderkey"))).alias("reached"))


@query("SELECT l_returnflag, array_to_string(list(l_partkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey, l_linenumber, l_suppkey)[1:3], ',') AS dearest FROM lineitem GROUP BY 1")
def first_of_ordered(t):
    """The first three of an ordered aggregate, by a window that keeps no more than three rows of a group."""
    order = Window.partitionBy("l_returnflag").orderBy(c("l_extendedprice").desc(), "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    few = t("lineitem").select("l_returnflag", "l_extendedprice", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").withColumn("r", F.row_number().over(order)).filter("r <= 3")
    return few.groupBy("l_returnflag").agg(F.sort_array(F.collect_list(F.struct("r", "l_partkey"))).alias("x")).select("l_returnflag", F.array_join(F.transform("x", lambda p: p["l_partkey"].cast("string")), ",").alias("dearest"))


@query("SELECT p_type, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)")
def dense_ids(t):
    return numbered(t("part").select("p_type").distinct(), ["p_type"], "id")


@query("""WITH f AS (SELECT source, lang, count(*) AS k FROM documents GROUP BY 1, 2), s AS (SELECT source, count(*) AS verses FROM documents GROUP BY 1) SELECT f.source, f.lang, k, round(k / verses, 6) AS share FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE k >= 0.2 * verses""")
def topic_of_record(t):
    """A topic is about a record that at least a fifth of its verses name."""
    named = t("documents").groupBy("source", "lang").agg(n().alias("k"))
    whole = F.sum("k").over(Window.partitionBy("source"))
    return named.withColumn("v", whole).filter("k >= 0.2 * v").select("source", "lang", "k", F.round(c("k") / c("v"), 6).alias("share"))


@query("""WITH v AS (SELECT l_orderkey AS chapter, l_linenumber AS verse, sum(l_quantity) AS letters FROM lineitem GROUP BY 1, 2), m AS (SELECT chapter, max(verse) AS last FROM v GROUP BY 1)
SELECT m.chapter, m.last = 4 AS ends_at_four, a.letters IS NOT NULL AS has_two, b.letters IS NULL AS lacks_five, a.letters < d.letters AS two_shorter_than_three, 2 * a.letters > d.letters AS twice_two_longer_than_three FROM m LEFT JOIN v a ON a.chapter = m.chapter AND a.verse = 2 LEFT JOIN v b ON b.chapter = m.chapter AND b.verse = 5 LEFT JOIN v d ON d.chapter = m.chapter AND d.verse = 3""")
def versification_conditions(t):
    """Whether a chapter ends at a verse, has or lacks one, and how long two are to one another; unknown where one is not printed."""
    letters = lambda k: F.sum(F.when(c("l_linenumber") == k, c("l_quantity")))
    ch = t("lineitem").groupBy(c("l_orderkey").alias("chapter")).agg(F.max("l_linenumber").alias("last"), letters(2).alias("a"), letters(5).alias("b"), letters(3).alias("d"))
    return ch.select("chapter", (c("last") == 4).alias("ends_at_four"), c("a").isNotNull().alias("has_two"), c("b").isNull().alias("lacks_five"), (c("a") < c("d")).alias("two_shorter_than_three"), (2 * c("a") > c("d")).alias("twice_two_longer_than_three"))


@query("""WITH r AS (SELECT user_id AS king, CAST(min(value) AS BIGINT) AS start, CAST(max(value) AS BIGINT) AS until FROM events GROUP BY 1)
SELECT a.king, b.king AS other, greatest(a.start, b.start) - a.start + 1 AS year_of_king, greatest(a.start, b.start) - b.start + 1 AS year_of_other, least(a.until, b.until) - greatest(a.start, b.start) AS together FROM r a JOIN r b ON a.king < b.king AND a.start <= b.until AND b.start <= a.until""")
def reigns_synchronism(t):
    """Reigns that overlap: in which year of each the later one began, and for how long both lasted."""
    r = t("events").filter("user_id IS NOT NULL").groupBy(c("user_id").alias("king")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # a cast of SQL rounds halves to the even number
    r = r.select("king", F.rint("lo").cast("long").alias("start"), F.rint("hi").cast("long").alias("until"))
    both = timeline.overlapping(r, "king", "start", "until")
    ordered, later = c("earlier_king") < c("later_king"), c("later_start")
    year = later - c("earlier_start") + 1
    one = F.lit(1).cast("long")
    return both.select(F.least("earlier_king", "later_king").alias("king"), F.greatest("earlier_king", "later_king").alias("other"), F.when(ordered, year).otherwise(one).alias("year_of_king"), F.when(ordered, one).otherwise(year).alias("year_of_other"), (F.least("earlier_until", "later_until") - later).alias("together"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value / 10) AS BIGINT), CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 WHEN 'view' THEN 4 ELSE 5 END, event_id) AS place FROM events""")
def event_order(t):
    """Events of a year in the order of their kinds: birth, death, end, begin, rest."""
    kinds = F.array(*[F.lit(k) for k in ("signup", "purchase", "error", "view")])
    at = F.array_position(kinds, c("event_type"))
    w = Window.partitionBy("user_id").orderBy(F.floor(c("value") / 10), F.when(at == 0, 5).otherwise(at), "event_id")
    return t("events").select("user_id", "event_id", long(F.row_number().over(w)).alias("place"))


# -- building


_BUILT = "(SELECT o_orderkey, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority END AS o_orderpriority, o_orderstatus, o_totalprice FROM orders)"
_STOOD = f"(SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_totalprice FROM {_BUILT} WHERE o_orderpriority IS DISTINCT FROM '5-LOW' UNION ALL SELECT o_orderkey, o_orderpriority, 'gone', o_totalprice FROM {_BUILT} WHERE o_orderpriority IS DISTINCT FROM '5-LOW')"


def _built(t):
    """The orders as they are built now, a priority of them without a name, and the state that stands: without one priority, one
    status changed, another that has since gone."""
    o = t("orders").select("o_orderkey", F.when(c("o_orderpriority") != "2-HIGH", c("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus", "o_totalprice")
    rest = o.filter("NOT o_orderpriority <=> '5-LOW'")
    stood = rest.withColumn("o_totalprice", c("o_totalprice") + F.when(c("o_orderstatus") == "P", 1).otherwise(0))
    return stood.unionByName(rest.withColumn("o_orderstatus", F.lit("gone"))), o, ["o_orderpriority", "o_orderstatus"]


@query(f"""WITH a AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, list_sort(list((o_orderkey, o_totalprice))) AS all_rows FROM {_STOOD} GROUP BY 1, 2), b AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, list_sort(list((o_orderkey, o_totalprice))) AS all_rows FROM {_BUILT} GROUP BY 1, 2)
SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' ELSE 'moved' END AS state
FROM a FULL JOIN b ON a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus WHERE a.n IS NULL OR b.n IS NULL OR a.all_rows <> b.all_rows""")
def parts_moved(t):
    """Digests of parts against the state that stands; a null is a part's key like any other."""
    stood, now, by = _built(t)
    return build.parts_moved(build.digest(stood, by), build.digest(now, by), by)


@query(f"SELECT * FROM {_BUILT}")
def apply_moved(t):
    """The state that stands with only the parts that moved taken from the new one is the new state, row by row."""
    stood, now, by = _built(t)
    moved = build.parts_moved(build.digest(stood, by), build.digest(now, by), by)
    return build.apply_moved(stood, now, moved, by)


@query(f"""WITH a AS (SELECT o_orderpriority, o_orderstatus, list_sort(list((o_orderkey, o_totalprice))) AS all_rows FROM {_STOOD} GROUP BY 1, 2), b AS (SELECT o_orderpriority, o_orderstatus, list_sort(list((o_orderkey, o_totalprice))) AS all_rows FROM {_BUILT} GROUP BY 1, 2)
SELECT n.*, CAST(CASE WHEN EXISTS (SELECT 1 FROM a JOIN b ON a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus AND a.all_rows = b.all_rows WHERE b.o_orderpriority IS NOT DISTINCT FROM n.o_orderpriority AND b.o_orderstatus = n.o_orderstatus) THEN 1 ELSE 2 END AS INTEGER) AS run FROM {_BUILT} n""")
def publish_moved(t):
    """The state that stood is published, then the new one: parts that did not move are still those of the first run."""
    stood, now, by = _built(t)
    spark = now.sparkSession
    path = scratch(spark, "published")
    publish.publish(stood, path, by)
    publish.publish(now, path, by)
    return publish.published(spark, path)


@query("""SELECT l_returnflag || l_linestatus AS "table", count(*) * 20 AS rows, count(*) FILTER (WHERE l_linenumber = 1) AS removed, count(*) FILTER (WHERE l_suppkey % 2 = 0) * 12 AS added, CASE WHEN l_returnflag || l_linestatus = 'RO' THEN 'refuse' WHEN count(*) * 20 >= 100000 AND count(*) FILTER (WHERE l_linenumber = 1) + count(*) FILTER (WHERE l_suppkey % 2 = 0) * 12 >= 0.25 * count(*) * 20 THEN 'refill' ELSE 'apply' END AS plan FROM lineitem GROUP BY 1, l_returnflag, l_linestatus""")
def release_plan(t):
    rows = t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("table")).agg((n() * 20).alias("rows"), F.count_if(c("l_linenumber") == 1).alias("removed"), (F.count_if(c("l_suppkey") % 2 == 0) * 12).alias("added"))
    sized = rows.withColumn("bytes", F.when(c("table") == "RO", 60).otherwise(10)).withColumn("dump_bytes", F.lit(100))
    return build.release_plan(sized).drop("bytes", "dump_bytes")


@query("""SELECT c_mktsegment AS layer, string_agg(DISTINCT r_name, ', ' ORDER BY r_name) AS licences, bool_and(r_name <> 'ASIA') AS free FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 9000 GROUP BY 1""")
def layer_licences(t):
    layers = t("customer").filter("c_acctbal > 9000").select(c("c_mktsegment").alias("layer"), c("c_nationkey").alias("source"))
    sources = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("source"), c("r_name").alias("licence"), (c("r_name") != "ASIA").alias("free"))
    return build.layer_licences(layers, sources)


@query("""SELECT r_name AS region, n_name AS tribe, c_mktsegment AS occupation, count(*) AS people, min(c_name) AS first_name, max(c_acctbal) AS northmost FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""")
def people_of_places(t):
    """People by region, tribe and occupation, with the northmost point; the small tables go to every task by the planner's own choice."""
    j = t("customer").join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), c("c_nationkey") == c("n_nationkey")).join(t("region").select("r_regionkey", "r_name"), c("n_regionkey") == c("r_regionkey"))
    return j.groupBy(c("r_name").alias("region"), c("n_name").alias("tribe"), c("c_mktsegment").alias("occupation")).agg(n().alias("people"), F.min("c_name").alias("first_name"), F.max("c_acctbal").alias("northmost"))


@query("""SELECT source, round(sum(CASE WHEN quality = 1 THEN 1.5 ELSE 1.0 END * covered / verses * ln(total / df)), 4) AS relevance FROM (SELECT source, lang, quality, count(*) AS covered, sum(count(*)) OVER (PARTITION BY source) AS verses, sum(count(*)) OVER () AS total, sum(count(*)) OVER (PARTITION BY lang) AS df FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3) GROUP BY 1""")
def said_topics(t):
    """Topics that are said weigh half as much again: covered / length x ln(all / df)."""
    per = t("documents").select("doc_id", "source", "lang").join(t("labels").select("doc_id", "quality"), "doc_id").groupBy("source", "lang", "quality").agg(n().alias("covered"))
    df = per.groupBy("lang").agg(F.sum("covered").alias("df"))
    length = per.groupBy("source").agg(F.sum("covered").alias("verses"))
    total = per.agg(F.sum("covered").alias("total"))  # one row
    all_ = per.join(df, "lang").join(length, "source").crossJoin(F.broadcast(total))
    weight = F.when(c("quality") == 1, 1.5).otherwise(1.0)
    return all_.groupBy("source").agg(F.round(F.sum(weight * c("covered") / c("verses") * F.ln(c("total") / c("df"))), 4).alias("relevance"))
