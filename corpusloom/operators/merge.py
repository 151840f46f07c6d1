"""Conflict resolution: precedence of methods, settling of claims, greedy competition by rank."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import kept

#: Ranks of methods (fixed values); strong links and evidence verdicts have several.
RANKS = {"pinned": 1000, "manual": 100, "ruling": 100, "stated": 90, "names": 77, "possessive": 76, "rule": 76, "model": 65, "composed": 60, "aligner": 40, "lexical": 20}
#: From a confidence on: strong links by a text's own numbers, by numbers laid onto it, the surer and the rest (fixed values).
STRONG, STRONG_LAID, STRONG_FAIR, STRONG_REST = (0.9, 85), (0.9, 55), (0.7, 50), 30
#: Evidence verdicts by tier, the attached one also where compositions read attached words better (fixed values).
EVIDENCE, ATTACHED_BELOW, EVIDENCE_REST = {"safe": 80, "attached": 79}, 59, 78
#: Absences: those that a source states or a person decides, and those of evidence rules (fixed values).
STATED_ABSENCE, EVIDENCE_ABSENCE = 95, 41
#: The confidence from which a word without a link keeps its best withdrawn one (fixed value).
ORPHAN = 0.7


def rank(method: Column, confidence: Column, tier: Column | None = None, laid: Column | None = None, attached_below: bool = False) -> Column:
    """Precedence of a claim; a strong link without a confidence ranks with the least sure."""
    laid = F.lit(False) if laid is None else F.coalesce(laid, F.lit(False))
    c = F.coalesce(confidence, F.lit(0.0))
    strong = F.when((c >= STRONG[0]) & ~laid, STRONG[1]).when(c >= STRONG_LAID[0], STRONG_LAID[1]).when(c >= STRONG_FAIR[0], STRONG_FAIR[1]).otherwise(STRONG_REST)
    verdict = F.lit(EVIDENCE_REST)
    if tier is not None:
        verdict = F.when(tier == "safe", EVIDENCE["safe"]).when(tier == "attached", ATTACHED_BELOW if attached_below else EVIDENCE["attached"]).otherwise(EVIDENCE_REST)
    out = F.when(method == "strong", strong).when(method == "evidentia", verdict)
    for name, value in RANKS.items():
        out = out.when(method == name, value)
    return out.otherwise(0)


def standing_rank(method: Column, relation: Column, of_claim: Column) -> Column:
    """Rank in the competition: absences have ranks of their own."""
    absent = relation.isin("omits", "expands")
    return F.when(absent & method.isin("stated", "manual", "ruling"), F.greatest(F.lit(STATED_ABSENCE), of_claim)).when(absent & (method == "evidentia"), EVIDENCE_ABSENCE).otherwise(of_claim)


def one_link_a_shape(claims: DataFrame, shape: list[str], key: str) -> DataFrame:
    """claims (rank, confidence, method, source, relation) with status: of the claims of one shape the first settles it, those of its
    relation support it, others are withdrawn by its method. First is the highest rank, the surer (stated ones are surest), then by name."""
    order = Window.partitionBy(*shape).orderBy(F.col("rank").desc(), F.coalesce(F.col("confidence"), F.lit(2.0)).desc(), "method", "source", key)
    top = F.first(F.struct("relation", "method")).over(order)
    status = F.when(F.row_number().over(order) == 1, "settles").when(F.col("relation") == top["relation"], "claims").otherwise(F.concat(F.lit("withdrawn:"), top["method"]))
    return claims.withColumn("status", status)


def stale(rows: DataFrame, current: DataFrame, segment: list[str]) -> DataFrame:
    """rows with status: stale where the hash of the segment they were made from is not the present one, lost where it is gone."""
    now = current.select(*segment, F.col("hash").alias("_now"))
    status = F.when(F.col("_now").isNull(), "lost").when(~F.col("hash").eqNullSafe(F.col("_now")), "stale").otherwise("current")
    return rows.join(now, segment, "left").withColumn("status", status).drop("_now")


class Standing:
    """What links of one segment hold, in the order of their ranks."""

    def __init__(self):
        self.source, self.rendered, self.absent = {}, {}, {}  # word -> the highest rank that holds it
        self.pairs: list[tuple[set, set]] = []

    def against(self, relation: str, source, target) -> int:
        """The highest rank that holds a word this link needs."""
        if relation == "omits":
            held = [(self.rendered, target), (self.absent, target)]
        elif relation == "expands":
            held = [(self.source, source)]
        else:
            held = [(self.source, source), (self.absent, target)]
        return max((by[w] for by, words in held for w in words if w in by), default=-1)

    def inside(self, source, target) -> bool:
        return any(a.issuperset(source) and b.issuperset(target) for a, b in self.pairs)

    def hold(self, relation: str, source, target, rank: int) -> None:
        places = {"omits": [(self.absent, target)], "expands": [(self.source, source)]}.get(relation, [(self.source, source), (self.rendered, target)])
        for by, words in places:
            for w in words:
                by[w] = max(rank, by.get(w, rank))
        if relation not in ("omits", "expands"):
            self.pairs.append((set(source), set(target)))


def decide(candidates: list[tuple]) -> list[str]:
    """status of one segment's (source, target, relation, rank, confidence), which come by falling rank.

    A link that needs a word a strictly higher rank holds is withdrawn, unless it lies inside a standing link on both sides,
    which it then refines. A source word left bare takes its best withdrawn link back if that is sure enough and contradicts none.
    """
    held, status = Standing(), []
    for source, target, relation, rank, _ in candidates:
        if held.against(relation, source, target) <= rank:
            held.hold(relation, source, target, rank)
            status.append("stands")
        else:
            status.append("refines" if relation not in ("omits", "expands") and held.inside(source, target) else "withdrawn")
    linked = {w for c, s in zip(candidates, status, strict=True) if s != "withdrawn" for w in c[0]}
    rendered, absent, absent_source = set(), set(), set()

    def stand(source, target, relation):
        absent.update(target) if relation == "omits" else absent_source.update(source) if relation == "expands" else rendered.update(target)

    def contradicts(source, target, relation):
        if relation == "omits":
            return not rendered.isdisjoint(target)
        if relation == "expands":
            return any(w in linked for w in source)
        return not absent_source.isdisjoint(source) or not absent.isdisjoint(target)

    for c, s in zip(candidates, status, strict=True):
        if s != "withdrawn":
            stand(*c[:3])
    # the surer of equal ranks first; candidates come by falling rank already
    order = sorted(range(len(candidates)), key=lambda k: (-candidates[k][3], -(2.0 if candidates[k][4] is None else candidates[k][4]), k))
    for k in order:
        source, target, relation, _, confidence = candidates[k]
        bare = any(w not in linked for w in source)
        if status[k] == "withdrawn" and bare and (confidence is None or confidence >= ORPHAN) and not contradicts(source, target, relation):
            status[k] = "restored"
            stand(source, target, relation)
            linked.update(source)
    return status


def compete_links(links: DataFrame) -> DataFrame:
    """links (segment, key, source, target: arrays of words, relation, rank, confidence) with the status that ``decide`` gives.

    Segments stream by, sorted, within a partition; one segment's links are held at a time. Every row keeps a status.
    """
    names = links.columns
    at = {name: k for k, name in enumerate(names)}

    def run(batches):
        now, own, out = None, [], []  # one segment's rows; rows that are decided

        def done():
            words = lambda x: () if x is None else tuple(x)
            got = decide([(words(r[at["source"]]), words(r[at["target"]]), r[at["relation"]], r[at["rank"]], r[at["confidence"]]) for r in own])
            out.extend((*r, s) for r, s in zip(own, got, strict=True))
            own.clear()

        def table():
            columns = zip(*out, strict=True) if out else [[] for _ in range(len(names) + 1)]
            made = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], [*names, "status"])
            out.clear()
            return made.to_batches()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and row[at["segment"]] != now:
                    done()
                    if len(out) >= 10_000:
                        yield from table()
                now = row[at["segment"]]
                own.append(row)
        if own:
            done()
        yield from table()

    schema = T.StructType([*links.schema.fields, T.StructField("status", T.StringType())])
    return links.repartition("segment").sortWithinPartitions("segment", F.col("rank").desc(), "key").mapInArrow(run, schema)


def annotate(claims: DataFrame, word: list[str], entity: str) -> DataFrame:
    """The entity of each word: its first claim by own reading before carried ones, standing, then confidence (stated is surest);
    no answer where the next claim ties with it in all of these and names another entity."""
    order = Window.partitionBy(*word).orderBy(F.col("own").desc(), F.col("standing").desc(), F.coalesce(F.col("confidence"), F.lit(1.0)).desc(), entity)
    facts = F.struct("own", "standing", F.coalesce(F.col("confidence"), F.lit(1.0)).alias("c"))
    marked = claims.withColumn("_f", facts).withColumn("_next", F.lead("_f").over(order)).withColumn("_other", F.lead(entity).over(order))
    ambiguous = F.col("_f").eqNullSafe(F.col("_next")) & ~F.col(entity).eqNullSafe(F.col("_other"))
    first = marked.withColumn("_r", F.row_number().over(order)).withColumn("claims", F.count("*").over(Window.partitionBy(*word))).filter("_r = 1")
    return first.select(*word, F.when(~ambiguous, F.col(entity)).alias(entity), "claims")


def chained_numbers(words: DataFrame, links: DataFrame, texts: list[str], originals: list[str], keep=kept) -> DataFrame:
    """text, word, number, hops, lender: each word's own number, else one that a link lends from a text before its own.

    words: text, word, number (null: none); links: text, word, other_text, other, confidence (null: stated). Texts are taken in order; a
    text reads the numbers of texts before it, and own ones of later texts. Of several: an original's, the surer link, the
    shorter chain, the number that the same lending text carries less often, then number and lender by name. ``keep`` writes what a
    text has got, so that the next one reads it and the plan grows with the texts alone.
    """
    own = words.filter("number IS NOT NULL").select("text", "word", "number", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("lender"))
    known = own
    rare = words.filter("number IS NOT NULL").groupBy(F.col("text").alias("other_text"), "number").agg(F.count("*").alias("carried"))
    for text in texts:
        lent = known.select(F.col("text").alias("other_text"), F.col("word").alias("other"), "number", "hops")
        bare = words.filter((F.col("text") == text) & F.col("number").isNull()).select("text", "word")
        offers = links.filter(F.col("text") == text).join(bare, ["text", "word"], "left_semi").join(lent, ["other_text", "other"]).join(rare, ["other_text", "number"], "left")
        order = Window.partitionBy("text", "word").orderBy(F.col("other_text").isin(*originals).desc(), F.coalesce(F.col("confidence"), F.lit(1.0)).desc(), "hops", F.coalesce("carried", F.lit(0)), "number", "other_text", "other")
        taken = offers.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("text", "word", "number", (F.col("hops") + 1).alias("hops"), F.concat_ws(" ", "other_text", F.col("other").cast("string")).alias("lender"))
        known = keep(known.unionByName(taken))
    return known


def settle(claims: DataFrame, target: list[str], answer: str, *order) -> DataFrame:
    """The first claim of each target by order; a tie with a different answer settles nothing."""
    first = claims.withColumn("_p", F.rank().over(Window.partitionBy(*target).orderBy(*order))).filter("_p = 1")
    tied = first.groupBy(*target).agg(F.min(answer).alias("_low"), F.max(answer).alias("_high"), F.count("*").alias("claims"))
    return tied.select(*target, F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).alias("answer"), "claims")


def compete(claims: DataFrame, segment: str) -> DataFrame:
    """segment, key, a, b, rank: a claim loses to a standing one of strictly higher rank that holds its a or its b."""

    def run(batches):
        now, held_a, held_b = None, {}, {}
        for pdf in batches:
            standing = []
            for s, a, b, r in zip(pdf[segment], pdf["a"], pdf["b"], pdf["rank"], strict=True):
                if s != now:
                    now, held_a, held_b = s, {}, {}
                # rows come by falling rank, so who holds a word first has the highest rank on it
                standing.append(wins := held_a.get(a, r) <= r and held_b.get(b, r) <= r)
                if wins:
                    held_a.setdefault(a, r)
                    held_b.setdefault(b, r)
            yield pdf.assign(stands=standing)

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in claims.schema.fields)}, stands boolean"
    return claims.repartition(segment).sortWithinPartitions(segment, F.col("rank").desc(), "key").mapInPandas(run, schema)
