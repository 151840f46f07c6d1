"""The merge's passes over rows: each gives rows a status that says what withdrew them, and none deletes a row.

Rows: key, pair, method, source, relation, confidence, tier, run, support (may only support other rows), laid (numbers laid from another
edition), book, source_words and target_words (sorted arrays of word ids), status (null: standing). What a pass makes anew has a
key of its own. The passes, in the order in which ``decided`` runs them:

refused      rulings take a shape, or a word on one side of a source's rows, out
superseded   a newer run of verdicts replaces older ones in the books and tiers it covers
pinned       an accepted shape that no standing row proposes becomes a row of its own
narrowed     a verdict that a word has no counterpart takes it out of laid rows
shaped       rows of one shape are one link; the best one settles it
unsupported  links all of whose rows may only support others go
giving_way   such a verdict ranks below any link on its word that another method than the aligner claims
crossing     machine links between verses that no verse link joins go
against      two pairs of the same texts the other way round: of an absence and a rendering of one word the higher rank keeps it

Rows and rulings may both have a column ``segment`` (never null): what rows and rulings that share a word share, as a verse. Passes then join,
group and order within it, so that tables dealt by it (``session.by_segment``) exchange nothing. Without it, words and shapes alone are met.

Every pass is joins, windows and aggregates over words or shapes; only ``against`` streams
segments in order or, without these, goes in rounds until each contest is decided.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop, kept, scratch
from . import merge

ABSENT = ("omits", "expands")
#: Ranks of a shape that a ruling accepts and of an absence that gives way; methods of machines (fixed values).
PINNED, GIVES_WAY = merge.RANKS["pinned"], 0
MACHINES = ("aligner", "composed")
SIDES = {"source": "source_words", "target": "target_words"}


def standing() -> Column:
    return F.col("status").isNull()


def absent() -> Column:
    return F.col("relation").isin(*ABSENT)


def shape() -> Column:
    """What rows of one link share: the pair and its words on both sides."""
    words = [F.array_join(F.transform(c, lambda w: w.cast("string")), " ") for c in SIDES.values()]
    return F.concat_ws("|", F.col("pair").cast("string"), *words)


def by(rows: DataFrame, *columns: str) -> list[str]:
    """The columns, within the segment where rows have one."""
    return [*(c for c in ("segment",) if c in rows.columns), *columns]


def sided() -> Column:
    """Words of both sides, each with its side."""
    one = lambda side, c: F.transform(c, lambda w: F.struct(F.lit(side).alias("side"), w.alias("word")))
    return F.concat(*[one(side, c) for side, c in SIDES.items()])


def each_word(rows: DataFrame, words: Column, *columns: str) -> DataFrame:
    """The columns with side and word of each of the words."""
    return rows.select(*by(rows, *columns), F.explode(words).alias("_w")).select(*by(rows, *columns), "_w.side", "_w.word")


def marked(rows: DataFrame, hit: DataFrame, status: Column | str, on: str = "key") -> DataFrame:
    """rows with a status where they stand and their key is among the hit ones; hit: on, and what status reads."""
    status = F.lit(status) if isinstance(status, str) else status
    found = hit.withColumn("_hit", F.lit(True))
    out = rows.join(found, on, "left").withColumn("status", F.when(standing() & F.col("_hit"), status).otherwise(F.col("status")))
    return out.select(*rows.columns)


def gone() -> Column:
    """The words that an absence says have no counterpart, with their side."""
    return F.filter(sided(), lambda w: w["side"] == F.when(F.col("relation") == "omits", "target").otherwise("source"))


def without(rows: DataFrame, lost: DataFrame, refused: str, narrowed: str, suffix: str) -> DataFrame:
    """rows whose words some are taken from; lost: key, source_lost, target_lost (arrays).

    A row left without words on a side it had words on gets ``refused``; another keeps its place as ``narrowed`` and stands
    again without these words, its roles with it, under its key and a suffix.
    """
    hit = rows.join(lost, by(rows, "key"), "left")
    left = {c: F.array_except(c, F.coalesce(F.col(f"{side}_lost"), F.array().cast(rows.schema[c].dataType))) for side, c in SIDES.items()}
    hit = hit.select(*rows.columns, *[x.alias(f"_{c}") for c, x in left.items()])
    less = F.lit(False)
    for c in SIDES.values():
        less = less | (F.size(f"_{c}") < F.size(c))
    less = standing() & less
    bare = F.lit(False)
    for c in SIDES.values():
        bare = bare | ((F.size(f"_{c}") == 0) & (F.size(c) > 0))
    status = F.when(less & bare, refused).when(less, narrowed).otherwise(F.col("status"))
    both = F.array(F.struct(status.alias("status"), F.lit(False).alias("again")), F.struct(F.lit(None).cast("string").alias("status"), F.lit(True).alias("again")))
    states = F.filter(both, lambda s: ~s["again"] | (less & ~bare))  # a narrowed row stands once more, from the same row
    out = hit.withColumn("_s", F.explode(states)).withColumn("status", F.col("_s.status"))
    again = F.col("_s.again")
    out = out.withColumn("key", F.when(again, F.concat("key", F.lit(suffix))).otherwise(F.col("key")))
    for c in SIDES.values():
        out = out.withColumn(c, F.when(again, F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*rows.columns)


def lost_words(rows: DataFrame, words: DataFrame, fits: Column) -> DataFrame:
    """key, source_lost, target_lost: words of standing rows that are among words (pair, side, word, and what fits reads)."""
    flat = each_word(rows.filter(standing()), sided(), "key", "pair", "source", "relation")
    found = flat.join(words, by(rows, "pair", "side", "word")).filter(fits)
    gather = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("word"))).alias(f"{side}_lost")
    return found.groupBy(*by(rows, "key")).agg(*[gather(side) for side in SIDES])


def refused(rows: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rulings (pair, action, source_words, target_words, source, relation) that refuse. With words on both sides they refuse the shape, to one
    source (by the beginning of its name) or relation if they name one; with words on one side they take these words out of the
    named source's rows. Shapes come first: a row that words were taken from is not refused by its new shape."""
    wrong = rulings.filter("action = 'refuse'").withColumn("named", F.struct("source", "relation"))
    allowed = lambda n: (F.coalesce(n["source"], F.lit("")) == "") | F.col("source").startswith(n["source"])
    related = lambda n: (F.coalesce(n["relation"], F.lit("")) == "") | (F.col("relation") == n["relation"])
    whole = wrong.filter("size(source_words) > 0 AND size(target_words) > 0").groupBy(*by(rows), shape().alias("_shape")).agg(F.collect_set("named").alias("_named"))
    hit = standing() & F.exists("_named", lambda n: allowed(n) & related(n))
    ruled = rows.withColumn("_shape", shape()).join(whole, by(rows, "_shape"), "left").withColumn("status", F.when(hit, "refused-by ruling").otherwise(F.col("status"))).select(*rows.columns)
    one_sided = wrong.filter("(size(source_words) > 0) <> (size(target_words) > 0)")
    words = each_word(one_sided, sided(), "pair", "named")
    return without(ruled, lost_words(ruled, words, allowed(F.col("named")) & related(F.col("named"))), "refused-by ruling", "narrowed-by ruling", "/ruling")


def floored(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """Composed rows under the floor (source, least) that is set by hand for their combination of readings; without confidence they pass."""
    hit = rows.filter(standing() & (F.col("method") == "composed")).join(floors, "source").filter("confidence < least").select("key", "least").distinct()
    return marked(rows, hit, F.concat(F.lit("under-floor "), F.col("least").cast("string")))


def superseded(rows: DataFrame) -> DataFrame:
    """Verdicts whose tier and book a later run has given verdicts in; rows without a run are none."""
    verdict = standing() & (F.col("method") == "evidentia")
    tier = F.coalesce("tier", F.lit("")).alias("_tier")
    newest = rows.filter(verdict).groupBy("pair", tier, "book").agg(F.max("run").alias("_newest"))  # a row for each book and tier
    out = rows.withColumn("_tier", tier).join(F.broadcast(newest), ["pair", "_tier", "book"], "left")
    status = F.when(verdict & (F.col("run") < F.col("_newest")), F.concat(F.lit("superseded-by run "), F.col("_newest").cast("string"))).otherwise(F.col("status"))
    return out.withColumn("status", status).select(*rows.columns)


def accepted(rulings: DataFrame) -> DataFrame:
    """shape of what rulings accept."""
    return rulings.filter("action = 'accept'").select(*by(rulings), shape().alias("shape")).distinct()


def pinned(rows: DataFrame, rulings: DataFrame) -> DataFrame:
    """rows with a row of method ruling for each accepted shape that no standing row has; of several rulings on a shape one makes it."""
    own = rulings.filter("action = 'accept'").withColumn("_shape", shape())
    own = own.join(rows.filter(standing()).select(*by(rows), shape().alias("_shape")), by(rows, "_shape"), "left_anti")
    relation = F.coalesce(F.nullif("relation", F.lit("")), F.lit("renders"))
    one = own.groupBy(*by(rows, "_shape")).agg(F.min(F.struct(relation.alias("relation"), F.coalesce("source", F.lit("")).alias("s"), "pair", "source_words", "target_words")).alias("r"))
    made = {"key": F.concat(F.lit("ruling:"), F.col("_shape")), "method": F.lit("ruling"), "source": F.lit("a ruling"), "relation": F.col("r.relation"), "pair": F.col("r.pair"), "source_words": F.col("r.source_words"), "target_words": F.col("r.target_words"), "support": F.lit(False), "laid": F.lit(False)} | {c: F.col(c) for c in by(rows)}
    fresh = one.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(fresh)


def narrowed(rows: DataFrame, rulings: DataFrame) -> DataFrame:
    """Laid number rows without the words that standing verdicts call absent; a pinned shape stays as it is."""
    verdicts = rows.filter(standing() & (F.col("method") == "evidentia") & absent())
    words = each_word(verdicts, gone(), "pair").distinct()
    laid = rows.filter(standing() & (F.col("method") == "strong") & F.col("laid") & ~absent())
    laid = laid.withColumn("shape", shape()).join(accepted(rulings), by(rows, "shape"), "left_anti").drop("shape")
    return without(rows, lost_words(laid, words, F.lit(True)), "withdrawn-by evidentia", "narrowed-by evidentia", "/evidentia")


def shaped(rows: DataFrame, rulings: DataFrame) -> DataFrame:
    """rows with shape, rank (of the row), link_rank and settles: of a shape's standing rows the first settles it, those of other relations go.

    First is the highest rank, the surer (stated rows are surest), then by method, source and key. A link ranks as its settling row,
    absences have ranks of their own, and an accepted shape is above all.
    """
    own = merge.rank(F.col("method"), F.col("confidence"), F.col("tier"), F.col("laid"))
    rows = rows.withColumn("shape", shape()).withColumn("rank", own.cast("long"))
    order = Window.partitionBy(*by(rows, "shape"), standing()).orderBy(F.col("rank").desc(), F.coalesce(F.col("confidence"), F.lit(2.0)).desc(), "method", "source", "key")
    top = F.first(F.struct("relation", "method", "rank")).over(order)
    rows = rows.withColumn("_top", top).withColumn("_first", F.row_number().over(order) == 1)
    pins = accepted(rulings).withColumn("_pinned", F.lit(True))
    rows = rows.join(pins, by(rows, "shape"), "left")
    link = F.when(F.col("_pinned"), PINNED).otherwise(merge.standing_rank(F.col("_top.method"), F.col("_top.relation"), F.col("_top.rank")))
    status = F.when(standing() & (F.col("relation") != F.col("_top.relation")), F.concat(F.lit("withdrawn-by "), F.col("_top.method"))).otherwise(F.col("status"))
    settles = standing() & F.col("_first")
    return rows.select(*[c for c in rows.columns if c not in ("_top", "_first", "_pinned", "status")], link.cast("long").alias("link_rank"), settles.alias("settles"), F.coalesce("_pinned", F.lit(False)).alias("pinned"), status.alias("status"))


def unsupported(rows: DataFrame) -> DataFrame:
    """Links all of whose standing rows may only support others, unless a ruling accepts their shape."""
    link = Window.partitionBy(*by(rows, "shape"), standing())
    alone = F.bool_and(F.coalesce("support", F.lit(False))).over(link) & ~F.bool_or("pinned").over(link)
    return rows.withColumn("_alone", alone).withColumn("status", F.when(standing() & F.col("_alone"), "unsupported").otherwise(F.col("status"))).select(*rows.columns)


def giving_way(rows: DataFrame) -> DataFrame:
    """The link rank of a verdict's absence falls to the lowest where a correspondence that not the aligner alone claims names its word."""
    claims = F.bool_or(~absent() & (F.col("method") != "aligner")).over(Window.partitionBy(*by(rows, "shape"), standing()))
    live = rows.withColumn("_claims", claims).filter(standing() & F.col("settles"))
    held = each_word(live.filter("_claims"), sided(), "pair").distinct()
    verdicts = each_word(live.filter((F.col("method") == "evidentia") & absent() & ~F.col("pinned")), gone(), "shape", "pair")
    found = verdicts.join(held, by(rows, "pair", "side", "word"), "left_semi").select(*by(rows, "shape")).distinct().withColumn("_way", F.lit(True))
    return rows.join(found, by(rows, "shape"), "left").withColumn("link_rank", F.when(standing() & F.col("_way"), GIVES_WAY).otherwise(F.col("link_rank"))).select(*rows.columns)


def crossing(rows: DataFrame, verse_of: DataFrame, joined: DataFrame) -> DataFrame:
    """Links that only machines claim and that hold words of two verses which stand at different addresses and no verse link joins.

    verse_of: side, word, verse, address (null: none); joined: verse, other (of the two sides, either way round).
    """
    machine = rows.filter(standing()).groupBy("shape").agg(F.bool_and(F.col("method").isin(*MACHINES)).alias("m")).filter("m").select("shape")
    links = rows.filter(standing() & F.col("settles")).join(machine, "shape", "left_semi")

    def verses(side: str) -> DataFrame:
        at = verse_of.filter(F.col("side") == side).select("word", "verse", "address")
        return links.select("shape", F.explode(SIDES[side]).alias("word")).join(at, "word").filter("address IS NOT NULL").select("shape", F.col("verse").alias(f"{side}_verse"), F.col("address").alias(f"{side}_at")).distinct()

    either = joined.select(F.col("verse").alias("source_verse"), F.col("other").alias("target_verse"))
    either = either.unionByName(either.select(F.col("target_verse").alias("source_verse"), F.col("source_verse").alias("target_verse"))).distinct()
    apart = verses("source").join(verses("target"), "shape").filter("source_at <> target_at").join(either, ["source_verse", "target_verse"], "left_anti")
    return marked(rows, apart.select("shape").distinct(), "withdrawn-by unjoined-verses", "shape")


def against(links: DataFrame) -> DataFrame:
    """links (link, pair, method, absence, rank, words: array of words with their text) with the status of the contest of two pairs.

    An absence of one pair and a rendering of the other that share a word are opponents. In the order of rank, correspondences before
    absences, then pair and link, a link that an opponent before it keeps from the word is withdrawn; a link that only lost
    opponents stand before is kept. Links with a column ``segment`` meet within it: they stream by in this order, and a segment's first
    kept link of each word and pair is held. Without it, each round decides all links no undecided opponent stands before.
    """
    if "segment" in links.columns:
        return _against_in_order(links)
    spark = links.sparkSession
    order = F.struct((-F.col("rank")).alias("r"), F.col("absence").cast("int").alias("a"), "pair", "link")
    each = links.select("link", "pair", "method", "absence", order.alias("o"), F.explode("words").alias("word"))
    a, b = each.filter("absence").alias("a"), each.filter("NOT absence").alias("b")
    met = a.join(b, "word").filter("a.pair <> b.pair").select(*[F.col(f"{x}.{c}").alias(f"{n}_{c}") for x, n in (("a", "x"), ("b", "y")) for c in ("link", "pair", "method", "o")]).distinct()
    first = F.col("x_o") < F.col("y_o")
    one = lambda c, yes: F.when(yes, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    edges = met.select(*[one(c, first).alias(c) for c in ("link", "method", "pair", "o")], *[one(c, ~first).alias(f"later_{c}") for c in ("link",)])
    path = scratch(spark, "contests")
    edges.write.parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges")
    ends = edges.select("link").unionByName(edges.select(F.col("later_link").alias("link"))).distinct()
    state, turn = ends.select("link", F.lit(None).cast("string").alias("fate"), F.lit(None).cast("string").alias("by")), 0
    while True:
        state.write.parquet(f"{path}/{turn}")
        if turn:
            drop(spark, f"{path}/{turn - 1}")
        state = spark.read.parquet(f"{path}/{turn}")
        if state.filter("fate IS NULL").isEmpty():
            break
        before = edges.join(state.select("link", F.col("fate").alias("_f")), "link")
        seen = before.groupBy(F.col("later_link").alias("link")).agg(
            F.min(F.when(F.col("_f") == "kept", F.struct("o", F.concat_ws(" in ", "method", F.col("pair").cast("string")).alias("by")))).alias("winner"),
            F.count_if(F.col("_f").isNull()).alias("open"),
            F.min(F.when(F.col("_f").isNull(), F.col("o"))).alias("first_open"),
        )
        # the winner is the first one kept: none still open may stand before it
        sure = F.col("winner").isNotNull() & (F.col("first_open").isNull() | (F.col("winner.o") < F.col("first_open")))
        fate = F.when(sure, "lost").when(F.coalesce("open", F.lit(0)) == 0, "kept")
        state = state.join(seen, "link", "left").select("link", F.coalesce("fate", fate).alias("fate"), F.coalesce("by", F.when(sure, F.col("winner.by"))).alias("by"))
        turn += 1
    lost = state.filter("fate = 'lost'").select("link", F.concat(F.lit("withdrawn-by "), "by").alias("status"))
    return links.join(lost, "link", "left")


def _against_in_order(links: DataFrame) -> DataFrame:
    names = links.columns

    def run(batches):
        now, kept_first, at = None, {}, 0  # (absence, word) -> pair -> place in the order and name of its first kept link
        for batch in batches:
            status = []
            for segment, pair, method, absence, words in zip(*(batch.column(names.index(c)).to_pylist() for c in ("segment", "pair", "method", "absence", "words"))):
                if segment != now:
                    now, kept_first, at = segment, {}, 0
                if pair is None or absence is None:
                    status.append(None)
                    continue
                own = [w for w in words or () if w is not None]
                winners = [first for w in own for other, first in kept_first.get((not absence, w), {}).items() if other != pair]
                status.append(f"withdrawn-by {min(winners)[1]}" if winners else None)
                if not winners:
                    at += 1
                    for w in own:
                        kept_first.setdefault((absence, w), {}).setdefault(pair, (at, " in ".join(str(v) for v in (method, pair) if v is not None)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string())], [*names, "status"])

    schema = T.StructType([*links.schema.fields, T.StructField("status", T.StringType())])
    return links.repartition("segment").sortWithinPartitions("segment", F.col("rank").desc_nulls_first(), "absence", "pair", "link").mapInArrow(run, schema).drop("segment")


def decided(rows: DataFrame, rulings: DataFrame, floors: DataFrame | None = None, keep=kept) -> DataFrame:
    """All passes before the competition, in order; ``keep`` cuts the lineage between them, as each reads its rows several times."""
    rows = keep(refused(rows, rulings))
    rows = floored(rows, floors) if floors is not None else rows
    rows = keep(pinned(superseded(rows), rulings))
    rows = keep(narrowed(rows, rulings))
    return giving_way(keep(unsupported(shaped(rows, rulings))))
