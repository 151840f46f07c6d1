"""Making and choosing links between two sides, with confidences; null confidence means stated, the surest."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of an alignment table that is held whole (32 MB); larger ones are held in part.
CELLS = 1 << 22


def sure(confidence) -> F.Column:
    """A confidence in a product: a stated one counts as 1."""
    return F.coalesce(confidence, F.lit(1.0))


def compose(first: DataFrame, second: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """a -> b (c1) and b -> c (c2): a -> c with the greatest product over paths, a stated hop counting as 1.

    With ``segments`` (seg_a, seg_c), only paths whose ends stand in segments that belong together; first then has seg_a, second seg_c.
    """
    # the best of each hop first: a word that many hops share then counts once a neighbour on either side
    best = lambda df, by, c: df.groupBy(*by).agg(F.max(sure(F.col(c))).alias(c))
    if segments is None:
        paths = best(first, ["a", "b"], "c1").join(best(second, ["b", "c"], "c2"), "b")
    else:
        paths = best(first, ["seg_a", "a", "b"], "c1").join(best(second, ["seg_c", "b", "c"], "c2"), "b")
        paths = paths.join(segments.select("seg_a", "seg_c").distinct(), ["seg_a", "seg_c"], "left_semi")
    return paths.groupBy("a", "c").agg(F.max(F.col("c1") * F.col("c2")).alias("confidence"))


#: Precision of composed paths by the number of words of the middle link, 1 to 5 and more (fixed values).
PRECISION_BY_SIZE = [0.891, 0.804, 0.710, 0.698, 0.563]


def specificity(size) -> F.Column:
    """Weight of a path by the number of words of its middle link, 1 for one word."""
    return F.get(F.array(*[F.lit(p / PRECISION_BY_SIZE[0]) for p in PRECISION_BY_SIZE]), (F.least(F.greatest(size, F.lit(1)), F.lit(5)) - 1).cast("int"))


def segment_pairs(left: DataFrame, right: DataFrame, linked: DataFrame) -> DataFrame:
    """seg_a, seg_c of segments at the same address, or that a segment link joins in either direction; left and right: seg, address."""
    same = left.select(F.col("seg").alias("seg_a"), "address").join(right.select(F.col("seg").alias("seg_c"), "address"), "address").select("seg_a", "seg_c")
    stated = both_ways(linked, "a", "b").select(F.col("a").alias("seg_a"), F.col("b").alias("seg_c"))
    own = stated.join(left.select(F.col("seg").alias("seg_a")), "seg_a", "left_semi").join(right.select(F.col("seg").alias("seg_c")), "seg_c", "left_semi")
    return same.unionByName(own.select("seg_a", "seg_c")).distinct()


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that are stored either way round, each in both directions; two directed selects, so that joins stay equi-joins."""
    other = [F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in pairs.columns]
    return pairs.unionByName(pairs.select(*other))


def bridged(members: DataFrame, links: DataFrame) -> DataFrame:
    """The words that links join: members (link, side, word), links (link, ...) -> source, target and the link's columns."""
    side = lambda k, name: members.filter(F.col("side") == k).select("link", F.col("word").alias(name))
    return links.join(side(0, "source"), "link").join(side(1, "target"), "link")


def noisy_or(claims: DataFrame, pair: list[str], family: str, confidence: str, cap: float = 0.98) -> DataFrame:
    """The greatest claim of each family; families are independent: 1 - product(1 - c), cap at most. A stated claim makes the result stated."""
    stated = F.max(F.col(confidence).isNull().cast("int"))
    best = claims.groupBy(*pair, family).agg(F.max(confidence).alias("c"), stated.alias("s"))
    together = F.least(F.lit(cap), 1 - F.exp(F.sum(F.log1p(-F.least(F.col("c"), F.lit(1 - 1e-15))))))
    return best.groupBy(*pair).agg(F.when(F.max("s") == 0, together).alias("confidence"), F.count("*").alias("families"))


def best_per_source(links: DataFrame, source: str, *order) -> DataFrame:
    """All links of a source's best rank; exact ties stay. Order confidences by desc_nulls_first: a stated link is the surest."""
    return links.withColumn("_r", F.rank().over(Window.partitionBy(source).orderBy(*order))).filter("_r = 1").drop("_r")


def most_families(answers: DataFrame, source: str, families: str, confidence: str) -> DataFrame:
    """Of a source's answers those that most families found, of these the surest; ties stay."""
    return best_per_source(answers, source, F.col(families).desc(), F.col(confidence).desc_nulls_first())


def proposals(offered: DataFrame, source: str, target: str, confidence: str, least: float = 0.25, crowd: int = 4) -> DataFrame:
    """Proposals that may be selected: none of targets that ``crowd`` sources and more only weakly propose, none below the
    threshold, and of a pair offered twice the surest. Stated ones are above any threshold."""
    c = F.coalesce(F.col(confidence), F.lit(2.0))
    of_target = Window.partitionBy(target)
    marked = offered.withColumn("_n", F.count("*").over(of_target)).withColumn("_most", F.max(c).over(of_target))
    kept = marked.filter(((F.col("_n") < crowd) | (F.col("_most") >= least)) & (c >= least)).drop("_n", "_most")
    return best_per_pair(kept, [source, target], confidence)


def best_per_pair(offered: DataFrame, pair: list[str], confidence: str) -> DataFrame:
    loudest = F.max_by(F.struct(*[F.col(x) for x in offered.columns]), F.struct(F.coalesce(F.col(confidence), F.lit(2.0)), *[F.col(x) for x in offered.columns if x not in (*pair, confidence)]))
    return offered.groupBy(*pair).agg(loudest.alias("_row")).select("_row.*")


def agreed(forward: DataFrame, backward: DataFrame, pair: list[str], confidence: str, level: float) -> DataFrame:
    """Selected links that are sure, or that the other direction selects as well."""
    other = backward.select(*pair).distinct().withColumn("_other", F.lit(True))
    both = forward.join(other, pair, "left")
    return both.filter(F.col(confidence).isNull() | (F.col(confidence) >= level) | F.col("_other")).drop("_other")


def admission_floor(answers: DataFrame, route: str, confidence: str, hit: str, least: int = 200, precision: float = 0.9) -> DataFrame:
    """Per route the lowest confidence from which, cumulated from the top with ties together, precision holds over enough answers.

    1.01 refuses a route that never gets there; a route with too few answers has no floor. Stated answers have no confidence and
    are left out. Ties are counted before the window, which then holds a row for each confidence that occurs.
    """
    counted = answers.filter(F.col(confidence).isNotNull()).groupBy(route, F.col(confidence).alias("c")).agg(F.count("*").alias("k"), F.sum(F.col(hit).cast("long")).alias("h"))
    above = Window.partitionBy(route).orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = counted.select(route, "c", F.sum("k").over(above).alias("n"), F.sum("h").over(above).alias("hits"))
    good = (F.col("n") >= least) & (F.col("hits") >= precision * F.col("n"))
    found = seen.groupBy(route).agg(F.max("n").alias("answers"), F.min(F.when(good, F.col("c"))).alias("floor"))
    return found.withColumn("floor", F.when(F.col("answers") >= least, F.coalesce("floor", F.lit(1.01))))


def floors(routes: DataFrame, measured: DataFrame, hand: DataFrame) -> DataFrame:
    """The floor of each text's route: set by hand, else measured, else borrowed: the lowest of any other text for the same
    route (ties by text), else 1.01, refused. routes, measured and hand: text, route (, floor)."""
    low = Window.partitionBy("route").orderBy("floor", "text")
    # a text's own measure counts before borrowing, so the lowest two others are never needed
    lent = measured.filter("floor <= 1").withColumn("_r", F.row_number().over(low)).filter("_r = 1").select("route", F.col("floor").alias("lent"), F.col("text").alias("lender"))
    out = routes.join(hand.withColumnRenamed("floor", "by_hand"), ["text", "route"], "left").join(measured.withColumnRenamed("floor", "own"), ["text", "route"], "left").join(lent, "route", "left")
    floor = F.coalesce("by_hand", "own", "lent", F.lit(1.01))
    origin = F.when(F.col("by_hand").isNotNull(), "hand").when(F.col("own").isNotNull(), "measured").when(F.col("lent").isNotNull(), "borrowed").otherwise("refused")
    return out.select("text", "route", floor.alias("floor"), origin.alias("origin"), F.when(origin == "borrowed", F.col("lender")).alias("lender"))


#: Confidences of number matching: settled, paired in order, one side contended, both (fixed values), and the loss by a redirect.
SETTLED, IN_ORDER, ONE_CONTENDED, BOTH_CONTENDED, REDIRECT_LOSS = 0.9, 0.7, 0.5, 0.3, 0.1


def number_match(tagged: DataFrame, witness: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """seg, numbers, words, witnesses, confidence: one link for each set of numbers of a segment.

    tagged: seg, id, numbers (array); witness: seg, id, number; redirects: number, other. A number that the segment's witness lacks
    is read as the one it redirects to, at a loss of 0.1. Words with the same set of reachable numbers and the witness
    words that carry one of them are one link, except that a single number with equal counts over one is paired in order.
    """
    has = witness.select("seg", "number").distinct().withColumn("_own", F.lit(True))
    each = tagged.select("seg", "id", F.explode(F.array_distinct("numbers")).alias("number")).join(has, ["seg", "number"], "left")
    if redirects is not None:
        other = has.select("seg", F.col("number").alias("other"), F.col("_own").alias("_theirs"))
        each = each.join(redirects.select("number", "other"), "number", "left").join(other, ["seg", "other"], "left")
        each = each.withColumn("redirected", F.col("_own").isNull() & F.col("_theirs").isNotNull())
        each = each.withColumn("number", F.when(F.col("redirected"), F.col("other")).otherwise(F.col("number"))).filter("_own OR _theirs")
    else:
        each = each.filter("_own").withColumn("redirected", F.lit(False))
    sets = each.groupBy("seg", "id").agg(F.sort_array(F.collect_set("number")).alias("numbers"), F.max("redirected").alias("redirected"))
    words = sets.groupBy("seg", "numbers").agg(F.sort_array(F.collect_list("id")).alias("words"), F.max("redirected").alias("redirected"))
    carried = words.select("seg", "numbers", F.explode("numbers").alias("number")).join(witness.select("seg", "number", "id"), ["seg", "number"])
    both = words.join(carried.groupBy("seg", "numbers").agg(F.sort_array(F.collect_set("id")).alias("witnesses")), ["seg", "numbers"])
    n, m = F.size("words"), F.size("witnesses")
    ordered = (F.size("numbers") == 1) & (n == m) & (n > 1)
    settled = (n == 1) & (m == F.size("numbers"))
    ladder = F.when(ordered, IN_ORDER).when(settled, SETTLED).when((n == 1) | (m == 1), ONE_CONTENDED).otherwise(BOTH_CONTENDED)
    whole = both.withColumn("confidence", F.round(ladder - F.when(F.col("redirected"), REDIRECT_LOSS).otherwise(0.0), 6))
    pairs = F.when(ordered, F.arrays_zip("words", "witnesses"))
    one = whole.withColumn("_pair", F.explode_outer(pairs))
    pick = lambda side: F.when(F.col("_pair").isNotNull(), F.array(F.col(f"_pair.{side}"))).otherwise(F.col(side)).alias(side)
    return one.select("seg", "numbers", pick("words"), pick("witnesses"), "confidence")


def nth_occurrence(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """The nth row of a group meets the nth of the other side's."""
    nth = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    return nth(left).withColumnRenamed(order, f"{order}_1").join(nth(right).withColumnRenamed(order, f"{order}_2"), [*by, "n"])


def competitive(links: DataFrame, segment: str) -> DataFrame:
    """Greedy one to one within a segment: stated links first, then by confidence, then a, then b. Segments stream by, sorted, within a partition."""
    names = links.columns

    def run(batches):
        now, taken_a, taken_b = None, set(), set()
        for pdf in batches:
            good = []
            for s, a, b in zip(pdf[segment], pdf["a"], pdf["b"], strict=True):
                if s != now:
                    now, taken_a, taken_b = s, set(), set()
                good.append(free := a not in taken_a and b not in taken_b)
                if free:
                    taken_a.add(a)
                    taken_b.add(b)
            yield pdf[good][names]

    return links.repartition(segment).sortWithinPartitions(segment, F.col("confidence").desc_nulls_first(), "a", "b").mapInPandas(run, links.schema)


def align_score(proposed: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall and alignment error rate, 1 - F1 of distinct pairs; nothing right is an error of 1."""
    p, g = proposed.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    n = p.join(g, keys, "full").agg(F.count("p").alias("proposed"), F.count("g").alias("gold"), F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("hits"))
    share = lambda c: F.when(F.col(c) > 0, F.col("hits") / F.col(c)).otherwise(0.0)
    return n.select("proposed", "gold", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.round(share("proposed"), 6).alias("precision"), F.round(share("gold"), 6).alias("recall"), F.round(F.when(F.col("hits") > 0, 1 - 2 * F.col("hits") / (F.col("proposed") + F.col("gold"))).otherwise(1.0), 6).alias("aer"))


#: What a shift of the log-odds is worth by how the neighbours' partners stand to a pair's own (fixed values).
COHESION = {"alone": -0.325, "apart": -0.573, "sentence": -0.376, "clause": 0.024, "phrase": 0.349}


def rescored(confidence, weight):
    """Log-odds shift of a confidence, clamped to .001 .. .98; a stated one stays stated."""
    c = F.least(F.greatest(confidence, F.lit(0.001)), F.lit(0.98))
    odds = c / (1 - c) * F.exp(weight)
    return F.when(confidence.isNotNull(), F.least(F.greatest(odds / (1 + odds), F.lit(0.001)), F.lit(0.98)))


def cohesion(offered: DataFrame, target: DataFrame, reach: int = 3, anchor: float = 0.5) -> DataFrame:
    """offered (seg, position, word, confidence) rescored by its neighbours in the source text.

    Anchors are proposals of at least ``anchor`` at most ``reach`` positions away in the same segment. target (word, phrase, clause,
    sentence) says where words stand. The closest unit that a proposal's word shares with any anchor's word decides.
    """
    at = offered.join(target, "word").withColumn("_id", F.struct("seg", "position", "word"))
    near = at.filter(F.col("confidence").isNull() | (F.col("confidence") >= anchor)).select("seg", F.col("position").alias("_p"), F.col("word").alias("_w"), *[F.col(u).alias(f"_{u}") for u in ("phrase", "clause", "sentence")])
    # a place is asked for from each position in reach, so that the join is by equality
    near = near.withColumn("position", F.explode(F.sequence(F.col("_p") - reach, F.col("_p") + reach))).filter("position <> _p")
    level = F.when(F.col("_w").isNull(), 0).when(F.col("phrase") == F.col("_phrase"), 4).when(F.col("clause") == F.col("_clause"), 3).when(F.col("sentence") == F.col("_sentence"), 2).otherwise(1)
    best = at.join(near, ["seg", "position"], "left").groupBy("seg", "position", "word", "confidence").agg(F.max(level).alias("level"))
    weight = F.get(F.array(*[F.lit(COHESION[k]) for k in ("alone", "apart", "sentence", "clause", "phrase")]), "level")
    return best.withColumn("confidence", rescored(F.col("confidence"), weight))


def one_edit(x: str, y: str) -> bool:
    """Equal, or one letter put in, left out or changed."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    k = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[k + (len(x) == len(y)) :] == y[k + 1 :]


def spelt_alike(a: list[str], b: list[str]) -> dict[str, dict[str, int]]:
    """The words of b equal to each word of a (8) or one edit from it (6). One edit leaves the first or the second half of b's word."""
    halves = defaultdict(list)
    for y in sorted(set(b)):
        h = len(y) // 2
        halves[len(y), y[:h], None].append(y)
        halves[len(y), None, y[h:]].append(y)
    out = {}
    for x in set(a):
        out[x] = own = {}
        for size in range(max(0, len(x) - 1), len(x) + 2):
            h = size // 2
            for y in (*halves.get((size, x[:h], None), ()), *halves.get((size, None, x[max(0, len(x) - size + h) :]), ())):
                if y not in own and one_edit(x, y):
                    own[y] = 8 if x == y else 6
    return out


def aligned(a: list, b: list, worth: dict, cells: int = CELLS) -> tuple[list[int], list[int]]:
    """Places of a and b (-1: none) in a global alignment of the most worth; worth[x][y] > 0, gaps cost nothing, other pairs are refused.

    Ties, from the end: pair, gap right, gap left. A row of the table is the one before where its word has no like, else a running
    maximum. Over cells, only every k-th row is kept, k about the root of their number, and the rows between are made again.
    """
    n, m = len(a), len(b)
    where = defaultdict(list)
    for j, y in enumerate(b):
        where[y].append(j)
    spots = {}
    for x, own in worth.items():
        at = [(j, w) for y, w in own.items() for j in where.get(y, ())]
        spots[x] = (np.array([j for j, _ in at], np.int64), np.array([w for _, w in at], np.int64)) if at else None

    def rows(row, lo, hi):
        for i in range(lo, hi):
            if (spot := spots.get(a[i])) is not None:
                at, w = spot
                new = row.copy()
                new[at + 1] = np.maximum(row[at + 1], row[at] + w)
                row = np.maximum.accumulate(new)
            yield row

    step = max(1, n if (n + 1) * (m + 1) <= cells else math.isqrt(n) + 1)
    marks = {0: np.zeros(m + 1, np.int64)}
    if step < n:
        marks |= {i: row for i, row in enumerate(rows(marks[0], 0, n), 1) if i % step == 0}
    left, right, i, j, low, block = [], [], n, m, n + 1, []
    while i or j:
        if i and i <= low:
            low = (i - 1) // step * step
            block = [marks[low], *rows(marks[low], low, i)]
        w = worth.get(a[i - 1], {}).get(b[j - 1], 0) if i and j else 0
        if w and block[i - low][j] == block[i - 1 - low][j - 1] + w:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
        elif i and (not j or block[i - low][j] == block[i - 1 - low][j]):
            i -= 1
            left.append(i)
            right.append(-1)
        else:
            j -= 1
            left.append(-1)
            right.append(j)
    return left[::-1], right[::-1]


def witness_alignment(a: list[str], b: list[str], cells: int = CELLS) -> list[tuple[int | None, int | None, int]]:
    """Global alignment of two token lists: equal 4, one edit apart 2, else -9; gap -2. Ties: pair, gap right, gap left.

    With 2 added for each token, gaps cost nothing, equal tokens are worth 8 and near ones 6, and no other pair is ever taken.
    """
    worth = spelt_alike(a, b)
    return [(None if i < 0 else i, None if j < 0 else j, -2 if i < 0 or j < 0 else worth[a[i]][b[j]] - 4) for i, j in zip(*aligned(a, b, worth, cells), strict=True)]


def align_segments(pairs: DataFrame) -> DataFrame:
    """seg, a, b (token arrays, null as empty): one row per aligned position of the whole lists."""

    def frame(rows):
        return pd.DataFrame(rows, columns=["seg", "step", "i", "j", "value"]).astype({"i": "Int64", "j": "Int64"})

    def run(batches):
        for pdf in batches:
            rows = []
            for s, a, b in zip(pdf["seg"], pdf["a"], pdf["b"], strict=True):
                rows += [(s, k, i, j, v) for k, (i, j, v) in enumerate(witness_alignment([] if a is None else list(a), [] if b is None else list(b)))]
                if len(rows) > 50_000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return pairs.mapInPandas(run, "seg long, step long, i long, j long, value long")


def interlinear(left: DataFrame, right: DataFrame, form: str = "form") -> DataFrame:
    """seg, form, nth, a, b: the nth word of a folded form in a segment meets the other text's nth of that form. left and right: seg, position, form."""
    return nth_occurrence(left, right, ["seg", form], "position").withColumnRenamed("n", "nth").withColumnRenamed("position_1", "a").withColumnRenamed("position_2", "b")


def placed_names(offers: DataFrame, signals: list[str], measured: str) -> DataFrame:
    """Offers that two signals bear out, or one where its precision was measured."""
    n = sum((F.coalesce(F.col(s), F.lit(False)).cast("int") for s in signals), F.lit(0))
    return offers.withColumn("signals", n).filter((n >= 2) | ((n == 1) & F.coalesce(F.col(measured), F.lit(False))))


def skeleton(name: str) -> str:
    """A name's consonants, doubled ones once."""
    bare = [x for x in name.lower() if x.isalpha() and x not in "aeiouy"]
    return "".join(x for k, x in enumerate(bare) if not k or bare[k - 1] != x)


def name_likeness(a: str, b: str) -> float:
    """2 LCS / (len + len) of two skeletons; names without consonants are unlike any."""
    a, b = skeleton(a), skeleton(b)
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def match_names(lists: DataFrame, least: float = 0.6) -> DataFrame:
    """seg, i, j, likeness: names of two lists (a, b) of a segment that match in the order of both, of the greatest sum of likeness."""

    def run(batches):
        for pdf in batches:
            rows = []
            for s, a, b in zip(pdf["seg"], pdf["a"], pdf["b"], strict=True):
                a, b = ([] if x is None else [str(w) for w in x] for x in (a, b))
                like = {x: {y: v for y in set(b) if (v := round(1_000_000 * name_likeness(x, y))) >= 1_000_000 * least} for x in set(a)}
                rows += [(s, i, j, like[a[i]][b[j]] / 1_000_000) for i, j in zip(*aligned(a, b, like), strict=True) if i >= 0 and j >= 0]
            yield pd.DataFrame(rows, columns=["seg", "i", "j", "likeness"])

    return lists.mapInPandas(run, "seg long, i long, j long, likeness double")


def latest(log: DataFrame, key: list[str], *order) -> DataFrame:
    """The last entry of each key of an append-only log, with the number of its entries."""
    w = Window.partitionBy(*key)
    return log.withColumn("entries", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).filter("_r = 1").drop("_r")


def exchanged(left: DataFrame, right: DataFrame, anchors: DataFrame) -> DataFrame:
    """seg, a, b: words without a link between the same two anchors in a row on both sides, as many on both sides, paired in order.

    left and right: seg, position; anchors: seg, a, b, one to one and rising on both sides within a segment.
    """
    def gaps(words: DataFrame, mine: str) -> DataFrame:
        at = words.select("seg", "position").join(anchors.select("seg", F.col(mine).alias("position"), F.struct("a", "b").alias("link")), ["seg", "position"], "left")
        order = Window.partitionBy("seg").orderBy("position")
        before = F.last("link", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first("link", True).over(order.rowsBetween(0, Window.unboundedFollowing))
        free = at.withColumn("before", before).withColumn("after", after).filter("link IS NULL AND before IS NOT NULL AND after IS NOT NULL")
        gap = Window.partitionBy("seg", "before", "after")
        return free.select("seg", "before", "after", F.col("position").alias(mine), F.count("*").over(gap).alias("n"), F.row_number().over(gap.orderBy("position")).alias("k"))

    return gaps(left, "a").join(gaps(right, "b"), ["seg", "before", "after", "n", "k"]).select("seg", "a", "b")
