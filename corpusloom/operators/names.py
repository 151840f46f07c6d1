"""Name consensus: the name of an entity in a text, read off the verses that name it.

The words that an entity's verses print and others do not are filed under the letters they share (cores), so that the cases and
spellings of one name stand together. A cluster of forms scores by coverage (the share of the entity's verses that print one of
them) times specificity (the share of the verses printing one, apart from a namesake's own, that are the entity's); each verse
counts once. The best cluster is the name, its margin the distance to the best one that shares no form with it. Words that another
entity of the verse has as good a claim on name neither.

Everything is joins and aggregates. Forms are counted by the entities of their verses, so verses of the same entities count together, and
gathered by core once. How many verses a cluster covers lies between what its most printed form covers and what all do together, which
bounds its score; only clusters whose bounds leave open whether they are the best, or its best rival, meet the verses. What these have is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages
from ..session import kept

#: Specificity of a form by kind, least coverage of a name, capitals by which a form or a text counts as capitalised (fixed values).
SPECIFICITY = {"person": 0.5, "place": 0.5, "people": 0.5, "title": 0.7, "object": 0.7, "observance": 0.7, "term": 0.7}
COVERAGE, CAPITALISED, MARKS_NAMES = 0.3, 0.5, 0.02
#: Kinds whose forms are refused when a text that marks names with capitals prints them mostly in lower case (fixed values).
PROPER = ("person", "place")
#: Letters of a core at least, and letters around it at most, by script; and for names too short for a core (fixed values).
SCRIPTS = {"[一-鿿㐀-䶿]": (2, 2), "[가-힯]": (2, 4), "[ሀ-፿]": (2, 3)}
ALPHABET, SHORTEST, SHORT_AFFIXES = (3, 4), 2, 2
#: Words of which nothing but the case goes (fixed value).
LATIN = "[A-Za-z0-9À-ÖØ-öø-ÿ]"
#: Scores within this of the best are as good: the longest core of them is the name (fixed value).
AS_GOOD = 0.01
#: By so much bounds of a score are wider than computed (fixed value).
SLACK = 1e-9


def folded(surface: Column) -> Column:
    """Lower case without the marks that a script writes at will, alifs as one; letters, their marks and digits only."""
    bare = languages.fold(languages.bare_greek(languages.fold(surface, "hbo")), "arb")
    bare = F.regexp_replace(F.translate(bare, "إأآ", "ااا"), r"[^\p{L}\p{M}\p{Nd}]", "")
    return F.when(surface.rlike(rf"\A{LATIN}*\z"), F.lower(surface)).otherwise(bare)


def folded_all(df: DataFrame, surfaces: str, name: str) -> DataFrame:
    """df with the distinct forms of its surfaces; Latin ones are lowered as one text, unless one of them holds the sign that joins them."""
    df = df.withColumn("_each", F.array_distinct(surfaces)).withColumn("_lines", F.array_join("_each", "\n"))
    df = df.withColumn("_lower", F.when(F.col("_lines").rlike(rf"\A[\n{LATIN[1:]}*\z"), F.split(F.lower("_lines"), "\n")))
    df = df.withColumn("_forms", F.when(F.size("_lower") == F.size("_each"), F.col("_lower")).otherwise(F.transform("_each", folded)))
    return df.withColumn(name, F.array_distinct(F.array_remove("_forms", ""))).drop("_each", "_lines", "_lower", "_forms")


def script(form: Column, at: int) -> Column:
    """Least core (0) or most affixes (1) of a form's script."""
    out = F.lit(ALPHABET[at])
    for letters, facts in SCRIPTS.items():
        out = F.when(form.rlike(letters), facts[at]).otherwise(out)
    return out


def cores(form: Column) -> Column:
    """The pieces of a form that it may share with other spellings: all but a few of its letters, at least half of them."""
    long, least = F.length(form), script(form, 0)
    shortest = F.greatest(least, long - script(form, 1), F.floor((long + 1) / 2).cast("int"))
    pieces = F.flatten(F.transform(F.sequence(F.least(shortest, long), long), lambda n: F.transform(F.sequence(F.lit(1), long - n + 1), lambda at: F.substring(form, at, n))))
    return F.when(long >= least, F.array_distinct(pieces)).when(long >= SHORTEST, F.array(form)).otherwise(F.array().cast("array<string>"))


def one_name(form: Column, lead: Column, core: Column) -> Column:
    """One form holds the other, or the core opens both or closes both."""
    return form.contains(lead) | lead.contains(form) | (form.startswith(core) & lead.startswith(core)) | (form.endswith(core) & lead.endswith(core))


def gathered(forms: DataFrame, particular: DataFrame) -> DataFrame:
    """Rows of ``forms`` (entity, form) once under each of their cores; a core under its script's least letters, a short name of
    ``particular``, also takes in forms that are longer by a few letters."""
    pieces = cores(F.col("form"))
    each = lambda df, made: df.withColumn("core", F.explode_outer(made)).filter("core IS NOT NULL")  # noqa: E731 (a plain explode makes them twice, to filter by their number)
    rows = each(forms, pieces)
    # a core has half of its form's letters at least, so longer forms have none that is short
    few = F.length("form") <= max(2 * (ALPHABET[0] - 1), ALPHABET[0] - 1 + SHORT_AFFIXES)
    short = each(particular.filter(few), pieces).select("entity", "core").filter(F.length("core") < script(F.col("core"), 0)).distinct()
    opens = F.transform(F.sequence(F.lit(1), F.lit(SHORT_AFFIXES)), lambda k: F.substring("form", F.lit(1), F.length("form") - k))
    longer = each(forms.filter(few), F.array_except(opens, pieces)).filter(F.length("core") >= SHORTEST)
    return rows.unionByName(longer.join(short, ["entity", "core"], "left_semi").select(*rows.columns))


def filed(particular: DataFrame, only: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """The forms of each core (or of the clusters ``only``: entity, core) that are one name with its lead: the form that most of the
    entity's verses print, then the first. ``forms`` are those of particular that may hold such a core."""
    rows = gathered(particular if forms is None else forms, particular)
    if only is not None:
        rows = rows.join(only.select("entity", "core"), ["entity", "core"], "left_semi")
    first = Window.partitionBy("entity", "core").orderBy(F.col("own").desc(), "form").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("lead", F.first("form").over(first)).filter(one_name(F.col("form"), F.col("lead"), F.col("core")))


def score(df: DataFrame) -> DataFrame:
    """df with coverage, specificity and score by its columns covered, printing and verses."""
    df = df.withColumn("coverage", F.col("covered") / F.col("verses")).withColumn("specificity", F.col("covered") / F.col("printing"))
    return df.withColumn("score", F.col("coverage") * F.col("specificity"))


def measured(clusters: DataFrame, particular: DataFrame, texts: DataFrame) -> DataFrame:
    """Clusters with their exact scores: those of one form by its counts, others by the verses that print one of their forms."""
    alone = clusters.filter("size = 1").select("entity", "core", "verses", F.col("most_own").alias("covered"), (F.col("most_own") + F.col("most_out")).alias("printing"))
    several = kept(clusters.filter("size > 1").select("entity", "core", "verses"), "consensus-several")
    members = kept(filed(particular, several).select("entity", "core", "form"), "consensus-members")
    at = texts.select("verse", "own", "beside", F.explode("forms").alias("form")).join(members, "form").filter(~F.array_contains("beside", F.col("entity")))
    at = at.select("entity", "core", "verse", F.array_contains("own", F.col("entity")).alias("mine")).distinct()
    counts = at.groupBy("entity", "core").agg(F.count_if("mine").alias("covered"), F.count("*").alias("printing"))
    return kept(score(alone.unionByName(counts.join(several, ["entity", "core"]))), "consensus-scores")


def found(words: DataFrame, entities: DataFrame, namesakes: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Findings (entity, kind, verses, core, forms, covered, coverage, specificity, score, margin), and what ``claimed`` takes.

    words: verse, word, surface; entities: entity, kind, verse; namesakes: entity, other (whom the original calls by one of its
    names); texts: verse, surfaces, the same words with each verse in one row, where these are at hand. An entity without verses in
    the text has no finding; one without a particular form has one without a name. Null verses, entities and surfaces take no part; of
    an entity with several kinds the first by name counts.
    """
    words = words.filter("verse IS NOT NULL AND surface IS NOT NULL")
    if texts is None:
        texts = words.groupBy("verse").agg(F.collect_list("surface").alias("surfaces"))
    namesakes = namesakes.filter("entity IS NOT NULL AND other IS NOT NULL").select("entity", "other").distinct()
    first = F.substring(F.regexp_extract("surface", r"\p{L}", 0), 1, 1)
    surfaces = words.groupBy("surface").agg(F.count("*").alias("n")).withColumn("form", folded(F.col("surface"))).filter("form <> ''")
    surfaces = kept(surfaces.select("surface", "form", "n", first.rlike(r"\p{Lu}").alias("upper"), first.rlike(r"\p{Ll}").alias("lower")), "consensus-surfaces")

    # each verse with its forms, its entities, and the entities that one of these is a namesake of
    named = entities.filter("entity IS NOT NULL AND verse IS NOT NULL").select("verse", "entity", "kind")
    theirs = named.join(namesakes.select(F.col("entity").alias("_e"), F.col("other").alias("entity")), "entity").select("verse", F.col("_e").alias("entity"))
    about = named.select("verse", F.struct("entity", "kind").alias("named"), F.lit(None).cast(named.schema["entity"].dataType).alias("beside"))
    about = about.unionByName(theirs.select("verse", F.lit(None).cast(about.schema["named"].dataType).alias("named"), F.col("entity").alias("beside")))
    about = about.groupBy("verse").agg(F.sort_array(F.collect_set("named")).alias("named"), F.sort_array(F.collect_set("beside")).alias("beside"))
    about = about.withColumn("own", F.array_distinct(F.transform("named", lambda x: x["entity"]))).withColumn("beside", F.array_except("beside", "own"))
    texts = folded_all(texts.filter("verse IS NOT NULL"), "surfaces", "forms").select("verse", "forms").join(about.hint("shuffle_hash"), "verse", "left")
    texts = texts.select("verse", "named", "forms", *[F.coalesce(c, F.array().cast(about.schema[c].dataType)).alias(c) for c in ("own", "beside")])
    texts = kept(texts, "consensus-texts").filter(F.size("forms") > 0)  # once written, else forms are made twice
    kinds = texts.select("verse", F.explode("named").alias("x")).groupBy("x.entity").agg(F.min("x.kind").alias("kind"), F.countDistinct("verse").alias("verses"))
    kinds = kept(kinds, "consensus-kinds")

    stats = surfaces.groupBy("form").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("upper"), F.col("n")).otherwise(0)).alias("capitals"), F.sum(F.when(F.col("lower"), F.col("n")).otherwise(0)).alias("small"))
    marks = kept(stats.agg((F.sum("capitals") >= MARKS_NAMES * (F.sum("capitals") + F.sum("small"))).alias("marks")), "consensus-marks")  # one row
    common = F.col("marks") & (F.col("small") > 0) & (F.col("capitals") < CAPITALISED * F.col("n"))
    # verses of the same entities count together, then for each of these
    alike = texts.select("own", "beside", F.explode("forms").alias("form")).groupBy("form", "own", "beside").agg(F.count("*").alias("n"))
    alike = kept(alike, "consensus-alike")
    facts = stats.join(alike.groupBy("form").agg(F.sum("n").alias("printed")), "form").crossJoin(F.broadcast(marks)).select("form", "printed", common.alias("common"))
    each = F.concat(F.transform("own", lambda e: F.struct(e.alias("entity"), F.lit(True).alias("own"))), F.transform("beside", lambda e: F.struct(e.alias("entity"), F.lit(False).alias("own"))))
    counts = alike.select("form", "n", F.explode(each).alias("x")).groupBy("form", "x.entity").agg(F.sum(F.when(F.col("x.own"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.col("x.own"), 0).otherwise(F.col("n"))).alias("beside"))
    least = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in SPECIFICITY.items()], F.lit(SPECIFICITY["person"]))
    share = F.col("own") / (F.col("printed") - F.col("beside"))
    proper = F.coalesce("kind", F.lit("person")).isin(*PROPER)
    reached = counts.filter("own > 0").join(facts, "form").join(kinds, "entity")
    reached = kept(reached.select("entity", "form", "own", (F.col("printed") - F.col("beside") - F.col("own")).alias("out"), ((share >= least) & ~(proper & F.col("common"))).alias("particular")), "consensus-reached")
    particular = reached.filter("particular").select("entity", "form", "own", "out")

    # a cluster covers no more verses than its forms together and no fewer than its most printed one; so for those of others
    clusters = filed(particular).groupBy("entity", "core").agg(F.count("*").alias("size"), F.sum("own").alias("all_own"), F.max("own").alias("most_own"), F.sum("out").alias("all_out"), F.max("out").alias("most_out"), F.first("lead").alias("lead"))
    bound = lambda own, out: own / F.col("verses") * (own / (own + out))
    clusters = clusters.join(kinds.select("entity", "verses"), "entity").withColumn("most", bound(F.least("all_own", "verses"), F.col("most_out")) + SLACK).withColumn("least", bound(F.col("most_own"), F.col("all_out")) - SLACK)
    clusters = kept(clusters, "consensus-clusters")
    ends = kept(clusters.groupBy("entity").agg(F.max("least").alias("top_least"), F.max("most").alias("top_most")), "consensus-bounds")
    bounded = clusters.join(ends, "entity")
    # all that may have the highest score, and all that may be as good with a core at least as long as one that is surely as good
    sure = kept(bounded.filter(F.col("least") >= F.col("top_most") - AS_GOOD).groupBy("entity").agg(F.max(F.length("core")).alias("long")), "consensus-sure")
    open_ = bounded.join(sure, "entity", "left").filter((F.col("most") >= F.col("top_least")) | ((F.col("most") >= F.col("top_least") - AS_GOOD) & (F.length("core") >= F.coalesce("long", F.lit(0)))))
    scored = measured(open_, particular, texts)
    top = scored.groupBy("entity").agg(F.max("score").alias("top"))
    good = scored.join(top, "entity").filter(F.col("score") >= F.col("top") - AS_GOOD)
    place = F.struct(F.length("core"), "score").alias("place")
    high = good.groupBy("entity").agg(F.max(place).alias("place"))
    best = good.withColumn("place", place).join(high, ["entity", "place"]).groupBy("entity").agg(F.min_by(F.struct("core", "covered", "coverage", "specificity", "score"), "core").alias("x")).select("entity", "x.*")
    best = kept(best, "consensus-best")
    own_forms = kept(filed(particular, best).select("entity", "form"), "consensus-named")

    holding = kept(particular.join(best.select("entity", F.col("core").alias("_core")), "entity").filter(F.col("form").contains(F.col("_core"))).select(*particular.columns), "consensus-holding")
    named = kept(filed(particular, best, holding).select("entity", "form", "own").join(kinds, "entity"), "consensus-named")

    # rivals share no form with the best
    shared = kept(gathered(named.select("entity", "form"), particular), "consensus-pieces").join(clusters.select("entity", "core", "lead"), ["entity", "core"])
    shared = kept(shared.filter(one_name(F.col("form"), F.col("lead"), F.col("core"))).select("entity", "core").distinct(), "consensus-shared")
    others = clusters.join(shared, ["entity", "core"], "left_anti")
    ends = kept(others.groupBy("entity").agg(F.max("least").alias("top_least")), "consensus-bounds")
    rival = measured(others.join(ends, "entity").filter(F.col("most") >= F.col("top_least")), particular, texts).groupBy("entity").agg(F.max("score").alias("rival"))
    sets = named.groupBy("entity").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    best = best.join(sets, "entity").join(rival, "entity", "left").withColumn("margin", F.col("score") - F.coalesce("rival", F.lit(0.0)))
    best = best.select("entity", "core", "forms", "covered", "coverage", "specificity", "score", "margin")
    findings = kept(kinds.join(best, "entity", "left").withColumn("margin", F.coalesce("margin", F.lit(0.0))), "consensus-findings")
    return findings, (words, namesakes, surfaces, texts, kinds, marks, reached, named)


def claimed(words: DataFrame, namesakes: DataFrame, surfaces: DataFrame, texts: DataFrame, kinds: DataFrame, marks: DataFrame, reached: DataFrame, named: DataFrame) -> DataFrame:
    """Claims by what ``found`` gives beside its findings: words printed as a name of an entity of their verse are looked up by surface."""
    proper = F.coalesce("kind", F.lit("person")).isin(*PROPER)
    printed = surfaces.join(named, "form").crossJoin(F.broadcast(marks)).filter(~(proper & F.col("marks") & F.col("lower")))
    printed = kept(printed.select("entity", "form", "surface"), "consensus-printed")
    wanted = words.join(printed, "surface").join(texts.select("verse", F.col("own").alias("all")), "verse").filter(F.array_contains("all", F.col("entity")))
    wanted = kept(wanted.select("entity", "form", "verse", "word", "all"), "consensus-claims")
    pairs = wanted.select("entity", "form", F.explode("all").alias("other")).filter("entity <> other").distinct().join(named, ["entity", "form"])
    pairs = pairs.join(kinds.select(F.col("entity").alias("other"), F.col("kind").alias("other_kind"), F.col("verses").alias("other_verses")), "other")
    pairs = pairs.join(namesakes.withColumn("_alike", F.lit(True)), ["entity", "other"], "left")
    prints = kept(reached.join(named.select("form").distinct(), "form", "left_semi").select(F.col("entity").alias("other"), "form", F.col("own").alias("other_prints"), F.when(F.col("particular"), F.col("own")).alias("other_own")), "consensus-prints")
    pairs = pairs.join(prints, ["other", "form"], "left")
    pairs = pairs.join(named.select(F.col("entity").alias("other"), "form", F.lit(True).alias("_theirs")), ["other", "form"], "left")
    blocked = F.when(F.col("_alike"), F.col("other_own").isNotNull() | (F.coalesce("other_prints", F.lit(0)) * 2 >= F.col("other_verses")))
    blocked = blocked.when(F.col("kind").eqNullSafe(F.col("other_kind")), F.coalesce("_theirs", F.lit(False)))
    blocked = blocked.otherwise(F.coalesce(F.col("other_own") * F.col("verses") >= F.col("own") * F.col("other_verses"), F.lit(False)))
    rivals = kept(pairs.filter(blocked).groupBy("entity", "form").agg(F.collect_set("other").alias("rivals")), "consensus-rivals")
    free = F.col("rivals").isNull() | ~F.arrays_overlap("all", "rivals")
    return wanted.join(rivals, ["entity", "form"], "left").filter(free).select("entity", "verse", "word")


def read(words: DataFrame, entities: DataFrame, namesakes: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, as ``found`` gives them, and claims (entity, verse, word)."""
    findings, facts = found(words, entities, namesakes, texts)
    return findings, claimed(*facts)


def accepted(findings: DataFrame, least_verses: int, least_score: float, least_margin: float) -> DataFrame:
    """Findings that pass a bar: verses, coverage, score, and the distance to the best other name."""
    return findings.filter((F.col("core").isNotNull()) & (F.col("verses") >= least_verses) & (F.col("coverage") >= COVERAGE) & (F.col("score") >= least_score) & (F.col("margin") >= least_margin))
