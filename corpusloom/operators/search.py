"""Ranked search over tokenised segments: typed queries, tiers of forms, phrases, relaxation, snippets, spellings, paging."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import languages
from ..functions.text import similarity, trigrams
from ..session import kept

#: Quotation marks with their closing ones, marks trimmed off words, and terms of a query at most (fixed values).
QUOTES = {'"': '"', "«": "»", "„": "“", "“": "”"}
TRIMMED = ".,;:!?\"'()[]«»„“”—–"
MOST_TERMS = 12


@dataclass(frozen=True)
class Term:
    """A typed word, and the number of the phrase that it was typed in."""

    word: str
    phrase: int | None = None


def parse(typed: str | None, most: int = MOST_TERMS) -> list[Term]:
    """Words outside quotation marks, and phrases inside a pair of them; a mark that nothing closes is trimmed off."""
    out: list[Term] = []
    words = lambda part: [w for w in (p.strip(TRIMMED) for p in part.split()) if w]
    at, phrase, plain, typed = 0, 0, "", typed or ""
    while at < len(typed):
        end = typed.find(QUOTES[typed[at]], at + 1) if typed[at] in QUOTES else -1
        if end < 0:
            plain += typed[at]
            at += 1
            continue
        out += [Term(w) for w in words(plain)]
        plain = ""
        if inside := words(typed[at + 1 : end]):
            out += [Term(w, phrase) for w in inside]
            phrase += 1
        at = end + 1
    return (out + [Term(w) for w in words(plain)])[:most]


def containing(text: Column, typed: str) -> Column:
    """ILIKE with the typed text's wildcards taken literally."""
    escaped = "".join(f"\\{x}" if x in "%_\\" else x for x in typed)
    return text.ilike(f"%{escaped}%")


def ranked(hits: DataFrame, key: str, terms: list[Term], joints: list[int]) -> DataFrame:
    """key, phrase, held, terms, tiers, span, partial: segments that hold all required terms, best first.

    hits: key, position, term (its number), tier. Joint words (by their numbers) are not required unless nothing else was typed; each
    quoted phrase must stand together. With no such segment and three required terms or more, half of them (rounded up) are
    enough, flagged partial. Order: all terms side by side in the typed order (phrase), required terms held, terms held, sum of best
    tiers, span of positions, key.
    """
    if not terms:
        return hits.sparkSession.createDataFrame([], f"{key} {hits.schema[key].dataType.simpleString()}, phrase boolean, held long, terms long, tiers long, span long, partial boolean")
    required = [k for k in range(len(terms)) if k not in joints] or list(range(len(terms)))
    phrases: dict[int, list[int]] = {}
    for k, t in enumerate(terms):
        if t.phrase is not None:
            phrases.setdefault(t.phrase, []).append(k)
    needed = F.col("term").isin(required)
    hits = hits.repartition(key)  # one exchange, which all that follows shares
    # one pass by segment: best tier of each term, places, and islands of terms that follow one another as typed
    per_term = hits.groupBy(key, "term").agg(F.min("tier").alias("tier"), F.min("position").alias("low"), F.max("position").alias("high"))
    held = per_term.groupBy(key).agg(F.count_if(needed).alias("held"), F.count("*").alias("terms"), F.sum("tier").cast("long").alias("tiers"), (F.max(F.when(needed, F.col("high"))) - F.min(F.when(needed, F.col("low")))).cast("long").alias("span"))

    def together(which: list[int], name: str) -> DataFrame:
        order = {k: n for n, k in enumerate(which)}
        place = F.col("position") - F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("term"))
        islands = hits.filter(F.col("term").isin(which) & (F.col("tier") <= 1)).groupBy(key, place.alias("island")).agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(which))
        return islands.select(key).distinct().withColumn(name, F.lit(True))

    full = held.join(together(list(range(len(terms))), "phrase"), key, "left").withColumn("phrase", F.coalesce("phrase", F.lit(False)) & F.lit(len(terms) > 1))
    for which in phrases.values():
        full = full.join(together(which, "_stands").drop("_stands"), key, "left_semi")
    count = len(required)
    half = (count + 1) // 2 if count >= 3 else count
    # whether any segment holds all: one row, beside each
    whole = full.agg(F.max((F.col("held") == count).cast("int")).alias("any"))
    least = F.when(F.coalesce("any", F.lit(0)) == 1, count).otherwise(half)
    out = full.crossJoin(F.broadcast(whole)).filter(F.col("held") >= least)
    out = out.select(key, "phrase", "held", "terms", "tiers", "span", (F.coalesce("any", F.lit(0)) == 0).alias("partial"))
    return out.orderBy(F.col("phrase").desc(), F.col("held").desc(), F.col("terms").desc(), "tiers", "span", key)


def page(ranked: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """A page by number from 1, clamped to the last one; ``total`` on each row."""
    ranked = kept(ranked, "ranking")  # made once, counted and read
    total = ranked.count()
    at = max(1, min(number, -(-total // size)))
    return ranked.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def keyset(rows: DataFrame, order: list[str], cursor: tuple, size: int, before: bool = False) -> DataFrame:
    """The rows that follow a cursor in an order, or the last ones before it; the bound on the first column reaches the scan."""
    at = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, cursor, strict=True)])
    row, first = F.struct(*order), F.col(order[0])
    if before:
        return rows.filter((first <= cursor[0]) & (row < at)).orderBy(*[F.col(c).desc() for c in order]).limit(size).orderBy(*order)
    return rows.filter((first >= cursor[0]) & (row > at)).orderBy(*order).limit(size)


def natural(number: Column) -> list[Column]:
    """Sort keys of numbers such as H12 or G3: Hebrew before Greek before others, then by number, then by what follows it."""
    letter = F.upper(F.left(number, F.lit(1)))
    digits = F.regexp_extract(number, r"^[A-Za-z]+(\d+)", 1)
    return [F.when(letter == "H", 0).when(letter == "G", 1).otherwise(2), digits.try_cast("long").asc_nulls_last(), number]


def snippet(text: Column, forms: Column) -> Column:
    """Escaped text with the words whose lower case is among the forms marked."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))
    safe = lambda p: F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = lambda p: F.when(F.array_contains(forms, F.lower(p)), F.concat(F.lit("<em>"), p, F.lit("</em>"))).otherwise(safe(p))
    return F.trim(F.array_join(F.transform(pieces, mark), ""))


def unspaced(runs: DataFrame, key: list[str], words: str, typed: str) -> DataFrame:
    """key, position, word: the words that an occurrence of the typed text falls in, where words are printed without spaces.

    words: array of the words of one run, which punctuation bounds, so that no occurrence reaches over it.
    """
    names = [*key, "position", "word"]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for *own, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line, at, hit = "".join(parts), -1, set()
                starts = list(accumulate(map(len, parts), initial=0))
                while typed and (at := line.find(typed, at + 1)) >= 0:
                    hit.update(range(bisect_right(starts, at) - 1, bisect_left(starts, at + len(typed))))
                out += [(*own, k, parts[k]) for k in sorted(hit) if parts[k]]
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            types = [batch.schema.field(k).type for k in range(len(key))] + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    schema = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in key)
    return runs.select(*key, words).mapInArrow(run, f"{schema}, position long, word string")


def neighbours(words: DataFrame, asked: list[str], least: float = 0.3) -> DataFrame:
    """asked, word, similarity, distance of words near the asked ones by trigrams and edit distance (2, or 1 up to four letters)."""
    spark = words.sparkSession
    q = spark.createDataFrame([(a,) for a in asked], "asked string").withColumn("g", trigrams(F.col("asked")))
    w = words.withColumn("h", trigrams(F.col("word")))
    like = similarity(F.col("g"), F.col("h"))
    distance = F.levenshtein(F.lower("asked"), F.lower("word")).cast("long")
    pairs = w.crossJoin(F.broadcast(q)).withColumn("similarity", F.round(like, 6)).withColumn("distance", distance)  # the asked words are few
    return pairs.filter((F.col("similarity") >= least) | (F.col("distance") <= F.when(F.length("asked") <= 4, 1).otherwise(2))).select("asked", "word", "similarity", "distance")


#: A spelling is looked for where a word is printed so often at most; its own word must be so many times as frequent (fixed values).
RARE, OUTWEIGHS, NEIGHBOURS = 25, 2, 30


def suggestions(forms: DataFrame, asked: list[str]) -> DataFrame:
    """language, asked, form, printed, weight: a spelling of each language near a rarely printed word of three letters and more.
    forms: language, form, stem, occurrences.

    Of the 30 likest forms by trigrams those within one letter (two beyond four letters), with another stem, that differ in more than
    the ending and, where the asked word is printed at all, only in vowels or by letters more; twice as frequent by stem. Only forms
    that hold enough of an asked word's trigrams are compared with it.
    """
    spark = forms.sparkSession
    typed = sorted({a.lower() for a in asked if len(a) >= 3})
    weight = forms.groupBy("language", "stem").agg(F.sum("occurrences").alias("weight"))
    every = spark.createDataFrame([(a,) for a in typed], "asked string")
    q = languages.stem_by(forms.select("language").distinct().crossJoin(F.broadcast(every)), "asked", "language", "asked_stem")
    mine = weight.select("language", F.col("stem").alias("asked_stem"), F.col("weight").alias("own"))
    q = q.join(mine, ["language", "asked_stem"], "left").fillna(0, ["own"]).filter(F.col("own") <= RARE)
    candidates = forms.withColumn("asked", F.explode(sharing(typed))).filter("form <> asked")
    pairs = candidates.join(F.broadcast(q), ["language", "asked"])  # a few words by language
    pairs = pairs.withColumn("like", similarity(trigrams(F.col("asked")), trigrams(F.col("form")))).filter("like >= 0.3")
    pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("language", "asked").orderBy(F.col("like").desc(), F.col("occurrences").desc(), "form"))).filter(F.col("place") <= NEIGHBOURS)
    distance = F.levenshtein("asked", "form")
    longest = F.greatest(F.length("asked"), F.length("form"))
    same_start = F.expr("left(asked, greatest(length(asked), length(form)) - 2) = left(form, greatest(length(asked), length(form)) - 2)") & (F.least(F.length("asked"), F.length("form")) >= longest - 2)
    consonants = lambda c: F.regexp_replace(c, "[aeiouy]", "")
    fits = (F.col("stem") != F.col("asked_stem")) & (distance <= F.when(F.length("asked") <= 4, 1).otherwise(2)) & ~same_start & ((F.col("own") == 0) | F.col("form").contains(F.col("asked")) | (consonants("form") == consonants("asked")))
    close = pairs.filter(fits).join(weight, ["language", "stem"]).withColumn("r", F.row_number().over(Window.partitionBy("language", "asked").orderBy(distance, "place"))).filter("r = 1")
    return close.filter((F.col("own") == 0) | (F.col("weight") >= OUTWEIGHS * F.col("own"))).select("language", "asked", "form", F.col("own").alias("printed"), "weight")


def sharing(asked: list[str], least: float = 0.3) -> Column:
    """The asked words whose trigrams a form (column form) holds so many of that their likeness may be the least: likeness is no more
    than the share of the asked word's own trigrams."""
    padded, out = F.concat(F.lit("  "), F.col("form"), F.lit(" ")), []
    for word in asked:
        grams = sorted({("  " + word + " ")[k : k + 3] for k in range(len(word) + 1)})
        held = reduce(add, [padded.contains(g).cast("int") for g in grams])
        out.append(F.when(held >= least * len(grams), F.lit(word)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")
