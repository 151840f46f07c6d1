"""Mixing sources to target weights, with DataFrame and SQL functions only.

A source's share p of all tokens becomes p ** a / Z. The exponent a is bisected: the largest one in 0..1 whose
mixture has at least ``entropy`` of the greatest possible entropy, but not under the least one at which no
source is repeated more than ``repetition`` times as often as the least repeated one. Weights turn into token budgets; unless a
total ``budget`` is given, it is the least that shows every document once, so mixing only ever adds repetitions.

A budget is realised as permutations of blocks: documents fall into blocks by a hash of their id, each epoch of a source has
an own order of its blocks, and an epoch ends with the last block that fits the budget, so a source is off its budget by
under one block. Only tables of sources and blocks are sorted; documents meet them in one join by source and block,
which spreads a hot source over its blocks.

Tokens are words plus one end each. Defined cases: null texts have no words; a null source counts as the source
with the empty name; rows that repeat are mixed each for themselves; with one source the exponent is 1; an empty table gives no
rows; other columns pass through. The columns that mix() adds start with ``mix_`` and replace any that do; the stage
packs the document's columns into one value meanwhile, so that it returns all of them as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import load

WORDS = r"[^ \t\n\x0B\f\r]+"
#: Halvings of the exponent's interval.
STEPS = 50


def prepared(docs: DataFrame) -> DataFrame:
    kept = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    return kept.withColumn("mix_source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("mix_tokens", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long") + 1)


def weights(data: DataFrame, entropy: float = 0.95, repetition: float = 1.5, budget: float | None = None) -> DataFrame:
    """One row a source: mix_source, tokens, mix_exponent, mix_weight, mix_budget."""
    totals = data.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"))
    row = totals.agg(F.sort_array(F.collect_list(F.struct("mix_source", "tokens"))).alias("s")).withColumn("n", F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["tokens"]))
    row = row.withColumn("p", F.transform("s", lambda x: x["tokens"] / F.col("n")))
    z = "aggregate(p, 0D, (t, x) -> t + power(x, {a}))"
    h = f"ln({z}) - {{a}} * aggregate(p, 0D, (t, x) -> t + power(x, {{a}}) * ln(x)) / {z}"
    enough = f"{h} >= {entropy} * ln(size(p))"
    bounded = f"power(array_max(p) / array_min(p), 1 - {{a}}) <= {repetition}"
    mid = "(i.lo + i.hi) / 2"
    interval = "named_struct('lo', {lo}, 'hi', {hi})"

    def bisect(good: str, good_is_low: bool) -> str:
        """The end of the interval 0..1 that stays good."""
        low, high = interval.format(lo=mid, hi="i.hi"), interval.format(lo="i.lo", hi=mid)
        step = f"if({good.format(a=f'({mid})')}, {low if good_is_low else high}, {high if good_is_low else low})"
        at_once, sure = ("1D", "lo") if good_is_low else ("0D", "hi")
        return f"if({good.format(a=at_once)}, {at_once}, aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (i, k) -> {step}).{sure})"

    row = row.withColumn("mix_exponent", F.expr(f"greatest({bisect(enough, True)}, {bisect(bounded, False)})"))
    row = row.withColumn("z", F.expr(z.format(a="mix_exponent")))
    out = row.select("mix_exponent", "z", "n", F.explode("s").alias("x")).select("x.mix_source", "x.tokens", "mix_exponent", (F.pow(F.col("x.tokens") / F.col("n"), F.col("mix_exponent")) / F.col("z")).alias("mix_weight"))
    total = F.lit(float(budget)) if budget is not None else F.max(F.col("tokens") / F.col("mix_weight")).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("mix_budget", F.col("mix_weight") * total)


def mix(docs: DataFrame, entropy: float = 0.95, repetition: float = 1.5, budget: float | None = None, block_tokens: int = 50_000_000, least_blocks: int = 64, seed: int = 11) -> DataFrame:
    """docs, repeated, with mix_epoch, mix_block, mix_rank (of the block in its epoch's order), mix_tokens, mix_weight."""
    data = prepared(docs)
    total = data.agg(F.sum("mix_tokens")).first()[0] or 0
    n = max(least_blocks, -(-total // block_tokens))
    # eight hexadecimal digits of a hash of the id
    data = data.withColumn("mix_block", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") % n)
    blocks = data.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens"))
    goal = weights(blocks.select("mix_source", F.col("block_tokens").alias("mix_tokens")), entropy, repetition, budget)
    full = F.floor(F.col("mix_budget") / F.col("tokens") + 1e-9)
    epochs = blocks.join(goal, "mix_source").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), full)))
    order = Window.partitionBy("mix_source", "mix_epoch").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "mix_source", F.col("mix_epoch").cast("string"), F.col("mix_block").cast("string"))), "mix_block")
    epochs = epochs.withColumn("mix_rank", F.row_number().over(order).cast("long")).withColumn("so_far", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    epochs = epochs.filter((F.col("mix_epoch") < full) | (F.col("so_far") <= F.col("mix_budget") - full * F.col("tokens")))
    return data.join(epochs.select("mix_source", "mix_block", "mix_epoch", "mix_rank", "mix_weight"), ["mix_source", "mix_block"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", F.col("mix_source").alias("source"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_rank").alias("block_rank"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources; every document stays, with all its columns whatever their names."""
    held = docs.select(F.col("doc_id"), F.col("source"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return mix(held).select("row.*")


SQL = rf"""
WITH RECURSIVE data AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) + 1 AS BIGINT) AS n_tokens,
         ('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM documents
), cnt AS (SELECT greatest(64, (CAST(coalesce(sum(n_tokens), 0) AS BIGINT) + 49999999) // 50000000) AS nb FROM data
), placed AS (SELECT data.*, h % nb AS block FROM data, cnt
), blocks AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS bt FROM placed GROUP BY ALL
), src AS (SELECT source, CAST(sum(bt) AS BIGINT) AS t FROM blocks GROUP BY source
), p AS (SELECT source, t, t / (SELECT sum(t) FROM src) AS p FROM src
), lim AS (SELECT count(*) AS n, max(p) AS hi, min(p) AS lo FROM p
), ent(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN (a + b) / 2 ELSE a END, CASE WHEN ok THEN b ELSE (a + b) / 2 END FROM (
    SELECT k, a, b, (SELECT ln(sum(pow(p, (a + b) / 2))) - (a + b) / 2 * sum(pow(p, (a + b) / 2) * ln(p)) / sum(pow(p, (a + b) / 2)) FROM p) >= 0.95 * (SELECT ln(n) FROM lim) AS ok
    FROM ent WHERE k < {STEPS})
), rep(k, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN a ELSE (a + b) / 2 END, CASE WHEN ok THEN (a + b) / 2 ELSE b END FROM (
    SELECT k, a, b, pow(hi / lo, 1 - (a + b) / 2) <= 1.5 AS ok FROM rep, lim WHERE k < {STEPS})
), expo AS (SELECT greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= 0.95 * (SELECT ln(n) FROM lim) THEN 1.0 ELSE (SELECT a FROM ent WHERE k = {STEPS}) END,
    CASE WHEN (SELECT hi / lo <= 1.5 FROM lim) THEN 0.0 ELSE (SELECT b FROM rep WHERE k = {STEPS}) END) AS e
), w AS (SELECT source, t, pow(p, e) / (SELECT sum(pow(p, e)) FROM p, expo) AS w FROM p, expo
), goal AS (SELECT source, t, w, w * (SELECT max(t / w) FROM w) AS budget FROM w
), epochs AS (
  SELECT source, block, bt, t, w, budget, unnest(range(0, CAST(floor(budget / t + 1e-9) AS BIGINT) + 1)) AS epoch FROM blocks JOIN goal USING (source)
), ranked AS (
  SELECT *, row_number() OVER o AS block_rank, sum(bt) OVER (o ROWS UNBOUNDED PRECEDING) AS so_far FROM epochs
  WINDOW o AS (PARTITION BY source, epoch ORDER BY md5('11:' || source || ':' || epoch || ':' || block), block)
)
SELECT doc_id, placed.source AS source, CAST(epoch AS BIGINT) AS epoch, CAST(placed.block AS BIGINT) AS block, block_rank, n_tokens, round(w, 6) AS weight
FROM placed JOIN ranked ON placed.source = ranked.source AND placed.block = ranked.block
WHERE epoch < floor(budget / t + 1e-9) OR so_far <= budget - floor(budget / t + 1e-9) * t
"""
