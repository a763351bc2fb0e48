"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent. The exponent is bisected until the mixture
meets a limit of repetition or a target entropy; weights become token budgets; a budget is spent in whole passes over
the source and one part of a pass. Each pass is a permutation of blocks, and of the documents in each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

GRID, ROUNDS, DIGITS = 32, 6, 6
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"


def _tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _source(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(NONE))


def measures(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(entropy in nats, highest number of passes if every source is seen whole, sum of powers) by exponent.

    ``totals`` has one row for each source; it is read by one distributed aggregate, whatever its size.
    """
    top = totals.agg(F.max("tokens")).first()[0]
    each = totals.filter("tokens > 0").withColumn("a", F.explode(F.array(*[F.lit(float(a)) for a in exponents])))
    power = F.pow(F.col("tokens") / F.lit(float(top)), F.col("a"))
    passes = F.pow(F.col("tokens") / F.lit(float(top)), F.col("a") - 1)
    rows = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("h"), (F.max(passes) / F.min(passes)).alias("r")).collect()
    by = {r["a"]: (math.log(r["z"]) - r["h"] / r["z"], r["r"], r["z"]) for r in rows}
    return [by[float(a)] for a in exponents]


def find_exponent(totals: DataFrame, max_passes: float | None, entropy: float | None) -> float:
    """The least exponent of 0 to 1 within the limit of passes, or the one that meets the entropy (nats), to DIGITS
    places. Both fall as the exponent grows. Every round splits the interval in GRID parts at once."""
    if (max_passes is None) == (entropy is None):
        raise ValueError("give max_passes or entropy")
    if totals.filter("tokens > 0").limit(1).count() == 0:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        steps = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        good = [(r <= max_passes if entropy is None else h <= entropy) for h, r, _ in measures(totals, steps)]
        at = next((i for i, ok in enumerate(good) if ok), GRID)
        low, high = steps[max(0, at - 1)], steps[at]
        if at == 0:
            return 0.0
    return min(1.0, math.ceil(high * 10**DIGITS - 1e-3) / 10**DIGITS)


def _pass_keys(source: Column, key: Column, block: Column, number: Column, seed: int) -> tuple[Column, Column]:
    """Where a document's block, and the document within it, come in a source's pass of that number."""
    n = number.cast("string")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), n, source, block)), F.md5(F.concat_ws("|", F.lit(str(seed)), n, key))


def mix(docs: DataFrame, max_passes: float | None = 2.0, entropy: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """``docs`` once for each pass that takes them, with n_tokens, pass_no (from 0), block_key and doc_key added.

    Sorted by (pass_no, block_key, doc_key) within its source, the result is the source's stream. The budget in all
    is the least that sees every source whole once, so the largest source (by share over weight) has one pass and no
    document is lost; a source's last pass stops before the first document that would exceed its budget. Tokens are
    runs of anything but blank and \\t to \\r; a null text has none. A null source is a source named "(none)"; null ids
    count as one id. Documents that share an id are taken together. A source without tokens is taken once. Columns
    named as the new ones are replaced.

    A block is the first three hexadecimal digits of the id's digest. Only the block where a budget ends is looked at
    document by document.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    names = ["n_tokens", "pass_no", "block_key", "doc_key"]
    base = docs.drop(*names).withColumn("n_tokens", _tokens(text_col))
    slim = materialize(base.select(_source(source_col).alias("source"), key.alias("key"), "n_tokens").withColumn("block", F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "key")), 1, 3)))
    blocks = materialize(slim.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    totals = materialize(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    exponent = find_exponent(totals, max_passes, entropy)
    span = totals.filter("tokens > 0").agg(F.max("tokens"), F.min("tokens")).first()
    top = float(span[0] or 1)
    # passes = weight * budget / tokens, where the budget is the greatest tokens / weight
    passes = F.pow(F.lit(top) / F.col("tokens"), F.lit(1.0 - exponent))
    budget = F.greatest(F.floor(F.col("tokens") * passes), F.col("tokens"))
    whole = F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(1).cast("long")
    plan = totals.withColumn("whole", whole).withColumn("rest", F.when(F.col("tokens") > 0, budget - F.col("whole") * F.col("tokens")).otherwise(0).cast("long"))
    few = plan.count() <= BROADCAST_SOURCES
    plan = F.broadcast(plan) if few else plan

    keyed = blocks.join(plan.select("source", "whole", "rest"), "source")
    keyed = keyed.withColumn("block_key", _pass_keys(F.col("source"), F.lit(""), F.col("block"), F.col("whole"), seed)[0])
    upto = Window.partitionBy("source").orderBy("block_key")
    edge = keyed.withColumn("sum", F.sum("tokens").over(upto)).filter("sum > rest").groupBy("source").agg(F.min(F.struct("block_key", "block", "sum", "tokens", "whole", "rest")).alias("e")).select("source", "e.*")
    edge = materialize(edge.select("source", "block", "block_key", "whole", (F.col("rest") - F.col("sum") + F.col("tokens")).alias("room")))
    inside = slim.join(F.broadcast(edge) if few else edge, ["source", "block"])
    inside = inside.withColumn("doc_key", _pass_keys(F.col("source"), F.col("key"), F.col("block"), F.col("whole"), seed)[1]).groupBy("source", "doc_key", "room").agg(F.sum("n_tokens").alias("n"))
    within = inside.withColumn("sum", F.sum("n").over(Window.partitionBy("source").orderBy("doc_key"))).filter("sum > room").groupBy("source").agg(F.min("doc_key").alias("cut"))
    ends = plan.join(edge.select("source", "block_key"), "source", "left").join(within, "source", "left").select(F.col("source").alias("_source"), F.col("whole").alias("_whole"), F.col("block_key").alias("_edge"), F.col("cut").alias("_cut"))
    ends = materialize(ends)

    taken = base.withColumn("_s", _source(source_col)).withColumn("_key", key).withColumn("_block", F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "_key")), 1, 3))
    taken = taken.join(F.broadcast(ends) if few else ends, F.col("_s") == F.col("_source"))
    block_key, doc_key = _pass_keys(F.col("_s"), F.col("_key"), F.col("_block"), F.col("_whole"), seed)
    more = F.col("_edge").isNull() | (block_key < F.col("_edge")) | ((block_key == F.col("_edge")) & (F.col("_cut").isNull() | (doc_key < F.col("_cut"))))
    # a source that its budget ends exactly has no edge and takes no part of a pass
    more = F.when(F.col("_edge").isNull(), F.lit(False)).otherwise(more)
    taken = taken.withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1 + more.cast("long"))))
    block_key, doc_key = _pass_keys(F.col("_s"), F.col("_key"), F.col("_block"), F.col("pass_no"), seed)
    return taken.withColumn("block_key", block_key).withColumn("doc_key", doc_key).drop("_s", "_key", "_block", "_source", "_whole", "_edge", "_cut")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, max_passes=2.0).select("doc_id", "source", "n_tokens", "pass_no", "block_key", "doc_key")


OP8_SQL = r"""
WITH slim AS (
  SELECT doc_id, source AS raw, coalesce(source, '(none)') AS source, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents
), d AS (
  SELECT *, substr(md5('17|' || key), 1, 3) AS block FROM slim
), totals AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source
), lim AS (
  SELECT max(tokens) AS top, greatest(0.0, least(1.0, CASE WHEN max(tokens) = min(tokens) THEN 0.0
         ELSE ceil((1 - ln(2.0) / ln(max(tokens) / min(tokens))) * 1000000 - 0.001) / 1000000 END)) AS a
  FROM totals WHERE tokens > 0
), budgets AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN greatest(CAST(floor(tokens * pow(top / tokens, 1 - a)) AS BIGINT), tokens) ELSE 0 END AS budget
  FROM totals, lim
), plan AS (
  SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole,
         CASE WHEN tokens > 0 THEN budget - (budget // tokens) * tokens ELSE 0 END AS rest FROM budgets
), keyed AS (
  SELECT d.*, whole, rest, md5('17|' || whole || '|' || d.source || '|' || block) AS bk, md5('17|' || whole || '|' || key) AS dk
  FROM d JOIN plan USING (source)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY bk, dk) AS upto FROM keyed
), edge AS (
  SELECT source, min(struct_pack(bk := bk, dk := dk)) AS e FROM summed WHERE upto > rest GROUP BY source
), copies AS (
  SELECT s.*, s.whole + CASE WHEN e IS NOT NULL AND (s.bk, s.dk) < (e.bk, e.dk) THEN 1 ELSE 0 END AS n
  FROM summed s LEFT JOIN edge USING (source)
), taken AS (
  SELECT *, unnest(range(n)) AS pass_no FROM copies
)
SELECT doc_id, raw AS source, n_tokens, pass_no, md5('17|' || pass_no || '|' || source || '|' || block) AS block_key,
       md5('17|' || pass_no || '|' || key) AS doc_key FROM taken
"""
