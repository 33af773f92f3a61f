"""Mixing sources to target weights, with DataFrame operations only.

A source's share p of all tokens is raised to a temperature exponent and normalised: weight = p^a / sum(p^a). At a = 1
the mixture is the corpus, at a = 0 it is uniform. The exponent is bisected (each pass over the table of sources tries
SECTIONS points at once) to the smallest that holds a target entropy or a limit on how often a source repeats. The weights are
realised as budgeted block permutations: a source with budget b and t tokens gives floor(b / t) whole blocks, each a
permutation of its documents by a hash of seed, block and document, and a last block that is the prefix of its
permutation which fits the rest. No task handles a source: the prefix is found from sums over hash buckets, of which a
source has at most 65,536, and then inside one bucket; and documents join a table with one row for each source.

Tokens are words between white space. Contract: null texts are empty, a null source counts as the empty name; rows that
share a doc_id (null among them) stay or go together in a block; documents without words are in every block their
source has, and sources without any words are in one block; an empty table gives an empty one. Further columns pass
through ``mix``; its own columns replace those of the same name.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.llm.common import Scratch, table, unused

SECTIONS, PASSES = 32, 8
BUCKET_DIGITS = 4
SEED = "mix"


class Target(NamedTuple):
    """What the exponent has to hold.

    entropy: the least entropy, as a fraction of the logarithm of the number of sources; the largest such exponent is
    taken. repeats: where entropy is None, the most often a source may repeat; the smallest such exponent is taken.
    budget: tokens in the mixture as a multiple of those in the corpus; None: as many as give each source a whole block.
    """

    entropy: float | None = None
    repeats: float | None = None
    budget: float | None = 1.0


def n_words(text: Column) -> Column:
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.when(stripped == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(stripped, r"[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))).cast("long")


def order_key(doc_id: Column, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def exponent(shares: DataFrame, target: Target) -> float:
    """The exponent in [0, 1], to six decimals, rounded to the side that holds the target. ``shares``: p, over 0."""
    n = shares.count()
    if n < 2:
        return 1.0

    def holds(a: float) -> Column:
        total = F.sum(F.pow("p", F.lit(a)))
        if target.entropy is not None:
            # H = ln(sum p^a) - a * sum(p^a ln p) / sum(p^a); falls as a grows
            entropy = F.log(total) - F.lit(a) * F.sum(F.pow("p", F.lit(a)) * F.log("p")) / total
            return entropy >= F.lit(target.entropy * math.log(n))
        growth = F.lit(target.budget) / total if target.budget is not None else F.pow(F.max("p"), F.lit(1 - a))
        return F.pow(F.min("p"), F.lit(a - 1)) * growth <= F.lit(target.repeats)

    low, high = 0.0, 1.0  # by entropy the lower end holds, by repeats the upper end
    by_entropy = target.entropy is not None
    for _ in range(PASSES):
        points = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        row = shares.agg(*[holds(a).alias(f"h{k}") for k, a in enumerate(points)]).first()
        good = [a for k, a in enumerate(points) if row[f"h{k}"]]
        if by_entropy:
            low = max(good, default=0.0)
            high = min((a for a in points if a > low), default=low)
        else:
            high = min(good, default=1.0)
            low = max((a for a in points if a < high), default=high)
    return math.floor(low * 1e6) / 1e6 if by_entropy else math.ceil(high * 1e6) / 1e6


def plan(counts: DataFrame, scratch: Scratch, target: Target) -> DataFrame:
    """One row for each source: source, tokens, weight, whole (blocks) and cut (the last key of the partial block).

    ``counts``: source, doc_id, tokens.
    """
    sums = scratch.keep(counts.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = scratch.keep(sums.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("p")))
    a = exponent(shares, target)
    norm = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.round(F.pow("p", F.lit(a)) / F.lit(norm), 12))
    if target.budget is None:
        budget = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    else:
        budget = total * target.budget
    asked = F.greatest(F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-3)), F.lit(0))
    budgets = weighted.withColumn("asked", asked).select("source", "tokens", "weight", F.floor(F.col("asked") / F.col("tokens")).cast("int").alias("whole"), (F.col("asked") % F.col("tokens")).alias("rest"))
    budgets = scratch.keep(budgets)

    keyed = counts.join(budgets, "source").select("source", "rest", order_key(F.col("doc_id"), F.col("whole")).alias("key"), counts["tokens"].alias("n"))
    bucket = F.substring("key", 1, BUCKET_DIGITS).alias("bucket")
    by_bucket = keyed.groupBy("source", "rest", bucket).agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = by_bucket.withColumn("upto", F.sum("n").over(so_far))
    last = scratch.keep(summed.where("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("last")).select("source", "last.bucket", "last.before"))
    inside = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)).join(last, ["source", "bucket"]).groupBy("source", "rest", "bucket", "before", "key").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("upto", F.col("before") + F.sum("n").over(in_order)).where("upto <= rest").groupBy("source").agg(F.max("key").alias("key"))
    # Where no key of the bucket fits, all buckets before it do.
    cuts = last.join(fits, "source", "left").select("source", F.coalesce("key", "bucket").alias("cut"))
    planned = budgets.join(cuts, "source", "left").select("source", "tokens", "weight", "whole", F.coalesce("cut", F.lit("")).alias("cut"))
    silent = sums.where("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1).alias("whole"), F.lit("").alias("cut"))
    return scratch.keep(planned.unionByName(silent))


def counted(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("tokens"))


def placed(docs: DataFrame, planned: DataFrame, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """A row for each block a document is in, with ``block`` and ``order_key``: its place in the block's permutation."""
    source_, whole, cut, times_ = (unused(c, docs) for c in ("_source", "_whole", "_cut", "_times"))
    own = planned.select(F.col("source").alias(source_), F.col("whole").alias(whole), F.col("cut").alias(cut))
    times = F.col(whole) + (order_key(F.col(doc_id), F.col(whole)) <= F.col(cut)).cast("int")
    joined = docs.join(own, F.coalesce(F.col(source), F.lit("")) == F.col(source_)).withColumn(times_, times).where(F.col(times_) > 0)
    rows = joined.withColumn("block", F.explode(F.sequence(F.lit(0), F.col(times_) - 1))).drop(source_, whole, cut, times_)
    return rows.withColumn("order_key", order_key(F.col(doc_id), F.col("block")))


def mix(docs: DataFrame, target: Target, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mixture, each as often as it is drawn, with ``block`` and ``order_key``."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(counted(docs, text, source, doc_id))
    return placed(docs, plan(counts, scratch, target), source, doc_id)


OP5_TARGET = Target(entropy=0.95)


def op5_mixing(spark, sf_dir):
    scratch = Scratch(spark)
    counts = scratch.keep(counted(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return placed(counts, plan(counts, scratch, OP5_TARGET)).select("doc_id", "source", "block", "order_key", F.col("tokens").alias("n_tokens"))


OP5_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
sums AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY source),
shares AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM sums)::DOUBLE AS p FROM sums WHERE tokens > 0),
listed AS (SELECT list(p ORDER BY source) AS ps, count(*) AS n FROM shares),
search(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT i, low, high, mid,
          ln(list_sum(list_transform(ps, lambda p: pow(p, mid)))) - mid * list_sum(list_transform(ps, lambda p: pow(p, mid) * ln(p)))
            / list_sum(list_transform(ps, lambda p: pow(p, mid))) >= {OP5_TARGET.entropy}::DOUBLE * ln(n) AS ok
        FROM (SELECT i, low, high, (low + high) / 2 AS mid, ps, n FROM search, listed WHERE i < 42))),
expo AS (SELECT CASE WHEN (SELECT n FROM listed) < 2 THEN 1.0::DOUBLE
    WHEN (SELECT low > 1 - 1e-9 FROM search ORDER BY i DESC LIMIT 1) THEN 1.0::DOUBLE
    ELSE floor((SELECT low FROM search ORDER BY i DESC LIMIT 1) * 1e6::DOUBLE) / 1e6::DOUBLE END AS a),
asked AS (SELECT source, tokens, floor(round(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, expo), 12)
    * (SELECT sum(tokens) FROM sums)::DOUBLE + 1e-3::DOUBLE)::BIGINT AS asked FROM shares, expo),
budgets AS (SELECT source, asked // tokens AS whole, asked % tokens AS rest FROM asked
  UNION ALL SELECT source, 1, -1 FROM sums WHERE tokens = 0),
drawn AS (SELECT d.doc_id, d.source, d.tokens, b.whole, b.rest,
    md5(concat_ws(':', '{SEED}', b.whole::VARCHAR, coalesce(d.doc_id::VARCHAR, ''))) AS key FROM docs d JOIN budgets b USING (source)),
running AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key) AS upto FROM drawn),
times AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS times FROM running)
SELECT doc_id, source, block::INTEGER AS block, md5(concat_ws(':', '{SEED}', block::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS order_key, tokens AS n_tokens
FROM (SELECT doc_id, source, tokens, unnest(range(0, times)) AS block FROM times)
"""
