"""Exact top-k search by columnar branch and bound.

Components become integers, floor(SCALE * x). Candidates are dealt into blocks, and each block is held dimension by
dimension (vertical layout). A query takes the dimensions in order of its own largest components, STEP at a time: the
products of a step are added up for all surviving candidates, and then those are compacted away whose sum and largest
possible rest (the query's remaining norm times the candidate's, by Cauchy and Schwarz) fall short of the k-th best score
known so far. The largest norm of the table is taken first: while its square is below 2^52, sums of doubles are exact. Beyond that
sums carry an allowance for rounding that follows the norms, so no candidate is lost, and the survivors of the last step are
scored in integers without bounds. A score that 64 bits can't hold raises OverflowError.

A block meets its queries as a stream: rows are sorted so that a block's candidates come first, then queries pass in
Arrow batches, so memory is bounded by one block. Each query brings a lower bound for its k-th score, found among a
bounded sample, so blocks return few rows.

Contract: vectors that are null, of uncommon length, or hold null or non-finite components take no part; zero vectors do.
Ties go to the smaller id. Rows that share an id are candidates and queries each on its own, and only a query's own row is
not its candidate; fewer than k candidates give fewer rows; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groundspark.llm.common import Scratch, table
from groundspark.llm.vectors import EXACT, exact_products, floored, matrix, sampled, sound, to_long

SCALE, STEP = 1024, 16
#: Candidates in a block: at least LEAST, at most MOST, so that memory is bounded and shuffled queries aren't many.
LEAST, MOST = 2_048, 65_536
#: Candidates that first bounds come from.
SEEDS = 1_024
FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


class Block:
    """Candidates in vertical layout, by ascending id. ``rows`` are unique."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, big: bool = False):
        self.big = big
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.columns = rows[order], ids[order], np.ascontiguousarray(vectors[order].T)
        self.mass = (self.columns**2).sum(0) if len(ids) else np.zeros(0)

    def search(self, row: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best with a score of at least ``floor``, best first, without that row."""
        dims = np.argsort(-np.abs(q), kind="stable")
        alive = np.flatnonzero(self.rows != row)
        sums, rest = np.zeros(len(alive)), self.mass[alive]
        left = float((q**2).sum())
        off = 1e-12 * np.sqrt(left) * np.sqrt(rest) if self.big else 0.0  # what sums can be off by
        for at in range(0, len(q), STEP):
            part = dims[at : at + STEP]
            own = self.columns[part] if len(alive) == len(self.ids) else self.columns[np.ix_(part, alive)]
            sums = sums + q[part] @ own
            left -= float((q[part] ** 2).sum())
            if at + STEP >= len(q):
                break
            rest = np.maximum(rest - (own**2).sum(0), 0)
            slack = np.sqrt(max(left, 0.0)) * np.sqrt(rest) * (1 + 1e-9) + 1e-6 + off
            bar = floor
            if len(sums) > k:  # the k-th best of the least possible scores bounds the k-th score from below
                bar = max(bar, np.partition(sums - slack, len(sums) - k)[len(sums) - k])
            keep = sums + slack >= bar
            if not keep.all():
                alive, sums, rest = alive[keep], sums[keep], rest[keep]
                off = off[keep] if self.big else off
        if self.big:
            bar = max(floor, np.partition(sums - off, len(sums) - k)[len(sums) - k]) if len(sums) > k else floor
            alive = alive[sums + off >= bar]
            exact = exact_products(q[None, :], self.columns[:, alive].T)[0]
            best = sorted(range(len(alive)), key=lambda j: (-exact[j], self.ids[alive[j]]))[:k]
            return self.ids[alive[best]], exact[best]
        good = sums >= floor
        alive, sums = alive[good], sums[good]
        best = np.lexsort((self.ids[alive], -sums))[:k]
        return self.ids[alive[best]], sums[best]


def search(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest integer inner product. ``is_query``: over ``id``."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows, dim = sound(df, vec_id, vector, True, scratch, lambda v: F.transform(v, lambda x: floored(x.cast("double") * SCALE)))
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
    big = (norm or 0.0) * (1 + 1e-9) >= EXACT
    sample = sampled(rows, n, SEEDS).toArrow()
    seeds = Block(sample.column("row").to_numpy(), sample.column("id").to_numpy(), matrix(sample.column("vector"), dim), big)
    blocks = max(1, -(-n // int(min(MOST, max(LEAST, n // 64)))))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for i, q in zip(batch.column("row").to_numpy(), matrix(batch.column("vector"), dim), strict=True):
                found = seeds.search(int(i), q, k)[1]
                floors.append(float(found[-1]) - 1e-15 * abs(float(found[-1])) if len(found) == k else float("-inf"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "vector")), pa.array(floors, pa.float64())], names=["row", "id", "vector", "floor"])

    queries = rows.where(is_query).mapInArrow(bounds, "row long, id long, vector array<double>, floor double")
    everywhere = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    dealt = rows.select("row", "id", "vector", F.lit(None).cast("double").alias("floor"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"))
    met = dealt.unionByName(everywhere).repartition(blocks, "block").sortWithinPartitions("block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            numbers, sides = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            cuts = np.flatnonzero(np.diff(numbers * 2 + sides)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
                if a == b:
                    continue
                if numbers[a] != at:
                    at, parts, block = numbers[a], [], None
                own = batch.slice(a, b - a)
                row, ids, vs = own.column("row").to_numpy(), own.column("id").to_numpy(), matrix(own.column("vector"), dim)
                if sides[a] == 0:
                    parts.append((row, ids, vs))
                    continue
                if block is None:
                    block = Block(*(np.concatenate([p[j] for p in parts]) for j in range(3)), big) if parts else Block(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim)))
                    parts = []
                for r, i, q, floor in zip(row, ids, vs, own.column("floor").to_numpy(), strict=True):
                    found, scores = block.search(int(r), q, k, float(floor))
                    out.append((np.full(len(found), r), np.full(len(found), i), found, to_long(scores)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out]), pa.int64()) for j in range(4)], names=FOUND.names)

    found = met.mapInArrow(run, FOUND)
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0, 10)


OP8_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored) WHERE rank <= 10
"""
