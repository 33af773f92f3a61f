"""Nearest neighbours by inner product: an inverted file with product-quantised residuals, visited twice.

Coarse centroids and residual codebooks are fitted on a bounded sample (SAMPLE rows, or IN_LIST for each of the lists, which
follow the square root of the table up to MOST_LISTS: 4.2 million rows; beyond that lists grow); every row is indexed: it joins the
list of its nearest centroid, and its residual, divided by the list's spread, is coded in PARTS bytes, with the length of what the
code loses. First a query visits the lists that are likeliest to hold its neighbours: from the sizes, centres and spreads of
all lists it estimates the score of the MORE * k-th neighbour and each list's yield above that score, and takes lists by falling
yield until COVER of the expected yield is reached; the first ones, which hold MORE * k rows, give their k best, the others what is above
the estimate. The result doesn't depend on estimates: the k-th score found is a bar, and the query then visits every list that may reach it, by the largest residuals of all its rows
(whole, by part and by component), also again where an estimate was above the bar. Where data are clustered these are few, where they have no structure all. In a list,
asymmetric distance tables (query parts against codebooks) score the codes; candidates whose score can reach the bar or the
k best of the block, given what their codes lose, are reranked on the original vectors in double precision.

A list is split into blocks of about BLOCK rows by a hash, and the queries of a list into groups of about GROUP, so
neither a hot list nor its queries meet in one task.

Contract: vectors that are null, zero, of uncommon length, or hold null or non-finite components take no part. Ties go
to the smaller id. Rows that share an id are candidates and queries each on its own, and only a query's own row is not its
candidate; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.llm.common import Scratch, table
from groundspark.llm.vectors import matrix, sampled, sound

SAMPLE, MOST_LISTS, IN_LIST, PARTS, CODES = 16_384, 4_096, 16, 16, 256
COVER, MORE, BLOCK, GROUP = 0.8, 3, 2_048, 2_048
#: Of the products of norms: what bounds allow for rounding. Queries and pairs that a block scores at once.
SLACK, ASKED, PAIRS = 1e-9, 256, 32_768


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row, 2,048 rows at a time."""
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((x[k : k + 2048] @ centres.T - half).argmax(1) for k in range(0, len(x), 2048))])


def n_lists(n: int) -> int:
    return int(max(1, min(MOST_LISTS, round(2 * n**0.5))))


def kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        at = nearest(x, centres)
        count = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


class Index(NamedTuple):
    centres: np.ndarray
    spread: np.ndarray
    books: list[np.ndarray]  # for each part: code, component
    error: float  # of an asymmetric score in the sample, as a share of spread times the query's norm

    def residuals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (x - self.centres[at]) / self.spread[at, None]

    def codes(self, scaled: np.ndarray) -> np.ndarray:
        cut = np.array_split(scaled, len(self.books), axis=1)
        return np.column_stack([nearest(c, b) for c, b in zip(cut, self.books, strict=True)]).astype(np.uint8)

    def lost(self, scaled: np.ndarray, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The length of what each row's codes lose."""
        kept = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return np.linalg.norm(scaled - kept, axis=1) * self.spread[at]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query the products of its parts with every code, CODES to a part, end to end."""
        out = np.zeros((len(q), len(self.books), CODES))
        for k, (part, book) in enumerate(zip(np.array_split(q, len(self.books), axis=1), self.books, strict=True)):
            out[:, k, : len(book)] = part @ book.T
        return out.reshape(len(q), -1)


def fit(x: np.ndarray, n: int, seed: int = 5) -> Index:
    """From a sample; ``n``: rows to be indexed."""
    lists = min(n_lists(n), len(x) // IN_LIST or 1)
    centres = kmeans(x, lists, 12, seed)
    at = nearest(x, centres)
    norm = ((x - centres[at]) ** 2).sum(1)
    count = np.bincount(at, minlength=len(centres))
    dim = x.shape[1]
    overall = max(float(norm.mean()), 1e-12) / dim
    spread = np.sqrt((np.bincount(at, norm, len(centres)) / dim + overall * 0.1) / (count + 0.1))
    spread = np.maximum(spread, 1e-9)
    scaled = (x - centres[at]) / spread[at, None]
    cuts = np.array_split(scaled, min(PARTS, dim), axis=1)
    books = [kmeans(c, min(CODES, len(c)), 8, seed + k) for k, c in enumerate(cuts)]
    lost = sum(((c - b[nearest(c, b)]) ** 2).sum(1) for c, b in zip(cuts, books, strict=True))
    return Index(centres, spread, books, float(np.sqrt(max(lost.mean(), 1e-12) / dim)))


def tail(z: np.ndarray) -> np.ndarray:
    """Of the normal distribution, by a smooth approximation that is good to a few percent."""
    z = np.clip(z, -8, 8)
    t = 1 / (1 + 0.2316419 * np.abs(z))
    p = np.exp(-z * z / 2) * 0.3989423 * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


def extents(residuals: np.ndarray, parts: int) -> np.ndarray:
    """For each row its components, these negated, the length of each part and the whole length; largest ones bound a list."""
    cut = np.array_split(residuals, parts, axis=1)
    return np.column_stack([residuals, -residuals, *(np.linalg.norm(c, axis=1) for c in cut), np.linalg.norm(residuals, axis=1)])


def highest(index: Index, largest: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query and list the score that no row of the list exceeds. ``largest``: of the ``extents`` of each list's rows."""
    dim, parts = q.shape[1], len(index.books)
    up, down, by_part, whole = np.split(largest, [dim, 2 * dim, 2 * dim + parts], axis=1)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    lengths = np.column_stack([np.linalg.norm(c, axis=1) for c in np.array_split(q, parts, axis=1)])
    above = np.minimum(np.maximum(q, 0) @ up.T + np.maximum(-q, 0) @ down.T, np.minimum(lengths @ by_part.T, norm * whole.T))
    return q @ index.centres.T + above + SLACK * norm * (np.linalg.norm(index.centres, axis=1) + whole[:, 0])


def route(index: Index, sizes: np.ndarray, q: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The lists that each query visits first, which hold k rows besides its own if there are so many, and what rows of each must
    reach: the estimate of the k-th score, but nothing in the best lists that hold k rows."""
    own = nearest(q, index.centres)
    sizes = np.repeat(np.asarray(sizes, float)[None, :], len(q), 0)
    sizes[np.arange(len(q)), own] -= 1  # the query itself
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    mean, sd = q @ index.centres.T, norm * index.spread[None, :] + 1e-12
    reach = mean + 8 * sd
    low, high = (mean - 8 * sd).min(1), reach.max(1)
    for _ in range(30):
        mid = (low + high) / 2
        over = (sizes * tail((mid[:, None] - mean) / sd)).sum(1) > k
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    gain = sizes * tail((low[:, None] - mean) / sd)
    order = np.argsort(-gain, axis=1, kind="stable")
    total = np.cumsum(np.take_along_axis(gain, order, 1), 1)
    reached = np.cumsum(np.take_along_axis(sizes, order, 1), 1)
    enough = (reached < k).sum(1) + 1
    need = np.maximum((total < COVER * total[:, -1:]).sum(1) + 1, enough)
    lists = [np.unique(np.append(o[:m], c)) for o, m, c in zip(order, need, own, strict=True)]
    return lists, [np.where(np.isin(those, o[:m]), -np.inf, least) for those, o, m, least in zip(lists, order, enough, low, strict=True)]


def route_again(index: Index, sizes: np.ndarray, largest: np.ndarray, q: np.ndarray, bar: np.ndarray, seen: list[np.ndarray], bars: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The lists that can hold a row which reaches the query's bar and hasn't been found, and for each the score from which on
    rows have been."""
    reach = ~(highest(index, largest, q) < bar[:, None]) & (sizes > 0)
    known = np.full(reach.shape, np.inf)
    for own, lists, least in zip(known, seen, bars, strict=True):
        own[lists] = least
    lists = [np.flatnonzero(own) for own in reach & (known > bar[:, None])]
    return lists, [own[those] for own, those in zip(known, lists, strict=True)]


class Block(NamedTuple):
    """Rows of a list; ids ascend."""

    number: int
    rows: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    lost: np.ndarray


def visit(index: Index, block: Block, rows: np.ndarray, q: np.ndarray, bars: np.ndarray, below: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries in a block: numbers of queries, ids and exact scores that reach the query's bar, best first, of the k best in the block;
    those from ``below`` on are known."""
    norm, centre = np.linalg.norm(q, axis=1)[:, None], index.centres[block.number]
    rough, tables = np.zeros((len(q), len(block.ids))), index.tables(q)
    for part in range(len(index.books)):
        rough += tables.take(CODES * part + block.codes[:, part], axis=1)
    rough = (q @ centre)[:, None] + index.spread[block.number] * rough
    off = norm * block.lost + SLACK * (norm * float(np.linalg.norm(centre)) + np.abs(rough))
    other, least = block.rows != rows[:, None], bars
    if len(block.ids) > k:
        low = rough - off
        low = np.where(other & (low == low), low, -np.inf)
        least = np.fmax(bars, np.partition(low, -k, axis=1)[:, -k])  # a block's k best reach this
    which, at = np.nonzero(other & ~(rough + off < least[:, None]))
    exact = np.concatenate([np.zeros(0), *((block.x[at[a : a + PAIRS]] * q[which[a : a + PAIRS]]).sum(1) for a in range(0, len(at), PAIRS))])
    order = np.lexsort((block.ids[at], -exact, which))
    which, at, exact = which[order], at[order], exact[order]
    place = np.arange(len(which)) - np.searchsorted(which, which)
    good = (place < k) & ~(exact < bars[which]) & ~((exact >= below[which]) & (below[which] < np.inf))
    return which[good], block.ids[at[good]], exact[good]


def search(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: over ``id``."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows, dim = sound(df, vec_id, vector, False, scratch)
    n = rows.count()
    sample = sampled(rows, n, max(SAMPLE, IN_LIST * n_lists(n))).toArrow()
    x = matrix(sample.column("vector"), dim) if n else np.zeros((1, dim))
    index = fit(x, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("vector"), dim)
            at = nearest(v, index.centres)
            scaled = index.residuals(v, at)
            codes = index.codes(scaled) if len(v) else np.zeros((0, len(index.books)), np.uint8)
            new = pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.lost(scaled, codes, at))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "vector")), *new], names=["row", "id", "vector", "list", "code", "lost"])

    kind = rows.schema["vector"].dataType.simpleString()
    indexed = scratch.keep(rows.mapInArrow(assign, f"row long, id long, vector {kind}, list int, code binary, lost double"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, top = np.zeros(len(index.centres), np.int64), None
        for batch in batches:
            at, v = batch.column("list").to_numpy(), matrix(batch.column("vector"), dim)
            own = extents(v - index.centres[at], len(index.books))
            top = np.full((len(count), own.shape[1]), -np.inf) if top is None else top
            np.maximum.at(top, at, own)
            count += np.bincount(at, minlength=len(count))
        some = np.flatnonzero(count)
        largest = pa.array([top[c].tobytes() for c in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), largest], names=["list", "n", "largest"])

    def joined(key, part):
        top = np.frombuffer(part.column("largest")[0].as_py())
        for more in part.column("largest")[1:]:
            top = np.maximum(top, np.frombuffer(more.as_py()))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(part.column("n").to_pylist())]), pa.array([top.tobytes()], pa.binary())], names=["list", "n", "largest"])

    # One row for each list, and lists are at most MOST_LISTS.
    known = "list int, n long, largest binary"
    sizes, largest = np.zeros(len(index.centres)), np.zeros((len(index.centres), 2 * dim + len(index.books) + 1))
    for r in indexed.select("list", "vector").mapInArrow(measured, known).groupBy("list").applyInArrow(joined, known).toLocalIterator():
        sizes[r["list"]], largest[r["list"]] = r["n"], np.frombuffer(r["largest"])
    blocks = np.maximum(1, np.ceil(sizes / BLOCK)).astype(int)
    of_lists = lambda lists: pa.array(lists, pa.list_(pa.int32()))
    some_rows = lambda batch: (batch.slice(a, 512) for a in range(0, batch.num_rows, 512))
    asking = f"row long, id long, vector {kind}, lists array<int>, bars array<double>, below array<double>, bar double"
    names = ["row", "id", "vector", "lists", "bars", "below", "bar"]
    of_scores = lambda scores: pa.array(scores, pa.list_(pa.float64()))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in some_rows(batch):
                lists, bars = route(index, sizes, matrix(part.column("vector"), dim), MORE * k)
                none = pa.array(np.full(part.num_rows, -np.inf))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), of_lists(lists), of_scores(bars), of_scores([np.full(len(b), np.inf) for b in bars]), none], names=names)

    def routed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in some_rows(batch):
                bar = part.column("bar").to_numpy()
                seen, before = ([np.asarray(own) for own in part.column(c).to_pylist()] for c in ("lists", "bars"))
                lists, below = route_again(index, sizes, largest, matrix(part.column("vector"), dim), bar, seen, before)
                bars = [np.full(len(own), b) for own, b in zip(lists, bar, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), of_lists(lists), of_scores(bars), of_scores(below), part.column("bar")], names=names)

    def meet(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        number = key[0].as_py()
        mine = mine.sort_by("id")
        ids = mine.column("id").to_numpy()
        codes = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(ids), len(index.books)).astype(np.int64)
        block = Block(number, mine.column("row").to_numpy(), ids, matrix(mine.column("vector"), dim), codes, mine.column("lost").to_numpy())
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        for a in range(0, len(theirs) if len(ids) else 0, ASKED):
            some = theirs.slice(a, ASKED)
            r, i, bars, below = (some.column(c).to_numpy() for c in ("row", "id", "bar", "below"))
            which, got, scores = visit(index, block, r, matrix(some.column("vector"), dim), bars, below, k)
            out.append((r[which], i[which], got, scores))
        return pa.table([pa.array(np.concatenate([o[j] for o in out])) for j in range(4)], names=["row", "query_id", "vec_id", "score"])

    by_list = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("list") + 1)
    spread = lambda values, salt: F.pmod(F.xxhash64("row", F.lit(salt)), by_list(values)).cast("int")
    all_of = lambda values: F.explode(F.sequence(F.lit(0), by_list(values) - 1))
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", best).where(F.col("rank") <= k)

    def visited(queries: DataFrame) -> DataFrame:
        """The best rows of the lists that queries name."""
        asked = queries.select("row", "id", "vector", F.explode(F.arrays_zip("lists", "bars", "below")).alias("x")).select("row", "id", "vector", F.col("x.lists").alias("list"), F.col("x.bars").alias("bar"), "x.below")
        groups = np.ones(len(sizes), int)
        for r in asked.groupBy("list").count().collect():
            groups[r["list"]] = max(1, -(-r["count"] // GROUP))
        held = indexed.withColumn("block", spread(blocks, 1)).withColumn("group", all_of(groups))
        come = asked.withColumn("group", spread(groups, 2)).withColumn("block", all_of(blocks))
        keys = ("list", "block", "group")
        return held.groupBy(*keys).cogroup(come.groupBy(*keys)).applyInArrow(meet, "row long, query_id long, vec_id long, score double")

    first = scratch.keep(rows.where(is_query).mapInArrow(routed, asking))
    found = scratch.keep(ranked(visited(first)).drop("rank"))
    bars = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("row", "least")
    barred = first.join(bars, "row", "left").withColumn("bar", F.coalesce("least", "bar")).drop("least")
    again = scratch.keep(barred.mapInArrow(routed_again, asking))
    return ranked(found.unionByName(visited(again))).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, 20)
