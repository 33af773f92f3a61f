"""Hard negatives by dual-tree search over integer inner products.

Components become integers, floor(SCALE * x), and a row's score for an anchor is their exact inner product. An anchor's
positives are the POSITIVES best other rows of its label; for each, its negatives are the NEGATIVES best rows of other labels
whose score lies between LOW and HIGH percent of the positive's.

Rows are indexed by a ball tree. Its upper levels are fitted on a bounded sample (SAMPLE rows) and end in cells; every row
joins a cell, a cell's true radius is taken over all its rows, and a cell is dealt into blocks of at most MOST rows by a hash,
so that neither a hot cell nor one vector repeated without end meets in one task. The lower levels are built where a block is
read. Anchors are grouped in the same way: by cell, and in a task by a tree over the anchors that pass. For a node of anchors
(centre a, radius r) and one of rows (centre c, radius s) all products lie in

    <a, c> +- (|a| s + |c| r + r s)

so a pair of nodes is dropped for all its anchors at once where that interval lies below what each of them still needs, or,
for negatives, above all their windows; so are pairs of nodes that can hold no wanted label. This is done first for pairs of
cells, before anything is shuffled, and then down both trees at once; pairs of leaves that remain are scored exactly.

Contract: rows with a null label or id, a null vector, null or non-finite components, or of uncommon length take no part; zero
vectors do. Ties go to the smaller id. Rows that share an id are rows each on its own, and only an anchor's own row isn't its
positive; fewer rows than asked for give fewer results, and a window that holds nothing gives none (one of a negative positive
is empty); an empty table gives an empty one; further columns are ignored. Scores are exact at any size of components: beyond
2^53 they are summed in unbounded integers; one that 64 bits can't hold raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.llm.balltree import BallTree, interval
from groundspark.llm.common import Scratch, table
from groundspark.llm.vectors import EXACT, exact_products, floored, matrix, sampled, sound, to_long

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows that the upper levels of the tree are fitted on, and about how many cells they end in.
SAMPLE, CELLS = 16_384, 1_024
#: Rows of a block: at least LEAST, at most MOST. Rows of a leaf, anchors of a leaf.
LEAST, MOST, LEAF, ANCHORS = 2_048, 65_536, 128, 32
#: Rows of the sample that give first bounds.
SEEDS = 2_048

LAYOUT = "cell int, part int, side int, band int, row long, id long, label long, vector array<double>, floor double, scores array<long>"


def ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by falling score and rising id."""
    if scores.dtype == object:
        order = np.array([sorted(range(len(i)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(scores, ids, strict=True)], np.int64).reshape(len(scores), -1)
    else:
        order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def shortlist(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``ranked`` over one list of ids in rising order that all rows share."""
    if scores.dtype == object or scores.shape[1] <= k:
        return ranked(scores, np.broadcast_to(ids, scores.shape), k)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, 1), ids[order]


class Found:
    """The best of each anchor so far, in W lists of k: scores fall, -inf where there is none yet."""

    def __init__(self, n: int, lists: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, lists, k), -np.inf), np.zeros((n, lists, k), np.int64)

    def add(self, anchors: slice, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: -inf where a row isn't wanted; ``ids``: in rising order."""
        if not (scores >= np.asarray(self.scores[anchors, w, -1:])).any():
            return
        new, of = shortlist(scores, ids, self.k)
        if scores.dtype == object and self.scores.dtype != object:
            self.scores = self.scores.astype(object)
        both = ranked(np.concatenate([self.scores[anchors, w], new], 1), np.concatenate([self.ids[anchors, w], of], 1), self.k)
        self.scores[anchors, w], self.ids[anchors, w] = both

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor, list, id, score of all that was found."""
        there = np.array(self.scores != -np.inf, bool)
        anchor, w, _ = np.nonzero(there)
        return anchor, w, self.ids[there], self.scores[there]


class Block:
    """Rows under a ball tree."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, big: bool):
        self.tree, self.big = BallTree(vectors, LEAF, labels, ids), big
        self.rows, self.ids, self.labels, self.vectors = (x[self.tree.order] for x in (rows, ids, labels, vectors))

    def products(self, anchors: np.ndarray, at: slice) -> np.ndarray:
        return exact_products(anchors, self.vectors[at]) if self.big else anchors @ self.vectors[at].T

    def search(self, anchors: Anchors) -> Found:
        """Down both trees at once. ``anchors`` says what each still needs and what a row must be."""
        found = anchors.lists()
        mine, theirs = anchors.tree, self.tree
        stack = [(0, np.zeros(1, np.int64))] if len(self.ids) and len(anchors.rows) else []
        while stack:
            a, nodes = stack.pop()
            own = slice(mine.start[a], mine.end[a])
            while True:
                low, high = interval(mine, a, theirs, nodes)
                floor, top = anchors.needs(own, found)
                nodes = nodes[(high >= floor) & (low <= top) & anchors.may(mine.labels[a], theirs.labels[nodes])]
                inner = theirs.left[nodes] >= 0
                if not len(nodes) or not inner.any() or (mine.left[a] >= 0 and mine.radius[a] >= theirs.radius[nodes].max()):
                    break
                split = nodes[inner]
                nodes = np.concatenate([nodes[~inner], theirs.left[split], theirs.right[split]])
            if not len(nodes):
                continue
            if mine.left[a] >= 0:
                stack += [(mine.right[a], nodes), (mine.left[a], nodes)]
                continue
            _, high = interval(mine, a, theirs, nodes)
            for j in np.argsort(-high, kind="stable"):
                if high[j] < anchors.needs(own, found)[0]:
                    break
                at = slice(theirs.start[nodes[j]], theirs.end[nodes[j]])
                anchors.take(own, self, at, self.products(anchors.vectors[own], at), found)
        return found


class Anchors:
    """A group of anchors under a ball tree of their own, looking for positives."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, floors: np.ndarray):
        self.tree = BallTree(vectors, ANCHORS, labels)
        self.order = self.tree.order
        self.rows, self.labels, self.vectors, self.floors = (x[self.order] for x in (rows, labels, vectors, floors))

    def lists(self) -> Found:
        return Found(len(self.rows), 1, POSITIVES)

    def needs(self, own: slice, found: Found) -> tuple[float, float]:
        """Scores outside of these bounds are of no use to any anchor of the slice."""
        return float(np.maximum(self.floors[own], found.scores[own, 0, -1].astype(float)).min()), np.inf

    def may(self, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Whether nodes of these least and largest labels can hold what is looked for."""
        return (theirs[:, 0] <= mine[1]) & (theirs[:, 1] >= mine[0])

    def take(self, own: slice, block: Block, at: slice, scores: np.ndarray, found: Found) -> None:
        wanted = (self.labels[own, None] == block.labels[at]) & (self.rows[own, None] != block.rows[at])
        found.add(own, 0, np.where(wanted, scores, -np.inf), block.ids[at])


class Windows(Anchors):
    """Anchors looking for negatives: a window for each positive."""

    def __init__(self, rows, labels, vectors, floors, scores: list[list[int]], big: bool):
        super().__init__(rows, labels, vectors, floors)
        kind = object if big else np.int64
        self.low, self.high = np.ones((len(rows), POSITIVES), kind), np.zeros((len(rows), POSITIVES), kind)
        for i, k in enumerate(self.order):
            for w, s in enumerate(scores[k]):
                self.low[i, w], self.high[i, w] = -(-LOW * s // 100), HIGH * s // 100
        self.open = np.array(self.low <= self.high, bool)

    def lists(self) -> Found:
        return Found(len(self.rows), POSITIVES, NEGATIVES)

    def needs(self, own: slice, found: Found) -> tuple[float, float]:
        is_open = self.open[own]
        if not is_open.any():
            return np.inf, -np.inf
        least = np.maximum(self.low[own].astype(float), found.scores[own, :, -1].astype(float))
        # Doubles of large integers may be off by a part of 2^52.
        floor, top = least[is_open].min(), self.high[own].astype(float)[is_open].max()
        return floor - abs(floor) * 1e-15, top + abs(top) * 1e-15

    def may(self, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        return (mine[0] != mine[1]) | (theirs[:, 0] != mine[0]) | (theirs[:, 1] != mine[0])

    def take(self, own: slice, block: Block, at: slice, scores: np.ndarray, found: Found) -> None:
        other = self.labels[own, None] != block.labels[at]
        for w in range(POSITIVES):
            inside = other & (scores >= self.low[own, w, None]) & (scores <= self.high[own, w, None])
            if inside.any():
                found.add(own, w, np.where(inside.astype(bool), scores, -np.inf), block.ids[at])


def meeting(search: Callable, dim: int, big: bool):
    """Over blocks whose rows come first and anchors behind them, in batches: what ``search`` finds for each batch of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            numbers = [batch.column(c).to_numpy() for c in ("cell", "part", "side")]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in numbers], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                key = (numbers[0][a], numbers[1][a])
                if key != at:
                    at, parts, block = key, [], None
                if numbers[2][a] == 0:
                    parts.append(own.select(["row", "id", "label", "vector"]))
                    continue
                if block is None:
                    t = pa.Table.from_batches(parts) if parts else own.slice(0, 0)
                    block = Block(*(t.column(c).to_numpy() for c in ("row", "id", "label")), matrix(t.column("vector"), dim), big)
                    parts = []
                yield search(block, own)

    return run


def batch_of(rows, of: tuple, names: list[str]) -> pa.RecordBatch:
    anchor, w, ids, scores = of
    return pa.RecordBatch.from_arrays([pa.array(rows[anchor], pa.int64()), pa.array(w, pa.int32()), pa.array(ids, pa.int64()), pa.array(to_long(scores), pa.int64())], names=names)


def mine(df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor``: over ``id``."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    labelled = df.where(F.col(label).isNotNull())
    rows, dim = sound(labelled, vec_id, vector, True, scratch, lambda v: F.transform(v, lambda x: floored(x.cast("double") * SCALE)), F.col(label).cast("long").alias("label"))
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
    big = (norm or 0.0) * (1 + 1e-9) >= EXACT
    size = int(min(MOST, max(LEAST, n // 64)))
    sample = sampled(rows, n, SAMPLE).toArrow()
    picked = matrix(sample.column("vector"), dim)
    cells = int(min(CELLS, max(1, -(-n // size))))
    tree = BallTree(picked, max(1, -(-len(picked) // cells))) if len(picked) else BallTree(np.zeros((1, dim)), 1)
    seeds = tuple(sample.column(c).to_numpy()[:SEEDS] for c in ("row", "label")) + (picked[:SEEDS],)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("vector"), dim)
            cell = tree.leaf_of(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "vector")), pa.array(cell, pa.int32()), pa.array(np.sqrt(((v - tree.centre[cell]) ** 2).sum(1)))], names=["row", "id", "label", "vector", "cell", "away"])

    held = scratch.keep(rows.mapInArrow(indexed, "row long, id long, label long, vector array<double>, cell int, away double"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "label", "vector", "cell", "away"]
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                v, own, labels = matrix(batch.column("vector"), dim), batch.column("row").to_numpy(), batch.column("label").to_numpy()
                scores = np.where((labels[:, None] == seeds[1]) & (own[:, None] != seeds[0]), v @ seeds[2].T, -np.inf)
                floor = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES] if scores.shape[1] >= POSITIVES else np.full(len(v), -np.inf)
                slack = 1e-9 * np.sqrt((v**2).sum(1)) * np.sqrt(norm or 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(floor - slack)], names=[*names, "floor"])

    anchors = scratch.keep(held.where(is_anchor).mapInArrow(floors, "row long, id long, label long, vector array<double>, cell int, away double, floor double"))
    # One row for each cell here and below; a leaf of the sample holds a sixteenth of its share at least, so cells are at most 16 * CELLS.
    stats = {r["cell"]: (r["n"], r["far"]) for r in held.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}

    def met(asked: DataFrame, ends: dict[int, tuple[float, float, float]]) -> DataFrame:
        """Blocks, and behind each the anchors that it can be of use to. ``ends``: of each cell of anchors radius, floor and top."""
        cells, far = np.array(list(stats), np.int64), np.array([f for _, f in stats.values()])
        visits = {}
        for a, (near, floor, top) in ends.items():
            low, high = interval(tree, a, tree, cells, near, far)
            visits[a] = cells[(high >= floor) & (low <= top)].tolist()
        parts = {c: max(1, -(-k // size)) for c, (k, _) in stats.items()}
        split = F.element_at(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(tree.left))]), F.col("cell") + 1)
        blocks = held.select("cell", F.pmod(F.xxhash64("row"), split).cast("int").alias("part"), F.lit(0).alias("side"), F.lit(0).alias("band"), "row", "id", "label", "vector", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("array<long>").alias("scores"))

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = {a: [(c, p) for c in cs for p in range(parts[c])] for a, cs in visits.items()}
            for batch in batches:
                for k, a in enumerate(batch.column("cell").to_pylist()):
                    to = every.get(a, [])
                    for x in range(0, len(to), 4096):
                        some = to[x : x + 4096]
                        same = batch.slice(k, 1).take(pa.array(np.zeros(len(some), np.int64)))
                        fixed = [pa.array([c for c, _ in some], pa.int32()), pa.array([p for _, p in some], pa.int32()), pa.array(np.ones(len(some), np.int32)), pa.array(np.full(len(some), a, np.int32))]
                        yield pa.RecordBatch.from_arrays([*fixed, *(same.column(c) for c in ("row", "id", "label", "vector", "floor", "scores"))], names=["cell", "part", "side", "band", "row", "id", "label", "vector", "floor", "scores"])

        return blocks.unionByName(asked.mapInArrow(sent, LAYOUT)).repartition(max(1, sum(parts.values())), "cell", "part").sortWithinPartitions("cell", "part", "side", "band", "row")

    def reached(asked: DataFrame, floor: Column, top: Column) -> dict[int, tuple[float, float, float]]:
        return {r["cell"]: (r["far"], r["floor"], r["top"]) for r in asked.groupBy("cell").agg(F.max("away").alias("far"), F.min(floor).alias("floor"), F.max(top).alias("top")).collect()}

    def positives(block: Block, own: pa.RecordBatch) -> pa.RecordBatch:
        group = Anchors(*(own.column(c).to_numpy() for c in ("row", "label")), matrix(own.column("vector"), dim), own.column("floor").to_numpy())
        return batch_of(group.rows, block.search(group).rows(), ["row", "nth", "id", "score"])

    def negatives(block: Block, own: pa.RecordBatch) -> pa.RecordBatch:
        group = Windows(*(own.column(c).to_numpy() for c in ("row", "label")), matrix(own.column("vector"), dim), np.zeros(own.num_rows), own.column("scores").to_pylist(), big)
        return batch_of(group.rows, block.search(group).rows(), ["row", "nth", "id", "score"])

    ddl = "row long, nth int, id long, score long"
    asked = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    first = met(asked, reached(asked, F.col("floor"), F.lit(float("inf")))).mapInArrow(meeting(positives, dim, big), ddl)
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    good = scratch.keep(first.withColumn("nth", best - 1).where(F.col("nth") < POSITIVES))

    listed = good.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda x: x["score"]).alias("scores"))  # POSITIVES of them
    windows = scratch.keep(anchors.join(listed, "row"))
    least, most = F.array_min("scores").cast("double"), F.array_max("scores").cast("double")
    ends = reached(windows, F.least(least * (LOW / 100), least * (HIGH / 100)), F.greatest(most * (LOW / 100), most * (HIGH / 100)))
    second = met(windows, ends).mapInArrow(meeting(negatives, dim, big), ddl)
    rank = F.row_number().over(Window.partitionBy("row", "nth").orderBy(F.desc("score"), "id"))
    hard = second.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("row", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = good.select("row", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return hard.join(named, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("id") % 50 == 0)


OP11_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same) WHERE nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) WHERE rank <= 3
"""
