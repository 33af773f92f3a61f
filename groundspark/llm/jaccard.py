"""N-gram Jaccard join: documents linked when their word shingle sets overlap enough, found through count-vector R-trees.

1. A sketch of SLOTS counters over all documents tells common shingles from others.
2. Each document gives its shingle set's size, signature, count vector and signing shingles: ordered by commonness and then
   by hash, the first n - ceil(3n/4) + 1 of its n shingles. Linked documents share a signing shingle. Documents that share
   one make a cell, which is cut where sizes and places in that order leave no room for a link, and left out if all its members
   share the shingle before, too: each pair is judged by the first signing shingle that it has in common. All cells with the
   same smallest document, their anchor, make a group: so groups split the documents into parts, which overlap, and no link
   runs between documents that have no group in common.
3. In each group the members' count vectors (shingles hashed into groups of counts) are the points of an R-tree, which is
   joined with itself: boxes bound overlaps by summed coordinate minima. Pairs that survive connect their ends, and the join
   passes over nodes that are connected already; what is connected in the end makes disjoint parts that hold all such pairs.
4. Each part gets its members' whole shingle sets, an R-tree over them is joined in the same way, and here a pair connects its
   ends only once it is verified. So a part of near copies costs about as many checks as it has members.
5. Links lie inside components, so each row's number of links is counted there: the intersections of all sets of a component
   are a product of incidence matrices. Only sums leave a task.
Groups and parts beyond TILE members or WEIGHT shingles are dealt into tiles, each with the group's first member, and tiles are
joined with each other only where what was found by then leaves the group in several components.

The result is exact but for collisions of hashes (64 bits for a shingle, 128 for a set): every link is verified, or lies
inside a component that verified links make up anyway. No pairs within a group of copies are made: equal sets are one
class, which is represented by its smallest doc_id and counts as many links as it has rows.

Contract: as in ``shingles``; null and wordless texts have empty sets and link with nothing. Rows with a null doc_id
take no part in links and have a null component and no links. Rows that repeat a doc_id are each judged by their own text. An empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groundspark.llm.common import Scratch, batches_of, give_back, lean, table, unused
from groundspark.llm.graph import components, labels
from groundspark.llm.rtree import LEAST_GROUPS, RTree, folded, may_share, point, points
from groundspark.llm.shingles import linked, mixed, need, sets, signature

#: Counters of the sketch, whatever the input: its classes are one byte each and go to every executor.
SLOTS = 1 << 24
RANGES = 64
#: Steps of commonness for each doubling; the class of slots that are full in some task.
STEPS, FULL = 8, 255
#: Rows with a shingle from which on it counts as hot, in any case: its cell is not formed in one task.
HOT = 65_536
#: Signing shingles in a bucket of cells, on average, and those that a task holds before it passes them on.
BUCKET, HELD = 400_000, 400_000
#: The packed numbers that are dealt to buckets.
DEALT = {"keys": np.uint32, "docs": np.int64, "sizes": np.int32, "reach": np.int32, "before": np.uint64}
#: Members of a tile, shingles of a tile, and shingles of the groups or parts that are searched together; a point weighs as POINT shingles.
TILE, WEIGHT, PACK, POINT = 2_048, 4_000_000, 2_000_000, 256
#: Columns of an incidence matrix that are multiplied at once; pairs of members that are listed at once.
COLUMNS, LISTED = 2_048, 1 << 21
#: Rows of ids that are broadcast to a larger side, at most.
MOST_SENT = 300_000
#: Texts in a batch.
BATCH = 128


def slot(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(20)) & np.uint64(SLOTS - 1)


def sketch(docs: DataFrame, text: str) -> np.ndarray:
    """For each slot its number of (document, shingle) pairs, in STEPS to a doubling. A task counts to 255, which makes the slot FULL."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint8)
        for batch in batches:
            for own in sets(batch.column(text).to_pylist()):
                at = slot(own).astype(np.int64)
                now = total[at]
                total[at] = now + (now < 255)
        for k, part in enumerate(np.split(total, RANGES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "n"])

    def add(key, rows):
        total, full = np.zeros(SLOTS // RANGES, np.int64), np.zeros(SLOTS // RANGES, bool)
        for n in rows.column("n").to_pylist():
            part = np.frombuffer(zlib.decompress(n), np.uint8)
            total += part
            full |= part == 255
        classes = np.minimum(np.log2(total + 1) * STEPS, FULL - 1).astype(np.uint8)
        classes[full] = FULL
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())], names=["part", "classes"])

    summed = docs.select(text).mapInArrow(lean(count), "part int, n binary").groupBy("part").applyInArrow(add, "part int, classes binary")
    out = np.zeros(SLOTS, np.uint8)
    width = SLOTS // RANGES
    for r in summed.toLocalIterator():  # SLOTS bytes in all, packed
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["classes"]), np.uint8)
    return out


def hot_class(classes: np.ndarray) -> int:
    """The class from which on shingles count as hot: HOT rows, and four times what a slot has in the median."""
    spread = np.cumsum(np.bincount(classes, minlength=256))
    median = int(np.searchsorted(spread, spread[-1] / 2))
    return min(FULL, max(int(np.log2(HOT) * STEPS), median + 2 * STEPS))


def signing(own: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, and in that order: rare before common, then by hash."""
    if not len(own):
        return own
    count = len(own) - (3 * len(own) + 3) // 4 + 1
    common = classes[slot(own).astype(np.int64)].astype(np.uint64)
    with np.errstate(over="ignore"):
        order = (common << np.uint64(56)) | (mixed(own) >> np.uint64(8))
    first = np.argpartition(order, count - 1)[:count]
    return own[first[np.argsort(order[first], kind="stable")]]


def described(docs: DataFrame, classes, hot: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, s1, s2 (signature), counts (the point), keys and hot (signing shingles that aren't and that are hot, in order: hot ones are the last), as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes.value
        for batch in batches:
            n, s1, s2, counts, keys, hots = [], [], [], [], [], []
            for own in sets(batch.column(text).to_pylist()):
                a, b = signature(own)
                n.append(len(own))
                s1.append(a)
                s2.append(b)
                counts.append(zlib.compress(point(own).tobytes(), 1))
                signs = signing(own, known)
                crowded = known[slot(signs).astype(np.int64)] >= hot
                keys.append((signs[~crowded] if crowded.any() else signs).tobytes())
                hots.append(signs[crowded].tobytes() if crowded.any() else None)
            columns = [batch.column(doc_id), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *(pa.array(x, pa.binary()) for x in (counts, keys, hots))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "counts", "keys", "hot"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(lean(run), f"doc_id {kind}, n long, s1 long, s2 long, counts binary, keys binary, hot binary")


def starting(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])[: len(columns[0])]


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Signing shingles by bucket: packed keys with the s1 of their documents, their sizes, the largest size of a set that can
    be linked if this is the first shingle in common, and the signing shingle before (0: none).

    Inside a bucket 32 bits of a shingle are its key: two that fall together by chance make one cell of two, which costs a
    few bounds and loses nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held, seen = 0, set()

        def out() -> pa.RecordBatch:
            key, *more = (np.concatenate([p[k] for p in parts]) for k in range(len(DEALT)))
            where = (key % np.uint64(buckets)).astype(np.int64)
            key = (key >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            packed = [pa.array([c[order[cuts[b] : cuts[b + 1]]].tobytes() for b in some], pa.binary()) for c in (key, *more)]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *packed], names=["bucket", *DEALT])

        for batch in batches:
            for s1, n, keys in zip(*(batch.column(c).to_pylist() for c in ("s1", "n", "keys")), strict=True):
                if not keys or s1 in seen:  # copies have the same keys
                    continue
                if len(seen) < 1_000_000:
                    seen.add(s1)
                own = np.frombuffer(keys, np.uint64)
                # What lies from the first common shingle on holds the intersection, which is 3/7 of both sizes at least.
                reach = 7 * (n - np.arange(len(own), dtype=np.int64)) // 3 - n
                before = np.concatenate([np.zeros(1, np.uint64), own[:-1]])
                parts.append((own, np.full(len(own), s1, np.int64), np.full(len(own), n, np.int32), reach.astype(np.int32), before))
                held += len(own)
                if held > HELD:
                    yield out()
                    parts, held = [], 0
        if parts:
            yield out()

    return rows.select("s1", "n", "keys").mapInArrow(lean(run), "bucket int, " + ", ".join(f"{c} binary" for c in DEALT))


def anchored(buckets: DataFrame) -> DataFrame:
    """anchor, s1: the members of each cell of two or more, or of what it is cut into, with the smallest.

    The first shingle that two linked sets have in common lies in both their signing shingles, and the ones before it differ or
    aren't there. So a cell whose members all have the same one before has no pair to judge, and a cell can be cut where no
    set on one side reaches the sizes of the other. Pairs with many shingles in common, which lie in many buckets,
    leave few of them for that.
    """

    def run(key, rows):
        cell, doc, n, reach, before = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in DEALT.items())
        # Of two keys of a document that fall together the first, which reaches farther, stands for both.
        order = np.lexsort((-reach, doc, cell))
        fresh = starting(cell[order], doc[order])
        alone = starting(cell[order][fresh])
        order = order[fresh][~(alone & np.append(alone[1:], True))]
        order = order[np.lexsort((n[order], cell[order]))]
        cell, doc, n, reach, before = (c[order] for c in (cell, doc, n.astype(np.int64), reach.astype(np.int64), before))
        if not len(cell):
            return pa.table([pa.array([], pa.int64())] * 2, names=["anchor", "s1"])
        own = starting(cell)
        rank = np.cumsum(own) << 33
        farthest = np.maximum.accumulate(reach + rank) - rank
        own[1:] |= farthest[:-1] < n[1:]
        starts = np.flatnonzero(own)
        two = starts[np.diff(np.append(starts, len(cell))) == 2]
        own[two + 1] = (n[two + 1] > reach[two]) | (n[two] > reach[two + 1])
        starts = np.flatnonzero(own)
        sizes = np.diff(np.append(starts, len(cell)))
        low = np.minimum.reduceat(before, starts)
        judged = (sizes > 1) & ((low == 0) | (low != np.maximum.reduceat(before, starts)))
        several = np.repeat(judged, sizes)
        a, b = np.repeat(np.minimum.reduceat(doc, starts), sizes)[several], doc[several]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = starting(a, b)
        give_back()
        return pa.table([pa.array(a[fresh]), pa.array(b[fresh])], names=["anchor", "s1"])

    return buckets.groupBy("bucket").applyInArrow(run, "anchor long, s1 long")


def anchored_hot(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for hot shingles, row by row: minima are summed up before the shuffle, so none of their cells meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(h, np.int64) for h in batch.column("hot").to_pylist()]
            s1 = np.repeat(batch.column("s1").to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *own])), pa.array(s1)], names=["key", "s1"])

    entries = scratch.keep(rows.where("hot IS NOT NULL").select("s1", "hot").mapInArrow(lean(run), "key long, s1 long"))
    least = scratch.keep(entries.groupBy("key").agg(F.min("s1").alias("anchor"), F.max("s1").alias("last")).where("anchor <> last").select("key", "anchor"))
    return entries.join(sent(least), "key").select("anchor", "s1")


def sent(rows: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if its size is in bounds; beyond them both sides of a join are shuffled."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows.hint("merge")


def with_sets(docs: DataFrame, known: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The classes ``known`` (s1, s2, rep and further columns) with body, the set as packed numbers. A class whose row is repeated can come twice."""
    schema = T.StructType([f for f in known.schema.fields if f.name not in ("s1", "s2", "rep")] + [T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)
            # A repeated doc_id has other texts besides the one of the class.
            own = pa.array([x.tobytes() if signature(x) == s else None for x, s in zip(sets(batch.column("body").to_pylist()), classes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([own if c == "body" else batch.column(c) for c in schema.names], names=schema.names).filter(own.is_valid())

    texts = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("body"))
    return texts.join(sent(known), "rep").mapInArrow(lean(run), schema)


def possible(counts: list[bytes], n: np.ndarray, known: np.ndarray, tile: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect all sets which the R-tree can't keep apart, besides those known to be connected; of different tiles only, if given."""
    fine = [np.frombuffer(zlib.decompress(c), np.uint8) for c in counts]
    tree, out = RTree(np.stack([folded(c, LEAST_GROUPS) for c in fine]), n, known), []

    def close(x: int, y: int) -> bool:
        groups = min(len(fine[x]), len(fine[y]))
        return groups == LEAST_GROUPS or bool(may_share(folded(fine[x], groups)[None], folded(fine[y], groups)[None], need(n[x], n[y]))[0])

    for a, b in tree.join():
        out += tree.tied(a, b, close, tile)
    return out


def verified(bodies: list[bytes], n: np.ndarray, known: np.ndarray, tile: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets, in the same way."""
    own = [np.frombuffer(b, np.uint64) for b in bodies]
    tree, out = RTree(points(own), n, known), []
    for a, b in tree.join():
        out += tree.tied(a, b, lambda x, y: linked(own[x], own[y]), tile)
    return out


def by_group(rows: pa.Table, *keys: str) -> Iterator[np.ndarray]:
    """The places of the rows of each group, by cls, which comes once."""
    columns = [rows.column(c).to_numpy() for c in (*keys, "cls")]
    order = np.lexsort(columns[::-1])
    same = [np.concatenate([[False], c[order][1:] == c[order][:-1]]) for c in columns]
    again = np.logical_and.reduce(same[:-1])
    starts = np.flatnonzero(~again)
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        yield order[a:b][~(again & same[-1])[a:b]]


def connected(groups: DataFrame, data: DataFrame, tie, scratch: Scratch) -> DataFrame:
    """a, b: what connects the members of groups. ``groups``: anchor, cls, n (weight); ``data``: cls, size, body; ``tie``: as ``possible``."""

    def run(key, rows):
        at = {c: rows.column(c).to_numpy() for c in ("i", "j", "cls", "part", "tile", "size")}
        bodies = rows.column("body").combine_chunks()
        left, right = [], []
        for own in by_group(rows, "anchor", "i", "j"):
            if len(own) > 1:
                across = at["tile"][own] if at["i"][own[0]] != at["j"][own[0]] else None
                for x, y in tie([bodies[int(k)].as_buffer() for k in own], at["size"][own], at["part"][own], across):
                    left.append(at["cls"][own[x]])
                    right.append(at["cls"][own[y]])
        give_back()
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def found(entries: DataFrame) -> DataFrame:
        return scratch.keep(data.join(sent(scratch.keep(entries)), "cls").groupBy("pack").applyInArrow(run, "a long, b long"), BATCH)

    sums = groups.groupBy("anchor").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.min("cls").alias("first"))
    tiles = F.ceil(F.greatest(F.col("members") / TILE, F.col("weight") / WEIGHT)).cast("int")
    large = scratch.keep(sums.withColumn("tiles", tiles).where("tiles > 1").select("anchor", "first", "tiles"))
    packs = max(1, -(-(groups.agg(F.sum("n")).first()[0] or 0) // PACK))
    spread = groups.join(sent(large), "anchor", "left").withColumn("tile", F.when(F.col("tiles").isNotNull(), F.pmod(F.xxhash64("cls"), F.col("tiles"))).otherwise(0).cast("int"))
    pack = F.when(F.col("tiles").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(packs))).otherwise(F.xxhash64("anchor", "i", "j"))
    entry = [pack.alias("pack"), "anchor", "i", "j", "tile", "part", "cls"]
    # The first member comes into every tile, and so holds them together.
    everywhere = F.when(F.col("cls") == F.col("first"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    links = found(spread.withColumn("i", F.explode(everywhere)).withColumn("j", F.col("i")).withColumn("part", F.col("cls")).select(*entry))
    if large.isEmpty():
        return links
    by_now = components(links, scratch).withColumnRenamed("node", "cls")
    named = scratch.keep(spread.where("tiles IS NOT NULL").join(by_now, "cls", "left").withColumn("part", F.coalesce("component", "cls")).select("anchor", "cls", "tiles", "tile", "part"))
    several = named.groupBy("anchor").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("anchor")
    across = named.join(several, "anchor").withColumn("pair", F.explode(tile_pairs())).select("*", "pair.i", "pair.j").where("i <> j")
    return links.unionByName(found(across.select(*entry)))


def tile_pairs():
    """The pairs of tiles that a tile is in."""
    return F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))


def settled(met: DataFrame, count_links: bool) -> DataFrame:
    """cls, component, links (rows of other classes) of parts that a task holds whole. ``met``: pack, part, cls, n, copies, body."""

    def run(key, rows):
        cls, n, copies = (rows.column(c).to_numpy() for c in ("cls", "n", "copies"))
        bodies = rows.column("body").combine_chunks()
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        for own in by_group(rows, "part"):
            if len(own) < 2:
                continue
            packed = [bodies[int(k)].as_buffer() for k in own]
            ties = verified(packed, n[own], np.arange(len(own)))
            if not ties:
                continue
            nodes, label = labels(*np.array(ties).T)
            for root in np.unique(label):
                some = nodes[label == root]
                links = np.zeros(len(some), np.int64)
                if count_links:
                    members = [np.frombuffer(packed[k], np.uint64) for k in some]
                    links = neighbours(members, members, copies[own[some]])[0] - copies[own[some]]
                out.append((cls[own[some]], np.full(len(some), cls[own[some]].min()), links))
        give_back()
        return pa.table([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(3)], names=["cls", "component", "links"])

    return met.groupBy("pack").applyInArrow(run, "cls long, component long, links long")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of one side with all of the other."""
    m, n = len(left), len(right)
    out = np.zeros((m, n), np.float32)  # exact below 2 ** 24
    key = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(m + n), [len(x) for x in (*left, *right)])
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(starts[1:], len(key))
    middle = starts + np.add.reduceat(owner < m, starts)  # owners ascend, so the left ones come first
    a, b = middle - starts, ends - middle
    met = (a > 0) & (b > 0)
    dense = met & (a * b > m * n // 32)
    for k in range(0, int(dense.sum()), COLUMNS):
        some = np.flatnonzero(dense)[k : k + COLUMNS]
        x, y = np.zeros((m, len(some)), np.float32), np.zeros((n, len(some)), np.float32)
        for side, since, count, less in ((x, starts, a, 0), (y, middle, b, m)):
            c = count[some]
            at = np.repeat(since[some] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            side[owner[at] - less, np.repeat(np.arange(len(some)), c)] = 1
        out += x @ y.T
    thin = np.flatnonzero(met & ~dense)
    size = a[thin] * b[thin]
    parts = np.cumsum(size) // LISTED
    for part in np.unique(parts):
        some, c = thin[parts == part], size[parts == part]
        within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        width = np.repeat(b[some], c)
        i = owner[np.repeat(starts[some], c) + within // width]
        j = owner[np.repeat(middle[some], c) + within % width] - m
        if len(i) * 4 > m * n:
            out += np.bincount(i * n + j, minlength=m * n).reshape(m, n)
        else:
            np.add.at(out, (i, j), 1)
    return out


def neighbours(left: list[np.ndarray], right: list[np.ndarray], right_weight: np.ndarray, left_weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """For each set of one side the weight of the sets of the other that it is linked with; of both sides, if both have weights."""
    both = shared(left, right)
    m, n = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    own, theirs = np.zeros(len(left), np.int64), None if left_weight is None else np.zeros(len(right), np.int64)
    for k in range(0, len(left), 256):
        link = both[k : k + 256] >= need(m[k : k + 256, None], n[None, :])
        own[k : k + 256] = link @ right_weight
        if theirs is not None:
            theirs += left_weight[k : k + 256] @ link
    return own, theirs


def link_counts(named: DataFrame, held: DataFrame) -> DataFrame:
    """cls, links: as in ``settled``, tile by tile. ``named``: cls, component, copies, weight (of the component), members; ``held``: cls, body."""
    tiles = F.ceil(F.greatest(F.col("members") / TILE, F.col("weight") / WEIGHT)).cast("int")
    own = named.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    spread = own.withColumn("pair", F.explode(tile_pairs())).select("component", "pair.i", "pair.j", "tile", "cls", "copies")

    def run(key, rows):
        i, j, tile, cls, copies = (rows.column(c).to_numpy() for c in ("i", "j", "tile", "cls", "copies"))
        bodies = rows.column("body").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in by_group(rows, "component", "i", "j"):
            one, two = (at[tile[at] == t[at[0]]] for t in (i, j))
            if len(one) and len(two):
                alone = i[at[0]] == j[at[0]]
                sides = [[np.frombuffer(bodies[int(k)].as_buffer(), np.uint64) for k in side] for side in (one, two)]
                own, theirs = neighbours(*sides, copies[two], None if alone else copies[one])
                out.append((cls[one], own - copies[one] if alone else own))
                if not alone:
                    out.append((cls[two], theirs))
        give_back()
        return pa.table([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(2)], names=["cls", "links"])

    return held.join(sent(spread), "cls").groupBy("component", "i", "j").applyInArrow(run, "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))


def classified(docs: DataFrame, doc_id: str, text: str, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, s1, s2) and classes (s1, s2, component_id, first: of its component?, n_links if wanted)."""
    spark = docs.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    # The sketch is SLOTS bytes, whatever the input.
    with batches_of(spark, BATCH):
        common = sketch(docs, text)
    rare = spark.sparkContext.broadcast(common)
    full = scratch.keep(described(docs, rare, hot_class(common), doc_id, text), BATCH)
    del common
    rare.destroy()
    rows = kept.keep(full.select("doc_id", "n", "s1", "s2"))
    usable = full.where("n > 0 AND doc_id IS NOT NULL")
    alike = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.count("*").alias("copies"))
    every = scratch.keep(alike.withColumn("cls", F.monotonically_increasing_id()))

    sums = usable.agg(F.sum(F.length("keys")).alias("keys"), F.count("hot").alias("hot")).first()
    buckets = max(24, -(-(sums["keys"] or 0) // (8 * BUCKET)))
    pairs = anchored(dealt(usable, buckets))
    if sums["hot"]:
        pairs = pairs.unionByName(anchored_hot(usable, scratch))
    pairs = scratch.keep(pairs.distinct())
    scratch.drop(full)
    # s1 stands for all classes that share it, if any do; they come into the same groups.
    known = scratch.keep(every.join(sent(scratch.keep(pairs.select("s1").distinct())), "s1"))
    groups = scratch.keep(pairs.join(sent(known.select("s1", "cls")), "s1").select("anchor", "cls", F.lit(POINT).alias("n")))
    near = components(connected(groups, known.select("cls", F.col("n").alias("size"), F.col("counts").alias("body")), possible, scratch), scratch)
    classes = kept.keep(every.select("s1", "s2", "cls", "rep", "copies"))

    parts = scratch.keep(known.drop("counts").join(sent(near.withColumnRenamed("node", "cls").withColumnRenamed("component", "part")), "cls"))
    sizes = scratch.keep(parts.groupBy("part").agg(F.count("*").alias("members"), F.sum("n").alias("weight")))
    whole = (F.col("members") <= TILE) & (F.col("weight") <= WEIGHT)
    packs = max(1, -(-(sizes.where(whole).agg(F.sum("weight")).first()[0] or 0) // PACK))
    large = scratch.keep(sizes.where(~whole).select("part"))
    some = not large.isEmpty()
    small = scratch.keep((parts.join(sent(large), "part", "left_anti") if some else parts).withColumn("pack", F.pmod(F.xxhash64("part"), F.lit(packs))))
    judged = scratch.keep(settled(with_sets(docs, small, doc_id, text), count_links), BATCH)
    if some:
        rest = scratch.keep(parts.join(sent(large), "part"))
        held = scratch.keep(with_sets(docs, rest.select("cls", "s1", "s2", "rep", F.col("n").alias("size")), doc_id, text), BATCH)
        found = components(connected(rest.select(F.col("part").alias("anchor"), "cls", "n"), held, verified, scratch), scratch).withColumnRenamed("node", "cls")
        named = scratch.keep(rest.join(sent(found), "cls"))
        if count_links:
            totals = named.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
            listed = scratch.keep(named.join(totals, "component").select("cls", "component", "copies", "members", "weight"))
            named = named.join(link_counts(listed, held.select("cls", "body")), "cls", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        else:
            named = named.withColumn("links", F.lit(0).cast("long"))
        judged = judged.unionByName(scratch.keep(named.select("cls", "component", "links"), BATCH))

    reps = classes.join(sent(judged), "cls")
    least = reps.groupBy("component").agg(F.min(F.struct("rep", "cls")).alias("least"))
    joined = kept.keep(reps.join(least, "component").select("cls", F.col("least.rep").alias("component_id"), (F.col("least.cls") == F.col("cls")).alias("first"), "links"))
    scratch.drop()
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return rows, classes.join(sent(joined), "cls", "left").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"), links)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows that the row is linked with) for each row."""
    rows, classes = classified(docs, doc_id, text, count_links=True)
    out = rows.join(classes, ["s1", "s2"], "left")
    some = F.col("doc_id").isNotNull()
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    links = F.when(some & F.col("n_links").isNotNull(), F.col("n_links")).otherwise(0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, own).alias("component_id"), links.alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are linked with one that stays: of each component a row of its smallest doc_id.

    Rows without words or without a doc_id stay. Whole texts are moved only for a doc_id that several rows share.
    """
    kept = Scratch(docs.sparkSession)
    rows, classes = classified(docs, doc_id, text, count_links=False)
    judged = rows.where("doc_id IS NOT NULL").join(classes, ["s1", "s2"], "left")
    stays = (F.col("n") == 0) | (F.col("first") & (F.col("doc_id") == F.col("component_id")))
    by_id = judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(stays).alias("stay"))
    gone = kept.keep(by_id.where("stay = 0 OR rows > 1").select(F.col("doc_id").alias(doc_id), (F.col("rows") > 1).alias("repeated_")))
    left = docs.join(sent(gone.select(doc_id)), doc_id, "left_anti").select(*docs.columns)
    again = gone.where("repeated_").select(doc_id)
    if again.isEmpty():
        return left
    one, two, size, place = (unused(c, docs) for c in ("one", "two", "size", "place"))
    schema = T.StructType([*docs.schema.fields, T.StructField(one, T.LongType()), T.StructField(two, T.LongType())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [signature(x) for x in sets(batch.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in marks], pa.int64()) for k in range(2))], names=schema.names)

    own = kept.keep(docs.join(sent(again), doc_id, "left_semi").select(*docs.columns).mapInArrow(lean(signed), schema), BATCH)
    chosen = judged.where(stays).select(F.col("doc_id").alias(doc_id), F.col("s1").alias(one), F.col("s2").alias(two), F.col("n").alias(size)).distinct()
    in_order = F.row_number().over(Window.partitionBy(doc_id, one, two).orderBy(text, *[c for c in docs.columns if c not in (doc_id, text)]))
    return left.unionByName(own.join(chosen, [doc_id, one, two]).withColumn(place, in_order).where((F.col(place) == 1) | (F.col(size) == 0)).select(*docs.columns))


def op6_jaccard(spark, sf_dir):
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
