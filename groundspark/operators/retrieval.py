"""Exact k-nearest-neighbour join by inner product, and what retrieval builds on it."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.functions.text import normalize_answer, normalized_words
from groundspark.settings import SETTINGS

#: Corpus rows and questions that meet in one task.
CORPUS_BLOCK, QUESTION_BLOCK = 32_768, 8_192
DECIMALS = 6


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def unit(vector: Column) -> Column:
    """A vector at length 1, so that inner products are cosines; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest scores of each row, best first, of equal ones the first."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), np.int64)
    for r in range(len(scores)):
        some = np.flatnonzero(scores[r] >= least[r])
        out[r] = some[np.argsort(-scores[r, some], kind="stable")[:k]]
    return out


def nearest(questions: DataFrame, corpus: DataFrame, k: int | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """qid, rank, chunk_id, score: each question's k best chunks; scores to DECIMALS, ties to the smaller id.

    ``questions``: qid, vector; ``corpus``: chunk_id, vector. ``k`` of None or 0 means the default. Blocks of questions
    meet blocks of the corpus, and each meeting passes on k rows a question at most, so nothing is broadcast, and the
    number of blocks follows the ``sizes`` of both sides; they are counted if they aren't given, so give them where the
    vectors are computed.
    """
    k = k or SETTINGS.top_k
    asked, held = (max(1, n) for n in sizes or (questions.count(), corpus.count()))
    nq, nc = -(-asked // QUESTION_BLOCK), max(-(-held // CORPUS_BLOCK), min(8, -(-held // 512)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = questions.select("qid", "vector", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("q")).withColumn("c", every(nc))
    right = corpus.select("chunk_id", "vector", F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).cast("int").alias("c")).withColumn("q", every(nq))
    q_kind, c_kind = questions.schema["qid"].dataType.simpleString(), corpus.schema["chunk_id"].dataType.simpleString()

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = pa.table({"qid": mine.column("qid").slice(0, 0), "chunk_id": theirs.column("chunk_id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(mine) or not len(theirs):
            return empty
        theirs = theirs.sort_by("chunk_id")
        corpus_t, out_q, out_c, out_s = _matrix(theirs.column("vector")).T, [], [], []
        for a in range(0, len(mine), 256):
            scores = np.round(_matrix(mine.slice(a, 256).column("vector")) @ corpus_t, DECIMALS) + 0.0
            best = best_places(scores, k)  # ids ascend
            out_q.append(np.repeat(np.arange(a, a + len(scores)), best.shape[1]))
            out_c.append(best.ravel())
            out_s.append(np.take_along_axis(scores, best, 1).ravel())
        return pa.table({"qid": mine.column("qid").take(pa.array(np.concatenate(out_q))), "chunk_id": theirs.column("chunk_id").take(pa.array(np.concatenate(out_c))), "score": pa.array(np.concatenate(out_s))})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(meet, f"qid {q_kind}, chunk_id {c_kind}, score double")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def hit_rate(hits: DataFrame, questions: DataFrame, is_gold: Column, k: int) -> DataFrame:
    """n, hits and rate at k and at 1; a question without hits counts as a miss."""
    own = hits.groupBy("qid").agg(F.max(F.when(is_gold & (F.col("rank") <= k), 1).otherwise(0)).alias("at_k"), F.max(F.when(is_gold & (F.col("rank") == 1), 1).otherwise(0)).alias("at_1"))
    totals = questions.select("qid").join(own, "qid", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("at_k"), F.lit(0)).alias("hits_at_k"), F.coalesce(F.sum("at_1"), F.lit(0)).alias("hits_at_1"))
    rate = lambda c: F.col(c) / F.greatest("n", F.lit(1))
    return totals.select("n", "hits_at_k", "hits_at_1", rate("hits_at_k").alias("hit_rate_at_k"), rate("hits_at_1").alias("hit_rate_at_1"))


def retrieval_hit(context: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, hit: some gold is inside the joined, normalised texts of a question's context. Golds that normalise to nothing never are."""
    joined = context.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("joined"))
    body = joined.select("qid", normalize_answer(F.col("joined")).alias("body"))
    golds = F.transform("answers", normalize_answer)
    hit = F.exists(golds, lambda g: (g != "") & F.contains(F.col("body"), g))
    return questions.join(body, "qid", "left").select("qid", F.coalesce(hit, F.lit(False)).alias("hit"))


#: Characters of passages that one pass over the texts searches for.
PASS_CHARS = 4_000_000


def holders(bodies: DataFrame, golds: DataFrame) -> DataFrame:
    """doc_id, item_id of each body that holds a gold passage whole. ``bodies``: doc_id, body; ``golds``: item_id, gold; both normalised.

    One automaton over the passages is run over each body, so nothing is shuffled. Passages are a stated set; they are dealt
    into as many passes as keep an automaton at PASS_CHARS characters, whatever their number. Empty passages are in no body.
    """
    some = golds.where("gold <> ''")
    chars = some.agg(F.sum(F.length("gold"))).first()[0] or 0
    passes = max(1, -(-chars // PASS_CHARS))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((bodies, "doc_id"), (golds, "item_id"))]
    item = pa.from_numpy_dtype(np.int64) if kinds[1] in ("bigint", "long") else None

    def one(k: int) -> DataFrame:
        # PASS_CHARS characters on average
        own = some.where(F.pmod(F.xxhash64("gold"), F.lit(passes)) == k).groupBy("gold").agg(F.collect_list("item_id").alias("items")).collect()
        listed = [(r["gold"], r["items"]) for r in own]

        def run(batches):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for n, (gold, _) in enumerate(listed):
                machine.add_word(gold, n)
            machine.make_automaton()
            for batch in batches:
                ids, items = [], []
                for i, body in enumerate(batch.column("body").to_pylist()):
                    found = {n for _, n in machine.iter(body)} if body and listed else ()
                    for n in sorted(found):
                        ids += [i] * len(listed[n][1])
                        items += listed[n][1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(items, item)], names=["doc_id", "item_id"])

        return bodies.select("doc_id", "body").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}")

    return reduce(DataFrame.unionByName, map(one, range(passes)))


def get_chunks(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk_id, text, found for each wanted chunk_id; text is null for one that isn't there."""
    known = index.select("chunk_id", "text", F.lit(True).alias("found"))
    return wanted.select("chunk_id").distinct().join(known, "chunk_id", "left").select("chunk_id", "text", F.coalesce("found", F.lit(False)).alias("found"))


def merge_rounds(first: DataFrame, wider: DataFrame) -> DataFrame:
    """First-round hits, then wider ones not seen yet, with their place: ``pos``. A chunk in both keeps its first copy."""
    both = first.withColumn("round", F.lit(0)).unionByName(wider.withColumn("round", F.lit(1)))
    once = both.withColumn("copy", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("round"))).where("copy = 1").drop("copy")
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("round", "rank")))


def hashed_vectors(texts: DataFrame, text: str = "text", dim: int = 256) -> DataFrame:
    """A lexical stand-in for an embedder, and named so: hashed, unit-length counts of normalised words in ``vector``."""
    words = texts.withColumn("_w", normalized_words(F.col(text)))

    def run(batches):
        for batch in batches:
            out = []
            for words in batch.column("_w").to_pylist():
                v = np.zeros(dim, np.float32)
                for w in words or []:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                out.append(v / (np.linalg.norm(v) or 1.0))
            keep = [n for n in batch.schema.names if n != "_w"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array([x.tolist() for x in out], pa.list_(pa.float32()))], names=[*keep, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return words.mapInArrow(run, f"{fields}, vector array<float>")
