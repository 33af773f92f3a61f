"""Exact duplicates by skew-safe combining.

Texts are compared whole at every stage; the digest only says which of them meet:

1. locally: each task brings its rows down to one for each different text, before anything is shuffled;
2. by salted digest: such rows of the same digest and text meet. A digest of more than 1 / HOT of all rows is salted by the
   task that its rows come from, a salt for each 1 / HOT of all rows; there are at most HOT such digests and 2 * HOT salts;
3. globally: the salts' winners of those digests meet and are compared whole again.

Whole texts are shuffled once, after the local stage. What leaves stage 2 are digests, counts and winners, with a text
only where a salt is still to be combined. Every row finds its group by its digest alone; where two different texts share a
digest (none do by SHA-256, but the digest is a parameter), its rows are found by their whole texts.

Contract: a null text counts as empty. Of equal texts the row of the largest id stays; an id of null is smaller than any
other. Of rows that also share that id exactly one stays. Every row counts, repeated ones too. An empty table gives an empty
one; long texts are compared whole; further columns are ignored by ``groups``, whatever their names, and kept by
``survivors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.llm.common import Scratch, table

#: Digests that can be hot at once, which bounds what is broadcast; a group of fewer than LEAST rows never is.
HOT, LEAST = 50_000, 32

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_is(text: Column) -> Column:
    return text


def texts(df: DataFrame, doc_id: str, text: str, digest: Digest, normal: Digest) -> DataFrame:
    """doc_id, text (normalised), digest."""
    own = df.select(F.col(doc_id).alias("doc_id"), normal(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return own.withColumn("digest", digest(F.col("text")))


def combined(rows: DataFrame, hot: DataFrame, scratch: Scratch) -> DataFrame:
    """digest, keep_id, group_size: one row for each different text. ``hot``: the digests to salt and their numbers of salts."""
    dealt = rows.join(F.broadcast(hot), "digest", "left")
    salt = F.coalesce(F.pmod(F.spark_partition_id().cast("long"), F.col("salts")), F.lit(-1))
    # The partial aggregate before this exchange is stage 1, the final one stage 2.
    salted = dealt.withColumn("salt", salt).groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    parts = scratch.keep(salted.withColumn("text", F.when(F.col("salt") >= 0, F.col("text"))))
    winners = parts.where("salt >= 0").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    columns = ("digest", "keep_id", "group_size")
    return parts.where("salt < 0").select(*columns).unionByName(winners.select(*columns))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Digest = sha256, normal: Digest = as_is) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: a row for each row of ``df``.

    ``normal``: what is compared of a text; ``digest``: where texts meet. Neither changes which texts are equal.
    """
    scratch = Scratch(df.sparkSession)
    rows = texts(df, doc_id, text, digest, normal)
    ids = scratch.keep(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest"))
    # An id of null wins only where there is no other.
    top = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))
    tops = scratch.keep(ids.groupBy("digest").agg(F.count("*").alias("n"), top.alias("top")))
    bar = max(LEAST, ids.count() // HOT)
    hot = tops.where(F.col("n") > bar).select("digest", F.ceil(F.col("n") / bar).alias("salts"))
    classes = scratch.keep(combined(rows, hot, scratch))
    shared = classes.groupBy("digest").count().where("count > 1").select("digest")
    n_shared = shared.count()
    single = classes.join(shared, "digest", "left_anti") if n_shared else classes
    # Rows of hot digests are dealt by their number, and the one class of each is there for every salt.
    dealt = ids.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")), F.lit(-1))).drop("salts")
    known = single.join(tops.select("digest", "top"), "digest").join(F.broadcast(hot), "digest", "left")
    each = F.when(F.col("salts") > 0, F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(F.lit(-1).cast("long")))
    out = dealt.join(known.withColumn("salt", F.explode(each)), ["digest", "salt"]).select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("top")).alias("kept"))
    return out.unionByName(crowded(rows, shared)) if n_shared else out


def crowded(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of digests that several texts share, by whole texts: copies are combined first and then joined again."""
    own = rows.join(shared, "digest", "left_semi")
    classes = own.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    met = own.join(classes, ["digest", "text"])
    first = F.row_number().over(Window.partitionBy("digest", "text", "doc_id").orderBy(F.lit(1)))
    return met.withColumn("nth", first).select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"))


def survivors(df: DataFrame, doc_id: str = "doc_id", text: str = "text", normal: Digest = as_is) -> DataFrame:
    """The rows that stay, with all their columns; rows that repeat an id and a text are combined before they are shuffled."""
    stay = groups(df, doc_id, text, normal=normal).where("kept").select(F.col("digest").alias("kept_digest"), F.col("doc_id").alias("kept_id"))
    body = normal(F.coalesce(F.col(text), F.lit("")))
    whole = df.select(F.struct(*df.columns).alias("own"), sha256(body).alias("digest"), body.alias("body"), F.col(doc_id).alias("id"))
    one = whole.groupBy("digest", "id", "body").agg(F.first("own").alias("own"))
    return one.join(stay, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("own.*")


def op12_dedup(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size, doc_id = max(doc_id) OVER own AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) WINDOW own AS (PARTITION BY body)
"""
