"""WARC records and the Merkle fixity audit of their replicas.

Records lie in files at byte offsets. Each record has a hash over its bytes; a leaf of a file's tree is a range of
offsets of RANGE_BYTES and hashes, in order, the offsets, lengths and hashes of the records that start there; each node
above hashes FANOUT ranges, up to the root of the file, and files are hashed the same way up to the root of a replica.
The audit compares the two roots and descends only into branches whose hashes differ; in the leaf ranges it reaches,
records are compared one by one.

Contract: rows with null bytes count as records of no bytes; records of equal offset are taken in the order of their
ids; repeated rows count as often as they are there; an empty replica lacks everything the other one has; further
columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groundspark.llm.common import Scratch, table

FANOUT, RANGE_BYTES = 16, 65_536
#: Pages that go into one file.
PER_FILE = 500
#: Files for pages without an id.
NAMELESS = 1 << 20
#: Where a record starts behind a damaged one, whose end may be cut off.
START, DAMAGED = re.compile(rb"WARC/1\.\d+\r\n(?=[A-Za-z-]+:)"), "damaged"

RECORDS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record_id", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("record", T.BinaryType()),
    T.StructField("payload", T.BinaryType()),
])


def record_bytes(record_id: Column, uri: Column, payload: Column, kind: str = "resource") -> Column:
    """A WARC 1.1 record as binary."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def parse(data: bytes) -> Iterator[tuple[int, str, str, str, bytes, bytes]]:
    """The records of a file, plain or gzipped (offsets then are those in the uncompressed data); none of a file that isn't an archive.

    What is no whole record is one of kind DAMAGED without payload, up to the next start of a record; its id and address
    are those that its head still has.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while at < len(data) and b"WARC" in data:
        end = data.find(b"\r\n\r\n", at)
        end = len(data) if end < 0 else end
        head = _head(data[at:end])
        size = head.get("content-length", "0")
        stop = end + 4 + (int(size) if size.isascii() and size.isdigit() and len(size) < 19 else len(data))
        whole = data.startswith(b"WARC/", at) and stop <= len(data) and b"\r\n\r\n".startswith(data[stop : stop + 4])
        if whole:
            to = min(stop + 4, len(data))
        else:
            following = START.search(data, at + 1)
            to = following.start() if following else len(data)
            head = _head(data[at : min(end, to)])
        yield at, head.get("warc-record-id", ""), head.get("warc-target-uri", ""), head.get("warc-type", "") if whole else DAMAGED, data[at:to], data[end + 4 : stop] if whole else b""
        at = to


def _head(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records under a path, through Spark's reader of binary files. One file goes to one task; archives keep files near 1 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(name, *r) for r in parse(content)]
                columns = [pa.array([r[k] for r in rows]) for k in range(len(RECORDS))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, (pa.string(), pa.int64(), *[pa.string()] * 3, *[pa.binary()] * 2), strict=True)], names=RECORDS.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def placed(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Pages as records of files: file, offset, record_id, record. A file holds a range of ids, in order.

    Pages without an id, however many, are dealt to NAMELESS files of negative numbers by a hash of their bytes.
    """
    known = F.floor(F.col("page_id") / per_file).cast("long")
    made = pages.select(known.alias("known"), "page_id", record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    file = F.coalesce("known", -1 - F.pmod(F.xxhash64("record"), F.lit(NAMELESS)))
    made = made.select(file.alias("file"), "page_id", "record")
    before = Window.partitionBy("file").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    at = made.withColumn("offset", F.coalesce(F.sum(F.octet_length("record").cast("long")).over(before), F.lit(0)))
    return at.select("file", "offset", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("record_id"), "record")


def laid_out(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """The records of ``placed``, hashed."""
    return hashed(placed(pages, per_file))


def flipped(record: Column) -> Column:
    """With one bit of the byte in the middle changed."""
    at = (F.floor(F.octet_length(record) / 2) + 1).cast("int")
    byte = F.conv(F.hex(F.substring(record, at, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))
    return F.concat(F.substring(record, F.lit(1), at - 1), F.unhex(F.lpad(F.hex(byte), 2, "0")), F.substring(record, at + 1, F.octet_length(record)))


def cut(record: Column) -> Column:
    """Without its last quarter, one byte at least."""
    n = F.octet_length(record)
    return F.substring(record, F.lit(1), (n - F.greatest(F.floor(n / 4), F.lit(1))).cast("int"))


def hashed(records: DataFrame, record: str = "record") -> DataFrame:
    """file, offset, record_id, length and digest of raw records."""
    data = F.coalesce(F.col(record), F.lit(b""))
    return records.select("file", "offset", F.coalesce(F.col("record_id").cast("string"), F.lit("")).alias("record_id"), F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("digest"))


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "|"), 256)


def _up(nodes: DataFrame, *within: str) -> DataFrame:
    """The level above: FANOUT nodes each, whatever their number. Indexes are padded so that their text sorts as they do."""
    part = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")
    return nodes.groupBy(*within, F.floor(F.col("node") / FANOUT).alias("node")).agg(_joined(part).alias("hash"))


class Tree:
    """A replica's levels: ranges of each file from the leaves up, then ranges of files up to the root."""

    def __init__(self, records: DataFrame, scratch: Scratch, ranges: int, files: int):
        self.records = records
        entry = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), "record_id", "length", "digest")
        leaf = records.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("node")).agg(_joined(entry).alias("hash"))
        self.inside = [scratch.keep(leaf)]
        while ranges > 1:
            self.inside.append(scratch.keep(_up(self.inside[-1], "file")))
            ranges = -(-ranges // FANOUT)
        self.across = [scratch.keep(self.inside[-1].select(F.col("file").alias("node"), "hash"))]
        while files > 1:
            self.across.append(scratch.keep(_up(self.across[-1])))
            files = -(-files // FANOUT)

    def root(self) -> list[tuple[int, str]]:
        """One row, or two where null keys gave a negative file; none for an empty replica."""
        return sorted((r["node"], r["hash"]) for r in self.across[-1].collect())


def _differing(mine: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    m, o = mine.withColumnRenamed("hash", "mine"), other.withColumnRenamed("hash", "other")
    return m.join(o, list(keys), "full").where(~F.col("mine").eqNullSafe(F.col("other"))).select(*keys)


def audit(original: DataFrame, replica: DataFrame, scratch: Scratch) -> DataFrame:
    """Records that differ: file, offset, record_id and status (corrupt, missing or extra). Inputs as from ``hashed``."""
    extent = original.unionByName(replica).agg(F.max("offset"), F.max("file"), F.min("file")).first()
    ranges, files = (extent[0] or 0) // RANGE_BYTES + 1, max((extent[1] or 0) + 1, -(extent[2] or 0))
    mine, other = Tree(original, scratch, ranges, files), Tree(replica, scratch, ranges, files)
    bad = _differing(mine.across[-1], other.across[-1], "node")
    if mine.root() == other.root():
        bad = bad.limit(0)
    for a, b in zip(mine.across[-2::-1], other.across[-2::-1], strict=True):
        parents = scratch.keep(bad).withColumnRenamed("node", "above")
        below = lambda t: t.withColumn("above", F.floor(F.col("node") / FANOUT)).join(parents, "above", "left_semi").drop("above")  # noqa: E731, B023
        bad = _differing(below(a), below(b), "node")
    bad = bad.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("node"))
    first = True
    for a, b in zip(mine.inside[::-1], other.inside[::-1], strict=True):
        parents = scratch.keep(bad).withColumnRenamed("node", "above")
        width = 1 if first else FANOUT
        first = False
        below = lambda t: t.withColumn("above", F.floor(F.col("node") / width)).join(parents, ["file", "above"], "left_semi").drop("above")  # noqa: E731, B023
        bad = _differing(below(a), below(b), "file", "node")
    ranges_left = scratch.keep(bad)
    near = lambda t: t.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(ranges_left, ["file", "node"], "left_semi").groupBy("file", "offset", "record_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("digest"))
    m, o = near(mine.records), near(other.records).withColumnsRenamed({"n": "n2", "digest": "digest2"})
    status = F.when(F.col("digest2").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return m.join(o, ["file", "offset", "record_id"], "full").where(~F.col("digest").eqNullSafe(F.col("digest2"))).select("file", "offset", "record_id", status.alias("status"))


def fingerprints(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """As ``laid_out``, with the length and the digest of each record's damaged bytes (bad_length, bad_digest), and records hashed where
    pages are read: what is shuffled is a key and digests, never the bytes. Records of equal ids lie in the order of their digests.
    """
    made = pages.select("page_id", F.floor(F.col("page_id") / per_file).cast("long").alias("known"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    both = made.withColumn("bad", spoiled(F.col("record"), F.col("page_id")))
    file = F.coalesce("known", -1 - F.pmod(F.xxhash64("record"), F.lit(NAMELESS)))
    size = lambda c: F.octet_length(c).cast("long")
    rows = both.select(file.alias("file"), "page_id", size("record").alias("length"), F.sha2("record", 256).alias("digest"), size("bad").alias("bad_length"), F.sha2("bad", 256).alias("bad_digest"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return at.select("file", "offset", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("record_id"), "length", "digest", "bad_length", "bad_digest")


def spoiled(record: Column, number: Column) -> Column:
    """A record as the damaged replica has it: of some numbers with a flipped byte or a cut tail."""
    changed = F.when(F.pmod(number, F.lit(2)) == 0, flipped(record)).otherwise(cut(record))
    return F.when(F.pmod(number, F.lit(97)) == 5, changed).otherwise(record)


def left_over(records: DataFrame) -> DataFrame:
    """Without the last records of some files, and without some whole files. A table of at most a row for each seventeenth file is joined
    by the optimizer's own choice."""
    lost = lambda step, k: (F.col("file") >= 0) & (F.pmod("file", F.lit(step)) == k)
    last = records.groupBy("file").agg(F.max("offset").alias("offset")).where(lost(17, 3))
    return records.where(~lost(53, 9)).join(last, ["file", "offset"], "left_anti")


def damaged(records: DataFrame) -> DataFrame:
    """A replica in which some records have a flipped byte or a cut tail, and the last ones of some files and whole files are lost.

    What is left of a record stays at its offset; records without an id stay whole.
    """
    return left_over(records).select("file", "offset", "record_id", spoiled(F.col("record"), F.col("record_id").try_cast("bigint")).alias("record"))


def numbered(original: DataFrame, root: str, replica: DataFrame, replica_root: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What ``read_warc`` found under two roots, with ``file`` as a number: that of the path below the root."""
    sides = [d.withColumn("name", F.substring_index("path", r.rstrip("/") + "/", -1)) for d, r in ((original, root), (replica, replica_root))]
    names = sides[0].select("name").unionByName(sides[1].select("name")).distinct()
    # One row for each file; archives keep files near 1 GB.
    known = scratch.keep(names.withColumn("file", F.row_number().over(Window.orderBy("name")).cast("long") - 1))
    mine, other = (d.join(F.broadcast(known), "name").select("file", "offset", "record_id", "record") for d in sides)
    return mine, other


def op7_warc(spark, sf_dir):
    """Audits a replica of the archive of all pages, damaged in known places: bytes changed, tails cut off, files lost."""
    scratch = Scratch(spark)
    records = scratch.keep(fingerprints(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    bad = left_over(records).select("file", "offset", "record_id", F.col("bad_length").alias("length"), F.col("bad_digest").alias("digest"))
    return audit(records.drop("bad_length", "bad_digest"), scratch.keep(bad), scratch)


OP7_SQL = f"""
WITH made AS (
  SELECT page_id, page_id // {PER_FILE} AS file,
    {len('WARC/1.1') + len('WARC-Type: resource') + len('WARC-Record-ID: <urn:page:>') + len('WARC-Target-URI: ') + len('Content-Type: text/html') + len('Content-Length: ') + 7 * 2 + 4}
      + length(page_id::VARCHAR) + strlen(coalesce(url, '')) + length(strlen(coalesce(html, ''))::VARCHAR) + strlen(coalesce(html, '')) AS length
  FROM pages),
placed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  row_number() OVER (PARTITION BY file ORDER BY page_id DESC) AS back FROM made),
judged AS (SELECT file::BIGINT AS file, "offset", page_id::VARCHAR AS record_id,
  CASE WHEN file % 53 = 9 OR (file % 17 = 3 AND back = 1) THEN 'missing' WHEN page_id % 97 = 5 THEN 'corrupt' END AS status FROM placed)
SELECT file, "offset", record_id, status FROM judged WHERE status IS NOT NULL
"""
