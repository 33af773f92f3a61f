"""An index by buckets of documents, whose versions share the buckets that didn't change.

    root/data/v=<number>/bucket=<k>/part-*      the buckets that version <number> wrote
    root/manifests/<number>.json                which version holds each bucket, and what is in it

A bucket is a hash of the document's id, so an update reads and writes the buckets of its own documents only; every other one
stays where an earlier version put it. A version exists once its manifest does: it is written beside and renamed, which either
happens as a whole or not at all, and which fails if another writer took the number. What a writer that died has left behind is
in no manifest and is overwritten by the next one to take its number. A reader takes the last manifest and, unless told not to,
compares each bucket's rows and the vectors' dimension with it before it answers.

Each batch has a key; one that the current version has seen already changes nothing, so a batch may be replayed.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new index; an existing one keeps its own number. Rows of a bucket that go to one file, about.
BUCKETS, IN_FILE = 256, 250_000
#: Keys of the last batches that a manifest remembers.
REMEMBERED = 64


class DamagedIndex(ValueError):
    """An index whose files aren't what its manifest says."""


class Manifest(NamedTuple):
    version: int
    buckets: int
    schema: str
    dimension: int | None
    batches: list[str]
    #: Of each bucket that has rows: the version that wrote it, chunks, documents.
    held: dict[str, list[int]]

    @property
    def chunks(self) -> int:
        return sum(h[1] for h in self.held.values())

    @property
    def documents(self) -> int:
        return sum(h[2] for h in self.held.values())


class _Files:
    """The few operations on files that a table writer has no name for, on whatever file system the root is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def system(self):
        return self.path().getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.system().listStatus(at)) if self.system().exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system().open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes beside and renames; False if the name is taken."""
        beside = f"{name}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp"
        stream = self.system().create(self.path(beside), True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        place = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system().getUri(), self.conf)
        qualified = [self.system().makeQualified(self.path(x)) for x in (beside, name)]
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            place.rename(*qualified, none)
        except Exception as e:
            self.system().delete(self.path(beside), False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.system().delete(self.path(name), True)


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _Files(spark, root).names("manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest | None:
    """The last version's manifest, or that of an earlier one that is still there; None for no index."""
    known = versions(spark, root)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise DamagedIndex(f"there is no version {version} of the index at {root}")
    at = known[-1] if version is None else version
    try:
        return Manifest(**json.loads(_Files(spark, root).read(f"manifests/{at:012d}.json")))
    except (ValueError, TypeError) as e:
        raise DamagedIndex(f"the manifest of version {at} can't be read: {e}") from e


def _paths(spark: SparkSession, root: str, own: Manifest, buckets: list[str]) -> list[str]:
    """Folders of these buckets; raises where one is missing."""
    files = _Files(spark, root)
    there: dict[int, set[str]] = {}
    for b in buckets:
        v = own.held[b][0]
        if v not in there:
            there[v] = set(files.names(f"data/v={v}"))
        if f"bucket={b}" not in there[v]:
            raise DamagedIndex(f"bucket {b} of version {v} is missing")
    return [f"{files.root}/data/v={own.held[b][0]}/bucket={b}" for b in buckets]


def _rows(spark: SparkSession, root: str, own: Manifest, buckets: list[str] | None = None) -> DataFrame:
    """The rows of some buckets, with the column ``bucket``."""
    schema = T.StructType.fromJson(json.loads(own.schema))
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    listed = sorted(own.held if buckets is None else set(buckets) & set(own.held))
    if not listed:
        return spark.createDataFrame([], whole)
    base = f"{root.rstrip('/')}/data"
    return spark.read.schema(whole).option("basePath", base).parquet(*_paths(spark, root, own, listed)).select(*whole.names)


def _contents(rows: DataFrame) -> DataFrame:
    """bucket, chunks, documents, and least and most dimension where there are vectors."""
    size = [F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")] if "vector" in rows.columns else []
    return rows.groupBy("bucket").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), *size)


def read(spark: SparkSession, root: str, version: int | None = None, check: bool = True, dimension: int | None = None) -> DataFrame:
    """The chunks of a version. Raises DamagedIndex where files and manifest differ, or vectors have another dimension than asked for."""
    own = manifest(spark, root, version)
    if own is None:
        raise DamagedIndex(f"there is no index at {root}")
    if dimension is not None and own.dimension is not None and own.dimension != dimension:
        raise DamagedIndex(f"the vectors of the index have dimension {own.dimension} instead of {dimension}")
    rows = _rows(spark, root, own)
    if check:
        try:
            found = {str(r["bucket"]): r for r in _contents(rows).collect()}  # a row for each bucket
        except Exception as e:
            raise DamagedIndex(f"version {own.version} can't be read: {e}") from e
        for b, (_, chunks, documents) in own.held.items():
            r = found.get(b)
            if r is None or (r["chunks"], r["documents"]) != (chunks, documents):
                raise DamagedIndex(f"bucket {b} holds {r and r['chunks']} chunks instead of {chunks}")
            if own.dimension is not None and (r["least"], r["most"]) != (own.dimension, own.dimension):
                raise DamagedIndex(f"bucket {b} holds vectors of dimension {r['least']} to {r['most']} instead of {own.dimension}")
    return rows.drop("bucket")


def update(root: str, fresh: DataFrame, batch: str, buckets: int = BUCKETS, removed: DataFrame | None = None, tries: int = 3) -> Manifest:
    """A new version in which the documents of ``fresh`` (doc_id, chunk_id, ...) replace their older chunks and those of ``removed``
    (doc_id) are gone. Only buckets that hold one of these documents are read and written. Where another writer takes the number
    first, the work is done again on top of its version.
    """
    spark = fresh.sparkSession
    files = _Files(spark, root)
    for _ in range(tries):
        old = manifest(spark, root)
        if old is not None and batch in old.batches:
            return old
        n = old.buckets if old else buckets
        number = old.version + 1 if old else 1
        place = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket")
        columns = fresh.columns
        new = fresh.select("*", place)
        gone = new.select("doc_id", "bucket") if removed is None else new.select("doc_id", "bucket").unionByName(removed.select(F.col("doc_id").cast("string").alias("doc_id")).select("doc_id", place))
        touched = sorted(str(r["bucket"]) for r in gone.select("bucket").distinct().collect())  # at most the number of buckets
        if old:
            if T.StructType.fromJson(json.loads(old.schema)).names != columns:
                raise ValueError(f"the index has the columns {T.StructType.fromJson(json.loads(old.schema)).names} instead of {columns}")
            new = _rows(spark, root, old, touched).join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*columns, "bucket").unionByName(new)
        # A bucket of many rows is written by several tasks.
        parts = max(1, -(-max([old.held[b][1] for b in touched if b in old.held], default=0) // IN_FILE)) if old else 1
        target = f"{files.root}/data/v={number}"
        new.repartition(F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).write.mode("overwrite").partitionBy("bucket").parquet(target)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fresh.schema.fields])
        written = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        contents = _contents(spark.read.schema(written).parquet(target)).collect()  # a row for each bucket
        sizes = {x for r in contents if "vector" in columns for x in (r["least"], r["most"])} | ({old.dimension} if old and old.dimension is not None else set())
        if len(sizes) > 1:
            files.delete(f"data/v={number}")
            raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
        held = {b: h for b, h in (old.held if old else {}).items() if b not in touched} | {str(r["bucket"]): [number, r["chunks"], r["documents"]] for r in contents}
        made = Manifest(number, n, schema.json(), next(iter(sizes), None), [*(old.batches if old else []), batch][-REMEMBERED:], held)
        if files.publish(f"manifests/{number:012d}.json", json.dumps(made._asdict())):
            return made
    raise RuntimeError(f"other writers were first {tries} times")


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Forgets all but the last ``keep`` versions, and deletes the buckets that none of those holds. Returns the versions left."""
    known = versions(spark, root)
    files = _Files(spark, root)
    for v in known[:-keep]:
        files.delete(f"manifests/{v:012d}.json")
    used = {(h[0], b) for v in known[-keep:] for b, h in manifest(spark, root, v).held.items()}
    for name in files.names("data"):
        v = int(name.removeprefix("v="))
        own = {b for w, b in used if w == v}
        if not own and v <= known[-1]:
            files.delete(f"data/{name}")
        elif own:
            for b in files.names(f"data/{name}"):
                if b.startswith("bucket=") and b.removeprefix("bucket=") not in own:
                    files.delete(f"data/{name}/{b}")
    return known[-keep:]
