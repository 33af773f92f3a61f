"""What the operators of this subpackage share: reading tables, cutting lineage and sizing Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from functools import wraps

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that go to Python in one Arrow batch where rows hold whole texts; bounds a worker's memory.
TEXT_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_OF_A_BATCH, BYTES_OF_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bounds the Arrow batches of the plans that this session runs from now on, unless they are smaller already.

    A result that is computed later is planned then, so operators that return one can't take the bound back.
    """
    now = int(spark.conf.get(ROWS_OF_A_BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(ROWS_OF_A_BATCH, str(rows))


@contextmanager
def batches_of(spark: SparkSession, most: int, what: str = ROWS_OF_A_BATCH) -> Iterator[None]:
    """The bound on Arrow batches, in rows or in bytes, for what is computed inside."""
    before = spark.conf.get(what)
    spark.conf.set(what, str(most))
    try:
        yield
    finally:
        spark.conf.set(what, before)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """The schema with that column last, instead of any of its name in any case of letters, as Spark tells no such names apart."""
    return T.StructType([*(f for f in schema.fields if f.name.lower() != name.lower()), T.StructField(name, kind)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir; only in local mode, where it is unset, one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if place is None:
        place = spark.sparkContext.getCheckpointDir()
    if place is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="groundspark-")
        spark.sparkContext.setCheckpointDir(place)
    return place


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor; ``drop`` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """``batch``: rows of an Arrow batch while it is computed."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with batches_of(self.spark, batch) if batch else nullcontext():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None = None) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root if df is None else df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt evenly by a hash of a unique key."""
    return df.repartition(n, F.xxhash64(key))


def give_back() -> None:
    """Returns freed memory to the system; a Python worker that waits for its next task would else keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For functions over a task's batches: gives memory back when the task is over."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
