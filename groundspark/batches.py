"""The size of the Arrow batches that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS_OF_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts in a batch: a worker holds a batch several times over, as Arrow data and as Python objects.
TEXTS = 256


def small_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """Bounds the batches of the plans that this session runs from now on, unless they are smaller already. Results are lazy and are
    planned when they are computed, so the bound stays."""
    now = int(spark.conf.get(ROWS_OF_A_BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(ROWS_OF_A_BATCH, str(rows))
