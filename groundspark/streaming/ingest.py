"""An extension: documents that arrive as a stream are chunked and replace their older versions in the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundspark.operators.chunking import chunk, replace_documents
from groundspark.sources import buckets


def ingest(documents: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """For small indexes: writes a whole version of the index for each batch, under ``root/v=<batch>``; a batch that runs again writes the same one.

    ``documents``: a stream of doc_id, text.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = chunk(batch)
        if number > 0:
            fresh = replace_documents(spark.read.parquet(f"{root}/v={number - 1}"), fresh)
        fresh.write.mode("overwrite").parquet(f"{root}/v={number}")

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_buckets(documents: DataFrame, root: str, checkpoint: str, n_buckets: int = buckets.BUCKETS) -> StreamingQuery:
    """As ``ingest``, into an index by buckets: a batch rewrites the buckets of its own documents, whatever the size of the index, and one
    that runs again changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_id").agg(F.last("text").alias("text"))  # of a document that comes twice in a batch one version stays
        buckets.update(root, chunk(last), f"{checkpoint}#{number}", n_buckets)

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
