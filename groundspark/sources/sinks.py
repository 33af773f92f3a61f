"""Writers: index, logs, tables of results, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import fmt
from groundspark.sources import buckets


def save_index(rows: DataFrame, path: str) -> None:
    """To a new version's path; readers are pointed to it afterwards, so an index in use is never overwritten.

    Beside the rows lies one record about them: chunks, documents and dimension, by which a reader can tell a damaged index.
    """
    rows.write.mode("errorifexists").parquet(path)
    index_record(rows.sparkSession.read.parquet(path)).write.mode("errorifexists").json(path.rstrip("/") + ".about")


def index_record(rows: DataFrame) -> DataFrame:
    """chunks, and documents and dimension where the index has the columns doc_id and vector."""
    more = {"doc_id": F.count_distinct("doc_id").alias("documents"), "vector": F.max(F.size("vector")).alias("dimension")}
    return rows.agg(F.count("*").alias("chunks"), *[c for name, c in more.items() if name in rows.columns])


def append_log(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One file with a header, nulls as empty cells, doubles to four places. For tables of results, which are small."""
    kinds = dict(rows.dtypes)
    shown = [fmt(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]
    rows.select(*shown).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table; pipes are escaped, nulls empty. Meant for tables of results: one of more than ``most`` rows is refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write this table with write_csv")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([cell(v) for v in r]) for r in got]
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *body])


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def store_replies(replies: DataFrame, path: str, batch: str | None = None) -> None:
    """Into the response cache: key, reply. A key has one row, its newest reply; of several in one call the largest.

    The cache lies in buckets of keys with versions, so a call rewrites its own keys' buckets, and of writers that meet the later
    one merges into the other's version. A call with a ``batch`` that was stored before changes nothing.
    """
    one = replies.groupBy("key").agg(F.max("reply").alias("reply")).select(F.col("key").alias("doc_id"), F.col("key").alias("chunk_id"), "reply")
    buckets.update(path, one, batch or uuid.uuid4().hex)


def store_variant(rows: DataFrame, path: str) -> None:
    """The ablation cache, by variant, split and limit; a run replaces the rows of its own keys only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant", "split", "limit").parquet(path)


def gate_summary(checks: DataFrame, required: tuple[str, ...] = ()) -> str:
    """The regression gate as markdown: a line for each metric, and the required ones. A gate has a few dozen metrics."""
    mark = F.when(F.col("status").isin("FAIL", "MISSING"), F.concat(F.lit("**"), "status", F.lit("**"))).when(F.col("status") == "SKIPPED", "skipped").otherwise(F.col("status"))
    four = lambda c, shape: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(shape, c))
    shown = checks.orderBy("metric").select(F.concat(F.lit("`"), "metric", F.lit("`")).alias("Metric"), mark.alias("Status"), four("expected", "%.4f").alias("Baseline"), four("threshold", "%.4f").alias("Threshold"), four("observed", "%.4f").alias("Observed"), four("delta", "%+.4f").alias("Delta"))
    return markdown(shown) + f"\n\nRequired: {', '.join(sorted(required)) or 'none'}. A required metric without a result fails the gate."


def write_splits(rows: DataFrame, path: str) -> None:
    """A training set as JSON lines, a folder for each split; an existing one is never replaced."""
    rows.write.mode("errorifexists").partitionBy("split").json(path)
