"""Readers: question sets, corpora, uploads, labels, results."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.batches import small_batches
from groundspark.functions.text import parse_answers
from groundspark.schemas import ASQA
from groundspark.sources import buckets, sinks

#: Limits and suffixes of uploads.
MOST_FILES, MOST_REQUEST_BYTES, MOST_FILE_BYTES = 50, 2 * 1024**3, 150 * 1024**2
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".text")


def qa_examples(rows: DataFrame) -> DataFrame:
    """Question rows of a hub export: qid, question, answers, subject_title, subject, prop; empty titles count as missing."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(F.col("id").cast("string").alias("qid"), "question", parse_answers(F.col("possible_answers")).alias("answers"), F.coalesce(filled("s_wiki_title"), filled("subj"), F.lit("")).alias("subject_title"), F.col("subj").alias("subject"), "prop")


def asqa(spark: SparkSession, path: str) -> DataFrame:
    """Nested long-answer questions: sample_id, question, long_answer, short_answer_sets, docs."""
    rows = spark.read.schema(ASQA).json(path, multiLine=True)
    return rows.select("sample_id", "question", F.col("answer").alias("long_answer"), F.transform("qa_pairs", lambda x: x["short_answers"]).alias("short_answer_sets"), "docs")


def supplied_context(questions: DataFrame, k: int) -> DataFrame:
    """The first k passages supplied with a question as chunks."""
    each = questions.select("sample_id", F.posexplode(F.slice("docs", 1, k)).alias("i", "d"))
    title = F.coalesce("d.title", F.lit(""))
    return each.select("sample_id", (F.col("i") + 1).alias("passage_no"), F.concat(F.lit("alce-"), "sample_id", F.lit("::"), F.col("i").cast("string")).alias("chunk_id"), F.when(title != "", F.concat(title, F.lit("\n"), "d.text")).otherwise(F.col("d.text")).alias("text"))


def all_short_answers(sets: Column) -> Column:
    return F.flatten(sets)


def corpus(lines: DataFrame) -> DataFrame:
    """title, text; the last line of a title counts. ``lines``: title, text, line_no."""
    return lines.groupBy("title").agg(F.max_by("text", "line_no").alias("text"))


def titles_to_fetch(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted titles that aren't stored yet, once each, in the order first asked for. ``wanted``: title, pos."""
    return wanted.groupBy("title").agg(F.min("pos").alias("pos")).join(stored.select("title"), "title", "left_anti")


def cut_page(text: Column, most: int = 6000) -> Column:
    return F.left(text, F.lit(most))


def _decoded(name: str, raw: bytes | None) -> tuple[str | None, str | None]:
    suffix = "." + name.rpartition(".")[2].lower() if "." in name else ""
    if suffix == ".pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            return None, "no PDF reader is installed"
        try:
            text = "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw or b"")).pages)
        except Exception as e:  # whatever a broken file raises is that file's status
            return None, f"unreadable PDF: {e}"
        return (text, None) if text.strip() else (None, "no text in the PDF")
    if suffix not in TEXT_SUFFIXES:
        return None, f"unsupported file type {suffix or 'without suffix'}"
    try:
        return (raw or b"").decode("utf-8"), None
    except UnicodeDecodeError:
        return (raw or b"").decode("latin-1"), None


def extracted(files: DataFrame) -> DataFrame:
    """Adds text and error to files: filename, content."""
    small_batches(files.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_decoded(n or "", c) for n, c in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([g[k] for g in got], pa.string()) for k in range(2)]], names=[*batch.schema.names, "text", "error"])

    return files.mapInArrow(run, f"{fields}, text string, error string")


def doc_id_of(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?s)\.[^.]*$", "")


def admission(files: DataFrame, most_request: int = MOST_REQUEST_BYTES, most_file: int = MOST_FILE_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """request_id, pos, filename, status, detail, doc_id by the order of rules. ``files``: request_id, pos, filename, n_bytes, error.

    A request with too many files is refused whole; the running sum of bytes then decides, so a file beyond it is skipped.
    """
    mine = Window.partitionBy("request_id")
    rows = files.withColumn("_sum", F.sum("n_bytes").over(mine.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.count("*").over(mine))
    rules = [(F.col("_n") > most_files, "failed", "too many files"), (F.col("_sum") > most_request, "skipped", "request too large"), (F.col("n_bytes") == 0, "skipped", "file is empty"), (F.col("n_bytes") > most_file, "skipped", "file too large"), (F.col("error").isNotNull(), "failed", "unreadable")]
    status, detail = F.lit("indexed"), F.lit("")
    for when, s, d in reversed(rules):
        status, detail = F.when(when, s).otherwise(status), F.when(when, d).otherwise(detail)
    return rows.select("request_id", "pos", "filename", status.alias("status"), detail.alias("detail"), F.when(status == "indexed", doc_id_of(F.col("filename"))).alias("doc_id"))


def demo_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of the non-empty markdown files of a folder."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc_id"), F.col("value").alias("text"))
    return rows.where(F.regexp_replace("text", r"\s", "") != "")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from JSON lines; Spark raises if the path is absent. A pair's last line counts (``line``)."""
    rows = spark.read.schema("qid string, question string, chunk_id string, chunk_text string, label string, source string").json(path)
    return rows.withColumn("line", F.monotonically_increasing_id())


def replies(spark: SparkSession, path: str) -> DataFrame:
    """key, reply of the response cache; none where nothing has been stored yet."""
    if not buckets.versions(spark, path):
        return spark.createDataFrame([], "key string, reply string")
    return buckets.read(spark, path, check=False).select(F.col("doc_id").alias("key"), "reply")


def index(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """The rows of an index in one folder; raises where they aren't what its record says (chunks, documents, dimension)."""
    rows = spark.read.parquet(path)
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"the index holds {n} chunks instead of {expected}")
    about = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".about")
    if about.getFileSystem(spark._jsc.hadoopConfiguration()).exists(about):
        said, found = spark.read.json(about.toString()).first().asDict(), sinks.index_record(rows).first().asDict()
        for name, value in said.items():
            if found.get(name) != value:
                raise buckets.DamagedIndex(f"the index holds {found.get(name)} as {name} instead of {value}")
    return rows


def synthetic_documents(spark: SparkSession, n: int, words: int, vocabulary: list[str], seed: int = 42) -> DataFrame:
    """doc_id, text: seeded words, the same on every run."""
    listed = F.array(*[F.lit(w) for w in vocabulary])
    pick = lambda i: F.element_at(listed, (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(vocabulary))) + 1).cast("int"))
    return spark.range(n).select(F.col("id").cast("string").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), pick), " ").alias("text"))


def result_value(document: Column, path: str) -> Column:
    """A number out of a result's JSON by a dotted path; null where there is none."""
    return F.try_variant_get(F.try_parse_json(document), "$." + path, "double")


def ablation_rows(spark: SparkSession, path: str, numbers: tuple[str, ...]) -> DataFrame:
    """A result CSV; empty cells are null."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in rows.columns])
