"""From raw documents to token ids: quality, near duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as Parquet to the shared
folder and hands the table it reads back to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import bpe, jaccard, mixing, pii, quality
from groundspark.llm.common import Scratch, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No source is cut: the most frequent one gives each document once, and the others repeat up to this often.
MIXTURE = mixing.Target(repeats=2.0, budget=None)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject.

    Null texts are judged as empty ones, long texts whole, repeated rows each; where no label is known all are kept.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.CUT).select(*COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id; documents without words or without an id stay.

    Of repeated rows of that id one stays. Texts of fewer than five words are linked by their whole sequence.
    """
    return jaccard.one_of_each(docs).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; null and empty texts stay as they are, repeated rows too."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again in further blocks; a null source is one of its own."""
    return mixing.mix(docs, MIXTURE).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture: none for null and empty texts; repeated rows are encoded each."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_vocabulary())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("personal data", hide_personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL can't express the classifier, the trie or the anchors; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
