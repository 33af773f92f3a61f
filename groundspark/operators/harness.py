"""Evaluation harness: splits, samples, variants, training pairs and calibration slices."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.functions.text import answer_matches, is_abstention, normalize_answer
from groundspark.kept import Kept
from groundspark.operators.grading import weak_label, weak_labels
from groundspark.operators.orchestrate import Flags, Runs
from groundspark.settings import SETTINGS


class Variant(NamedTuple):
    key: str
    name: str
    use_evaluator: bool
    force_citations: bool
    verify_citations: bool
    repair_and_abstain: bool


#: Keys and names are fixed values.
VARIANTS = (
    Variant("A", "Vanilla RAG", False, False, False, False),
    Variant("B", "+ retrieval evaluator", True, False, False, False),
    Variant("C", "+ citation forcing", True, True, False, False),
    Variant("D", "+ NLI verification", True, True, True, False),
    Variant("E", "+ repair and abstention", True, True, True, True),
)


def with_variants(rows: DataFrame) -> DataFrame:
    """Each row once for every variant, with its flags: one plan over all five."""
    listed = [F.struct(F.lit(v.key).alias("variant"), *[F.lit(getattr(v, f)).alias(f) for f in Variant._fields[2:]]) for v in VARIANTS]
    return rows.withColumn("_v", F.explode(F.array(*listed))).select(*rows.columns, "_v.*")


def run_variants(runs: Runs, golds: DataFrame) -> DataFrame:
    """A row for each variant and question, as ``ablation_table`` takes them: answers under the variant's flags, and counters out of its
    own verdicts, sentences and calls. Stages that variants share are computed once. ``golds``: qid, answers.
    """
    s = runs.s
    out = []
    for v in VARIANTS:
        flags = Flags(*v[2:])
        rows = runs.answers(flags).join(runs.counters(flags), "qid", "left").join(golds.select("qid", "answers"), "qid", "left")
        cost = (F.coalesce("input_tokens", F.lit(0)) * F.lit(s.price_in) + F.coalesce("output_tokens", F.lit(0)) * F.lit(s.price_out)) / F.lit(1e6)
        names = ("sentences", "parseable", "scored", "supported", "contradicted", "citations", "good_citations")
        out.append(rows.select(F.lit(v.key).alias("variant"), "qid", "abstained", "abstain_reason", "text", "answers", F.lit(None).cast("string").alias("error"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], "repair_attempted", "repair_succeeded", cost.alias("cost_usd")))
    return reduce(DataFrame.unionByName, out)


def shuffle_key(key: Column, seed: int = SETTINGS.seed) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


#: Rows that are numbered in one window, on average.
IN_BUCKET = 50_000


def ranked(rows: DataFrame, order: Column, name: str = "pos", bits: int | None = None) -> DataFrame:
    """Numbers rows from 0 in a global order of md5 keys, with no task that sorts them all.

    Buckets by the first ``bits`` bits of the key get their offset from the running sum of bucket sizes; inside a bucket
    a window counts on. By default there are as many bits as keep IN_BUCKET rows in a bucket; the table of buckets is
    broadcast, and has at most 2^20 rows.
    """
    if bits is None:
        bits = min(20, max(6, (rows.count() // IN_BUCKET).bit_length()))
    keyed = rows.withColumn("_k", order).withColumn("_b", F.shiftright(F.conv(F.substring("_k", 1, 8), 16, 10).cast("long"), 32 - bits))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    # At most 2^bits rows.
    placed = keyed.join(F.broadcast(before), "_b")
    return placed.withColumn(name, F.col("_o") + F.row_number().over(Window.partitionBy("_b").orderBy("_k")) - 1).drop("_k", "_b", "_o")


def split_questions(pairs: DataFrame, key: str = "qid", train: float = 0.7, val: float = 0.1, seed: int = SETTINGS.seed) -> DataFrame:
    """Adds ``split``; all rows of a question fall into the same one."""
    ids = ranked(pairs.select(key).distinct(), shuffle_key(F.col(key), seed))
    n = ids.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    named = ids.select(key, F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test").alias("split"))
    return pairs.join(named, key)


def carve_splits(ids: DataFrame, dev: int, test: int, distractor: int, key: str = "qid", seed: int = SETTINGS.seed) -> DataFrame:
    """split, pos and id of seeded, disjoint slices of fixed sizes. Persist with mode errorifexists: a split is never redrawn."""
    rows = ranked(ids.select(key).distinct(), shuffle_key(F.col(key), seed)).where(F.col("pos") < dev + test + distractor)
    split = F.when(F.col("pos") < dev, "dev").when(F.col("pos") < dev + test, "test").otherwise("distractor")
    first = F.when(F.col("pos") < dev, F.lit(0)).when(F.col("pos") < dev + test, F.lit(dev)).otherwise(F.lit(dev + test))
    return rows.select(split.alias("split"), (F.col("pos") - first).alias("pos"), key)


def load_split(split: DataFrame, rows: DataFrame, limit: int | None = None, key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """The rows of a split's prefix with their ``pos``, and the wanted ids that have no row."""
    wanted = split.select("pos", key) if limit is None else split.select("pos", key).where(F.col("pos") < limit)
    return wanted.join(rows, key), wanted.join(rows.select(key), key, "left_anti")


def split_by_corpus(questions: DataFrame, titles: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Answerable and unanswerable questions, each the first ``limit`` in order. ``questions``: title, pos; ``titles``: title."""
    first = lambda df: df.orderBy("pos").limit(limit)
    return first(questions.join(titles, "title", "left_semi")), first(questions.join(titles, "title", "left_anti"))


def sample_by_label(pairs: DataFrame, n: int, seed: int = SETTINGS.seed) -> DataFrame:
    """The first n/3 pairs of each weak label in order, of those the first n in shuffled order. ``pairs``: label, pos, key."""
    per = max(n // 3, 1)
    some = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("pos"))).where(F.col("_r") <= per).drop("_r")
    return some.orderBy(shuffle_key(F.col("key"), seed)).limit(n)


def training_split(name: str) -> str:
    """The split to train on; the one that variants are compared on is refused."""
    if name == "dev":
        raise ValueError("variants are compared on the split dev, so nothing may be trained on it")
    return name


def missing_ids(wanted: DataFrame, found: DataFrame, key: str = "qid") -> DataFrame:
    """Ids of a split that have no row."""
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def training_pairs(questions: DataFrame, hits: DataFrame, chunks: DataFrame, titles: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Weakly labelled pairs of covered questions: qid, chunk_id, rank, label. ``questions``: subjects, answers, title; ``aliases``: title,
    doc_id, other names of pages that count as their subject too."""
    covered = questions.join(titles.select("title"), "title", "left_semi")
    if aliases is not None:
        return weak_labels(hits.select("qid", "chunk_id", "rank").join(covered.select("qid"), "qid", "left_semi"), covered, chunks, aliases)
    rows = hits.join(covered, "qid").join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    return rows.select("qid", "chunk_id", "rank", weak_label(F.col("text"), F.col("doc_id"), F.col("subjects"), F.col("answers")).alias("label"))


def distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def annotator_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels of pairs that both annotators judged: qid, chunk_id, a, b; the last label of a pair counts. Inputs: qid, chunk_id, label, line."""
    last = lambda df, name: df.groupBy("qid", "chunk_id").agg(F.max_by("label", "line").alias(name))
    return last(a, "a").join(last(b, "b"), ["qid", "chunk_id"])


def remaining(sample: DataFrame, done: DataFrame) -> DataFrame:
    """Another annotator's sample without what is labelled already."""
    return sample.join(done.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


def lexical_positives(sentences: DataFrame, citations: DataFrame, context: DataFrame, golds: DataFrame) -> DataFrame:
    """Sentences with a gold answer that also is in a cited passage, with the first such citation. ``golds``: qid, answers."""
    normal = lambda df, name: df.withColumn(name, normalize_answer(F.col("text"))).drop("text")
    s = normal(sentences.select("qid", "sent_idx", "text"), "s")
    p = normal(context.select("qid", "chunk_id", "text"), "p")
    g = golds.select("qid", F.filter(F.transform("answers", normalize_answer), lambda x: x != "").alias("g"))
    rows = citations.where("chunk_id IS NOT NULL").join(s, ["qid", "sent_idx"]).join(p, ["qid", "chunk_id"]).join(g, "qid")
    both = F.exists("g", lambda x: F.contains(F.col("s"), x) & F.contains(F.col("p"), x))
    return rows.where(both).groupBy("qid", "sent_idx").agg(F.min_by("chunk_id", "cite_pos").alias("chunk_id"), F.min("cite_pos").alias("cite_pos"))


#: Rows of draws that one task joins and sorts, on average.
IN_TASK = 250_000


def swap_negatives(sentences: DataFrame, passages: DataFrame, draws: int = 20, seed: int = SETTINGS.seed) -> DataFrame:
    """Each sentence with one passage of another question: qid, sent_idx, other_qid, chunk_id.

    As many seeded draws of a passage number as asked for are made a sentence; the first that lands on another question counts,
    and a sentence whose draws all land on its own has none. Draws meet passages by number, so nothing is crossed. All sentences
    meet the passage of their first draw; only those that it leads to their own question make the others. Tasks rise in number
    with the rows, so what one sorts is bounded.
    """
    spark = sentences.sparkSession
    kept = Kept(spark)
    asked, pool = kept.keep(sentences.select("qid", "sent_idx")), kept.keep(passages.select("qid", "chunk_id"))
    n = pool.count()
    numbered = ranked(pool, shuffle_key(F.concat_ws("/", "qid", "chunk_id"), seed)).select(F.col("qid").alias("other_qid"), "chunk_id", "pos")
    parts = lambda rows: max(spark.sparkContext.defaultParallelism, -(-rows // IN_TASK))
    drawn = lambda d: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "qid", F.col("sent_idx").cast("string"), d.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long"), F.lit(max(n, 1)))
    # Null where a question is.
    other = F.coalesce(F.col("qid") != F.col("other_qid"), F.lit(False))

    def met(rows: DataFrame, k: int) -> DataFrame:
        return rows.join(numbered.repartition(k, "pos"), "pos").withColumn("other", other)

    # Repeats of a sentence draw the same number, so they are in one task.
    k = parts(max(n, asked.count()))
    first = kept.keep(met(asked.withColumn("pos", drawn(F.lit(0))).repartition(k, "pos").distinct(), k).drop("pos"))
    found, own = first.where("other").drop("other"), first.where("NOT other")
    left = own.count()
    if not left or draws < 2:
        return found
    k = parts(max(n, left * (draws - 1)))
    tries = F.explode(F.transform(F.sequence(F.lit(1), F.lit(draws - 1)), lambda d: F.struct(d.alias("draw"), drawn(d).alias("pos"))))
    rows = own.select("qid", "sent_idx", tries.alias("t")).select("qid", "sent_idx", "t.draw", "t.pos").repartition(k, "pos")
    again = met(rows, k).where("other").repartition(k, "qid", "sent_idx").groupBy("qid", "sent_idx").agg(F.min_by(F.struct("other_qid", "chunk_id"), "draw").alias("x"))
    return found.unionByName(again.select("qid", "sent_idx", "x.other_qid", "x.chunk_id"))


def calibration_slice(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """qid, sent_idx, chunk_id, truth, kind."""
    good = positives.select("qid", "sent_idx", "chunk_id", F.lit(True).alias("truth"), F.lit("lexical_match").alias("kind"))
    return good.unionByName(negatives.select("qid", "sent_idx", "chunk_id", F.lit(False).alias("truth"), F.lit("swapped").alias("kind")))


def ablation_table(rows: DataFrame) -> DataFrame:
    """One row for each variant. ``rows``: variant, abstained, text, answers, error, parseable, sentences, repair_attempted, repair_succeeded, cost_usd.

    A refusal in the text counts as an abstention for every variant. With the columns scored, supported, contradicted, citations
    and good_citations (of an answer's verdicts) the table also has citation recall and precision and the automatic rates of
    hallucination and contradiction. A rate is null where there is nothing to count.
    """
    failed = F.col("error").isNotNull()
    out = F.coalesce("abstained", F.lit(False)) | F.coalesce(is_abstention(F.col("text")), F.lit(False))
    own = rows.withColumn("_out", ~failed & out).withColumn("_right", ~failed & ~out & answer_matches(F.coalesce("text", F.lit("")), F.col("answers")))
    answered_sum = lambda c: F.coalesce(F.sum(F.when(~F.col("_out"), F.col(c))), F.lit(0)).cast("long").alias(c)
    verified = [c for c in ("scored", "supported", "contradicted", "citations", "good_citations") if c in rows.columns]
    sums = own.groupBy("variant").agg(
        F.count("*").alias("n"), F.count_if("_out").alias("abstained"), F.count_if(failed).alias("errors"), F.count_if("_right").alias("correct"), answered_sum("parseable"), answered_sum("sentences"), *map(answered_sum, verified),
        F.coalesce(F.sum("repair_attempted"), F.lit(0)).cast("long").alias("repair_attempted"), F.coalesce(F.sum("repair_succeeded"), F.lit(0)).cast("long").alias("repair_succeeded"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )
    answered = F.col("n") - F.col("abstained") - F.col("errors")
    rates = {"citation_recall": ("supported", "scored"), "citation_precision": ("good_citations", "citations"), "contradiction_rate_auto": ("contradicted", "scored")}
    more = [F.try_divide(a, b).alias(name) for name, (a, b) in rates.items()] + [F.try_divide(F.col("scored") - F.col("supported"), F.col("scored")).alias("hallucination_rate_auto")]
    return sums.select(
        "variant", "n", answered.alias("answered"), "abstained", "errors", "correct", F.try_divide("abstained", "n").alias("abstention_rate"), F.try_divide(answered, F.col("n")).alias("coverage"),
        F.try_divide("correct", "n").alias("accuracy_all"), F.try_divide(F.col("correct"), answered).alias("accuracy_answered"), F.try_divide("parseable", "sentences").alias("parseable_citation_rate"),
        *(more if len(verified) == 5 else []), "repair_attempted", "repair_succeeded", "cost_usd",
    )
