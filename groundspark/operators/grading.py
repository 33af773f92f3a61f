"""Grading what was retrieved, the action of a question, the corrective round and the kept context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.functions.text import normalize_answer, normalize_doc_id
from groundspark.operators.retrieval import merge_rounds
from groundspark.settings import SETTINGS, Settings


def label_from_probs(s: Settings = SETTINGS) -> tuple[Column, Column]:
    """Label and confidence from p_correct, p_ambiguous and p_wrong."""
    c, a, w = F.col("p_correct"), F.col("p_ambiguous"), F.col("p_wrong")
    low = c <= F.lit(s.wrong_threshold)
    label = F.when(c >= F.lit(s.correct_threshold), "correct").when(low & (w >= a), "wrong").otherwise("ambiguous")
    confidence = F.when(c >= F.lit(s.correct_threshold), c).when(low & (w >= a), w).when(low, a).otherwise(F.greatest(a, c))
    return label, confidence


def grade(scored: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    label, confidence = label_from_probs(s)
    return scored.withColumns({"label": label, "confidence": confidence})


def action_of(label: Column) -> Column:
    """Over a question's labels: any correct proceeds; all wrong, or none at all, abstains; else retrieve again."""
    return F.when(F.max(label == "correct"), "proceed").when(F.coalesce(F.min(label == "wrong"), F.lit(True)), "abstain").otherwise("corrective_retrieve")


def actions(graded: DataFrame, questions: DataFrame, *keys: str) -> DataFrame:
    """The action of every question, also of those without any graded chunk."""
    keys = keys or ("qid",)
    return questions.select(*keys).join(graded.select(*keys, "label"), list(keys), "left").groupBy(*keys).agg(action_of(F.col("label")).alias("action"))


def corrective_round(questions: DataFrame, first: DataFrame, wider: DataFrame, score, s: Settings = SETTINGS, keep=lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """Graded chunks after at most one corrective round, with ``pos``, and the trace of each question.

    ``first`` and ``wider``: hits of the default and of the larger k. ``score`` adds the three probabilities. The bounded
    loop is unrolled: questions that need no second round keep the first, the rest take both rounds merged and graded anew.
    ``keep`` writes what is used more than once, so that nothing is graded again for the trace.
    """
    round0 = keep(grade(score(first.withColumn("pos", F.col("rank"))), s))
    before = keep(actions(round0, questions).withColumnRenamed("action", "first_action"))
    need = before.where("first_action = 'corrective_retrieve'").select("qid")
    merged = merge_rounds(first.join(need, "qid", "left_semi"), wider.join(need, "qid", "left_semi")).drop("round")
    graded = keep(round0.join(need, "qid", "left_anti").unionByName(grade(score(merged), s)))
    after = actions(graded, questions)
    trace = before.join(after, "qid").select("qid", F.when(F.col("first_action") == "corrective_retrieve", 2).otherwise(1).alias("rounds"), (F.col("first_action") == "corrective_retrieve").alias("corrective_fired"), "action", (F.col("action") == "abstain").alias("abstained_before_generation"))
    return graded, trace


def kept_context(graded: DataFrame, trace: DataFrame, k: int = SETTINGS.top_k) -> DataFrame:
    """qid, passage_no, chunk_id, label: correct before others, then by confidence, then in merged order; wrong ones dropped."""
    going = trace.where("action <> 'abstain'").select("qid")
    order = Window.partitionBy("qid").orderBy(F.col("label") != "correct", F.desc("confidence"), "pos")
    kept = graded.where("label <> 'wrong'").join(going, "qid", "left_semi").withColumn("passage_no", F.row_number().over(order)).where(F.col("passage_no") <= k)
    return kept.select("qid", "passage_no", "chunk_id", "label")


def weak_label(text: Column, doc_id: Column, subjects: Column, golds: Column) -> Column:
    """Off the subject: wrong, whatever the text; on it: correct if a gold is in the text, else ambiguous."""
    own = F.transform(F.filter(subjects, lambda x: x.isNotNull()), normalize_doc_id)
    body = normalize_answer(text)
    has = F.exists(F.transform(golds, normalize_answer), lambda g: (g != "") & F.contains(body, g))
    return F.when(~F.array_contains(own, doc_id), "wrong").when(has, "correct").otherwise("ambiguous")


def subject_pages(questions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """qid, doc_id of every page that counts as a question's subject: its titles, and what they are aliases of. ``questions``: qid,
    subjects; ``aliases``: title, doc_id, where a title stands exactly as subjects do."""
    titles = questions.select("qid", F.explode("subjects").alias("title")).where("title <> ''").distinct()
    pages = titles.select("qid", normalize_doc_id(F.col("title")).alias("doc_id"))
    if aliases is not None:
        pages = pages.unionByName(titles.join(aliases.select("title", "doc_id"), "title").select("qid", normalize_doc_id(F.col("doc_id")).alias("doc_id")))
    return pages.distinct()


def weak_labels(hits: DataFrame, questions: DataFrame, chunks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``hits`` (qid, chunk_id) with the label of ``weak_label``, where a subject's page is found by an equi-join over titles and aliases,
    so texts are moved and normalised for chunks of a subject's page only. ``questions``: qid, subjects, answers; ``chunks``: chunk_id,
    doc_id, text.
    """
    pages, ids = subject_pages(questions, aliases), chunks.select("chunk_id", "doc_id")
    wrong = hits.join(ids, "chunk_id").join(pages, ["qid", "doc_id"], "left_anti").select(*hits.columns, F.lit("wrong").alias("label"))
    # A chunk id that comes twice meets its texts once.
    on = hits.join(ids.distinct(), "chunk_id").join(pages, ["qid", "doc_id"], "left_semi")
    rows = on.join(questions.select("qid", "answers"), "qid", "left").join(chunks.select("chunk_id", "doc_id", "text"), ["chunk_id", "doc_id"])
    golds = F.filter(F.transform(F.coalesce("answers", F.array().cast("array<string>")), normalize_answer), lambda g: g != "")
    body = rows.withColumn("_body", normalize_answer(F.coalesce("text", F.lit(""))))
    has = F.coalesce(F.exists(golds, lambda g: F.contains(F.col("_body"), g)), F.lit(False))
    return wrong.unionByName(body.select(*hits.columns, F.when(has, "correct").otherwise("ambiguous").alias("label")))


def alias_map(documents: DataFrame) -> DataFrame:
    """title (lower case, spaces) to the first doc_id of that title. ``documents``: doc_id, ord."""
    return documents.groupBy(F.lower(F.translate("doc_id", "_", " ")).alias("title")).agg(F.min_by("doc_id", "ord").alias("doc_id"))


def class_weights(rows: DataFrame, label: str, classes: list) -> DataFrame:
    """label, n, weight: total / (3 * count) for three classes and so on, counts at least 1, scaled to a mean of 1."""
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)]))
    raw = [F.col("total") / (F.lit(len(classes)) * F.greatest(F.col(f"n{i}"), F.lit(1))) for i in range(len(classes))]
    mean = sum(raw[1:], raw[0]) / len(classes)
    listed = counts.select("total", mean.alias("mean"), each.alias("x"))
    return listed.select("x.label", "x.n", (F.col("total") / (F.lit(len(classes)) * F.greatest("x.n", F.lit(1))) / F.col("mean")).alias("weight"))
