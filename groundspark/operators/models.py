"""The model boundary: what embedders, graders, generators, verifiers and judges must give, with lexical stand-ins.

A stand-in computes something of the same shape from word overlap. None is a model, and none of its figures may be read as
one. A real model takes its place as a function of the same signature, usually an iterator pandas UDF over Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.sentences import split_sentences
from groundspark.functions.text import content_words, overlap
from groundspark.operators.grading import class_weights
from groundspark.settings import CHUNK_LABELS, SETTINGS


def lexical_grader(pairs: DataFrame) -> DataFrame:
    """Adds p_correct, p_ambiguous, p_wrong to pairs with question and text: the share of question words in the text."""
    rows = pairs.withColumns({"_q": content_words(F.col("question")), "_t": content_words(F.col("text"))})
    return rows.withColumn("p_correct", F.round(overlap(F.col("_q"), F.col("_t")), 6)).drop("_q", "_t").withColumns({"p_wrong": (F.lit(1.0) - F.col("p_correct")) * F.lit(0.7), "p_ambiguous": (F.lit(1.0) - F.col("p_correct")) * F.lit(0.3)})


def _cited(sentence: Column, number: Column) -> Column:
    """A sentence with its marker before the final mark."""
    bare = F.regexp_replace(sentence, r"[.!?]+$", "")
    return F.concat(bare, F.lit(" ["), number.cast("string"), F.lit("]."))


def extractive_generator(context: DataFrame) -> DataFrame:
    """qid, raw_text, path: the first sentence of each passage in order, each cited. ``context``: qid, passage_no, text."""
    first = context.select("qid", "passage_no", F.get(split_sentences(F.col("text")), F.lit(0)).alias("s")).where("s IS NOT NULL")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("passage_no", _cited(F.col("s"), F.col("passage_no")).alias("line")))), lambda x: x["line"])
    return first.groupBy("qid").agg(F.array_join(lines, " ").alias("raw_text")).withColumn("path", F.lit("text"))


def plain_generator(context: DataFrame) -> DataFrame:
    """As the cited one, without markers."""
    return extractive_generator(context).withColumn("raw_text", F.regexp_replace("raw_text", r" \[[0-9]+\]", ""))


def extractive_repair(sentences: DataFrame, citations: DataFrame, context: DataFrame, least: float = 0.0) -> DataFrame:
    """qid, sent_idx, new_text, new_score, recheck_supported for each cited sentence: the sentence of its first citation that shares
    most words with it, scored again; null where the best one shares less than ``least``, as no version of the claim is supported
    then. Sentences without a resolvable citation get no row."""
    first = citations.where("chunk_id IS NOT NULL").groupBy("qid", "sent_idx").agg(F.min_by("chunk_id", "cite_pos").alias("chunk_id"))
    rows = first.join(sentences.select("qid", "sent_idx", content_words(F.col("text")).alias("w")), ["qid", "sent_idx"]).join(context.select("qid", "chunk_id", "text"), ["qid", "chunk_id"])
    each = rows.select("qid", "sent_idx", "w", F.col("text").alias("passage"), F.posexplode(split_sentences(F.col("text"))).alias("at", "s")).withColumn("share", overlap(F.col("w"), content_words(F.col("s"))))
    best = each.groupBy("qid", "sent_idx").agg(F.max_by("s", F.struct("share", -F.col("at"))).alias("new_text"), F.max("share").alias("share"), F.first("passage").alias("passage"))
    best = best.withColumn("new_text", F.when(F.col("share") >= F.lit(least), F.col("new_text")))
    score = overlap(content_words(F.col("new_text")), content_words(F.col("passage")))
    return best.select("qid", "sent_idx", "new_text", score.alias("new_score"), (score >= F.lit(SETTINGS.entailment_threshold)).alias("recheck_supported"))


def lexical_faithfulness(answers: DataFrame, context: DataFrame, least: float = 0.5) -> DataFrame:
    """qid, claims, supported, faithfulness over the first sentences of an answer; null for abstentions and empty answers."""
    claims = answers.where("NOT abstained").select("qid", F.posexplode(F.slice(split_sentences(F.col("text")), 1, SETTINGS.faithfulness_max_claims)).alias("i", "claim"))
    joint = context.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(content_words(F.col("text"))))).alias("words"))
    judged = claims.join(joint, "qid", "left").withColumn("ok", F.coalesce(overlap(content_words(F.col("claim")), F.col("words")) >= F.lit(least), F.lit(False)))
    own = judged.groupBy("qid").agg(F.count("*").alias("claims"), F.count_if("ok").alias("supported"))
    return answers.select("qid").join(own, "qid", "left").withColumn("faithfulness", F.try_divide("supported", "claims"))


class MissingModel(FileNotFoundError):
    """No fitted model where one was asked for. Nothing takes its place."""


def select_grader(pairs: DataFrame, strengths: tuple[float, ...] = (0.3, 0.1, 0.03, 0.01, 0.003), features: int = 1 << 14):
    """The grader of the best macro-F1 on the split val, of those fitted on train with class weights, and the history of all.

    ``pairs``: question, text, label, split, where no question is in two splits. Accuracy would reward a grader that never says
    ambiguous. Of equal ones the strongest regularisation, which is tried first, is taken. The history has a dict for each strength.
    """
    from groundspark.operators.metrics import accuracy_and_macro_f1, confusion_counts

    crossing = pairs.groupBy("question").agg(F.count_distinct("split").alias("n")).where("n > 1").limit(1).count()
    if crossing:
        raise ValueError("a question is in more than one split")
    train, val = pairs.where("split = 'train'").drop("split"), pairs.where("split = 'val'").drop("split")
    best, history = None, []
    for strength in strengths:
        model = train_grader(train, features, strength)
        predicted = graded_by(model)(val)
        top = F.when((F.col("p_correct") >= F.col("p_ambiguous")) & (F.col("p_correct") >= F.col("p_wrong")), "correct").when(F.col("p_ambiguous") >= F.col("p_wrong"), "ambiguous").otherwise("wrong")
        got = accuracy_and_macro_f1(confusion_counts(predicted.select(F.col("label").alias("gold"), top.alias("pred")), CHUNK_LABELS)).first()
        history.append({"strength": strength, "accuracy": got["accuracy"], "macro_f1": got["macro_f1"], "n": got["n"]})
        if best is None or got["macro_f1"] > best[0]:
            best = (got["macro_f1"], model)
    return best[1], history


def graded_by(model):
    """A fitted grader as the function that stages take: adds p_correct, p_ambiguous and p_wrong to question and text."""
    from pyspark.ml.functions import vector_to_array

    def grade(pairs: DataFrame) -> DataFrame:
        made = model.transform(pairs.withColumn("words", _pair_words())).withColumn("_p", vector_to_array("probability"))
        return made.select(*pairs.columns, *[F.get("_p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(CHUNK_LABELS)])

    return grade


def load_grader(path: str):
    """The fitted grader of a folder, as a stage's function; MissingModel where there is none."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.ml import PipelineModel

    try:
        return graded_by(PipelineModel.load(path))
    except (Py4JJavaError, PySparkException) as e:
        raise MissingModel(f"no fitted grader at {path}: {e}") from e


def _pair_words() -> Column:
    q, t = content_words(F.col("question")), content_words(F.col("text"))
    return F.concat(F.transform(F.array_intersect(q, t), lambda w: F.concat(F.lit("both "), w)), F.transform(q, lambda w: F.concat(F.lit("q "), w)), F.transform(t, lambda w: F.concat(F.lit("t "), w)))


def train_grader(pairs: DataFrame, features: int = 1 << 14, strength: float = 0.01):
    """A logistic grader on hashed words of question and text with class weights; a substitute for a fine-tuned model, not its equal.

    ``pairs``: question, text, label. Returns a pyspark.ml pipeline model whose ``probability`` follows CHUNK_LABELS.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    weights = class_weights(pairs, "label", list(CHUNK_LABELS)).select("label", "weight")
    number = F.array_position(F.array(*[F.lit(c) for c in CHUNK_LABELS]), F.col("label")) - 1
    # Three rows of weights.
    rows = pairs.join(F.broadcast(weights), "label").select(_pair_words().alias("words"), number.cast("double").alias("y"), "weight")
    return Pipeline(stages=[HashingTF(inputCol="words", outputCol="x", numFeatures=features), LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=30, regParam=strength, family="multinomial")]).fit(rows)
