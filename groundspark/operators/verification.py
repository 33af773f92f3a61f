"""Verification of cited sentences, with a pluggable premise scorer, and the metrics over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import content_words, overlap
from groundspark.settings import SETTINGS, Settings


def lexical_score(words: Column, passage_words: Column) -> Column:
    """A stand-in for entailment, and known to overstate it: the share of content words found in the passage."""
    return overlap(words, passage_words)


def verify(sentences: DataFrame, citations: DataFrame, context: DataFrame, s: Settings = SETTINGS, score=lexical_score) -> DataFrame:
    """Verdicts: qid, sent_idx, supported, entailment_score, supporting_chunk_id, nli_label, n_scored, scores, uncited.

    Every resolvable citation is scored by itself; the best one decides under ``any`` or when it is the only one; under
    ``concat`` several are scored as one joint premise. Sentences without a resolvable citation are uncited, score 0.
    ``scores`` maps chunk ids to their score, rounded to 4 places; the decision uses the unrounded one.
    """
    words = sentences.select("qid", "sent_idx", content_words(F.col("text")).alias("words"))
    passages = context.select("qid", "chunk_id", content_words(F.col("text")).alias("passage"))
    each = citations.where("chunk_id IS NOT NULL").join(words, ["qid", "sent_idx"]).join(passages, ["qid", "chunk_id"])
    scored = each.withColumn("score", score(F.col("words"), F.col("passage")))
    own = scored.groupBy("qid", "sent_idx").agg(
        F.max_by("chunk_id", F.struct("score", -F.col("cite_pos"))).alias("best_id"), F.max("score").alias("best"), F.count("*").alias("n_scored"),
        F.first("words").alias("words"), F.array_distinct(F.flatten(F.collect_list("passage"))).alias("joint"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("chunk_id", F.bround("score", 4))))).alias("scores"),
    )
    final = F.col("best") if s.policy == "any" else F.when(F.col("n_scored") > 1, score(F.col("words"), F.col("joint"))).otherwise(F.col("best"))
    judged = own.select("qid", "sent_idx", "best_id", "n_scored", "scores", final.alias("final"))
    out = sentences.select("qid", "sent_idx").join(judged, ["qid", "sent_idx"], "left")
    value = F.coalesce("final", F.lit(0.0))
    uncited = F.col("n_scored").isNull()
    label = F.when(uncited, "neutral").when(value >= F.lit(s.entailment_threshold), "entailment").when(value <= F.lit(0.0), "contradiction").otherwise("neutral")
    return out.select(
        "qid", "sent_idx", (~uncited & (value >= F.lit(s.entailment_threshold))).alias("supported"), value.alias("entailment_score"),
        F.when(value >= F.lit(s.entailment_threshold), F.col("best_id")).alias("supporting_chunk_id"), label.alias("nli_label"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "scores", uncited.alias("uncited"),
    )


def lexical_support(sentences: DataFrame, citations: DataFrame, context: DataFrame, least: float = 0.5) -> DataFrame:
    """qid, sent_idx, supported of each sentence with a resolvable citation: some cited passage holds that share of its content words."""
    words = sentences.select("qid", "sent_idx", content_words(F.col("text")).alias("words"))
    passages = context.select("qid", "chunk_id", content_words(F.col("text")).alias("passage"))
    each = citations.where("chunk_id IS NOT NULL").join(words, ["qid", "sent_idx"]).join(passages, ["qid", "chunk_id"])
    return each.groupBy("qid", "sent_idx").agg((F.max(overlap(F.col("words"), F.col("passage"))) >= F.lit(least)).alias("supported"))


def counted(has_ids: Column = None) -> Column:
    """Verdicts that metrics count: all but those of sentences without any citation."""
    return ~(F.col("uncited") & ((F.col("n_scored") == 0) if has_ids is None else ~has_ids))


def report(verdicts: DataFrame) -> DataFrame:
    """For each draft: n, unsupported, contradicted, all_supported, flag_rate (0 when empty)."""
    return verdicts.groupBy("qid").agg(
        F.count("*").alias("n"), F.count_if(~F.col("supported")).alias("unsupported"), F.count_if(F.col("nli_label") == "contradiction").alias("contradicted"),
        F.coalesce(F.bool_and("supported"), F.lit(True)).alias("all_supported"), F.coalesce(F.try_divide(F.count_if(~F.col("supported")), F.count("*")), F.lit(0.0)).alias("flag_rate"),
    )


def counts_by_draft(verdicts: DataFrame, threshold: float = SETTINGS.entailment_threshold) -> DataFrame:
    """qid, scored, supported, contradicted, citations, good_citations of the sentences that metrics count."""
    values = F.coalesce(F.map_values("scores"), F.array().cast("array<double>"))
    return verdicts.where(counted()).groupBy("qid").agg(
        F.count("*").alias("scored"), F.count_if("supported").alias("supported"), F.count_if(F.col("nli_label") == "contradiction").alias("contradicted"),
        F.sum(F.size(values)).cast("long").alias("citations"), F.sum(F.size(F.filter(values, lambda x: x >= F.lit(threshold)))).cast("long").alias("good_citations"),
    )


def citation_precision_recall(verdicts: DataFrame, threshold: float = SETTINGS.entailment_threshold) -> DataFrame:
    """Recall over counted sentences, precision over their rounded citation scores; null on an empty denominator."""
    rows = verdicts.where(counted())
    values = F.coalesce(F.map_values("scores"), F.array().cast("array<double>"))
    good = F.size(F.filter(values, lambda x: x >= F.lit(threshold)))
    total = rows.agg(F.count("*").alias("sentences"), F.count_if("supported").alias("supported_sentences"), F.coalesce(F.sum(F.size(values)), F.lit(0)).cast("long").alias("citations"), F.coalesce(F.sum(good), F.lit(0)).cast("long").alias("supported_citations"))
    return total.select("*", F.try_divide("supported_sentences", "sentences").alias("recall"), F.try_divide("supported_citations", "citations").alias("precision"))


def hallucination_rate(verdicts: DataFrame) -> DataFrame:
    """The shares of counted sentences that are unsupported and contradicted; null without any."""
    total = verdicts.where(counted()).agg(F.count("*").alias("sentences"), F.count_if(~F.col("supported")).alias("unsupported"), F.count_if(F.col("nli_label") == "contradiction").alias("contradicted"))
    return total.select("*", F.try_divide("unsupported", "sentences").alias("hallucination_rate"), F.try_divide("contradicted", "sentences").alias("contradiction_rate"))


def labeled_hallucination_rate(rows: DataFrame) -> DataFrame:
    """From labels supported or hallucinated; null while nothing is labelled."""
    total = rows.where(F.col("label").isin("supported", "hallucinated")).agg(F.count("*").alias("labeled"), F.count_if(F.col("label") == "hallucinated").alias("hallucinated"))
    return total.withColumn("rate", F.try_divide("hallucinated", "labeled"))


def not_one_verdict(sentences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """qid, sent_idx, n of every sentence that hasn't exactly one verdict, and of verdicts without a sentence. Empty for a sound run."""
    key = ["qid", "sent_idx"]
    judged = verdicts.groupBy(*key).agg(F.count("*").alias("n"))
    both = sentences.select(*key).distinct().withColumn("there", F.lit(True)).join(judged, key, "full")
    return both.where((F.coalesce("n", F.lit(0)) != 1) | F.col("there").isNull()).select(*key, F.coalesce("n", F.lit(0)).alias("n"))


def checked_rollup(sentences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The roll-up of verdicts; raises where a sentence has none or several, as counts would then mean nothing."""
    if bad := not_one_verdict(sentences, verdicts).limit(1).collect():
        raise ValueError(f"sentence {bad[0]['qid']}/{bad[0]['sent_idx']} has {bad[0]['n']} verdicts instead of one")
    return verifier_rollup(verdicts)


def verifier_rollup(verdicts: DataFrame) -> DataFrame:
    """Counts of outcomes, labels and sentences with several citations."""
    return verdicts.agg(
        F.count("*").alias("sentences"), F.count_if("supported").alias("supported"), F.count_if("uncited").alias("uncited"), F.count_if(F.col("n_scored") > 1).alias("several_citations"),
        *[F.count_if(F.col("nli_label") == x).alias(x) for x in ("entailment", "neutral", "contradiction")],
        F.avg(F.when(F.col("n_scored") > 0, F.col("n_scored"))).alias("mean_citations"),
    )
