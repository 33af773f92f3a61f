"""From verdicts to final answers: keep, repair, drop or abstain, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import abstain_explanation, is_abstention, stripped
from groundspark.settings import SETTINGS, Settings


def sentence_outcomes(sentences: DataFrame, verdicts: DataFrame, repairs: DataFrame, repair_on: bool = True) -> DataFrame:
    """qid, sent_idx, status, text, score: kept, uncited_dropped, repaired or dropped.

    ``repairs``: qid, sent_idx, new_text (null where none came back), new_score, recheck_supported. A repair counts only if it
    passed verification again.
    """
    rows = sentences.select("qid", "sent_idx", "text", "citation_ids").join(verdicts.select("qid", "sent_idx", "supported", "uncited", "entailment_score"), ["qid", "sent_idx"]).join(repairs, ["qid", "sent_idx"], "left")
    passed = F.col("new_text").isNotNull() & F.coalesce("recheck_supported", F.lit(False))
    status = F.when(F.col("supported"), "kept").when(F.col("uncited"), "uncited_dropped").when(F.lit(repair_on) & passed, "repaired").otherwise("dropped")
    rows = rows.withColumn("status", status)
    return rows.select("qid", "sent_idx", "status", F.when(F.col("status") == "repaired", F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(F.col("status") == "repaired", F.col("new_score")).otherwise(F.col("entailment_score")).alias("score"), "citation_ids")


def answers(drafts: DataFrame, outcomes: DataFrame, repair_on: bool = True, s: Settings = SETTINGS) -> DataFrame:
    """One row for each draft: abstained, abstain_reason, text, repair statistics and confidence.

    ``drafts``: qid, raw_text, gen_abstained. The reasons are tried in a fixed order, the share of unsupported
    sentences on the verdicts before repair.
    """
    lives = F.col("status").isin("kept", "repaired")
    own = outcomes.groupBy("qid").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "kept").alias("flagged"), F.count_if(F.col("status").isin("repaired", "dropped")).alias("unsupported_cited"),
        F.count_if(F.col("status") == "repaired").alias("repair_succeeded"), F.count_if(F.col("status").isin("dropped", "uncited_dropped")).alias("dropped"), F.count_if(F.col("status") == "uncited_dropped").alias("uncited_dropped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(lives, F.struct("sent_idx", "text")))), lambda x: x["text"]), " ").alias("surviving"),
        F.count_if(lives).alias("n_surviving"), F.avg(F.when(lives, F.col("score"))).alias("mean_score"), F.bool_or(is_abstention(F.col("text"))).alias("refusal"),
    )
    rows = drafts.join(own, "qid", "left")
    n = F.coalesce("n", F.lit(0))
    refused = F.coalesce("gen_abstained", F.lit(False)) | ((n == 1) & F.coalesce("refusal", F.lit(False)))
    before = F.when(refused, "generator_abstained").when(F.startswith("raw_text", F.lit("GENERATION FAILED")), "generation_failed").when(n == 0, "nothing_survived").when(F.try_divide("flagged", "n") > F.lit(s.abstain_above), "too_much_unsupported")
    short = (F.col("n_surviving") < s.min_surviving_sentences) | (F.length(stripped(F.col("surviving"))) < s.min_surviving_chars)
    after = F.when(F.col("n_surviving") == 0, "nothing_survived").when(short, "fragment_after_drops")
    rows = rows.withColumn("early", before).withColumn("abstain_reason", F.coalesce("early", after))
    spent = lambda c: F.when(F.col("early").isNull(), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "qid", F.col("abstain_reason").isNotNull().alias("abstained"), "abstain_reason", F.when(F.col("abstain_reason").isNull(), F.col("surviving")).alias("text"),
        F.coalesce("flagged", F.lit(0)).cast("long").alias("flagged"), spent(F.col("unsupported_cited") if repair_on else F.lit(0)).alias("repair_attempted"), spent("repair_succeeded").alias("repair_succeeded"),
        spent("dropped").alias("dropped"), spent("uncited_dropped").alias("uncited_dropped"), F.when(F.col("abstain_reason").isNull(), F.coalesce("mean_score", F.lit(1.0))).otherwise(F.lit(1.0)).alias("confidence"),
    )


def explained(rows: DataFrame) -> DataFrame:
    return rows.withColumn("abstain_explanation", abstain_explanation(F.col("abstain_reason")))


def repair_rate(rows: DataFrame) -> DataFrame:
    """Totals of repair statistics; a success rate of 0 when nothing was tried."""
    names = ("flagged", "repair_attempted", "repair_succeeded", "dropped", "uncited_dropped")
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    return total.withColumn("repair_success_rate", F.coalesce(F.try_divide("repair_succeeded", "repair_attempted"), F.lit(0.0)))


def final_citations(outcomes: DataFrame, final: DataFrame, context: DataFrame) -> DataFrame:
    """The passages that surviving sentences of answers cite, in the order of the context."""
    going = final.where("NOT abstained").select("qid")
    cited = outcomes.where(F.col("status").isin("kept", "repaired")).join(going, "qid", "left_semi").select("qid", F.explode("citation_ids").alias("chunk_id")).distinct()
    return context.join(cited, ["qid", "chunk_id"], "left_semi").select("qid", "passage_no", "chunk_id")


def response_status(has_verdict: Column, supported: Column, repairs: Column) -> Column:
    """What a response says of a sentence."""
    return F.when(~has_verdict & (repairs > 0), "repaired").when(~has_verdict, "unverified").when(supported, "passed").otherwise("unverified")


def by_text(answer_sentences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts matched to an answer's sentences by their text, the last of equal texts winning. ``verdicts``: qid, sent_idx, text, supported."""
    last = verdicts.groupBy("qid", "text").agg(F.max_by("supported", "sent_idx").alias("supported"), F.lit(True).alias("has_verdict"))
    return answer_sentences.join(last, ["qid", "text"], "left").withColumn("has_verdict", F.coalesce("has_verdict", F.lit(False)))
