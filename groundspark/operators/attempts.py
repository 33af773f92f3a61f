"""Calls of a model that can fail: a bounded number of rounds over whole tables, each only over what the rounds before left open.

A caller is a function of a table of requests that adds what the service answered: ``code`` (200, an error's code, null where no
connection came about) and ``raw`` (the reply's text). It sees ``attempt`` (from 1) and ``structured`` (whether a schema is asked for).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import citation_numbers, json_object_text, stripped, without_markers
from groundspark.kept import Kept
from groundspark.schemas import PAYLOAD, REPAIR
from groundspark.settings import SETTINGS

FAILED = "GENERATION FAILED: "


def is_payload(raw: Column) -> Column:
    """Whether a structured reply is a JSON object with sentences."""
    return F.coalesce(F.from_json(json_object_text(raw), PAYLOAD)["sentences"].isNotNull(), F.lit(False))


def generate(requests: DataFrame, call, kept: Kept, structured: bool = True, retries: int = SETTINGS.max_citation_retries) -> DataFrame:
    """qid, raw_text, path, attempts, last_error, error: one row for each request. ``requests``: qid and what ``call`` needs.

    A limit on the rate, a server's error or a lost connection is tried again as it was. A structured request that is refused, or
    whose reply is no payload, is tried again as plain text, where any reply is one. A request without a model (404), or one that is
    refused as plain text, ends with ``error``. Where all rounds are used up the draft says so and cites nothing.
    """
    open_ = requests.withColumns({"structured": F.lit(structured), "last_error": F.lit(None).cast("string")})
    done = []
    for attempt in range(1, retries + 2):
        replied = kept.keep(call(open_.withColumn("attempt", F.lit(attempt))))
        code = F.col("code")
        parses = ~F.col("structured") | is_payload(F.col("raw"))
        refused = (code >= 400) & (code < 500) & ~code.isin(404, 429)
        error = F.when(code == 404, "model not found").when(refused & ~F.col("structured"), F.concat(F.lit("rejected_"), code.cast("string")))
        why = (
            F.when(code.isNull(), "connection_error").when(code == 429, "rate_limited").when(code >= 500, F.concat(F.lit("server_error_"), code.cast("string")))
            .when(refused, F.concat(F.lit("structured_rejected_"), code.cast("string"))).when(~parses, "unparseable_structured_output")
        )
        judged = replied.withColumns({"error": error, "why": why})
        ends = F.col("error").isNotNull() | F.col("why").isNull()
        path = F.when(F.col("error").isNull(), F.when(F.col("structured"), "structured").otherwise("text"))
        done.append(judged.where(ends).select("qid", F.when(F.col("error").isNull(), F.col("raw")).alias("raw_text"), path.alias("path"), F.col("attempt").alias("attempts"), "last_error", "error"))
        left = judged.where(~ends)
        plain = F.col("why").startswith("structured_rejected") | (F.col("why") == "unparseable_structured_output")
        open_ = left.select(*requests.columns, (F.col("structured") & ~plain).alias("structured"), F.col("why").alias("last_error"))
    given_up = open_.select("qid", F.concat(F.lit(FAILED), "last_error").alias("raw_text"), F.lit(None).cast("string").alias("path"), F.lit(retries + 1).alias("attempts"), "last_error", F.lit(None).cast("string").alias("error"))
    return reduce(DataFrame.unionByName, [*done, given_up])


def attempt_totals(drafts: DataFrame) -> DataFrame:
    """calls, retries, structured, fallback, failed, errors over all requests; shares of fallbacks among replies, 0 without any."""
    failed = F.col("path").isNull() & F.col("error").isNull()
    total = drafts.agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("calls"), F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).cast("long").alias("retries"), F.count_if(F.col("path") == "structured").alias("structured"),
        F.count_if(F.col("path") == "text").alias("fallback"), F.count_if(failed).alias("failed"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return total.withColumn("fallback_rate", F.coalesce(F.try_divide("fallback", F.col("structured") + F.col("fallback")), F.lit(0.0)))


def regenerate(failed: DataFrame, context: DataFrame, call, kept: Kept) -> DataFrame:
    """qid, sent_idx, outcome, new_text, citation_ids for each failed sentence, after one call each.

    Outcomes: repaired; unrepairable (no passage supports any version of the claim); repaired_but_uncited (a version that cites no
    passage there is, for which none is guessed); unparseable_repair_output; rate_limited, server_error_<code>, connection_error;
    and error where the request itself was refused. Only repaired sentences have a text. ``failed``: qid, sent_idx and what
    ``call`` needs; ``context``: qid, passage_no, chunk_id.
    """
    replied = kept.keep(call(failed.withColumns({"attempt": F.lit(1), "structured": F.lit(True)})))
    code, got = F.col("code"), F.from_json(F.col("raw"), REPAIR)
    parsed = replied.withColumns({"p": F.when(F.try_parse_json("raw").isNotNull(), got)})
    text = stripped(F.coalesce("p.text", F.lit("")))
    numbers = F.array_distinct(F.concat(F.coalesce("p.citations", F.array().cast("array<int>")), citation_numbers(text)))
    rows = parsed.select("qid", "sent_idx", "code", F.col("p").isNotNull().alias("is_json"), F.coalesce("p.repairable", F.lit(False)).alias("repairable"), text.alias("reply"), numbers.alias("numbers"))
    each = rows.where("repairable").select("qid", "sent_idx", F.posexplode("numbers").alias("at", "passage_no")).join(context.select("qid", "passage_no", "chunk_id"), ["qid", "passage_no"])
    ids = each.groupBy("qid", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda x: x["chunk_id"]).alias("citation_ids"))
    outcome = (
        F.when(code.isNull(), "connection_error").when(code == 429, "rate_limited").when(code >= 500, F.concat(F.lit("server_error_"), code.cast("string"))).when(code >= 400, "error")
        .when(~F.col("is_json"), "unparseable_repair_output").when(~F.col("repairable") | (F.col("reply") == ""), "unrepairable").when(F.col("citation_ids").isNull(), "repaired_but_uncited").otherwise("repaired")
    )
    known = rows.join(ids, ["qid", "sent_idx"], "left").withColumn("outcome", outcome)
    good = F.col("outcome") == "repaired"
    return known.select("qid", "sent_idx", "outcome", F.when(good, without_markers(F.col("reply"))).alias("new_text"), F.when(good, F.col("citation_ids")).otherwise(F.array().cast("array<string>")).alias("citation_ids"))


def rechecked(repaired: DataFrame, score: Column, threshold: float = SETTINGS.entailment_threshold) -> DataFrame:
    """Outcomes with a score as repairs of ``repair.sentence_outcomes``: qid, sent_idx, new_text, new_score, recheck_supported."""
    return repaired.select("qid", "sent_idx", "new_text", F.when(F.col("outcome") == "repaired", score).alias("new_score"), ((F.col("outcome") == "repaired") & (score >= F.lit(threshold))).alias("recheck_supported"))
