"""Drafts: parsed sentences, citations resolved against the context, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.functions.sentences import split_sentences
from groundspark.functions.text import cache_key, citation_numbers, json_object_text, rendered_passages, stripped, without_markers
from groundspark.schemas import PAYLOAD
from groundspark.settings import SETTINGS


def sentences_of(drafts: DataFrame, text: str = "raw_text") -> DataFrame:
    """qid, sent_idx, raw for each sentence of a draft."""
    return drafts.select("qid", F.posexplode(split_sentences(F.col(text))).alias("sent_idx", "raw"))


def parse(sentences: DataFrame) -> DataFrame:
    """Adds text without markers, the distinct numbers and whether there were any."""
    numbers = citation_numbers(F.col("raw"))
    return sentences.select("qid", "sent_idx", without_markers(F.col("raw")).alias("text"), stripped(F.col("raw")).alias("raw"), numbers.alias("numbers"), (F.size(numbers) > 0).alias("had_citation"))


def parse_payload(drafts: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Structured replies: sentences from a JSON object; field and inline numbers united, blank sentences dropped."""
    payload = F.from_json(json_object_text(F.col(raw)), PAYLOAD)
    each = drafts.select("qid", F.posexplode(payload["sentences"]).alias("sent_idx", "s")).select("qid", "sent_idx", F.col("s.text").alias("raw"), F.col("s.citations").alias("field"))
    some = each.where(stripped(F.coalesce("raw", F.lit(""))) != "")
    numbers = F.array_distinct(F.concat(F.coalesce("field", F.array().cast("array<int>")), citation_numbers(F.col("raw"))))
    return some.select("qid", "sent_idx", without_markers(F.col("raw")).alias("text"), stripped(F.col("raw")).alias("raw"), numbers.alias("numbers"), (F.size(numbers) > 0).alias("had_citation"))


def is_structured(raw: str = "raw_text"):
    """Whether a reply is a JSON object with sentences; other replies are parsed as text."""
    return F.from_json(json_object_text(F.col(raw)), PAYLOAD)["sentences"].isNotNull()


def resolve(parsed: DataFrame, context: DataFrame) -> DataFrame:
    """qid, sent_idx, cite_pos, passage_no, chunk_id: one row for each citation; null where no such passage was given."""
    each = parsed.select("qid", "sent_idx", F.posexplode("numbers").alias("cite_pos", "passage_no"))
    return each.join(context.select("qid", "passage_no", "chunk_id"), ["qid", "passage_no"], "left").select("qid", "sent_idx", "cite_pos", "passage_no", "chunk_id")


def cited_sentences(parsed: DataFrame, citations: DataFrame) -> DataFrame:
    """qid, sent_idx, text, citation_ids in written order, parseable."""
    ids = citations.where("chunk_id IS NOT NULL").groupBy("qid", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cite_pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("citation_ids"))
    out = parsed.select("qid", "sent_idx", "text").join(ids, ["qid", "sent_idx"], "left")
    return out.withColumn("citation_ids", F.coalesce("citation_ids", F.array().cast("array<string>"))).withColumn("parseable", F.size("citation_ids") > 0)


def citation_stats(parsed: DataFrame, citations: DataFrame) -> DataFrame:
    """For each draft: sentences, with_citation, with_valid_citation, invalid_ids, sentences_with_invalid_id."""
    own = citations.groupBy("qid", "sent_idx").agg(F.count("chunk_id").alias("valid"), F.count_if(F.col("chunk_id").isNull()).alias("invalid"))
    each = parsed.select("qid", "sent_idx", "had_citation").join(own, ["qid", "sent_idx"], "left").fillna(0, ["valid", "invalid"])
    return each.groupBy("qid").agg(
        F.count("*").alias("sentences"), F.count_if("had_citation").alias("with_citation"), F.count_if(F.col("valid") > 0).alias("with_valid_citation"),
        F.sum("invalid").alias("invalid_ids"), F.count_if(F.col("invalid") > 0).alias("sentences_with_invalid_id"),
    )


def citation_rates(stats: DataFrame) -> DataFrame:
    """Over all drafts, ratios of sums; 0 without sentences."""
    total = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("sentences", "with_citation", "with_valid_citation", "invalid_ids", "sentences_with_invalid_id")])
    rate = lambda c: F.coalesce(F.try_divide(c, "sentences"), F.lit(0.0))
    return total.select("*", rate("with_valid_citation").alias("parseable_rate"), rate("with_citation").alias("citation_rate"), rate("sentences_with_invalid_id").alias("invalid_id_rate"))


def prompts(questions: DataFrame, context: DataFrame, plain: bool = False) -> DataFrame:
    """qid, key, prompt: passages rendered in order and the cache key over them; only the plain key holds chunk ids."""
    rows = F.array_sort(F.collect_list(F.struct("passage_no", "text", "chunk_id")))
    listed = context.groupBy("qid").agg(rows.alias("rows"))
    texts, ids = F.transform("rows", lambda x: x["text"]), F.transform("rows", lambda x: x["chunk_id"])
    key = cache_key(F.col("question"), texts, ids) if plain else cache_key(F.col("question"), texts)
    return questions.join(listed, "qid").select("qid", key.alias("key"), rendered_passages(texts, ids if plain else None).alias("prompt"))


def draft_key(question: Column, texts: Column, model: str, effort: str, prompt: str) -> Column:
    """What a reply to a request for a draft depends on: the model, its effort, the system prompt, the question and the passages' texts."""
    return cache_key(F.lit("draft"), F.lit(model), F.lit(effort), F.lit(prompt), question, texts)


def repair_keys(failed: DataFrame, questions: DataFrame, context: DataFrame, model: str) -> DataFrame:
    """qid, sent_idx, key of each request to repair a sentence: model, question, the failed sentence and the passages' texts, no chunk ids."""
    texts = context.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_no", "text"))), lambda x: x["text"]).alias("texts"))
    rows = failed.select("qid", "sent_idx", "text").join(questions.select("qid", "question"), "qid").join(texts, "qid", "left")
    return rows.select("qid", "sent_idx", cache_key(F.lit("repair"), F.lit(model), F.col("question"), F.col("text"), F.col("texts")).alias("key"))


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their stored reply, and one request for each key that has none, to be generated and stored."""
    hits = requests.join(cache.select("key", "reply"), "key")
    misses = requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return hits, misses


def first_parseable(attempts: DataFrame, most: int = SETTINGS.max_citation_retries + 1) -> DataFrame:
    """Of each question's attempts (1 on) the first whose reply parses, or else the last one allowed."""
    order = Window.partitionBy("qid").orderBy(~F.col("parses"), F.when(F.col("parses"), F.col("attempt")).otherwise(-F.col("attempt")))
    return attempts.where(F.col("attempt") <= most).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def path_totals(drafts: DataFrame) -> DataFrame:
    """calls, structured and fallback, with the share of fallbacks; 0 without calls. ``drafts``: path."""
    total = drafts.agg(F.count("*").alias("calls"), F.count_if(F.col("path") == "structured").alias("structured"), F.count_if(F.col("path") == "text").alias("fallback"))
    return total.withColumn("fallback_rate", F.coalesce(F.try_divide("fallback", "calls"), F.lit(0.0)))


def tokens(chars):
    """Tokens of so many characters, by the rule of thumb of four to one; a real run takes them from the provider's usage record."""
    return F.ceil(chars / F.lit(4.0)).cast("long")


def usage_totals(usage: DataFrame) -> DataFrame:
    """Tokens and cost over all calls. Calls from the cache cost nothing but count in the cost a query."""
    s = SETTINGS
    cost = F.when(F.col("cached"), F.lit(0.0)).otherwise(
        (F.col("input_tokens") * F.lit(s.price_in) + F.col("output_tokens") * F.lit(s.price_out) + F.col("cache_creation_input_tokens") * F.lit(s.price_cache_write) + F.col("cache_read_input_tokens") * F.lit(s.price_cache_read)) / F.lit(1e6)
    )
    total = usage.select("*", cost.alias("cost")).agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cached_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_usd"), F.avg(F.when(~F.col("cached"), F.col("latency_s"))).alias("mean_latency_s"),
    )
    return total.withColumn("cost_per_query", F.col("cost_usd") / F.greatest("calls", F.lit(1)))


def dry_run_cost(requests: DataFrame, batch: bool = False, reply_tokens: int = 300) -> DataFrame:
    """calls and cost before anything is spent. ``requests``: input_tokens."""
    s = SETTINGS
    cost = F.sum(F.col("input_tokens") * F.lit(s.price_in) + F.lit(reply_tokens * s.price_out)) / F.lit(1e6) * F.lit(0.5 if batch else 1.0)
    return requests.agg(F.count("*").alias("calls"), F.coalesce(cost, F.lit(0.0)).alias("cost_usd"))
