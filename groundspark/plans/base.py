"""Deterministic inputs of the registered queries, made from the given tables, each with the SQL that makes the same rows.

The tables hold no questions, citations, probabilities or repairs; these are constructed by fixed arithmetic on ids, and
scores are lexical stand-ins.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.functions.sentences import BOUNDARY, CUT, HELD, KEPT
from groundspark.functions.text import ARTICLES, STOPWORDS
from groundspark.kept import Kept
from groundspark.operators import drafting, grading, repair, retrieval, verification
from groundspark.settings import SETTINGS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


# -- retrieval --------------------------------------------------------------------------------------------------------


def vectors(spark, sf_dir):
    """Questions are the rows with vec_id % 25 = 0, the corpus is the rest."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label"), rows.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def hits(spark, sf_dir, k):
    q, c = vectors(spark, sf_dir)
    return retrieval.nearest(q, c, k)


def hits_sql(name: str, k: int) -> str:
    return f"""{name} AS (SELECT qid, rank, chunk_id, score FROM (
  SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id)::INTEGER AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 25 = 0 AND c.vec_id % 25 <> 0) WHERE rank <= {k})"""


def probabilities(rows: DataFrame) -> DataFrame:
    """A stand-in grader: the score stretched to [0, 1], the rest split 0.7 to 0.3."""
    p = F.least(F.greatest((F.col("score") - F.lit(0.35)) * F.lit(5.0), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("p_correct", F.round(p, 6))
    return rows.withColumns({"p_wrong": (F.lit(1.0) - F.col("p_correct")) * F.lit(0.7), "p_ambiguous": (F.lit(1.0) - F.col("p_correct")) * F.lit(0.3)})


P_SQL = "round(least(greatest((score - 0.35::DOUBLE) * 5.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 6)"


def graded_sql(name: str, source: str, p: str = P_SQL) -> str:
    """Adds probabilities, label and confidence. ``p``: the probability of being correct."""
    return f"""{name} AS (SELECT *,
    CASE WHEN p_correct >= 0.5::DOUBLE THEN 'correct' WHEN p_correct <= 0.05::DOUBLE AND p_wrong >= p_ambiguous THEN 'wrong' ELSE 'ambiguous' END AS label,
    CASE WHEN p_correct >= 0.5::DOUBLE THEN p_correct WHEN p_correct <= 0.05::DOUBLE AND p_wrong >= p_ambiguous THEN p_wrong
      WHEN p_correct <= 0.05::DOUBLE THEN p_ambiguous ELSE greatest(p_ambiguous, p_correct) END AS confidence
  FROM (SELECT *, (1.0::DOUBLE - p_correct) * 0.7::DOUBLE AS p_wrong, (1.0::DOUBLE - p_correct) * 0.3::DOUBLE AS p_ambiguous
    FROM (SELECT *, {p} AS p_correct FROM {source})))"""


def action_sql(questions: str, graded: str) -> str:
    return f"""SELECT q.qid, CASE WHEN max(CASE WHEN label = 'correct' THEN 1 ELSE 0 END) = 1 THEN 'proceed'
      WHEN coalesce(min(CASE WHEN label = 'wrong' THEN 1 ELSE 0 END) FILTER (WHERE label IS NOT NULL), 1) = 1 THEN 'abstain' ELSE 'corrective_retrieve' END AS action
    FROM {questions} q LEFT JOIN {graded} g ON q.qid = g.qid GROUP BY q.qid"""


def corrective(spark, sf_dir):
    q, _ = vectors(spark, sf_dir)
    kept = Kept(spark)
    wide = kept.keep(hits(spark, sf_dir, SETTINGS.corrective_fetch_k))
    first = wide.where(F.col("rank") <= SETTINGS.top_k)
    return grading.corrective_round(q.select("qid"), first, wide, probabilities, keep=kept.keep)


def corrective_sql(p: str = P_SQL) -> str:
    """CTEs round0, before, need, merged, round1, graded, afters and trace, over wide (qid, rank, chunk_id, score) and questions (qid)."""
    return f"""firsts AS (SELECT *, rank AS pos FROM wide WHERE rank <= {SETTINGS.top_k}),
{graded_sql('round0', 'firsts', p)},
before AS ({action_sql('questions', 'round0')}),
need AS (SELECT qid FROM before WHERE action = 'corrective_retrieve'),
merged AS (SELECT w.*, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= {SETTINGS.top_k} THEN 0 ELSE 1 END, rank)::INTEGER AS pos FROM wide w WHERE qid IN (SELECT qid FROM need)),
{graded_sql('round1', 'merged', p)},
graded AS (SELECT qid, chunk_id, label, confidence, pos FROM round0 WHERE qid NOT IN (SELECT qid FROM need) UNION ALL SELECT qid, chunk_id, label, confidence, pos FROM round1),
afters AS ({action_sql('questions', 'graded')}),
trace AS (SELECT b.qid, CASE WHEN b.action = 'corrective_retrieve' THEN 2 ELSE 1 END AS rounds, b.action = 'corrective_retrieve' AS corrective_fired, a.action,
  a.action = 'abstain' AS abstained_before_generation FROM before b JOIN afters a ON a.qid = b.qid)"""


CORRECTIVE_SQL = f"""{hits_sql('wide', SETTINGS.corrective_fetch_k)},
questions AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 25 = 0),
{corrective_sql()}"""
KEPT_SQL = f"""SELECT qid, passage_no, chunk_id, label FROM (
   SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label <> 'correct', confidence DESC, pos)::INTEGER AS passage_no FROM graded
   WHERE label <> 'wrong' AND qid IN (SELECT qid FROM trace WHERE action <> 'abstain')) WHERE passage_no <= {SETTINGS.top_k}"""


# -- normalisation in SQL ---------------------------------------------------------------------------------------------

_PUNCT = string.punctuation.replace("'", "''")


def words_sql(text: str) -> str:
    articles = ", ".join(f"'{a}'" for a in ARTICLES)
    return f"list_filter(string_split(regexp_replace(translate(lower(strip_accents({text})), '{_PUNCT}', ''), '\\s+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({articles}))"


def normal_sql(text: str) -> str:
    return f"array_to_string({words_sql(text)}, ' ')"


def content_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter({words_sql(text)}, lambda w: w NOT IN ({stop})))"


def trimmed_sql(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


# -- drafts: assistant turns as answers, the first turns of the conversation as passages -------------------------------

_HELD, _BOUNDARY = HELD.replace("'", "''"), BOUNDARY.replace("'", "''")


def sentences_sql(text: str) -> str:
    body = trimmed_sql(f"regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g')")
    for _ in range(2):
        body = f"regexp_replace({body}, '{_HELD}', '\\1\\2.\\3' || chr({ord(KEPT)}), 'g')"
    cut = f"string_split(regexp_replace({body}, '{_BOUNDARY}', '\\1' || chr({ord(CUT)}), 'g'), chr({ord(CUT)}))"
    return f"list_filter(list_transform({cut}, lambda p: trim(replace(p, chr({ord(KEPT)}), ' '))), lambda p: p <> '')"


def draft_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), "conv_id", "turn", "text")


def passages(spark, sf_dir):
    """The first five turns of the conversation that aren't the answer itself."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.where("turn < 6").select("conv_id", F.col("turn").alias("p"), F.col("text").alias("passage"))
    own = draft_turns(spark, sf_dir).select("qid", "conv_id", "turn").join(first, "conv_id").where("p <> turn")
    numbered = own.withColumn("passage_no", F.row_number().over(Window.partitionBy("qid").orderBy("p"))).where("passage_no <= 5")
    return numbered.select("qid", "passage_no", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("::"), F.col("p").cast("string")).alias("chunk_id"), F.col("passage").alias("text"))


def marked_sentences(spark, sf_dir):
    """Sentences with citations put in: every fourth one has none, every fifth has two, and some numbers are invented."""
    turns = draft_turns(spark, sf_dir)
    each = drafting.sentences_of(turns, "text").join(turns.select("qid", "conv_id", "turn"), "qid")
    first = (F.lit(1) + F.pmod(F.col("conv_id") + F.col("turn") + F.col("sent_idx"), F.lit(7))).cast("string")
    second = (F.lit(1) + F.pmod(F.col("conv_id") + F.col("sent_idx") * 2, F.lit(6))).cast("string")
    mark = F.when(F.pmod(F.col("conv_id") + F.col("sent_idx"), F.lit(4)) == 3, "").when(F.pmod(F.col("turn") + F.col("sent_idx"), F.lit(5)) == 0, F.concat(F.lit(" ["), first, F.lit(", "), second, F.lit("]"))).otherwise(F.concat(F.lit(" ["), first, F.lit("]")))
    raw = F.concat(F.left("raw", F.length("raw") - 1), mark, F.right("raw", F.lit(1)))
    return each.select("qid", "sent_idx", raw.alias("raw"))


TURNS_SQL = f"""turns AS (SELECT conv_id || '-' || turn AS qid, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
split AS (SELECT qid, conv_id, turn, s, unnest(range(0, len(s))) AS i FROM (SELECT *, {sentences_sql('text')} AS s FROM turns)),
marked AS (SELECT qid, i::INTEGER AS sent_idx, left(s[i + 1], length(s[i + 1]) - 1)
   || CASE WHEN (conv_id + i) % 4 = 3 THEN '' WHEN (turn + i) % 5 = 0 THEN ' [' || (1 + (conv_id + turn + i) % 7) || ', ' || (1 + (conv_id + i * 2) % 6) || ']'
      ELSE ' [' || (1 + (conv_id + turn + i) % 7) || ']' END || right(s[i + 1], 1) AS raw FROM split)"""
#: From marked (qid, sent_idx, raw) to sentences and their distinct numbers.
PARSED_SQL = f"""parsed AS (SELECT qid, sent_idx, {trimmed_sql("regexp_replace(regexp_replace(regexp_replace(raw, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', '', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), '\\s+', ' ', 'g')")} AS text, {trimmed_sql('raw')} AS raw,
   coalesce(flatten(list_transform(regexp_extract_all(raw, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda g: list_transform(string_split(g, ','), lambda n: trim(n)::INTEGER))), []) AS all_numbers FROM marked),
numbered AS (SELECT qid, sent_idx, n, min(j) AS j FROM (SELECT qid, sent_idx, unnest(all_numbers) AS n, unnest(range(0, len(all_numbers))) AS j FROM parsed) GROUP BY ALL)"""
_CONTEXT = """context AS (SELECT qid, passage_no, chunk_id, text FROM (
   SELECT t.qid, row_number() OVER (PARTITION BY t.qid ORDER BY c.turn)::INTEGER AS passage_no, 'c' || c.conv_id || '::' || c.turn AS chunk_id, c.text
   FROM turns t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn < 6 AND c.turn <> t.turn) WHERE passage_no <= 5)"""
#: Numbers against context (qid, passage_no, chunk_id, text).
CITATIONS_SQL = """citations AS (SELECT n.qid, n.sent_idx, (row_number() OVER (PARTITION BY n.qid, n.sent_idx ORDER BY n.j) - 1)::INTEGER AS cite_pos, n.n AS passage_no, c.chunk_id
   FROM numbered n LEFT JOIN context c ON c.qid = n.qid AND c.passage_no = n.n)"""
DRAFTS_SQL = ",\n".join((TURNS_SQL, PARSED_SQL, _CONTEXT, CITATIONS_SQL))

SCORED_SQL = f"""words AS (SELECT qid, sent_idx, {content_sql('text')} AS w FROM parsed),
pwords AS (SELECT qid, chunk_id, {content_sql('text')} AS pw FROM context),
scored AS (SELECT c.qid, c.sent_idx, c.cite_pos, c.chunk_id, w, pw, CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(w, pw)) / len(w)::DOUBLE END AS score
   FROM citations c JOIN words USING (qid, sent_idx) JOIN pwords p ON p.qid = c.qid AND p.chunk_id = c.chunk_id),
owns AS (SELECT qid, sent_idx, count(*) AS n_scored, max(score) AS best, arg_max(chunk_id, score * 1000 - cite_pos * 0.0000001) AS best_id, any_value(w) AS w, list_distinct(flatten(list(pw))) AS joint,
   list(round(score, 4)) AS rounded FROM scored GROUP BY ALL),
finals AS (SELECT *, CASE WHEN n_scored > 1 THEN CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(w, joint)) / len(w)::DOUBLE END ELSE best END AS final FROM owns),
verdicts AS (SELECT p.qid, p.sent_idx, p.text, coalesce(final, 0) >= 0.2::DOUBLE AND n_scored IS NOT NULL AS supported, coalesce(final, 0.0::DOUBLE) AS entailment_score,
   CASE WHEN final >= 0.2::DOUBLE THEN best_id END AS supporting_chunk_id,
   CASE WHEN n_scored IS NULL THEN 'neutral' WHEN final >= 0.2::DOUBLE THEN 'entailment' WHEN final <= 0 THEN 'contradiction' ELSE 'neutral' END AS nli_label,
   coalesce(n_scored, 0)::BIGINT AS n_scored, n_scored IS NULL AS uncited, rounded FROM parsed p LEFT JOIN finals USING (qid, sent_idx))"""

VERDICTS_SQL = f"{DRAFTS_SQL},\n{SCORED_SQL}"


def parsed(spark, sf_dir):
    return drafting.parse(marked_sentences(spark, sf_dir))


def resolved(spark, sf_dir):
    p = parsed(spark, sf_dir)
    c = passages(spark, sf_dir)
    return p, c, drafting.resolve(p, c)


def verdicts(spark, sf_dir):
    p, c, cites = resolved(spark, sf_dir)
    return verification.verify(p.select("qid", "sent_idx", "text"), cites, c)


def final_answers(spark, sf_dir):
    """Drafts, outcomes and answers; repairs come back for even sentences and pass again for every third."""
    p, c, cites = resolved(spark, sf_dir)
    sentences = drafting.cited_sentences(p, cites)
    v = verification.verify(sentences.select("qid", "sent_idx", "text"), cites, c)
    new = sentences.select("qid", "sent_idx", F.when(F.col("sent_idx") % 2 == 0, F.concat(F.lit("Repaired: "), "text")).alias("new_text"), F.lit(0.5).alias("new_score"), (F.col("sent_idx") % 3 == 0).alias("recheck_supported"))
    outcomes = repair.sentence_outcomes(sentences, v, new)
    drafts = draft_turns(spark, sf_dir).select("qid", F.when(F.pmod("conv_id", F.lit(41)) == 7, "GENERATION FAILED").otherwise(F.col("text")).alias("raw_text"), (F.pmod("conv_id", F.lit(37)) == 5).alias("gen_abstained"))
    return drafts, outcomes, repair.answers(drafts, outcomes), c


#: Outcomes (status, out_text, score) summed up for each question.
SUMS_SQL = f"""sums AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE status <> 'kept') AS flagged, count(*) FILTER (WHERE status IN ('repaired', 'dropped')) AS tried, count(*) FILTER (WHERE status = 'repaired') AS ok,
   count(*) FILTER (WHERE status IN ('dropped', 'uncited_dropped')) AS dropped, count(*) FILTER (WHERE status = 'uncited_dropped') AS uncited_dropped, coalesce(string_agg(out_text, ' ' ORDER BY sent_idx) FILTER (WHERE status IN ('kept', 'repaired')), '') AS surviving,
   count(*) FILTER (WHERE status IN ('kept', 'repaired')) AS n_surviving, avg(score) FILTER (WHERE status IN ('kept', 'repaired')) AS mean_score, bool_or(contains(lower(out_text), 'cannot answer this from the provided sources')) AS refusal FROM outcomes GROUP BY qid)"""
#: Sums and drafts (qid, raw_text, gen_abstained) to answers.
JUDGED_SQL = f"""judged AS (SELECT d.qid, CASE WHEN gen_abstained OR (n = 1 AND refusal) THEN 'generator_abstained' WHEN starts_with(raw_text, 'GENERATION FAILED') THEN 'generation_failed' WHEN n IS NULL THEN 'nothing_survived'
     WHEN flagged / n::DOUBLE > 0.5::DOUBLE THEN 'too_much_unsupported' END AS early,
   CASE WHEN n_surviving = 0 THEN 'nothing_survived' WHEN length({trimmed_sql('surviving')}) < 20 THEN 'fragment_after_drops' END AS late, s.* EXCLUDE (qid) FROM drafts d LEFT JOIN sums s ON s.qid = d.qid),
answers AS (SELECT qid, coalesce(early, late) IS NOT NULL AS abstained, coalesce(early, late) AS abstain_reason, CASE WHEN coalesce(early, late) IS NULL THEN surviving END AS text, coalesce(flagged, 0)::BIGINT AS flagged,
   CASE WHEN early IS NULL THEN tried ELSE 0 END::BIGINT AS repair_attempted, CASE WHEN early IS NULL THEN ok ELSE 0 END::BIGINT AS repair_succeeded, CASE WHEN early IS NULL THEN dropped ELSE 0 END::BIGINT AS dropped,
   CASE WHEN early IS NULL THEN uncited_dropped ELSE 0 END::BIGINT AS uncited_dropped, CASE WHEN coalesce(early, late) IS NULL THEN coalesce(mean_score, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS confidence FROM judged)"""
ANSWERS_SQL = f"""{VERDICTS_SQL},
outcomes AS (SELECT *, CASE WHEN status = 'repaired' THEN 'Repaired: ' || text ELSE text END AS out_text, CASE WHEN status = 'repaired' THEN 0.5::DOUBLE ELSE entailment_score END AS score FROM (
   SELECT *, CASE WHEN supported THEN 'kept' WHEN uncited THEN 'uncited_dropped' WHEN sent_idx % 2 = 0 AND sent_idx % 3 = 0 THEN 'repaired' ELSE 'dropped' END AS status FROM verdicts)),
{SUMS_SQL},
drafts AS (SELECT qid, CASE WHEN conv_id % 41 = 7 THEN 'GENERATION FAILED' ELSE text END AS raw_text, conv_id % 37 = 5 AS gen_abstained FROM turns),
{JUDGED_SQL}"""
