"""Questions to answers, and files to an index: the stages put together, for whole tables at a time."""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.kept import Kept
from groundspark.operators import chunking, drafting, grading, models, repair, retrieval, verification
from groundspark.settings import SETTINGS, Settings
from groundspark.sources import readers


class Flags(NamedTuple):
    use_evaluator: bool = True
    force_citations: bool = True
    verify_citations: bool = True
    repair_and_abstain: bool = True


class Models(NamedTuple):
    """Functions on DataFrames, all of them lexical stand-ins here: each says what a real model in its place must give."""

    grade: object = models.lexical_grader
    draft: object = models.extractive_generator
    plain: object = models.plain_generator
    score: object = verification.lexical_score
    repair: object = models.extractive_repair
    #: questions, index, k to qid, rank, chunk_id, score.
    retrieve: object = retrieval.nearest


def _models(use: Models | None) -> Models:
    if use is None:
        warnings.warn("no models were given, so lexical stand-ins answer; pass Models() to say that they are meant", stacklevel=3)
    return use or Models()


class Runs:
    """The stages of answering a table of questions under any flags, written as tables; those that runs share are computed once.

    ``questions``: qid, question, and vector where retrieval is dense; ``index``: chunk_id, text (vector). Context depends on the
    evaluator alone, drafts on that and on forced citations, verdicts on the drafts, outcomes on the verdicts.
    """

    def __init__(self, questions: DataFrame, index: DataFrame, use: Models | None = None, s: Settings = SETTINGS):
        self.questions, self.index, self.use, self.s, self.kept = questions, index, _models(use), s, Kept(index.sparkSession)
        self._made: dict[tuple, object] = {}

    def _once(self, name: str, *key, make):
        if (name, *key) not in self._made:
            self._made[(name, *key)] = make()
        return self._made[(name, *key)]

    def hits(self) -> DataFrame:
        return self._once("hits", make=lambda: self.kept.keep(self.use.retrieve(self.questions, self.index, self.s.corrective_fetch_k)))

    def context(self, evaluator: bool) -> tuple[DataFrame, DataFrame]:
        """qid, passage_no, chunk_id, text, and the trace of each question."""
        return self._once("context", evaluator, make=lambda: self._context(evaluator))

    def _context(self, evaluator: bool) -> tuple[DataFrame, DataFrame]:
        texts, wide = self.index.select("chunk_id", "text"), self.hits()
        first = wide.where(F.col("rank") <= self.s.top_k)
        if not evaluator:
            trace = self.questions.select("qid", F.lit(1).alias("rounds"), F.lit(False).alias("corrective_fired"), F.lit("evaluator_disabled").alias("action"), F.lit(False).alias("abstained_before_generation"))
            return self.kept.keep(first.select("qid", F.col("rank").alias("passage_no"), "chunk_id").join(texts, "chunk_id").select("qid", "passage_no", "chunk_id", "text")), trace

        def score(hits: DataFrame) -> DataFrame:
            return self.use.grade(hits.join(self.questions.select("qid", "question"), "qid").join(texts, "chunk_id")).drop("question", "text")

        graded, trace = grading.corrective_round(self.questions.select("qid"), first, wide, score, self.s, self.kept.keep)
        trace = self.kept.keep(trace)
        chosen = grading.kept_context(graded, trace, self.s.top_k).drop("label")
        return self.kept.keep(chosen.join(texts, "chunk_id").select("qid", "passage_no", "chunk_id", "text")), trace

    def drafts(self, evaluator: bool, cited: bool) -> DataFrame:
        """qid, raw_text, gen_abstained of the questions that have context: no other one reaches a generator."""
        make = self.use.draft if cited else self.use.plain
        return self._once("drafts", evaluator, cited, make=lambda: self.kept.keep(make(self.context(evaluator)[0]).select("qid", "raw_text").withColumn("gen_abstained", F.lit(False))))

    def parsed(self, evaluator: bool, cited: bool) -> DataFrame:
        return self._once("parsed", evaluator, cited, make=lambda: self.kept.keep(drafting.parse(drafting.sentences_of(self.drafts(evaluator, cited)))))

    def citations(self, evaluator: bool, cited: bool) -> DataFrame:
        return self._once("citations", evaluator, cited, make=lambda: self.kept.keep(drafting.resolve(self.parsed(evaluator, cited), self.context(evaluator)[0])))

    def sentences(self, evaluator: bool, cited: bool) -> DataFrame:
        return self._once("sentences", evaluator, cited, make=lambda: self.kept.keep(drafting.cited_sentences(self.parsed(evaluator, cited), self.citations(evaluator, cited))))

    def verdicts(self, evaluator: bool, cited: bool) -> DataFrame:
        at = (evaluator, cited)
        return self._once("verdicts", *at, make=lambda: self.kept.keep(verification.verify(self.parsed(*at).select("qid", "sent_idx", "text"), self.citations(*at), self.context(evaluator)[0], self.s, self.use.score)))

    def repairs(self, evaluator: bool, cited: bool) -> DataFrame:
        """qid, sent_idx, new_text, new_score, recheck_supported for the cited sentences that failed, and only for those."""
        at = (evaluator, cited)
        failed = lambda: self.parsed(*at).join(self.verdicts(*at).where("NOT supported AND NOT uncited").select("qid", "sent_idx"), ["qid", "sent_idx"], "left_semi")
        return self._once("repairs", *at, make=lambda: self.kept.keep(self.use.repair(failed(), self.citations(*at), self.context(evaluator)[0])))

    def outcomes(self, evaluator: bool, cited: bool) -> DataFrame:
        at = (evaluator, cited)
        return self._once("outcomes", *at, make=lambda: self.kept.keep(repair.sentence_outcomes(self.sentences(*at), self.verdicts(*at), self.repairs(*at))))

    def answers(self, flags: Flags) -> DataFrame:
        """qid, text, abstained, abstain_reason, repair_attempted, repair_succeeded of every question. Text is the draft as it was written
        unless a run repairs; null where it abstains."""
        at = flags[:2]
        drafts = self.drafts(*at)
        if flags.verify_citations and flags.repair_and_abstain:
            final = repair.answers(drafts, self.outcomes(*at), True, self.s).select("qid", "text", "abstained", "abstain_reason", "repair_attempted", "repair_succeeded")
        else:
            none = F.lit(0).cast("long")
            final = drafts.select("qid", F.col("raw_text").alias("text"), F.lit(False).alias("abstained"), F.lit(None).cast("string").alias("abstain_reason"), none.alias("repair_attempted"), none.alias("repair_succeeded"))
        out = self.questions.select("qid").join(final, "qid", "left")
        missing = F.col("abstained").isNull()
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return out.select("qid", "text", F.coalesce("abstained", F.lit(True)).alias("abstained"), F.when(missing, "no_usable_chunk").otherwise(F.col("abstain_reason")).alias("abstain_reason"), zero("repair_attempted"), zero("repair_succeeded"))

    def counters(self, flags: Flags) -> DataFrame:
        """What metrics count of each answer: sentences and parseable ones where citations are forced; scored, supported and contradicted
        sentences, citations and good ones where they are verified; tokens of all calls. Questions without a draft have no row."""
        at, zero = flags[:2], F.lit(0).cast("long")
        out = self.drafts(*at).select("qid", drafting.tokens(F.length("raw_text")).alias("output_tokens"))
        size = self.context(flags.use_evaluator)[0].groupBy("qid").agg(F.sum(F.length("text")).alias("read"))
        size = size.join(self.questions.select("qid", F.length("question").alias("asked")), "qid").select("qid", (F.col("read") + F.col("asked")).alias("chars"))
        out = out.join(size.withColumn("input_tokens", drafting.tokens(F.col("chars"))), "qid")
        repairing = flags.verify_citations and flags.repair_and_abstain
        if repairing:
            called = self.repairs(*at).join(self.parsed(*at).select("qid", "sent_idx", "text"), ["qid", "sent_idx"]).join(size, "qid").join(self.answers(flags).where("repair_attempted > 0").select("qid"), "qid", "left_semi")
            spent = called.groupBy("qid").agg(F.sum(drafting.tokens(F.col("chars") + F.length("text"))).alias("more_in"), F.sum(drafting.tokens(F.coalesce(F.length("new_text"), F.lit(0)))).alias("more_out"))
            out = out.join(spent, "qid", "left").withColumns({"input_tokens": F.col("input_tokens") + F.coalesce("more_in", zero), "output_tokens": F.col("output_tokens") + F.coalesce("more_out", zero)}).drop("more_in", "more_out")
        if flags.force_citations:
            mine = self.outcomes(*at).where(F.col("status").isin("kept", "repaired")) if repairing else self.sentences(*at)
            out = out.join(mine.groupBy("qid").agg(F.count("*").alias("sentences"), F.count_if(F.size("citation_ids") > 0).alias("parseable")), "qid", "left")
        if flags.verify_citations:
            out = out.join(verification.counts_by_draft(self.verdicts(*at), self.s.entailment_threshold), "qid", "left")
        for name in ("sentences", "parseable", "scored", "supported", "contradicted", "citations", "good_citations"):
            out = out.withColumn(name, F.coalesce(name, zero) if name in out.columns else zero)
        return out.drop("chars")


def retrieve_and_grade(questions: DataFrame, index: DataFrame, flags: Flags = Flags(), use: Models | None = None, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """Context (qid, passage_no, chunk_id, text) and trace. ``questions``: qid, question, vector; ``index``: chunk_id, text, vector."""
    return Runs(questions, index, use, s).context(flags.use_evaluator)


def answer(questions: DataFrame, index: DataFrame, flags: Flags = Flags(), use: Models | None = None, s: Settings = SETTINGS) -> DataFrame:
    """qid, text, abstained, abstain_reason, repair_attempts for every question, texts without markers. Questions without context never
    reach the generator."""
    runs = Runs(questions, index, use, s)
    out = runs.answers(flags).withColumnRenamed("repair_attempted", "repair_attempts").drop("repair_succeeded")
    if not (flags.verify_citations and flags.repair_and_abstain):
        clean = runs.parsed(*flags[:2]).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "text"))), lambda x: x["text"]), " ").alias("clean"))
        out = out.join(clean, "qid", "left").withColumn("text", F.col("clean")).drop("clean")
    return out


def ingest(files: DataFrame, index: DataFrame | None = None, bulk: bool = False, embed=retrieval.hashed_vectors) -> tuple[DataFrame, DataFrame]:
    """Statuses with the number of chunks, and the new index. ``files``: request_id, pos, filename, content.

    Of two files with one stem the later one counts, and only that one reports chunks.
    """
    read = Kept(files.sparkSession).keep(readers.extracted(files).withColumn("n_bytes", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).drop("content"))
    statuses = readers.admission(read.select("request_id", "pos", "filename", "n_bytes", "error"))
    good = statuses.where("status = 'indexed'").join(read.select("request_id", "pos", "text"), ["request_id", "pos"])
    last = good.groupBy("doc_id").agg(F.max_by(F.struct("text", "request_id", "pos"), F.struct("request_id", "pos")).alias("x")).select("doc_id", "x.text", "x.request_id", "x.pos")
    chunks = embed(chunking.bulk_chunk(last) if bulk else chunking.chunk(last))
    counts = chunking.chunks_per_document(chunks).withColumnRenamed("doc_id", "chunk_doc")
    own = last.select("request_id", "pos", chunking.normalize_doc_id(F.col("doc_id")).alias("chunk_doc")).join(counts, "chunk_doc", "left").select("request_id", "pos", "n_chunks")
    reported = statuses.join(own, ["request_id", "pos"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return reported, chunks if index is None else chunking.replace_documents(index, chunks)
