"""Chunks, retrieval, grading, drafts, verification and repair."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from groundspark.operators import chunking, drafting, grading, harness, repair, retrieval, verification
from groundspark.settings import ABSTAIN_REASONS, Settings


def test_chunks(spark):
    docs = spark.createDataFrame([("a b", "word " * 2000), ("empty", ""), ("null", None), ("one", " One sentence. ")], "doc_id string, text string")
    rows = chunking.chunk(docs).orderBy("doc_id", "chunk_index").collect()
    own = [r for r in rows if r.doc_id == "a_b"]
    assert [r.chunk_index for r in own] == list(range(len(own))) and own[0].chunk_id == "a_b::0"
    assert all(len(r.text) <= 800 for r in own) and own[-1].end_char == len(("word " * 2000).strip())
    assert all(b.start_char < a.end_char for a, b in itertools.pairwise(own))
    assert {r.doc_id for r in rows} == {"a_b", "one"}
    with pytest.raises(ValueError):
        chunking.chunk(docs, 10, 10)


def test_replacement_keeps_documents_without_new_chunks(spark):
    old = chunking.chunk(spark.createDataFrame([("a", "old a"), ("b", "old b")], "doc_id string, text string"))
    new = chunking.chunk(spark.createDataFrame([("a", "new a"), ("b", "")], "doc_id string, text string"))
    assert sorted(r.text for r in chunking.replace_documents(old, new).collect()) == ["new a", "old b"]
    twice = spark.createDataFrame([("a::b", "x"), ("a__b", "y")], "doc_id string, text string")
    assert chunking.repeated_ids(twice).count() == 1


def test_nearest(spark):
    corpus = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], "chunk_id long, vector array<float>")
    asked = spark.createDataFrame([(100, [1.0, 0.0]), (101, [-1.0, 0.0])], "qid long, vector array<float>")
    got = retrieval.nearest(asked, corpus, 3).orderBy("qid", "rank").collect()
    assert [r.chunk_id for r in got] == [2, 5, 8, 0, 3, 6]
    assert retrieval.nearest(asked, corpus, 0).groupBy("qid").count().first()["count"] == 5
    assert retrieval.nearest(asked.limit(0), corpus, 3).count() == 0


def test_labels_and_actions(spark):
    rows = spark.createDataFrame([(0.85, 0.10, 0.05), (0.05, 0.15, 0.80), (0.40, 0.35, 0.25), (0.05, 0.90, 0.05)], "p_correct double, p_ambiguous double, p_wrong double")
    assert [r.label for r in grading.grade(rows).collect()] == ["correct", "wrong", "ambiguous", "ambiguous"]
    assert grading.grade(spark.sql("SELECT .5D p_correct, .25D p_ambiguous, .25D p_wrong"), Settings(correct_threshold=0.7, wrong_threshold=0.3)).first().label == "ambiguous"
    cases = {"1": "wcw", "2": "ww", "3": "wa", "4": ""}
    names = {"w": "wrong", "c": "correct", "a": "ambiguous"}
    graded = spark.createDataFrame([(q, names[x]) for q, xs in cases.items() for x in xs], "qid string, label string")
    asked = spark.createDataFrame([(q,) for q in cases], "qid string")
    assert {r.qid: r.action for r in grading.actions(graded, asked).collect()} == {"1": "proceed", "2": "abstain", "3": "corrective_retrieve", "4": "abstain"}


def test_corrective_round_is_bounded(spark):
    asked = spark.createDataFrame([(1,), (2,)], "qid long")
    first = spark.createDataFrame([(1, 1, 10, 0.5), (2, 1, 20, 0.9)], "qid long, rank int, chunk_id long, score double")
    wide = spark.createDataFrame([(1, 1, 10, 0.5), (1, 2, 11, 0.5), (2, 1, 20, 0.9)], "qid long, rank int, chunk_id long, score double")

    def score(rows):
        p = F.when(F.col("qid") == 2, 0.9).otherwise(0.2)
        return rows.withColumns({"p_correct": p, "p_ambiguous": 1 - p, "p_wrong": F.lit(0.0)})

    graded, trace = grading.corrective_round(asked, first, wide, score)
    assert {r.qid: (r.rounds, r.corrective_fired, r.action) for r in trace.collect()} == {1: (2, True, "corrective_retrieve"), 2: (1, False, "proceed")}
    kept = grading.kept_context(graded, trace).orderBy("qid", "passage_no").collect()
    assert [(r.qid, r.chunk_id) for r in kept] == [(1, 10), (1, 11), (2, 20)]


def test_kept_order(spark):
    graded = spark.createDataFrame([(1, "A::0", "ambiguous", 0.9, 1), (1, "B::0", "correct", 0.6, 2), (1, "C::0", "wrong", 0.9, 3)], "qid long, chunk_id string, label string, confidence double, pos int")
    trace = spark.createDataFrame([(1, "proceed")], "qid long, action string")
    assert [r.chunk_id for r in grading.kept_context(graded, trace).orderBy("passage_no").collect()] == ["B::0", "A::0"]


def test_weak_labels(spark):
    rows = spark.createDataFrame([("Ada", "She was a politician"), ("Ada", "nothing here"), ("Bob", "a politician")], "doc_id string, text string")
    label = grading.weak_label(F.col("text"), F.col("doc_id"), F.array(F.lit("Ada")), F.array(F.lit("Politician"), F.lit("The")))
    assert [r[0] for r in rows.select(label).collect()] == ["correct", "ambiguous", "wrong"]


def _context(spark, n=3):
    return spark.createDataFrame([("q", i + 1, f"Doc::{i}", t) for i, t in enumerate(["alpha beta gamma", "delta epsilon", "zeta"][:n])], "qid string, passage_no int, chunk_id string, text string")


def test_citation_validation(spark):
    raw = spark.createDataFrame([("q", i, r) for i, r in enumerate(["Alpha beta [2].", "Nothing [9].", "Zero [0].", "None at all.", "Both [1, 9]."])], "qid string, sent_idx int, raw string")
    parsed = drafting.parse(raw)
    cites = drafting.resolve(parsed, _context(spark))
    got = drafting.citation_stats(parsed, cites).first()
    assert (got.sentences, got.with_citation, got.with_valid_citation, got.invalid_ids, got.sentences_with_invalid_id) == (5, 4, 2, 3, 3)
    assert drafting.citation_rates(drafting.citation_stats(parsed.limit(0), cites.limit(0))).first().parseable_rate == 0.0
    listed = {r.sent_idx: r.citation_ids for r in drafting.cited_sentences(parsed, cites).collect()}
    assert listed[0] == ["Doc::1"] and listed[1] == [] and listed[4] == ["Doc::0"]


def test_structured_payload(spark):
    rows = spark.createDataFrame([("q", 'Here: {"sentences": [{"text": "A [2]", "citations": [1]}, {"text": " ", "citations": [1]}]}'), ("r", "plain text")], "qid string, raw_text string")
    got = drafting.parse_payload(rows).collect()
    assert [(r.qid, r.text, r.numbers) for r in got] == [("q", "A", [1, 2])]
    assert [r[0] for r in rows.select(drafting.is_structured()).collect()] == [True, False]


def test_attempts(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, False), ("b", 4, True)], "qid string, attempt int, parses boolean")
    assert {r.qid: r.attempt for r in drafting.first_parseable(rows).collect()} == {"a": 2, "b": 2}


def _verdicts(spark, s=Settings()):
    parsed = drafting.parse(spark.createDataFrame([("q", 0, "Alpha beta [1]."), ("q", 1, "Omega psi [2]."), ("q", 2, "Uncited claim."), ("q", 3, "Alpha delta [1][2].")], "qid string, sent_idx int, raw string"))
    context = _context(spark)
    return verification.verify(parsed, drafting.resolve(parsed, context), context, s)


def test_verification(spark):
    got = {r.sent_idx: r for r in _verdicts(spark).collect()}
    assert got[0].supported and got[0].supporting_chunk_id == "Doc::0" and got[0].nli_label == "entailment"
    assert not got[1].supported and got[1].nli_label == "contradiction"
    assert got[2].uncited and got[2].entailment_score == 0.0
    assert got[3].entailment_score == 1.0 and got[3].n_scored == 2
    assert {r.sent_idx: r.entailment_score for r in _verdicts(spark, Settings(policy="any")).collect()}[3] == 0.5
    pr = verification.citation_precision_recall(_verdicts(spark)).first()
    assert (pr.recall, pr.precision) == (2 / 3, 3 / 4)
    none = verification.citation_precision_recall(_verdicts(spark).limit(0)).first()
    assert none.recall is None and none.precision is None
    assert verification.hallucination_rate(_verdicts(spark).limit(0)).first().hallucination_rate is None
    assert verification.labeled_hallucination_rate(spark.createDataFrame([], "label string")).first().rate is None


PATTERNS = [(True, True, True), (True, True, False), (True, False, True, True), (False, True, True), (False, False, True)]


def test_no_unverified_sentence_reaches_an_answer(spark):
    """All patterns of support, repair outcome and second check."""
    rows, repairs, drafts = [], [], []
    for k, (flags, outcome, recheck) in enumerate(itertools.product(PATTERNS, ("repaired", "unrepairable"), (True, False))):
        drafts.append((k, "raw", False))
        for i, ok in enumerate(flags):
            rows.append((k, i, f"Sentence number {i} of the draft.", ["d::0"], ok, False, 0.9 if ok else 0.05))
            repairs.append((k, i, f"Repaired number {i} of the draft." if outcome == "repaired" else None, 0.7, recheck))
    both = spark.createDataFrame(rows, "qid long, sent_idx int, text string, citation_ids array<string>, supported boolean, uncited boolean, entailment_score double")
    new = spark.createDataFrame(repairs, "qid long, sent_idx int, new_text string, new_score double, recheck_supported boolean")
    outcomes = repair.sentence_outcomes(both, both.select("qid", "sent_idx", "supported", "uncited", "entailment_score"), new)
    bad = outcomes.where(F.col("status").isin("kept", "repaired")).join(both.select("qid", "sent_idx", "supported"), ["qid", "sent_idx"]).join(new, ["qid", "sent_idx"])
    assert bad.where("status = 'kept' AND NOT supported OR status = 'repaired' AND NOT (recheck_supported AND new_text IS NOT NULL)").count() == 0
    final = repair.answers(spark.createDataFrame(drafts, "qid long, raw_text string, gen_abstained boolean"), outcomes).collect()
    assert len(final) == 20
    for r in final:
        mostly_bad = sum(PATTERNS[r.qid // 4]) * 2 < len(PATTERNS[r.qid // 4])
        assert r.abstained == mostly_bad and (r.abstain_reason == "too_much_unsupported") == mostly_bad


def test_abstain_order(spark):
    drafts = spark.createDataFrame([(1, "GENERATION FAILED: x", False), (2, "t", True), (3, "t", False), (4, "t", False)], "qid long, raw_text string, gen_abstained boolean")
    outcomes = spark.createDataFrame([(1, 0, "kept", "A long enough sentence.", 0.9, ["c"]), (2, 0, "kept", "A long enough sentence.", 0.9, ["c"]), (4, 0, "kept", "Short.", 0.9, ["c"])], "qid long, sent_idx int, status string, text string, score double, citation_ids array<string>")
    got = {r.qid: r.abstain_reason for r in repair.answers(drafts, outcomes).collect()}
    assert got == {1: "generation_failed", 2: "generator_abstained", 3: "nothing_survived", 4: "fragment_after_drops"}
    assert repair.explained(repair.answers(drafts, outcomes)).where("qid = 3").first().abstain_explanation == ABSTAIN_REASONS["nothing_survived"]


def test_splits_never_straddle(spark):
    rows = spark.createDataFrame([(f"q{i % 50}", i) for i in range(200)], "qid string, n int")
    got = harness.split_questions(rows)
    assert got.count() == 200 and got.groupBy("qid").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert {r.split: r.n for r in got.groupBy("split").agg(F.count_distinct("qid").alias("n")).collect()} == {"train": 35, "val": 5, "test": 10}
    split = harness.carve_splits(rows.select("qid"), 5, 10, 8)
    found, missing = harness.load_split(split.where("split = 'dev'"), rows.select("qid").distinct().where("qid <> 'x'"), 3)
    assert found.count() == 3 and missing.count() == 0


def test_swapped_negatives_come_from_other_questions(spark):
    sentences = spark.createDataFrame([(f"q{i}", 0) for i in range(30)], "qid string, sent_idx int")
    passages = spark.createDataFrame([(f"q{i}", f"d::{i}") for i in range(30)], "qid string, chunk_id string")
    got = harness.swap_negatives(sentences, passages)
    assert got.count() == 30 and got.where("qid = other_qid").count() == 0


def drawn(qid, idx, draw, n):
    return int(hashlib.md5(f"{qid}:{idx}:{draw}:42".encode()).hexdigest()[:15], 16) % n


def test_swapped_negatives_are_the_first_draws_of_another_question(spark, monkeypatch):
    monkeypatch.setattr(harness, "IN_TASK", 20)
    asked = [(f"q{i % 3}", i // 3) for i in range(90)] + [("q0", 0)] * 5
    pool = [(f"q{min(i % 10, 2)}", f"d::{i}") for i in range(60)]
    listed = sorted(pool, key=lambda x: hashlib.md5(f"{x[0]}/{x[1]}:42".encode()).hexdigest())
    want = {(q, i): next((listed[p] for d in range(3) if listed[p := drawn(q, i, d, len(listed))][0] != q), None) for q, i in asked}
    sentences, passages = spark.createDataFrame(asked, "qid string, sent_idx int"), spark.createDataFrame(pool, "qid string, chunk_id string")
    got = harness.swap_negatives(sentences, passages, draws=3).collect()
    assert len(got) == len({(r.qid, r.sent_idx) for r in got})
    assert {(r.qid, r.sent_idx): (r.other_qid, r.chunk_id) for r in got} == {k: v for k, v in want.items() if v} and None in want.values()
    assert harness.swap_negatives(sentences, passages.where("qid = 'q0'")).where("qid = 'q0'").count() == 0
    assert harness.swap_negatives(sentences, passages.limit(0)).count() == 0


def test_swapped_negatives_shuffle_a_sentence_once(spark):
    """Not with all its draws: 20 of them to a sentence made tasks that grew with the table."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}

    sentences = spark.range(4000).selectExpr("concat('q', id % 400) AS qid", "cast(id div 400 AS int) AS sent_idx")
    passages = spark.range(800).selectExpr("concat('q', id % 400) AS qid", "concat('d::', id) AS chunk_id")
    spark.range(1).collect()
    last = max(written())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(harness.swap_negatives(sentences, passages).collect()) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 4000 <= sum(n for k, n in written().items() if k > last) < 4 * 4000
