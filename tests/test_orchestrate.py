"""All stages together, with stand-ins and with scripted ones."""

import itertools

from pyspark.sql import functions as F

from groundspark.operators import models, orchestrate, retrieval
from groundspark.settings import CHUNK_LABELS

TEXTS = {
    "d::0": "Ada Lovelace wrote the first published algorithm for a machine. She lived in London.",
    "d::1": "Mount Everest is the highest mountain above sea level. It is in the Himalayas.",
    "d::2": "Photosynthesis turns light into chemical energy. Plants do it.",
}


def tables(spark):
    index = retrieval.hashed_vectors(spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string"))
    asked = spark.createDataFrame([("a", "Who wrote the first published algorithm?"), ("b", "quantum chromodynamics lattice?")], "qid string, question string")
    return retrieval.hashed_vectors(asked, "question"), index


def test_answers_under_all_flags(spark):
    asked, index = tables(spark)
    for flags in itertools.product((False, True), repeat=4):
        got = {r.qid: r for r in orchestrate.answer(asked, index, orchestrate.Flags(*flags)).collect()}
        assert set(got) == {"a", "b"}
        if flags[0]:
            assert got["b"].abstained and got["b"].abstain_reason == "no_usable_chunk" and got["b"].text is None
        if flags[2] and flags[3] and not flags[1]:
            assert got["a"].abstained  # plain drafts cite nothing, so nothing of them is supported
        elif flags[0]:
            assert "algorithm" in got["a"].text and "[" not in got["a"].text


def test_faithfulness(spark):
    answers = spark.createDataFrame([("a", "Ada wrote the algorithm. Bananas swim.", False), ("b", None, True)], "qid string, text string, abstained boolean")
    context = spark.createDataFrame([("a", 1, "Ada Lovelace wrote the first algorithm")], "qid string, passage_no int, text string")
    got = {r.qid: r.faithfulness for r in models.lexical_faithfulness(answers, context).collect()}
    assert got == {"a": 0.5, "b": None}


def test_ingest_reports_and_replaces(spark):
    files = [(1, 0, "a.txt", b"first text"), (1, 1, "a.md", b"second text"), (1, 2, "b.zip", b"x"), (1, 3, "c.txt", b""), (1, 4, "d.txt", b"  ")]
    statuses, index = orchestrate.ingest(spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in files], "request_id long, pos long, filename string, content binary"))
    got = {r.filename: (r.status, r.n_chunks) for r in statuses.collect()}
    assert got == {"a.txt": ("indexed", 0), "a.md": ("indexed", 1), "b.zip": ("failed", 0), "c.txt": ("skipped", 0), "d.txt": ("indexed", 0)}
    assert [r.text for r in index.collect()] == ["second text"]
    again = spark.createDataFrame([(2, 0, "a.txt", bytearray(b"third"))], "request_id long, pos long, filename string, content binary")
    assert [r.text for r in orchestrate.ingest(again, index)[1].collect()] == ["third"]


def test_grader_learns_its_classes(spark):
    rows = [("who is ada", "ada was a writer", "correct"), ("who is ada", "bob sells boats", "wrong"), ("who is ada", "ada ate", "ambiguous")] * 10
    pairs = spark.createDataFrame(rows, "question string, text string, label string")
    model = models.train_grader(pairs, 256)
    assert model.stages[-1].numClasses == len(CHUNK_LABELS)


def test_lexical_grader_shape(spark):
    row = models.lexical_grader(spark.createDataFrame([("who is ada", "ada")], "question string, text string")).first()
    assert abs(row.p_correct + row.p_wrong + row.p_ambiguous - 1) < 1e-9


def test_nothing_is_broadcast_by_hand_in_retrieval(spark):
    asked, index = tables(spark)
    plan = retrieval.nearest(asked, index, 2).select(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()
