"""Sparse retrieval against a plain sum, and the variants of answering over shared stages."""

import math
import random
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundspark.functions.text import STOPWORDS
from groundspark.kept import Kept
from groundspark.operators import harness, models, orchestrate, retrieval, sparse
from groundspark.plans import answering

WORDS = [f"w{k}" for k in range(60)] + ["Common", "common", "the", "näive"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(f"c{k}", " ".join(rng.choices(WORDS, weights=[1 / (1 + j % 20) for j in range(60)] + [8, 8, 8, 1], k=rng.randint(0, 40)))) for k in range(n)] + [("empty", ""), ("null", None)]


def plain_words(text):
    return [w for w in (text or "").lower().replace("ä", "a").split() if w not in STOPWORDS]


def plain_search(chunks, questions, k):
    counts = {c: Counter(plain_words(t)) for c, t in chunks}
    total, mean = len(chunks), sum(sum(c.values()) for c in counts.values()) / len(chunks)
    frequency = Counter(w for c in counts.values() for w in c)
    rare = {w: math.floor(10_000.0 * math.log((total - d + 0.5) / (d + 0.5) + 1.0)) for w, d in frequency.items()}
    out = []
    for q, text in questions:
        scores = Counter()
        for w in set(plain_words(text)):
            for c, own in counts.items():
                if own[w]:
                    scores[c] += math.floor(rare[w] * (own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * sum(own.values()) / mean))) * 100.0)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, c, s) for r, (c, s) in enumerate(best)]
    return sorted(out)


def test_sparse_search_is_exact(spark):
    chunks = corpus(200)
    rng = random.Random(2)
    asked = [(q, " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))) for q in range(30)] + [(100, "nothing of it"), (101, ""), (102, None), (103, "common common"), (104, chunks[3][1])]
    kept = Kept(spark)
    index = sparse.fit(spark.createDataFrame(chunks, "chunk_id string, text string"), kept)
    got = sparse.nearest(spark.createDataFrame(asked, "qid long, question string"), index, kept, 7)
    assert sorted(map(tuple, got.collect())) == plain_search(chunks, asked, 7)
    kept.drop()


@pytest.mark.parametrize("limits", [{}, {"HELD": 3, "AT_ONCE": 40}, {"MOST_ASKED": 10}])
def test_search_of_few_questions_is_exact_and_writes_no_lists(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(sparse, name, value)
    chunks = corpus(200) + [(f"t{k}", "näive w1") for k in range(20)]  # ties
    rng = random.Random(2)
    asked = [(q, " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))) for q in range(30)] + [(100, "nothing of it"), (101, ""), (102, None), (103, "common common"), (104, "naive")]
    kept = Kept(spark)
    got = sparse.search(spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3), kept, 7)
    assert sorted(map(tuple, got.collect())) == plain_search(chunks, asked, 7)
    tables = [spark.read.parquet(f"{kept.root}/{k}") for k in range(1, kept.n + 1)]
    assert any("impact" in t.columns for t in tables) == ("MOST_ASKED" in limits)
    everywhere = [(f"c{k}", "common") for k in range(6_000)]
    got = sparse.search(spark.createDataFrame([(None, "common")], "qid long, question string"), spark.createDataFrame(everywhere, "chunk_id string, text string"), kept, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == [(None, 1, "c0", 0), (None, 2, "c1", 0), (None, 3, "c10", 0)]
    none = spark.createDataFrame([], "chunk_id string, text string")
    few = spark.createDataFrame(asked, "qid long, question string")
    assert sparse.search(few, none, kept).count() == 0
    assert sparse.search(few.limit(0), spark.createDataFrame(chunks, none.schema), kept).count() == 0
    kept.drop()


def test_sparse_search_of_nothing(spark):
    kept = Kept(spark)
    none = spark.createDataFrame([], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "word")], "qid long, question string")
    assert sparse.nearest(asked, sparse.fit(none, kept), kept).count() == 0
    assert sparse.nearest(asked.limit(0), sparse.fit(spark.createDataFrame([("a", "word")], none.schema), kept), kept).count() == 0


def test_lists_of_weak_words_are_not_joined_as_a_whole(spark):
    """A word that every chunk has can't decide, so it is looked up only for chunks that other words bring."""
    chunks = [(f"c{k}", "common rare" if k < 8 else f"common word{k}") for k in range(400)]
    kept = Kept(spark)
    index = sparse.fit(spark.createDataFrame(chunks, "chunk_id string, text string"), kept)
    made = sparse.nearest(spark.createDataFrame([(1, "common rare")], "qid long, question string"), index, kept, 5)
    assert [r.chunk_id for r in made.orderBy("rank").collect()] == ["c0", "c1", "c2", "c3", "c4"]
    tables = [spark.read.parquet(f"{kept.root}/{k}") for k in range(1, kept.n + 1)]
    weak = next(t for t in tables if "weak" in t.columns)
    assert {r.word: r.weak for r in weak.collect()} == {"common": True, "rare": False}
    alive = tables[-1]
    assert alive.count() == 8


@pytest.fixture(scope="module")
def runs(spark):
    texts = {"d::0": "Ada Lovelace wrote the first published algorithm for a machine! She lived in London.", "d::1": "Mount Everest is the highest mountain above sea level. It is in the Himalayas.", "d::2": "Plants turn light into chemical energy by photosynthesis. They do so by day.", "d::3": "Machines run an algorithm."}
    index = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    asked = spark.createDataFrame([("a", "Who wrote the first published algorithm for a machine"), ("b", "quantum chromodynamics lattice"), ("c", "highest mountain above sea level photosynthesis")], "qid string, question string")
    kept = Kept(spark)
    fitted = sparse.fit(index, kept)
    calls = Counter()

    def counted(name, f):
        def run(*args):
            calls[name] += 1
            return f(*args)

        return run

    def wrong_citations(context):
        """The second passage's sentence is said to be from the first."""
        return answering.careless(context).withColumn("raw_text", F.replace("raw_text", F.lit("[2]"), F.lit("[1]")))

    use = orchestrate.Models(grade=counted("grade", models.lexical_grader), draft=counted("draft", wrong_citations), plain=counted("plain", models.plain_generator), repair=counted("repair", models.extractive_repair), retrieve=counted("retrieve", lambda q, i, k: sparse.nearest(q, fitted, kept, k)))
    return orchestrate.Runs(asked, index, use), calls


def test_variants_share_their_stages_and_differ_by_their_flags(spark, runs):
    own, calls = runs
    golds = spark.createDataFrame([("a", ["first published"]), ("b", ["x"]), ("c", ["everest"])], "qid string, answers array<string>")
    rows = harness.run_variants(own, golds).collect()
    by = {(r.variant, r.qid): r for r in rows}
    assert len(by) == len(rows) == 15
    assert calls["retrieve"] == 1 and calls["draft"] == 1 and calls["plain"] == 2 and calls["repair"] == 1 and calls["grade"] == 2
    assert all(by[v, "b"].abstained for v in "BCDE") and by["B", "b"].abstain_reason == "no_usable_chunk" and by["B", "b"].cost_usd == 0
    assert by["C", "a"].text == by["D", "a"].text and "[1]" in by["C", "a"].text and "[" not in by["B", "a"].text
    for v in "ABCDE":
        r = by[v, "a"]
        assert (r.sentences > 0) == (v in "CDE") and (r.scored > 0) == (v in "DE") and (r.supported <= r.scored) and (r.cost_usd > 0)
    table = {r.variant: r for r in harness.ablation_table(harness.run_variants(own, golds)).collect()}
    assert set(table) == set("ABCDE") and table["A"].citation_recall is None and table["C"].citation_precision is None
    assert table["D"].citation_recall is not None and table["C"].parseable_citation_rate is not None and table["B"].parseable_citation_rate is None
    assert calls["draft"] == 1 and table["E"].n == 3


def test_counters_equal_the_tables_they_come_from(spark, runs):
    own, _ = runs
    flags = orchestrate.Flags()
    got = {r.qid: r for r in own.counters(flags).collect()}
    verdicts = own.verdicts(True, True).collect()
    for q, r in got.items():
        mine = [v for v in verdicts if v.qid == q and not v.uncited]
        assert r.scored == len(mine) and r.supported == sum(v.supported for v in mine) and r.citations == sum(len(v.scores) for v in mine)
        assert r.good_citations == sum(s >= 0.2 for v in mine for s in v.scores.values())
    failed = {(v.qid, v.sent_idx) for v in verdicts if not v.supported and not v.uncited}
    assert {(r.qid, r.sent_idx) for r in own.repairs(True, True).collect()} == failed


def test_stand_ins_are_never_silent(spark):
    index = retrieval.hashed_vectors(spark.createDataFrame([("a", "some text")], "chunk_id string, text string"))
    asked = retrieval.hashed_vectors(spark.createDataFrame([("q", "text")], "qid string, question string"), "question")
    with pytest.warns(UserWarning, match="stand-ins"):
        orchestrate.answer(asked, index)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        orchestrate.answer(asked, index, use=orchestrate.Models())


# -- calls that fail


def scripted(script):
    """``script``: (qid, attempt) to (code, raw); a structured request is told by its own key."""

    def call(requests):
        spark = requests.sparkSession
        rows = [(q, a, s, c, r) for (q, a, s), (c, r) in script.items()]
        told = spark.createDataFrame(rows, "qid string, attempt int, structured boolean, code int, raw string")
        return requests.join(told, ["qid", "attempt", "structured"], "left")

    return call


GOOD = '{"sentences": [{"text": "A claim.", "citations": [1]}]}'


def test_attempts_are_bounded_and_only_for_what_failed(spark):
    from groundspark.operators import attempts

    script = {
        ("fine", 1, True): (200, GOOD), ("limit", 1, True): (429, None), ("limit", 2, True): (200, GOOD),
        ("broken", 1, True): (200, "no json"), ("broken", 2, False): (200, "A claim [1]."), ("schema", 1, True): (422, None), ("schema", 2, False): (503, None), ("schema", 3, False): (200, "Text."),
        ("down", 1, True): (500, None), ("down", 2, True): (None, None), ("down", 3, True): (529, None), ("gone", 1, True): (404, None), ("refused", 1, True): (400, None), ("refused", 2, False): (400, None),
        ("empty", 1, True): (200, '{"sentences": []}'), ("other", 1, True): (200, '{"answer": 1}'), ("other", 2, False): (200, ""), ("fenced", 1, True): (200, f"```json\\n{GOOD}\\n```"),
    }
    seen = []

    def call(requests):
        seen.append(requests.select("qid").collect())
        return scripted(script)(requests)

    asked = spark.createDataFrame([(q,) for q in sorted({k[0] for k in script})], "qid string")
    got = {r.qid: r for r in attempts.generate(asked, call, Kept(spark)).collect()}
    assert [len(s) for s in seen] == [10, 6, 2] and len(got) == 10
    short = {q: (r.path, r.attempts, r.last_error, r.error) for q, r in got.items()}
    assert short == {
        "fine": ("structured", 1, None, None), "limit": ("structured", 2, "rate_limited", None), "broken": ("text", 2, "unparseable_structured_output", None), "schema": ("text", 3, "server_error_503", None),
        "down": (None, 3, "server_error_529", None), "gone": (None, 1, None, "model not found"), "refused": (None, 2, "structured_rejected_400", "rejected_400"),
        "empty": ("structured", 1, None, None), "other": ("text", 2, "unparseable_structured_output", None), "fenced": ("structured", 1, None, None),
    }
    assert got["down"].raw_text == "GENERATION FAILED: server_error_529" and got["gone"].raw_text is None and got["other"].raw_text == ""
    total = attempts.attempt_totals(attempts.generate(asked, scripted(script), Kept(spark))).first()
    assert (total.calls, total.retries, total.structured, total.fallback, total.failed, total.errors) == (18, 8, 4, 3, 1, 2)
    assert attempts.generate(asked.limit(0), scripted(script), Kept(spark)).count() == 0


def test_outcomes_of_repairs(spark):
    from groundspark.operators import attempts, repair

    replies = {
        0: (200, '{"repairable": true, "text": "Fixed claim [2].", "citations": [1]}'), 1: (200, '{"repairable": false, "text": "x", "citations": [1]}'), 2: (200, '{"repairable": true, "text": "  ", "citations": [1]}'),
        3: (200, '{"repairable": true, "text": "No source.", "citations": [7]}'), 4: (200, '{"repairable": true, "text": "None at all."}'), 5: (200, "broken"), 6: (429, None), 7: (502, None), 8: (None, None), 9: (404, None), 10: (200, "null"),
    }
    failed = spark.createDataFrame([("q", k, "old") for k in replies], "qid string, sent_idx int, text string")
    context = spark.createDataFrame([("q", 1, "c::1"), ("q", 2, "c::2")], "qid string, passage_no int, chunk_id string")
    told = spark.createDataFrame([(k, c, r) for k, (c, r) in replies.items()], "sent_idx int, code int, raw string")
    made = attempts.regenerate(failed, context, lambda rows: rows.join(told, "sent_idx"), Kept(spark))
    got = {r.sent_idx: r for r in made.collect()}
    assert {k: r.outcome for k, r in got.items()} == {0: "repaired", 1: "unrepairable", 2: "unrepairable", 3: "repaired_but_uncited", 4: "repaired_but_uncited", 5: "unparseable_repair_output", 6: "rate_limited", 7: "server_error_502", 8: "connection_error", 9: "error", 10: "unrepairable"}
    assert (got[0].new_text, got[0].citation_ids) == ("Fixed claim.", ["c::1", "c::2"]) and all(r.new_text is None and r.citation_ids == [] for k, r in got.items() if k)
    repairs = attempts.rechecked(made, F.lit(0.6))
    sentences = failed.withColumn("citation_ids", F.array(F.lit("c::1")))
    verdicts = failed.select("qid", "sent_idx", F.lit(False).alias("supported"), F.lit(False).alias("uncited"), F.lit(0.1).alias("entailment_score"))
    assert {r.sent_idx: r.status for r in repair.sentence_outcomes(sentences, verdicts, repairs).collect()} == {k: "repaired" if k == 0 else "dropped" for k in replies}


# -- weak labels by alias, graders by selection


def test_subjects_are_found_by_their_aliases(spark):
    from groundspark.operators import grading

    chunks = spark.createDataFrame([("c1", "Ada_Lovelace", "She was a Mathematician."), ("c2", "Ada_Lovelace", "She lived."), ("c3", "Babbage", "A mathematician."), ("c4", "Ada_Lovelace", None)], "chunk_id string, doc_id string, text string")
    asked = spark.createDataFrame([(1, ["Ada Lovelace"], ["mathematician"]), (2, ["Countess of Lovelace", None], ["the mathematician!"]), (3, ["Nobody", ""], ["mathematician"]), (4, ["Ada Lovelace"], ["", "the"]), (5, None, None)], "qid int, subjects array<string>, answers array<string>")
    aliases = spark.createDataFrame([("Countess of Lovelace", "Ada_Lovelace"), ("Countess of Lovelace", "Babbage"), ("Other", "Babbage")], "title string, doc_id string")
    hits = spark.createDataFrame([(q, c) for q in range(1, 6) for c in ("c1", "c2", "c3", "c4")], "qid int, chunk_id string")
    label = lambda al: {(r.qid, r.chunk_id): r.label[0] for r in grading.weak_labels(hits, asked, chunks, al).collect()}
    show = lambda got, q: "".join(got[q, c] for c in ("c1", "c2", "c3", "c4"))
    with_, without = label(aliases), label(None)
    assert [show(with_, q) for q in range(1, 6)] == ["cawa", "caca", "wwww", "aawa", "wwww"]
    assert [show(without, q) for q in range(1, 6)] == ["cawa", "wwww", "wwww", "aawa", "wwww"]


def test_the_grader_of_the_best_macro_f1_is_chosen(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for q in range(60):
        split = "train" if q < 40 else "val" if q < 50 else "test"
        for label, text in (("correct", f"name{q} is a gold fact"), ("ambiguous", f"name{q} lived somewhere"), ("wrong", f"boat {rng.randint(0, 9)} sails on")):
            rows += [(f"who is name{q}", text, label, split)] * (3 if label == "wrong" else 1)
    pairs = spark.createDataFrame(rows, "question string, text string, label string, split string")
    model, history = models.select_grader(pairs, (5.0, 0.01), 1 << 10)
    best = max(history, key=lambda h: h["macro_f1"])
    assert [h["strength"] for h in history] == [5.0, 0.01] and best["n"] == 50 and best["macro_f1"] > 0.9
    assert model.stages[-1].getRegParam() == best["strength"]
    model.write().save(str(tmp_path / "grader"))
    val = pairs.where("split = 'val'")
    loaded = {(r.question, r.text): r for r in models.load_grader(str(tmp_path / "grader"))(val).collect()}
    own = {(r.question, r.text): r for r in models.graded_by(model)(val).collect()}
    assert own == loaded and all(abs(r.p_correct + r.p_ambiguous + r.p_wrong - 1) < 1e-9 for r in own.values())
    with pytest.raises(models.MissingModel):
        models.load_grader(str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="more than one split"):
        models.select_grader(pairs.unionByName(pairs.limit(1).withColumn("split", F.lit("test"))))


def test_every_sentence_has_one_verdict(spark):
    from groundspark.operators import drafting, verification

    sentences = spark.createDataFrame([("q", k) for k in range(4)], "qid string, sent_idx int")
    verdicts = spark.createDataFrame([("q", 0), ("q", 1), ("q", 1), ("q", 3), ("q", 9)], "qid string, sent_idx int").withColumns({"supported": F.lit(True), "uncited": F.lit(False), "n_scored": F.lit(1), "nli_label": F.lit("neutral")})
    assert sorted((r.sent_idx, r.n) for r in verification.not_one_verdict(sentences, verdicts).collect()) == [(1, 2), (2, 0), (9, 1)]
    with pytest.raises(ValueError, match="instead of one"):
        verification.checked_rollup(sentences, verdicts)
    assert verification.checked_rollup(sentences.where("sent_idx IN (0, 3)"), verdicts.where("sent_idx IN (0, 3)")).first().sentences == 2

    failed = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")], "qid string, sent_idx int, text string")
    asked = spark.createDataFrame([("a", "Q"), ("b", "Q")], "qid string, question string")
    context = lambda ids, text="t": spark.createDataFrame([(q, 1, f"{ids}{q}", text) for q in "ab"], "qid string, passage_no int, chunk_id string, text string")
    keys = lambda c, model="m": {(r.qid, r.sent_idx): r.key for r in drafting.repair_keys(failed, asked, c, model).collect()}
    one = keys(context("c"))
    assert one == keys(context("other")) and one["a", 0] == one["b", 0] != one["a", 1]
    assert not set(one.values()) & set(keys(context("c"), "another").values()) and not set(one.values()) & set(keys(context("c", "u")).values())
    base = spark.range(1).select(*[drafting.draft_key(F.lit("Q"), F.array(F.lit("t")), *x).alias(f"k{i}") for i, x in enumerate([("m", "low", "p"), ("m", "high", "p"), ("m", "low", "other"), ("n", "low", "p")])]).first()
    assert len(set(base)) == 4


def test_weak_labels_move_texts_through_one_join(spark):
    """Texts meet only the pairs on a subject's page; rows that repeat a chunk id are judged by their own text."""
    from groundspark.operators import grading

    hits = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "qid string, chunk_id string")
    asked = spark.createDataFrame([("q", ["My page"], ["gold"])], "qid string, subjects array<string>, answers array<string>")
    chunks = spark.createDataFrame([("a", "My_page", "some gold"), ("a", "My_page", "none"), ("b", "My_page", None), ("c", "Other", "gold")], "chunk_id string, doc_id string, text string")
    made = grading.weak_labels(hits, asked, chunks)
    assert sorted((r.chunk_id, r.label) for r in made.collect()) == [("a", "ambiguous"), ("a", "correct"), ("b", "ambiguous"), ("c", "wrong")]

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    moved = [n for n in nodes(made._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join" and "text#" in n.output().mkString(",")]
    assert len(moved) == 1
