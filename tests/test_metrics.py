"""Metrics against published counts and tiny inputs."""

import pytest

from groundspark.operators import metrics
from groundspark.plans.catalogue import PUBLISHED, PUBLISHED_ACTIONS, published


def test_published_grading(spark):
    counts = published(spark, PUBLISHED)
    got = metrics.accuracy_and_macro_f1(counts).first()
    assert (round(got.accuracy, 4), round(got.macro_f1, 4), got.n) == (0.9197, 0.8011, 760)
    rows = {r.label: r for r in metrics.per_class(counts).collect()}
    assert [round(x, 4) for x in (rows["correct"].precision, rows["correct"].recall, rows["correct"].f1)] == [0.8392, 0.8219, 0.8304]
    assert [round(x, 4) for x in (rows["ambiguous"].precision, rows["ambiguous"].recall, rows["ambiguous"].f1)] == [0.5333, 0.6557, 0.5882]
    assert [round(x, 4) for x in (rows["wrong"].precision, rows["wrong"].recall, rows["wrong"].f1)] == [0.9945, 0.9747, 0.9845]


def test_published_actions(spark):
    got = metrics.majority(published(spark, PUBLISHED_ACTIONS)).first()
    assert (got.majority_class, round(got.majority_rate, 4), round(got.accuracy, 4), got.beats_majority) == ("Correct", 0.875, 0.8158, False)


def test_absent_class_counts_in_macro_f1(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "gold string, pred string")
    counts = metrics.confusion_counts(rows, ("a", "b", "c"))
    assert counts.count() == 9 and metrics.accuracy_and_macro_f1(counts).first().macro_f1 == pytest.approx((2 / 3 + 0 + 0) / 3)


def test_kappa(spark):
    rows = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "gold int, pred int")
    assert metrics.cohens_kappa(metrics.confusion_counts(rows, (0, 1))).first().kappa == pytest.approx(0.4)
    assert metrics.cohens_kappa(metrics.confusion_counts(rows.limit(0), (0, 1))).first().kappa == 0.0
    same = spark.createDataFrame([(1, 1)], "gold int, pred int")
    assert metrics.cohens_kappa(metrics.confusion_counts(same, (0, 1))).first().kappa == 0.0


def test_sweep(spark):
    rows = spark.createDataFrame([(0.2, True), (0.1, False), (0.3, False)], "score double, truth boolean")
    got = {r.threshold: r for r in metrics.threshold_sweep(rows, [0.2, 0.5]).collect()}
    assert (got[0.2].tp, got[0.2].missed_hallucinations, got[0.2].false_flags, got[0.2].tn) == (1, 1, 0, 1)
    assert got[0.5].precision == 0.0
    assert metrics.best_threshold(metrics.threshold_sweep(rows, [0.2, 0.5])).first().threshold == 0.2


def test_grid_has_25_points(spark):
    rows = spark.createDataFrame([("correct", 0.6, 0.2, 0.2)], "gold string, p_correct double, p_ambiguous double, p_wrong double")
    assert metrics.threshold_grid(rows, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [0.05, 0.1, 0.2, 0.3], ("correct", "ambiguous", "wrong")).count() == 25


def test_risk_coverage(spark):
    rows = spark.createDataFrame([(f"{i:02}", i >= 20, 0.5 if i < 10 else 0.9, i % 2 == 0) for i in range(25)], "qid string, abstained boolean, confidence double, correct boolean")
    got = {r.fraction: r for r in metrics.risk_coverage(rows, [0.1, 0.5, 1.0]).collect()}
    assert (got[0.1].n, got[0.5].n, got[1.0].n) == (2, 10, 20) and got[1.0].coverage == 0.8 and got[0.1].accuracy == 0.5
    assert metrics.risk_coverage(rows.where("abstained"), [0.1]).count() == 0


def test_gate(spark):
    b = spark.createDataFrame([("up", 0.9, 0.8, None, "higher_is_better"), ("down", 0.1, None, 0.2, "lower_is_better"), ("gone", 0.5, 0.4, None, "higher_is_better"), ("none", None, None, None, "higher_is_better"), ("sim", 0.5, 0.4, None, "higher_is_better")], "metric string, value double, min double, max double, direction string")
    o = spark.createDataFrame([("up", 0.8), ("down", 0.21)], "metric string, value double")
    got = {r.metric: r.status for r in metrics.regression_gate(b, o, {"sim": 0.1}, ("gone",)).collect()}
    assert got == {"up": "PASS", "down": "FAIL", "gone": "MISSING", "none": "SKIPPED", "sim": "FAIL"}
    assert {r.metric: r.status for r in metrics.regression_gate(b, o).collect()}["gone"] == "SKIPPED"


def test_grid_actions_equal_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for q in range(60):
        for _ in range(rng.randint(1, 4)):
            c = round(rng.random(), 3)
            w = round((1 - c) * rng.random(), 3)
            rows.append((q, rng.choice(["correct", "ambiguous", "wrong", "wrong"]), c, round(1 - c - w, 3), w))
    points = [(c, w) for c in (0.2, 0.5, 0.8) for w in (0.05, 0.2, 0.6) if w < c]

    def action(labels):
        return "go" if "correct" in labels else "stop" if set(labels) == {"wrong"} else "again"

    gold = {q: action([r[1] for r in rows if r[0] == q]) for q in range(60)}
    most = max(sum(g == a for g in gold.values()) for a in ("go", "stop", "again"))
    want = {}
    for c, w in points:
        label = lambda r, c=c, w=w: "correct" if r[2] >= c else "wrong" if r[2] <= w and r[4] >= r[3] else "ambiguous"
        right = sum(action([label(r) for r in rows if r[0] == q]) == gold[q] for q in range(60))
        want[c, w] = (sum(label(r) == r[1] for r in rows) / len(rows), right / 60, (right - most) / 60)
    df = spark.createDataFrame(rows, "qid long, gold string, p_correct double, p_ambiguous double, p_wrong double")
    grid = metrics.threshold_grid(df, [0.2, 0.5, 0.8], [0.05, 0.2, 0.6], ("correct", "ambiguous", "wrong"), "qid")
    got = {(r.correct_threshold, r.wrong_threshold): (r.accuracy, r.action_accuracy, r.vs_majority) for r in grid.collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-12 for p in want for a, b in zip(got[p], want[p], strict=True))
    best = {r.best_by: (r.correct_threshold, r.wrong_threshold) for r in metrics.best_points(grid).collect()}
    assert best["action_accuracy"] == max(want, key=lambda p: (want[p][1], -p[0], -p[1]))
