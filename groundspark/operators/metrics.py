"""Metrics over labels, scores and answers. Where nothing was measured the value is null, not 0, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.settings import ACTIONS


def confusion_counts(rows: DataFrame, classes: tuple, gold: str = "gold", pred: str = "pred", weight: Column | None = None) -> DataFrame:
    """gold, pred, n for all pairs of classes, zeros filled in. One pass; a row for each pair, however long the input."""
    w = F.lit(1) if weight is None else weight
    cells = [(g, p) for g in classes for p in classes]
    sums = rows.agg(*[F.coalesce(F.sum(F.when((F.col(gold) == g) & (F.col(pred) == p), w)), F.lit(0)).cast("long").alias(f"c{i}") for i, (g, p) in enumerate(cells)])
    listed = F.explode(F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred"), F.col(f"c{i}").alias("n")) for i, (g, p) in enumerate(cells)]))
    return sums.select(listed.alias("x")).select("x.gold", "x.pred", "x.n")


def confusion_matrix(counts: DataFrame, classes: tuple) -> DataFrame:
    """gold and one column for each predicted class."""
    return counts.groupBy("gold").agg(*[F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in classes])


def per_class(counts: DataFrame) -> DataFrame:
    """label, tp, support, precision, recall and f1, 0 on empty denominators."""
    halves = counts.select(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"))
    other = counts.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    sums = halves.unionByName(other).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    # 2 tp / (support + predicted) is the harmonic mean of both.
    return sums.select("label", "tp", "support", ratio("tp", "predicted").alias("precision"), ratio("tp", "support").alias("recall"), ratio(F.col("tp") * 2, F.col("support") + F.col("predicted")).alias("f1"))


def accuracy_and_macro_f1(counts: DataFrame) -> DataFrame:
    """n, accuracy and the unweighted mean of F1 over all classes, absent ones included."""
    f1 = per_class(counts).agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("support").alias("n"))
    return f1.select("n", F.try_divide("tp", "n").alias("accuracy"), "macro_f1")


def majority(counts: DataFrame) -> DataFrame:
    """The commonest gold class (ties to the smaller name), its share, and whether the predictions beat it."""
    own = counts.groupBy("gold").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    # Classes are few; the smaller name wins among equals.
    first = own.agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("gold"))).alias("top"), F.sum("n").alias("total"), F.sum("right").alias("right"))
    return first.select(F.col("top.gold").alias("majority_class"), F.try_divide(-F.col("top.minus"), "total").alias("majority_rate"), F.try_divide("right", "total").alias("accuracy"), (F.col("right") > -F.col("top.minus")).alias("beats_majority"))


def cohens_kappa(counts: DataFrame) -> DataFrame:
    """n, observed, expected, kappa: 0 without rows or where agreement by chance is certain."""
    a = counts.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("na"))
    b = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "label").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"), F.sum("na").alias("n"))
    same = counts.where("gold = pred").agg(F.sum("n").alias("same"))
    both = chance.withColumn("_", F.lit(1)).join(same.withColumn("_", F.lit(1)), "_")  # one row on each side
    observed, expected = F.coalesce(F.try_divide("same", "n"), F.lit(0.0)), F.coalesce(F.try_divide("products", F.col("n").cast("double") * F.col("n")), F.lit(1.0))
    return both.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected >= 1, F.lit(0.0)).otherwise((observed - expected) / (F.lit(1.0) - expected)).alias("kappa"))


def per_class_agreement(rows: DataFrame, classes: tuple, a: str = "a", b: str = "b") -> DataFrame:
    """For each class against the rest: n_a, n_b, n_both, jaccard (null if neither uses it) and binary kappa."""
    sums = rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for i, k in enumerate(classes) for n, c in ((f"a{i}", F.col(a) == k), (f"b{i}", F.col(b) == k), (f"x{i}", (F.col(a) == k) & (F.col(b) == k)))])
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"a{i}").alias("n_a"), F.col(f"b{i}").alias("n_b"), F.col(f"x{i}").alias("n_both")) for i, k in enumerate(classes)]))
    r = sums.select("n", listed.alias("x")).select("n", "x.*")
    n = F.col("n").cast("double")
    observed = F.coalesce(F.try_divide(n - F.col("n_a") - F.col("n_b") + 2 * F.col("n_both"), n), F.lit(0.0))
    expected = F.coalesce(F.try_divide(F.col("n_a") * F.col("n_b").cast("double") + (n - F.col("n_a")) * (n - F.col("n_b")), n * n), F.lit(1.0))
    return r.select("label", "n_a", "n_b", "n_both", F.try_divide("n_both", F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("jaccard"), F.when(expected >= 1, F.lit(0.0)).otherwise((observed - expected) / (F.lit(1.0) - expected)).alias("kappa"))


def threshold_sweep(rows: DataFrame, points: list[float]) -> DataFrame:
    """For each threshold the counts and rates of ``score >= threshold`` against ``truth``, in one pass over the rows."""
    hit = lambda t: F.col("score") >= F.lit(t)
    sums = rows.agg(*[F.count_if(c).alias(n) for i, t in enumerate(points) for n, c in ((f"tp{i}", hit(t) & F.col("truth")), (f"fp{i}", hit(t) & ~F.col("truth")), (f"fn{i}", ~hit(t) & F.col("truth")), (f"tn{i}", ~hit(t) & ~F.col("truth")))])
    listed = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(points)]))
    r = sums.select(listed.alias("x")).select("x.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return r.select("threshold", "tp", F.col("fp").alias("missed_hallucinations"), F.col("fn").alias("false_flags"), "tn", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the best F1, the first of equals."""
    return sweep.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def threshold_grid(rows: DataFrame, correct: list[float], wrong: list[float], classes: tuple, key: str | None = None) -> DataFrame:
    """For each pair with wrong < correct: accuracy and macro-F1 of the labels that probabilities get. ``rows``: gold and p_*.

    With the column ``key`` of questions also action_accuracy and vs_majority: how often a question's action out of its labels is
    the one out of its gold labels, and by how much that beats always taking the commonest. A row's labels at all points are two
    integers with a bit for each point; a question's actions are their bit_or and bit_and, so no point is a pass of its own.
    """
    grid = [(c, w) for c in correct for w in wrong if w < c]
    if len(grid) > 62:
        raise ValueError("at most 62 points fit the bits of an integer")
    is_correct = lambda c: F.col("p_correct") >= F.lit(c)
    is_wrong = lambda c, w: ~is_correct(c) & (F.col("p_correct") <= F.lit(w)) & (F.col("p_wrong") >= F.col("p_ambiguous"))
    bits = lambda conditions: reduce(Column.bitwiseOR, [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(conditions)])
    marked = rows.select("gold", *([key] if key else []), bits([is_correct(c) for c, _ in grid]).alias("hit"), bits([is_wrong(c, w) for c, w in grid]).alias("out"))
    # Rows with equal bits and gold are counted together first: there are few such patterns, and only they meet every point.
    patterns = marked.groupBy("gold", "hit", "out").agg(F.count("*").alias("n"))
    named = F.when(_bit("hit"), "correct").when(_bit("out"), "wrong").otherwise("ambiguous")
    each = patterns.withColumn("i", _points(grid)).select("i", "gold", named.alias("pred"), "n")
    k = range(len(classes))
    counts = each.groupBy("i").agg(*[F.coalesce(F.sum(F.when((F.col("gold") == g) & (F.col("pred") == p), F.col("n"))), F.lit(0)).alias(f"n{a}_{b}") for a, g in enumerate(classes) for b, p in enumerate(classes)])
    n = lambda a, b: F.col(f"n{a}_{b}")
    total = sum((n(a, b) for a in k for b in k), F.lit(0))
    f1 = [F.coalesce(F.try_divide(n(a, a) * 2, sum((n(a, b) + n(b, a) for b in k), F.lit(0))), F.lit(0.0)) for a in k]
    at = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in grid]), F.col("i") + 1)
    named_counts = counts.select("i", at(0).alias("correct_threshold"), at(1).alias("wrong_threshold"), F.try_divide(sum((n(a, a) for a in k), F.lit(0)), total).alias("accuracy"), (sum(f1[1:], f1[0]) / len(classes)).alias("macro_f1"))
    if key is None:
        return named_counts.drop("i")
    acted = _right_actions(marked, key, grid)
    out = named_counts.join(acted, "i").withColumns({"action_accuracy": F.try_divide("right", "questions"), "vs_majority": F.try_divide(F.col("right") - F.col("majority"), F.col("questions"))})
    return out.drop("i", "right", "questions", "majority")


def _points(grid: list) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))


def _bit(name: str) -> Column:
    """The bit of point i."""
    return F.call_function("getbit", F.col(name), F.col("i")) == 1


def _right_actions(marked: DataFrame, key: str, grid: list) -> DataFrame:
    """i, right, questions, majority: at each point the questions whose action is the gold one, all, and those of the commonest gold action."""
    own = marked.groupBy(key).agg(F.bit_or("hit").alias("any"), F.bit_and("out").alias("all"), F.max(F.col("gold") == "correct").alias("goes"), F.min(F.col("gold") == "wrong").alias("stops"))
    none = F.bitwise_not(F.col("any"))
    right = F.when(F.col("goes"), F.col("any")).when(F.col("stops"), none.bitwiseAND(F.col("all"))).otherwise(none.bitwiseAND(F.bitwise_not(F.col("all"))))
    patterns = own.groupBy(right.alias("bits"), F.when(F.col("goes"), 0).when(F.col("stops"), 1).otherwise(2).alias("gold")).agg(F.count("*").alias("n"))
    share = [F.coalesce(F.sum(F.when(F.col("gold") == g, F.col("n"))), F.lit(0)) for g in range(3)]
    return patterns.withColumn("i", _points(grid)).groupBy("i").agg(F.sum(F.when(_bit("bits"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("questions"), F.greatest(*share).alias("majority"))


def best_points(grid: DataFrame) -> DataFrame:
    """The grid points of the best action accuracy and of the best macro-F1, the first of equals, and whether the better one beats the majority."""
    first = lambda by: F.max_by(F.struct("correct_threshold", "wrong_threshold", "macro_f1", "action_accuracy", "vs_majority"), F.struct(by, -F.col("correct_threshold"), -F.col("wrong_threshold")))
    r = grid.agg(first("action_accuracy").alias("action"), first("macro_f1").alias("f1"))
    each = F.explode(F.array(F.struct(F.lit("action_accuracy").alias("best_by"), F.col("action").alias("x")), F.struct(F.lit("macro_f1").alias("best_by"), F.col("f1").alias("x"))))
    return r.select(each.alias("y")).select("y.best_by", "y.x.*").withColumn("beats_majority", F.col("vs_majority") > 0)


def separation(rows: DataFrame) -> DataFrame:
    """Means and exact medians of the scores of both kinds, and the difference of the means."""
    pick = lambda t: F.when(F.col("truth") == F.lit(t), F.col("score"))
    r = rows.agg(F.count_if("truth").alias("positives"), F.count_if(~F.col("truth")).alias("negatives"), F.avg(pick(True)).alias("mean_positive"), F.avg(pick(False)).alias("mean_negative"), F.median(pick(True)).alias("median_positive"), F.median(pick(False)).alias("median_negative"))
    return r.withColumn("separation", F.col("mean_positive") - F.col("mean_negative"))


#: Ranges of confidence that are summed up; the few that hold a cut are looked into.
STEPS = 4_096


def risk_coverage(rows: DataFrame, fractions: list[float]) -> DataFrame:
    """Accuracy of the most confident answers at ten coverages. ``rows``: qid, abstained, confidence, correct.

    Ranks come from sums over STEPS ranges of confidence; a cut's place inside its range is found there, so no task sorts
    all answers. Confidences outside 0 to 1 fall into the ranges at the ends. Ties in confidence go by qid.
    """
    step = F.least(F.greatest(F.floor(F.col("confidence") * STEPS), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    answered = rows.where("NOT abstained").select("qid", F.col("confidence").alias("c"), step.alias("step"), F.col("correct").cast("int").alias("right"))
    totals = rows.agg(F.count("*").alias("total"), F.count_if(~F.col("abstained")).alias("answered")).first()
    total, n = totals["total"], totals["answered"]
    cuts = [(f, max(1, int(n * f))) for f in fractions] if n else []
    # STEPS rows at most.
    upto = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    sums = answered.groupBy("step").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    placed = sums.select("step", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.coalesce(F.sum("right").over(upto), F.lit(0)).alias("right_before"))
    if not cuts:
        return placed.select(F.lit(0.0).alias("fraction"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("accuracy")).limit(0)
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(k).cast("long").alias("take")) for f, k in cuts]))
    at = placed.withColumn("g", grid).where((F.col("before") < F.col("g.take")) & (F.col("before") + F.col("n") >= F.col("g.take"))).select("step", "before", "right_before", "g.fraction", "g.take")
    in_order = Window.partitionBy("step").orderBy(F.desc("c"), "qid")
    inside = answered.join(F.broadcast(at.select("step").distinct()), "step", "left_semi").withColumn("place", F.row_number().over(in_order))
    got = at.join(inside, "step").where(F.col("place") <= F.col("take") - F.col("before")).groupBy("fraction", "take", "right_before").agg(F.sum("right").alias("right"))
    return got.select("fraction", F.col("take").alias("n"), (F.col("take") / F.lit(max(total, 1))).alias("coverage"), ((F.col("right") + F.col("right_before")) / F.col("take")).alias("accuracy"))


def baseline_row(rows: DataFrame) -> DataFrame:
    """One run's figures. ``rows``: correct, abstained, error, retrieval_hit, faithfulness (null where none was measured).

    Shares of no rows are 0, but a mean faithfulness of no rows is null.
    """
    answered = ~F.col("abstained") & F.col("error").isNull()
    total = rows.agg(
        F.count("*").alias("n"), F.count_if("correct").alias("right"), F.count_if(answered).alias("answered"), F.count_if(F.col("correct") & answered).alias("right_answered"), F.count_if("retrieval_hit").alias("hits"),
        F.avg("faithfulness").alias("faithfulness"), F.count("faithfulness").alias("faithfulness_n"), F.count("error").alias("errors"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return total.select("n", share("right", "n").alias("accuracy"), share("answered", "n").alias("coverage"), share("right_answered", "answered").alias("answered_accuracy"), share("hits", "n").alias("retrieval_hit_rate"), "faithfulness", "faithfulness_n", "errors")


def citation_bench(rows: DataFrame) -> DataFrame:
    """Citations of a set of drafts, with and without refusals, which make no claim and so owe no citation.

    ``rows``: sentences, with_valid_citation, invalid_ids, sentences_with_invalid_id, abstained, error, proxy (null without
    counted sentences) and str_em. Drafts with an error or without sentences count as questions only.
    """
    scored = F.col("error").isNull() & (F.col("sentences") > 0)
    own = scored & ~F.col("abstained")
    add = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    total = rows.agg(
        F.count("*").alias("questions"), F.count_if(own).alias("answered"), F.count_if(scored & F.col("abstained")).alias("abstentions"), F.count("error").alias("errors"), add("sentences", own).alias("sentences"),
        add("with_valid_citation", own).alias("with_valid_citation"), add("sentences", scored).alias("all_sentences"), add("with_valid_citation", scored).alias("all_valid"), F.count_if(own & (F.col("with_valid_citation") == F.col("sentences"))).alias("fully_cited"),
        add("invalid_ids", own).alias("invalid_ids"), add("sentences_with_invalid_id", own).alias("sentences_with_invalid_id"), F.avg(F.when(own, F.col("proxy"))).alias("support_proxy"), F.coalesce(F.avg(F.when(own, F.col("str_em"))), F.lit(0.0)).alias("str_em"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rate = share("with_valid_citation", "sentences")
    return total.select(
        "questions", "answered", "abstentions", "errors", "sentences", "with_valid_citation", rate.alias("parseable_rate"), share("all_valid", "all_sentences").alias("parseable_rate_with_abstentions"), (rate == 1).alias("passes"), "fully_cited",
        "invalid_ids", "sentences_with_invalid_id", share("sentences_with_invalid_id", "sentences").alias("invalid_id_rate"), "support_proxy", "str_em",
    )


def trigger_rates(traces: DataFrame) -> DataFrame:
    """Of each subset: n, the share that abstained before generation, the share with a corrective round, and a count of each action."""
    share = lambda c: F.count_if(c) / F.count("*")
    return traces.groupBy("subset").agg(F.count("*").alias("n"), share("abstained_before_generation").alias("pre_generation_abstention_rate"), share("corrective_fired").alias("corrective_rate"), *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])


def paper_action(action: Column) -> Column:
    """An action by its published name."""
    return F.when(action == "proceed", "Correct").when(action == "corrective_retrieve", "Ambiguous").when(action == "abstain", "Incorrect")


def corrective_trigger_rate(actions: DataFrame) -> DataFrame:
    """n and the share of questions whose action is another retrieval; 0 without questions."""
    total = actions.agg(F.count("*").alias("n"), F.count_if(F.col("action") == "corrective_retrieve").alias("corrective"))
    return total.select("n", "corrective", F.coalesce(F.try_divide("corrective", "n"), F.lit(0.0)).alias("trigger_rate"))


def absent_labels(known: DataFrame, wanted: tuple[str, ...], label: str = "label") -> DataFrame:
    """Labels that are wanted but that no row has, in any case of letters: a checkpoint that lacks one can't be used."""
    names = known.agg(F.collect_set(F.lower(label)).alias("names"))
    return names.select(F.explode(F.array_except(F.array(*map(F.lit, wanted)), "names")).alias(label))


def subset_summary(rows: DataFrame) -> DataFrame:
    """Counts and rates over all rows and for each subset (null: all). ``rows``: subset, abstained, correct, confidence."""
    r = rows.groupingSets([[], ["subset"]], "subset").agg(F.count("*").alias("n"), F.count_if("abstained").alias("abstained"), F.count_if("correct").alias("correct"), F.avg(F.when(~F.col("abstained"), F.col("confidence"))).alias("mean_confidence"))
    return r.select("subset", "n", "abstained", "correct", F.try_divide("abstained", "n").alias("abstention_rate"), F.try_divide("correct", F.col("n") - F.col("abstained")).alias("accuracy_answered"), "mean_confidence")


def reason_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("abstained").groupBy("abstain_reason").agg(F.count("*").alias("n"))


def throughput(rows: DataFrame, chunks_per_second: float, target_s: float) -> DataFrame:
    """Projected seconds for a number of chunks at a measured rate, and whether they meet a target. ``rows``: profile, n_chunks."""
    need = F.col("n_chunks") / F.lit(float(chunks_per_second))
    return rows.select("profile", "n_chunks", need.alias("seconds"), (need <= F.lit(float(target_s))).alias("meets_target"))


def regression_gate(baseline: DataFrame, observed: DataFrame, simulated: dict[str, float] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """metric, status, expected, threshold, observed, delta: PASS, FAIL, SKIPPED or MISSING, bounds inclusive.

    A metric without a baseline or a threshold is skipped; one without an observation is missing if it is required, else
    skipped; a simulated value replaces the observed one.
    """
    threshold = F.when(F.col("direction") == "higher_is_better", F.col("min")).otherwise(F.col("max"))
    forced = F.element_at(F.create_map(*[F.lit(x) for kv in simulated.items() for x in kv]), F.col("metric")) if simulated else F.lit(None).cast("double")
    rows = baseline.join(observed.select("metric", F.col("value").alias("seen")), "metric", "left").withColumn("threshold", threshold).withColumn("observed", F.coalesce(forced, F.col("seen")))
    none = F.col("value").isNull() | F.col("threshold").isNull()
    ok = F.when(F.col("direction") == "higher_is_better", F.col("observed") >= F.col("threshold")).otherwise(F.col("observed") <= F.col("threshold"))
    status = F.when(none, "SKIPPED").when(F.col("observed").isNull() & F.col("metric").isin(*required), "MISSING").when(F.col("observed").isNull(), "SKIPPED").when(ok, "PASS").otherwise("FAIL")
    shown = lambda c: F.when(~none, F.col(c))
    return rows.select("metric", status.alias("status"), shown("value").alias("expected"), shown("threshold").alias("threshold"), shown("observed").alias("observed"), shown("observed").__sub__(F.col("value")).alias("delta"))


