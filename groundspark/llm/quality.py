"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of a text are Spark column expressions. On a bounded sample of labelled rows (SAMPLE, by hash of the id) the
driver grows boosted trees, takes every path from a root to a node as a conjunctive rule, and fits logistic weights to
the rules under a lasso penalty, which leaves a few. The rules kept are compiled into one column expression, so
documents are scored inside the JVM in a single pass over the scan, without a shuffle.

Contract: null and empty texts have statistics of 0 and get a score; null ids take part (their remainder counts as 0,
so nothing is learnt from them); without labels of both classes the score is the share of good labels, or 1/2; of several
labels or texts of one id the smallest label and statistics are learnt from; repeated rows get equal scores; an empty table
gives an empty one; further columns pass through ``score``, whatever their names, but for one named ``score``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm import trees
from groundspark.llm.common import give_back, table, unused
from groundspark.llm.vectors import matrix

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
CUT = 0.3
MOST_RULES = 400


NAMES = (
    "symbols", "bars", "shouts", "code", "digits", "points", "upper", "spaces", "echoes", "distinct", "distinct_lines", "line_words", "words", "word_chars",
)


def with_statistics(df: DataFrame, text: str = "text", name: str = "_stats") -> DataFrame:
    """Adds ``name``, an array in the order of NAMES: ratios or logarithms, so that rules carry over to texts of any length.

    What several statistics need comes first, as columns: the words, the lines and the odd characters, the rest of the text
    without its lower-case letters and white space, which is short in most texts and cheap to count in. The row number at
    the end, always true, is a step that the optimizer doesn't move expressions or filters across: rules then read the
    array, where else it would put the statistics themselves into every rule and compute them again and again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    chars_, odd_, echoed_, words_, lines_ = own = [unused(c, df) for c in ("_chars", "_odd", "_echoed", "_words", "_lines")]
    parts = df.withColumns({
        chars_: F.length(body),
        odd_: F.regexp_replace(body, r"[a-zß-öø-ÿ \n\t]+", ""),
        echoed_: F.length(F.regexp_replace(body, r"(?<![^ ])([^ ]++) (?=\1(?![^ ]))", "")),
        words_: F.split(body, " "),
        lines_: F.split(body, "\n"),
    })
    chars, n_words, n_lines = F.greatest(chars_, F.lit(1)).cast("double"), F.size(words_), F.size(lines_)
    share = lambda odd: (F.length(odd_) - F.length(F.translate(odd_, odd, ""))) / chars
    made = {
        "symbols": share("*$%&#@^~"),
        "bars": share("|"),
        "shouts": share("!?"),
        "code": share("{}<>()[];=_/\\"),
        "digits": share("0123456789"),
        "points": share(".,"),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"),
        "spaces": (n_words + n_lines - 2) / chars,
        "echoes": (F.col(chars_) - F.col(echoed_)) / chars,
        "distinct": F.size(F.array_distinct(words_)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines_)) / n_lines,
        "line_words": F.log1p(n_words / n_lines),
        "words": F.log1p(n_words.cast("double")),
        "word_chars": F.col(chars_) / n_words,
    }
    stats = F.transform(F.array(*[made[n].cast("double") for n in NAMES]), lambda x: F.round(x, 9))
    return parts.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, stats)).drop(*own)


class Rule(NamedTuple):
    """All conditions hold: (statistic, over the threshold?, threshold)."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]

    def expression(self, stats: str = "_stats") -> Column:
        """The score between 0 and 1 as a column; thresholds are the same doubles as in the fit.

        The weights are added up in pairs, and these in pairs: the code of a sum holds that of its terms, so a chain of sums
        would write the first ones out again for each of the others.
        """

        def holds(c: tuple[int, bool, float]) -> Column:
            value = F.col(stats)[c[0]]
            return value > F.lit(c[2]) if c[1] else value <= F.lit(c[2])

        terms = [F.when(reduce(lambda a, b: a & b, map(holds, r.conditions)), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules]
        terms = [F.lit(self.intercept), *terms]
        while len(terms) > 1:
            terms = [reduce(lambda a, b: a + b, terms[k : k + 2]) for k in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy."""
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * matches(r.conditions, x)
        return trees.sigmoid(z)


def matches(conditions: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, over, t in conditions:
        out &= x[:, f] > t if over else x[:, f] <= t
    return out


def paths(tree: trees.Tree) -> set[tuple[tuple[int, bool, float], ...]]:
    """The conditions on the way to each node, the tightest for each statistic and side."""
    out, stack = set(), [(0, {})]
    while stack:
        node, so_far = stack.pop()
        if so_far:
            out.add(tuple(sorted((f, over, t) for (f, over), t in so_far.items())))
        f = int(tree.feature[node])
        if f < 0:
            continue
        t = float(tree.threshold[node])
        for over, child in ((False, tree.left[node]), (True, tree.right[node])):
            old = so_far.get((f, over), t)
            stack.append((int(child), so_far | {(f, over): max(old, t) if over else min(old, t)}))
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty and a free intercept, by accelerated proximal gradient steps."""
    n, m = r.shape
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b, w = float(np.log(p / (1 - p))), np.zeros(m, r.dtype)
    vb, vw, t = b, w.copy(), 1.0
    v = np.ones(m, r.dtype)  # the largest curvature by power iteration
    for _ in range(20):
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) or r.dtype.type(1)
    rate = 1 / (0.25 * (float(np.linalg.norm(r @ v) ** 2) / n + 1) + 1e-9)
    for _ in range(steps):
        error = ((trees.sigmoid(r @ vw + vb) - y) / n).astype(r.dtype)
        nb = vb - rate * float(error.sum())
        nw = vw - rate * (r.T @ error)
        nw = (np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)).astype(r.dtype)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), (nw + (t - 1) / nt * (nw - w)).astype(r.dtype)
        b, w, t = nb, nw, nt
    return b, w


def fit_arrays(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4) -> Model:
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model(float(np.log(p / (1 - p))), ())
    grown = trees.boost(x, y, rounds=40, depth=3, rate=0.3, share=0.5, least=2.0)
    rules = sorted(set().union(*map(paths, grown.trees)))
    # One rule after another: the matrix of all of them is the largest thing on the driver.
    support, pull = np.zeros(len(rules)), np.zeros(len(rules))
    for k, c in enumerate(rules):
        hit = matches(c, x)
        support[k], pull[k] = hit.mean(), abs(float((y[hit] - y.mean()).sum()))
    useful = np.flatnonzero((support > 0.002) & (support < 0.998))
    useful = useful[np.argsort(-pull[useful], kind="stable")[:MOST_RULES]]
    r = np.empty((len(x), len(useful)), np.float32)
    for j, k in enumerate(useful):
        r[:, j] = matches(rules[k], x)
    b, w = lasso(r, y, penalty)
    return Model(b, tuple(Rule(rules[k], float(w[j])) for j, k in enumerate(useful) if abs(w[j]) > 1e-4))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled rows whose remainder isn't 0: ``labels``: doc_id, quality; ``docs``: doc_id, text."""
    known = labels.where(F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0))
    usable = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = usable.count()
    scale = 1 << 30
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(scale))
    # About twice as many by hash, and of these the first ones: bounded, and the same rows whatever their order.
    drawn = usable.where(place < int(scale * min(1.0, 2 * sample / max(n, 1)))).orderBy(place, "doc_id").limit(sample)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")).groupBy("doc_id", "quality").agg(F.min("_stats").alias("_stats"))
    got = rows.toArrow().sort_by("doc_id")
    x = matrix(got.column("_stats"), len(NAMES))
    model = fit_arrays(x, got.column("quality").to_numpy().astype(np.float64))
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score``: near 1 where a good label is likely."""
    stats = unused("_stats", docs)
    return with_statistics(docs, text, stats).withColumn("score", model.expression(stats)).drop(stats)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
