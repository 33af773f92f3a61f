"""The operators against brute force, and their defined results at the edges."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import ann, bpe, chat, extract, jaccard, mixing, pii, quality, topk, trees, warc
from groundspark.llm.common import Scratch
from groundspark.llm.dom import Page
from groundspark.llm import graph
from groundspark.llm.graph import components
from groundspark.llm.rtree import RTree, points
from groundspark.llm.shingles import linked, need, sets

DOCS = "doc_id long, text string"


# -- 1: BPE


def awkward_texts():
    rng = random.Random(1)
    own = ["", "a", " a", "  a", "a  b", " \n\n x  ", "a  b", "a\x1c b !\x1c x", "x" * 5000, "it's we'll I'D", "<|endoftext|>hi<|endoftext|> <|endoftext", "漢字 😀😀", "1234567890" * 50, "\r\n\t x \t", "!\u0085 ?", "word " * 3000]
    own += ["".join(rng.choice(" \n\t ab'sé1!?. \x1c\x85漢") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    own += ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    return own


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    texts = awkward_texts()
    df = spark.createDataFrame([(i, t, "kept", "old") for i, t in enumerate(texts)] + [(-1, None, "kept", "old")], "doc_id long, text string, other string, ids string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path), path).collect()}
    reference = Tokenizer.from_file(path)
    for i, e in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert got[i].ids == e.ids, repr(texts[i])
        assert got[i].decoded == reference.decode(e.ids, skip_special_tokens=False)
    assert got[-1].ids == [] and got[-1].decoded == "" and got[-1].other == "kept"
    both = bpe.encode(df.withColumn("decoded", F.lit(7)), path, decoded="decoded").collect()
    assert {r.doc_id: (r.ids, r.decoded, r.other) for r in both} == {i: (r.ids, r.decoded, r.other) for i, r in got.items()}
    assert bpe.encode(df.limit(0), path).count() == 0


def test_bpe_forgets_without_changing_results(monkeypatch):
    texts = awkward_texts()[:300]
    want = bpe.Encoder(bpe.default_vocabulary()).encode(texts)
    for name, value in (("MOST_PAIRS", 10), ("MOST_PIECES", 10), ("TOGETHER", 50), ("LONGEST_KEPT", 3)):
        monkeypatch.setattr(bpe, name, value)
    assert bpe.Encoder(bpe.default_vocabulary()).encode(texts) == want


def test_decoding_broken_ids(spark):
    df = spark.createDataFrame([(1, [447, -5, 99_999_999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, bpe.default_vocabulary()).collect()}
    assert got[2] == got[3] == "" and "�" in got[1]


# -- 2 and 8: vectors


def clustered(n=900, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    x = centres[rng.integers(0, 9, n)] + 0.15 * rng.normal(size=(n, dim))
    x[::2] = rng.normal(size=(len(x[::2]), dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def vectors(spark, x, more=()):
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector int")


ODD = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [1.0, None] + [0.0] * 14, 0), (5060, [float("nan")] * 16, 0), (5080, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (5100, [1.0, 2.0], 0)]


def test_ann_recall_and_scores(spark):
    x = clustered()
    got = defaultdict(list)
    for r in ann.search(vectors(spark, x, ODD), F.col("id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    wide = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, len(x), 20))
    for q, rows in got.items():
        s = wide @ wide[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:10]
        hits += len(set(best) & {r[1] for r in rows})
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(abs(r[2] - s[r[1]]) < 1e-12 for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    assert hits / (10 * len(got)) >= 0.9


def uneven(kind, n=2000, dim=16):
    rng = np.random.default_rng(8)
    g = rng.normal(size=(n, dim))
    if kind == "plane":
        return rng.normal(size=(n, 3)) @ rng.normal(size=(3, dim))
    if kind == "decaying":
        return g / np.arange(1, dim + 1)
    return rng.standard_cauchy((n, dim))


@pytest.mark.parametrize("kind", ["plane", "decaying", "heavy"])
def test_ann_finds_nearest_where_residuals_have_no_common_spread(spark, kind, monkeypatch):
    """Also rows outside the sample, which stretch their lists beyond what was fitted."""
    monkeypatch.setattr(ann, "SAMPLE", 400)
    x = uneven(kind).astype(np.float32)
    wide, got = x.astype(np.float64), defaultdict(list)
    for r in ann.search(vectors(spark, x), F.col("id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, len(x), 20))
    for q, rows in got.items():
        s = (wide * wide[q]).sum(1)
        s[q] = -np.inf
        assert rows == np.lexsort((np.arange(len(s)), -s))[:10].tolist()


def test_ann_visits_a_list_again_below_its_estimate():
    """Rows between the bar and an estimate that was too high are found by the second visit, those above it aren't found twice."""
    index = ann.Index(np.array([[1.0], [5.0]]), np.array([0.1, 0.1]), [np.array([[0.0], [5.0]])], 0.0)
    largest = np.array([[0.5, 0.5, 0.5, 0.5]] * 2)
    lists, below = ann.route_again(index, np.array([3, 3]), largest, np.array([[1.0]]), np.array([1.1]), [np.array([0, 1])], [np.array([1.4, -np.inf])])
    assert lists[0].tolist() == [0] and below[0].tolist() == [1.4]
    x = np.array([[1.0], [1.2], [1.5]])
    block = ann.Block(0, np.arange(3), np.arange(3), x, np.zeros((3, 1), np.int64), np.abs(x[:, 0] - 1.0))
    which, ids, scores = ann.visit(index, block, np.array([9]), np.array([[1.0]]), np.array([1.1]), below[0], 2)
    assert (which.tolist(), ids.tolist(), scores.tolist()) == ([0], [1], [1.2])


def test_ann_visits_lists_of_k_other_rows():
    index = ann.Index(np.array([[1.0, 0.0], [-1.0, 0.0]]), np.array([0.01, 0.01]), [], 0.0)
    for size, want in ((20, [0, 1]), (21, [0])):
        lists, _ = ann.route(index, np.array([size, 500]), np.array([[1.0, 0.0]]), 20)
        assert lists[0].tolist() == want


def test_ann_copies_and_few_rows(spark):
    same = np.tile(np.eye(16, dtype=np.float32)[0], (120, 1))
    rows = ann.search(vectors(spark, same), F.col("id") % 20 == 0, 5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in rows if r.query_id == 0] == [1, 2, 3, 4, 5] and [r.vec_id for r in rows if r.query_id == 20] == [0, 1, 2, 3, 4]
    few = ann.search(vectors(spark, clustered(3)), F.col("id") == 0, 5)
    assert few.count() == 2
    assert ann.search(vectors(spark, clustered(3)).limit(0), F.col("id") == 0, 5).count() == 0


@pytest.mark.parametrize("search", [ann.search, topk.search])
def test_every_row_but_the_querys_own_is_a_candidate(spark, search):
    # The rows that take no part have no say in the dimension; two rows share the id 1.
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.25]), (1, [4.0, 4.0]), (2, [1.0, 0.0])] + [(k, [None, 1.0, 2.0]) for k in range(10, 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id) for r in search(df, F.col("id") < 2, 5).orderBy("query_id", "rank", "vec_id").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 1)] + [(1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 2), (1, 3, 1), (1, 3, 2)]
    tied = spark.createDataFrame([(k, [1.0, 1.0]) for k in (5, 3, 9, 3)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search(tied, F.col("id") == 9, 2).orderBy("rank").collect()] == [3, 3]


def test_topk_is_exact(spark):
    x = clustered(700) * 3
    zero = [(5020, [0.0] * 16, 0)]
    rows = topk.search(vectors(spark, x, [o for o in ODD if o[0] != 5020] + zero), F.col("id") % 100 == 0, 7).orderBy("query_id", "rank").collect()
    ids = np.append(np.arange(len(x)), 5020)
    v = np.floor(1024 * np.vstack([x, np.zeros((1, 16))]).astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, len(x), 100):
        s = v @ v[q]
        keep = np.flatnonzero(ids != q)
        best = keep[np.lexsort((ids[keep], -s[keep]))[:7]]
        want += [(q, k + 1, int(ids[b]), int(s[b])) for k, b in enumerate(best)]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == want
    assert topk.search(vectors(spark, x[:0]), F.col("id") == 0, 5).count() == 0


def test_block_bounds_lose_nothing():
    rng = np.random.default_rng(0)
    for scale in (3, 1000):
        v = rng.integers(-scale, scale, (400, 40)).astype(np.float64)
        block = topk.Block(np.arange(400), np.arange(400), v)
        for q in range(0, 400, 40):
            s = v @ v[q]
            s[q] = -np.inf
            best = np.lexsort((np.arange(400), -s))[:10]
            ids, scores = block.search(q, v[q], 10)
            assert ids.tolist() == best.tolist() and scores.tolist() == s[best].tolist()


# -- 3: quality


def test_rules_equal_their_column_expression(spark):
    rng = np.random.default_rng(2)
    words = ["the", "cat", "sat", "on", "a", "mat", "again"]
    good = [" ".join(rng.choice(words, 30)) + "." for _ in range(150)]
    bad = [" ".join(w + "***" for w in rng.choice(words, 30)) if k % 2 else " ".join(["spam"] * 30) for k in range(60)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(good + bad)] + [(900, None, 1.0), (901, "", 1.0), (None, "x", 1.0), (903, "word " * 20_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(5000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) <= quality.MOST_RULES
    rows = quality.with_statistics(quality.score(docs, model)).collect()
    x = np.array([r._stats for r in rows])
    assert np.allclose(model.score(x), [r.score for r in rows])
    got = {r.doc_id: r.score for r in rows}
    assert len(rows) == 214 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([got[i] >= quality.CUT for i in range(150)]) > 0.98 and np.mean([got[i] < quality.CUT for i in range(150, 210)]) > 0.95
    assert quality.fit(docs, labels.limit(0)).rules == () and quality.score(docs.limit(0), model).count() == 0


def test_fit_depends_on_no_order_and_passes_columns(spark):
    rows = [(i % 120, ("good words here " if i % 3 else "bad*** $$$ ") * (1 + i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i % 120, int(i % 3 > 0)) for i in range(250)], "doc_id long, quality int")
    one = quality.fit(docs, labels, 60)
    assert one.rules and one == quality.fit(docs.orderBy(F.rand(3)).repartition(3), labels.orderBy(F.rand(4)).repartition(2), 60)
    mine = docs.select("*", *[F.lit(c).alias(c) for c in ("_chars", "_odd", "_echoed", "_words", "_lines", "_stats")])
    got = quality.score(mine, one)
    assert got.columns == [*mine.columns, "score"] and got.where("_words <> '_words' OR _stats <> '_stats'").isEmpty()
    assert sorted(r.score for r in got.collect()) == sorted(r.score for r in quality.score(docs, one).collect())


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], DOCS)
    held = docs.select("doc_id", (quality.remainder(F.col("doc_id")) == 0).alias("h")).where("h").select("doc_id", F.lit(0).alias("quality"))
    assert quality.fit(docs, held) == quality.Model(0.0, ())
    import zlib

    assert {r.doc_id for r in held.collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}


# -- 4: HTML


def test_extraction_of_generated_pages():
    made, exact = extract.Generator(55), 0
    model = extract.fitted()
    for _ in range(60):
        p = Page(made.page())
        want = p.blocks([extract.MARK in t for t in p.text]).replace(extract.MARK, "")
        p.text = [t.replace(extract.MARK, "") for t in p.text]
        exact += extract.mains([p], model)[0] == want
    assert exact >= 50


def test_extraction_edges(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>A title</h1><p><b>First &amp; best,<br>it is so.<p>Second paragraph, longer than the first one.</article><footer>&copy; us</footer></body></html>'
    rows = [(1, None), (2, ""), (3, page), (4, page), (5, "<div"), (6, "<article><p>" + "Long words here. " * 20_000 + "</p></article>")]
    df = spark.createDataFrame([(i, h, "mine") for i, h in rows], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    assert got[1] == got[2] == got[5] == ""
    assert got[3] == got[4] == "A title\n\nFirst & best, it is so.\n\nSecond paragraph, longer than the first one."
    assert len(got[6]) == len("Long words here. ") * 20_000 - 1
    assert extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<p>one<svg/>two<p>three", "onetwo\n\nthree"),
    ("<p>one <math/>two <svg><title/><path d='x'/></svg>three", "one two three"),
    ("<p>one<svg width=1><path d='x'/><p>two", "one\n\ntwo"),
    ("<p>one<svg><text>no</text></object>no</svg><p>two", "one\n\ntwo"),
    ("<article><h1>a</h1><p>one</p><svg width='1'/><p>two</p></article>", "a\n\none\n\ntwo"),
    ("<p>one<object data=x><p>two<audio src=y>, too</object><select>no</select><p>three<select><p>four", "one\n\nthree\n\nfour"),
    ("<p>one<video><iframe><p>no", "one"),
    ("<html><head><meta charset=utf-8><title>T</title><p>text", "text"),
    ("<head><title>T</title><script>no</script>Text, <b>too", "Text, too"),
    ("<head><template><p>no</template><meta x></head><p>text", "text"),
    ("<p title=it's>one<p>two", "one\n\ntwo"),
    ('<p class="a"">one<p>two', "one\n\ntwo"),
    ('<p class="a>one</p><p>two', "one\n\ntwo"),
    ("<p a = \"x>y\" b='>'>one<a href=x/>, two", "one, two"),
    ("<!-->one<!-- no --><p>two", "one\n\ntwo"),
    ("<p>where <math><mi>x</mi><mo>+</mo><mspace/><mi>y</mi><annotation>no</annotation></math> is odd", "where x+y is odd"),
])
def test_text_after_odd_tags_is_read(page, want):
    p = Page(page)
    assert p.blocks([True] * len(p.tag)) == want


PAGES = {
    "a title in a header of the article": (
        "<article><header><h1>Solar sails</h1></header><p>Light pushes them, slowly, and for years.</p><p>No fuel is used, which saves weight.</p></article>",
        "Solar sails|Light pushes them, slowly, and for years.|No fuel is used, which saves weight.",
    ),
    "comments without a name": (
        "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><article><h1>On tea</h1><p>Tea is steeped in hot water, not boiled.</p>"
        "<p>Green tea wants less heat than black tea does.</p></article><section id='thread'><h3>3 answers</h3><div><b>Ann</b><p>I boil mine, sorry.</p></div>"
        "<div><b>Bob</b><p>Nice read. Thanks!</p></div><div><b>Cy</b><p>What about oolong?</p></div></section><footer>&copy; 2020 Tea</footer></body>",
        "On tea|Tea is steeped in hot water, not boiled.|Green tea wants less heat than black tea does.",
    ),
    "comments inside the article": (
        "<article><h1>Knots</h1><p>A bowline holds well, and is easy to untie.</p><p>Learn it first.</p><section class='comments'><h2>Comments</h2><div class='comment'><p>I prefer a hitch.</p></div></section></article>",
        "Knots|A bowline holds well, and is easy to untie.|Learn it first.",
    ),
    "a table": (
        "<main><h1>Rates</h1><p>The table lists the rates.</p><table><tr><th>Year</th><th>Rate</th></tr><tr><td>1999</td><td>4.5</td></tr></table><p>Rates fell later on.</p></main><aside class='sidebar'><h3>More</h3><ul><li><a href=/x>Loans</a></li></ul></aside>",
        "Rates|The table lists the rates.|Year|Rate|1999|4.5|Rates fell later on.",
    ),
    "divisions only": (
        "<div class='header'><a href=/>Site</a></div><div class='post'><h2>Walks</h2><p>We went up the hill, and back down.</p><blockquote>It was steep.</blockquote><ul><li>Bring water.</li><li>Bring a map.</li></ul></div><div class='footer'>All rights reserved</div>",
        "Walks|We went up the hill, and back down.|It was steep.|Bring water.|Bring a map.",
    ),
    "a header of the site": (
        "<header><h1>The Daily</h1><p>News of the day</p></header><article><h1>Rain ahead</h1><p>It will rain on Monday, the office says.</p></article><form><label>Search</label><input><button>Go</button></form>",
        "Rain ahead|It will rain on Monday, the office says.",
    ),
    "a drawing": ("<article><h1>Icons</h1><p>Before the icon.</p><svg width='1'/><p>After the icon.</p></article>", "Icons|Before the icon.|After the icon."),
    "a notice and an advert": (
        "<div id='cookie-consent'><p>We use cookies. Accept?</p><button>OK</button></div><article><h1>Bread</h1><p>Flour, water, salt and time make bread.</p><div class='ad'>Buy flour now!</div><p>Let it rest.</p></article>",
        "Bread|Flour, water, salt and time make bread.|Let it rest.",
    ),
    "no markup": ("Only some words.", "Only some words."),
    "character references": ("<main><h1>Caf&eacute; &amp; bar</h1><p>Open&nbsp;from 9&ndash;17,\n  every   day.</p></main><footer>Impressum</footer>", "Café & bar|Open from 9–17, every day."),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_of_other_layouts(name):
    page, want = PAGES[name]
    assert extract.mains([Page(page)], extract.fitted())[0].split("\n\n") == want.split("|")


def test_decoding_is_the_best_of_all_choices():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = 9
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        text = ~np.isin(np.arange(n), parent)
        odds = rng.normal(size=n)
        best = 0.0
        for chosen in itertools.product((False, True), repeat=n):
            kids = {int(parent[k]) for k in range(n) if chosen[k]}
            if all(chosen[parent[k]] for k in range(1, n) if chosen[k]) and all(k in kids for k in range(n) if chosen[k] and not text[k]):
                best = max(best, float(odds[np.array(chosen)].sum()))
        assert odds[extract.decode(odds, parent, depth, text)].sum() == pytest.approx(best)


def test_decoding_is_consistent():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = 30
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        text = ~np.isin(np.arange(n), parent)
        kept = extract.decode(rng.normal(size=n), parent, depth, text)
        assert all(kept[parent[k]] for k in range(1, n) if kept[k])
        assert all(any(kept[c] for c in np.flatnonzero(parent == k)) for k in range(n) if kept[k] and not text[k])


# -- 5: mixing


def corpus(spark, counts, words=4):
    rows = [(i, s, "w " * words, "mine") for i, s in enumerate(itertools.chain.from_iterable([s] * n for s, n in counts.items()))]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, block string")


def test_entropy_target(spark):
    docs = corpus(spark, {"hot": 400, "b": 40, "c": 40})
    scratch = Scratch(spark)
    planned = {r.source: r for r in mixing.plan(mixing.counted(docs), scratch, mixing.Target(entropy=0.9)).collect()}
    w = np.array([r.weight for r in planned.values()])
    assert abs(w.sum() - 1) < 1e-9 and 0.9 <= -(w * np.log(w)).sum() / np.log(3) < 0.9001
    rows = mixing.mix(docs, mixing.Target(entropy=0.9)).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("t"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.max("block").alias("b")).collect()
    for r in rows:
        budget = planned[r.source].weight * 480 * 4
        assert budget - 4 < r.t <= budget + 1
        assert r.n - r.d * r.b <= r.d  # whole blocks come before the last one
    again = [sorted((r.doc_id, r.block, r.order_key) for r in mixing.mix(docs, mixing.Target(entropy=0.9)).collect()) for _ in range(2)]
    assert again[0] == again[1]


def test_repetition_limit_keeps_every_document(spark):
    docs = corpus(spark, {"hot": 300, "b": 30, "c": 10})
    rows = mixing.mix(docs, mixing.Target(repeats=2.0, budget=None))
    per = {r.source: (r.n, r.d) for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect()}
    assert {s: d for s, (_, d) in per.items()} == {"hot": 300, "b": 30, "c": 10}
    assert per["hot"][0] == 300 and per["c"][0] == 20 and 30 < per["b"][0] <= 60


def test_mixing_edges(spark):
    odd = spark.createDataFrame([(None, None, None), (1, None, "a b"), (1, None, "a b"), (2, "empty", ""), (3, "s", "x " * 50_000)], "doc_id long, source string, text string")
    rows = mixing.mix(odd, mixing.Target(repeats=3.0, budget=None)).collect()
    assert {r.doc_id for r in rows} >= {1, 2, 3} and sum(r.doc_id == 2 for r in rows) == 1
    assert mixing.mix(odd.limit(0), mixing.Target(entropy=0.9)).count() == 0
    assert mixing.mix(odd.where("source = 's'"), mixing.Target(entropy=0.9)).count() == 1
    clashing = odd.select("*", *[F.lit(c).alias(c) for c in ("_source", "_whole", "_cut", "_times", "whole", "cut", "tokens")])
    mixed = mixing.mix(clashing, mixing.Target(repeats=3.0, budget=None))
    assert mixed.count() == len(rows) and mixed.where("_source <> '_source' OR _times <> '_times'").isEmpty()
    got = odd.select(mixing.n_words(F.col("text"))).collect()
    assert [r[0] for r in got] == [0, 2, 2, 0, 50_000]


# -- 6: Jaccard join


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(texts):
    own = {i: shingle_set(t) for i, t in texts.items()}
    top = {i: i for i in own}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        x, y = own[a], own[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            top[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(own[i]), find(i)) for i in own}


def near_copies(n=260, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 5, 8, 40, 90)))] for _ in range(12)]
    out = {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            t = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind < 0.8:
            t = [rng.choice(words) for _ in range(rng.randint(5, 60))] + passage
        else:
            t = [rng.choice(words) for _ in range(rng.randint(0, 50))]
        out[i] = " ".join(t) if rng.random() < 0.7 else " \n".join(t).upper()
    return out


@pytest.mark.parametrize("limits", [{}, {"TILE": 6}, {"WEIGHT": 200, "PACK": 100}, {"HOT": 4}, {"HOT": 4, "TILE": 6, "MOST_SENT": 0}])
def test_join_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = near_copies()
    words = [f"u{k}" for k in range(60)]
    texts |= {1000 + k: " ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(60)}  # linked in chains or all together
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts.items()], "doc_id long, text string, n long, s1 string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == brute_components(texts)


def test_one_row_of_each_component_stays(spark):
    texts = near_copies(120, 9)
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, "a b", "x"), (None, "a b", "x"), (500, None, "x"), (500, None, "x"), (501, " ", "x")]
    rows += [(600, "p q", "x"), (600, "p  q", "x"), (600, "r s", "y"), (601, "R S", "x"), (599, "r s", "z")]  # r s: 599 stays
    df = spark.createDataFrame(rows, "doc_id long, text string, one string")
    got = sorted(map(tuple, jaccard.one_of_each(df).collect()), key=repr)
    own = brute_components(texts)
    want = [(i, texts[i], "x") for i, (n, c) in own.items() if i == c or not n]
    want += [(None, "a b", "x")] * 2 + [(500, None, "x")] * 2 + [(501, " ", "x"), (600, "p  q", "x"), (599, "r s", "z")]
    assert got == sorted(want, key=repr)


def test_a_pair_is_judged_by_its_first_shingle_in_common_in_few_buckets(spark):
    rng = random.Random(12)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2_000)]
        other = [*words[:900], f"new{k}", *words[901:]]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other)), (100 + k, " ".join(words[:700]))]  # the last links with none
    classes = spark.sparkContext.broadcast(np.zeros(jaccard.SLOTS, np.uint8))
    full = jaccard.described(spark.createDataFrame(rows, DOCS), classes, jaccard.FULL, "doc_id", "text").cache()
    ids = {r.s1: r.doc_id for r in full.select("s1", "doc_id").collect()}
    made = [(ids[r.anchor], ids[r.s1]) for r in jaccard.anchored(jaccard.dealt(full, 64)).collect()]
    assert {frozenset(x) for x in made if x[0] != x[1]} == {frozenset((2 * k, 2 * k + 1)) for k in range(20)}
    assert len(made) < 20 * 2 * 16  # one in every bucket before


@pytest.mark.parametrize("tile", [9, jaccard.TILE])
def test_links_are_counted_exactly(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "COLUMNS", 5)
    monkeypatch.setattr(jaccard, "LISTED", 50)
    texts = near_copies(220, 6)
    words = [f"v{k}" for k in range(100)]
    texts |= {1000 + k: " ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(0, 100, 2)}  # all linked
    texts |= {2000 + k: " ".join(words) for k in range(4)}
    own = {i: shingle_set(t) for i, t in texts.items()}
    want = dict.fromkeys(texts, 0)
    for a, b in itertools.combinations(texts, 2):
        x, y = own[a], own[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            want[a], want[b] = want[a] + 1, want[b] + 1
    assert want[1000] == want[2000] == 53
    df = spark.createDataFrame(list(texts.items()), DOCS)
    assert {r.doc_id: r.n_links for r in jaccard.join(df).collect()} == want
    rows = [(1, None), (2, "a b"), (2, "a b"), (2, "c d"), (3, "A  B"), (None, "a b"), (4, "c d e")]
    got = sorted((r.doc_id or 0, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (2, 2), (2, 2), (3, 2), (4, 0)]


def test_intersections_of_all_sets():
    rng = np.random.default_rng(7)
    made = [[np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(0, 5000, n)]).astype(np.uint64)) for n in rng.integers(0, 200, m)] for m in (60, 90)]
    assert jaccard.shared(*made).tolist() == [[len(np.intersect1d(x, y)) for y in made[1]] for x in made[0]]


def test_join_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "word " * 30_000), (8, "word " * 30_000), (None, "a b"), (9, "a b"), (9, "a b")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (9, 1, 4), (9, 1, 4)]
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0


def test_threshold_is_exact():
    for a, b in itertools.product(range(1, 60), repeat=2):
        for i in range(min(a, b) + 1):
            assert (100 * i >= 75 * (a + b - i)) == (i >= need(a, b))
    x = np.arange(100, dtype=np.uint64)
    assert linked(x[:75], x) and not linked(x[:74], x) and not linked(x[:0], x[:0])


def test_tree_join_finds_every_link():
    texts = near_copies(150, 8)
    own = list(sets(list(texts.values())))
    keep = [k for k, s in enumerate(own) if len(s)]
    sizes = np.array([len(own[k]) for k in keep])
    found = set()
    for a, b in RTree(points([own[k] for k in keep]), sizes, np.arange(len(keep))).join():
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for a, b in itertools.combinations(range(len(keep)), 2):
        if linked(own[keep[a]], own[keep[b]]):
            assert (a, b) in found
    assert len(found) < len(keep) * (len(keep) - 1) / 4


def test_tree_passes_over_what_is_connected():
    words = [f"v{k}" for k in range(200)]
    own = list(sets([" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in range(200)]))
    sizes, tried = np.array(list(map(len, own))), 0
    tree = RTree(points(own), sizes, np.arange(200))
    for a, b in tree.join():
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if not tree.connected(x, y):
                tried += 1
                assert linked(own[x], own[y])
                tree.connect(x, y)
    assert tried == 199 and len(set(tree.label)) == 1
    assert list(RTree(points(own), sizes, np.zeros(200, int)).join()) == []


@pytest.mark.parametrize("together", [graph.TOGETHER, 0])
def test_components_of_long_chains(spark, monkeypatch, together):
    monkeypatch.setattr(graph, "TOGETHER", together)
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


# -- 7: WARC


def raw_records(spark, rows):
    return warc.hashed(spark.createDataFrame(rows, "file long, offset long, record_id string, record binary"))


def test_audit_finds_exactly_the_damage(spark):
    rows = [(f, 3000 * k, f"{f}-{k}", bytearray(f"record {f} {k}".encode())) for f in range(20) for k in range(60)]
    bad = [list(r) for r in rows]
    bad[70][3] = bytearray(b"rot")
    lost = bad.pop(500)
    bad.append([19, 999_999_999, "new", None])
    got = {(r.file, r.record_id): r.status for r in warc.audit(raw_records(spark, rows), raw_records(spark, [tuple(r) for r in bad]), Scratch(spark)).collect()}
    assert got == {(rows[70][0], rows[70][2]): "corrupt", (lost[0], lost[2]): "missing", (19, "new"): "extra"}
    assert warc.audit(raw_records(spark, rows), raw_records(spark, rows[::-1]), Scratch(spark)).count() == 0
    assert warc.audit(raw_records(spark, rows[:3]), raw_records(spark, rows[:0] or [rows[0]]).limit(0), Scratch(spark)).count() == 3


def test_warc_round_trip(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/é", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    data = [bytes(r[0]) for r in pages.select(warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "c.warc").write_bytes(b"no record")
    got = sorted((r.path[-9:], r.offset, r.uri, bytes(r.payload).decode()) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert [g[2:] for g in got] == [("http://a/é", "<p>é</p>"), ("", "")] * 2
    laid = warc.laid_out(pages).orderBy("offset").collect()
    assert [r.offset for r in laid] == [0, len(data[0])] and laid[1].length == len(data[1])


def test_pages_without_an_id_are_dealt_to_many_files(spark):
    rows = [(None, f"u{k}", "<p>" * k) for k in range(300)] + [(None, None, None)] * 3 + [(k, "u", "x" * 200_000 if k == 7 else None) for k in range(9)] + [(8, "u", None)]
    pages = spark.createDataFrame([(i, u, h, "mine", 5) for i, u, h in rows], "page_id long, url string, html string, file string, offset int")
    laid = warc.laid_out(pages, 4).collect()
    assert len(laid) == len(rows) and len({r.file for r in laid if r.file < 0}) > 200
    assert all(a.offset != b.offset for a, b in itertools.combinations(laid, 2) if a.file == b.file)
    mine = warc.laid_out(pages, 4)
    assert warc.audit(mine, warc.laid_out(pages, 4), Scratch(spark)).count() == 0
    gone = sorted(laid, key=lambda r: (r.file, r.offset))[5]
    left = mine.where((F.col("file") != gone.file) | (F.col("offset") != gone.offset))
    assert [(r.file, r.offset, r.status) for r in warc.audit(mine, left, Scratch(spark)).collect()] == [(gone.file, gone.offset, "missing")]
    assert warc.damaged(warc.placed(pages, 4)).where("record_id = ''").count() == 303
    assert warc.audit(mine.limit(0), mine.limit(0), Scratch(spark)).count() == 0


def test_records_of_equal_offset_and_repeated_rows(spark):
    rows = [(0, 0, "a", bytearray(b"one")), (0, 0, "b", bytearray(b"two")), (0, 5, "c", None), (0, 5, "c", None), (2, 0, None, bytearray(b"three"))]
    find = lambda a, b: {(r.file, r.offset, r.record_id, r.status) for r in warc.audit(raw_records(spark, a), raw_records(spark, b), Scratch(spark)).collect()}
    assert find(rows, rows[::-1]) == set()
    assert find(rows, rows[:3] + rows[4:]) == {(0, 5, "c", "corrupt")}
    assert find(rows, rows[1:]) == {(0, 0, "a", "missing")}
    assert find(rows[:4], rows) == {(2, 0, "", "extra")}


def test_records_behind_a_damaged_one_are_read():
    made = [f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n" for k, body in enumerate((b"one", b"two\r\n\r\nmore", b"", b"four"))]
    whole = b"".join(made)
    assert [(r[0], r[1], r[3], r[4]) for r in warc.parse(whole)] == [(len(b"".join(made[:k])), f"<{k}>", "resource", m) for k, m in enumerate(made)]
    for old, new in ((b"WARC/1.1", b"WARX/1.1"), (b"Length: 11", b"Length: 3"), (b"Length: 11", b"Length: 9999"), (b"Length: 11", b"Length: x1"), (b"more\r\n\r\n", b"mo")):
        bad = made[1].replace(old, new)
        got = list(warc.parse(made[0] + bad + made[2] + made[3]))
        at = len(made[0])
        assert [(r[0], r[1]) for r in got if r[3] == "resource"][-2:] == [(at + len(bad), "<2>"), (at + len(bad) + len(made[2]), "<3>")]
        assert any(r[0] == at and r[1] == "<1>" for r in got) and b"".join(r[4] for r in got) == made[0] + bad + made[2] + made[3]
        assert "damaged" in {r[3] for r in got}
    assert [(r[0], r[3]) for r in warc.parse(whole[:-6])] == [(0, "resource"), (len(made[0]), "resource"), (len(b"".join(made[:2])), "resource"), (len(b"".join(made[:3])), "damaged")]


def test_changed_bytes_are_found_by_their_hashes(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 9) for i in range(200)], "page_id long, url string, html string")
    records = warc.placed(pages, 4)
    own = {r.record_id: bytes(r.record) for r in records.collect()}
    got = {r.record_id: bytes(r.record) for r in warc.damaged(records).collect()}
    lost = {str(i) for i in range(200) if i // 4 % 53 == 9 or i // 4 % 17 == 3 and i % 4 == 3}
    assert set(own) - set(got) == lost and {k for k in got if got[k] != own[k]} == {"5", "102", "199"}
    assert sum(a != b for a, b in zip(got["102"], own["102"], strict=True)) == 1
    assert own["5"].startswith(got["5"]) and 0 < len(got["5"]) < len(own["5"])
    want = {k: "missing" for k in lost} | {"5": "corrupt", "102": "corrupt", "199": "corrupt"}
    assert {r.record_id: r.status for r in warc.audit(warc.hashed(records), warc.hashed(warc.damaged(records)), Scratch(spark)).collect()} == want
    # Files that are read fit the audit.
    for side in ("one", "two"):
        for f in range(3):
            (tmp_path / side / str(f)).mkdir(parents=True)
            data = [own[str(k)] if (side, k) != ("two", 6) else got["102"] for k in range(4 * f, 4 * f + 4)]
            (tmp_path / side / str(f) / "a.warc").write_bytes(b"".join(data).replace(b"<p>1</p>", b"<p>x</p>" if side == "two" else b"<p>1</p>"))
    read = [(warc.read_warc(spark, str(tmp_path / s / "*")), str(tmp_path / s)) for s in ("one", "two")]
    mine, other = warc.numbered(*read[0], *read[1], Scratch(spark))
    found = {(r.file, r.record_id, r.status) for r in warc.audit(warc.hashed(mine), warc.hashed(other), Scratch(spark)).collect()}
    assert (0, "<urn:page:1>", "corrupt") in found and (1, "<urn:page:6>", "missing") in found and (1, "<urn:page:102>", "extra") in found


# -- 9: personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


@pytest.mark.parametrize("letters", ["a.@-b1 ", "0123456789 -", "0129.. ", "+01234 ()-.", "a@b.c+1.2 3-é"])
def test_anchors_find_the_base_kinds(letters):
    rng, own = random.Random(3), pii.finder()
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in own.find(t) if s.kind in pii.BASE] == base_spans(t), t


def test_added_kinds():
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" cards 7536784127813050 4845168114407329 IBAN: DE44 5001 0517 5407 3249 31 at https://me:pw@host.org/x and https://host.org/y'
    got = [(s.kind, text[s.start : s.end]) for s in pii.finder().find(text)]
    assert ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962") in got and ("account", "4845168114407329") in got
    assert ("account", "DE44 5001 0517 5407 3249 31") in got and ("url", "https://me:pw@host.org/x") in got
    assert not any("host.org/y" in v for _, v in got)
    assert pii.finder().find("A token of thanks, an account of 1999, password please") == []


@pytest.mark.parametrize("text, kind, value", [
    ("My account number: 12345678.", "account", "12345678"),
    ("Passport No. X1234567 of", "account", "X1234567"),
    ("acct no 998877", "account", "998877"),
    ("Acct. nr: 998877", "account", "998877"),
    ("account # 998877", "account", "998877"),
    ("the aCCount number is 12-345-678", "account", "12-345-678"),
    ("IBan: DE44 5001 0517 5407 3249 31", "account", "DE44 5001 0517 5407 3249 31"),
    ("apiKey = '04dbebab91ab85687d33eeaa'", "secret", "04dbebab91ab85687d33eeaa"),
    ("İ apiKey=04dbebab91ab85687d33eeaa", "secret", "04dbebab91ab85687d33eeaa"),
    ("password: hunter2! then", "secret", "hunter2!"),
    ("(PassWord = s3cret).", "secret", "s3cret"),
])
def test_usual_forms_of_accounts_and_secrets(text, kind, value):
    assert [(s.kind, text[s.start : s.end]) for s in pii.finder().find(text)] == [(kind, value)]
    assert pii.finder().find("account no more, account number: none, password: required") == []


def test_redaction_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "write to a@b.co or +1 (243) 555-5526 now"), (3, "write to a@b.co or +1 (243) 555-5526 now"), (4, "clean 😀 text"), (5, "x " * 100_000 + "a@b.co"), (6, "😀 a@b.co")]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, pii string")
    got = pii.redact(df).collect()
    assert [r.text for r in got if r.doc_id < 5] == [None, "", "write to <EMAIL> or <PHONE> now", "write to <EMAIL> or <PHONE> now", "clean 😀 text"]
    found = {r.doc_id: r.pii for r in pii.find(df).collect()}
    assert found[1] == found[2] == [] and found[5][0].start == 200_000 and found[6][0].start == 2
    assert pii.find(df.limit(0)).count() == 0


# -- 10: chat


def test_every_branch_is_enumerated_and_the_best_chosen(spark):
    #        1        10 (root whose parent is absent)
    #      2   3
    #     4 5   6 - 7
    rows = [(1, 1, None, "user", "a", 1.0), (2, 1, 1, "assistant", "b", 5.0), (3, 1, 1, "assistant", "c", 1.0), (4, 1, 2, "user", "d", 0.0), (5, 1, 2, "user", "e", 0.0), (6, 1, 3, "user", "f", 1.0), (7, 1, 6, "assistant", "g", 1.0), (10, 2, 99, "user", "h", None), (20, 3, 21, "user", "i", 1.0), (21, 3, 20, "user", "j", 1.0)]
    nodes = spark.createDataFrame(rows, "node long, tree long, parent long, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.branches(nodes, Scratch(spark), None).orderBy("leaf", "depth").collect():
        paths[r.leaf].append(r.node)
    assert paths == {4: [1, 2, 4], 5: [1, 2, 5], 7: [1, 3, 6, 7], 10: [10]}
    best = {(r.tree, r.leaf) for r in chat.branches(nodes, Scratch(spark), 1).collect()}
    assert best == {(1, 4), (2, 10)}


def test_masks_of_long_conversations_and_clashing_columns(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"{k} <|im_end|> é" * (k % 5)) for k in range(5 * chat.CHUNK + 3)] + [(2, 0, "assistant", "long " * 60_000)]
    df = spark.createDataFrame([(*t, "mine", 1) for t in turns], "conv_id long, turn long, role string, text string, piece string, rank int")
    scratch = Scratch(spark)
    nodes = scratch.keep(chat.linear_replies(df, scratch))
    done = chat.format_paths(chat.branches(nodes, scratch), nodes)
    got = {r.tree: r for r in done.select("tree", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for c in (1, 2):
        own = [(r, x) for i, _, r, x in turns if i == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss == "".join(x for r, x in own if r == "assistant")


def test_formatting_reads_back(spark):
    hard = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<|im_end|>\n<|im_start|>user\nhi", "", None, "tail\\", "<|im_\\end|>", "<\\|im_end|>", "😀 <<SYS>>\n"]
    rows = [(c, t, "assistant" if t % 2 else "us\ner", hard[(c + t) % len(hard)]) for c in range(9) for t in range(c + 1)] + [(50, t, "assistant", f"turn {t}") for t in range(300)] + [(None, 1, None, "x"), (60, 1, "user", "same"), (60, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark)
    nodes = scratch.keep(chat.linear_replies(df, scratch))
    done = chat.format_paths(chat.branches(nodes, scratch), nodes)
    got = {r.tree: r for r in done.select("tree", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(text for role, text in turns if role == "assistant")
    assert chat.branches(nodes.limit(0), scratch).count() == 0


# -- what they share


def test_boosting_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((trees.boost(x, y, 40, 3).score(x) > 0) == y).mean() > 0.95
    assert np.isfinite(trees.boost(x[:0], y[:0]).score(x)).all() and np.isfinite(trees.boost(x, y * 0).score(x)).all()


def test_digest_forms(spark):
    df = spark.createDataFrame([(1, "hello world")], DOCS)
    path = bpe.default_vocabulary()
    ids = bpe.encode(df, path).first().ids
    got = spark.createDataFrame([(ids,)], "ids array<int>").select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)).first()[0]
    assert got == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
