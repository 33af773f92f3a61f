"""Hard negatives, exact duplicates and the divergence of sources against brute force, and their defined results at the edges."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import dedup, divergence, negatives
from groundspark.llm.balltree import BallTree, interval

ROWS = "vec_id long, embedding array<double>, label int"


# -- 11: hard negatives


def brute_negatives(rows, is_anchor):
    """Python integers only."""
    good = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if k is not None and i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, v, k) in enumerate(good):
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, own == k) for m, (i, w, own) in enumerate(good) if m != n]
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            window = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(window)]
    return sorted(out)


def some_vectors(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, [float(x) for x in centres[i % 6] + 0.4 * rng.normal(size=dim)] if i % 3 else [float(x) for x in rng.normal(size=dim)], int(rng.integers(0, 4))) for i in range(n)]


def mined(spark, rows, step=5, ddl=ROWS):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, ddl), F.col("id") % step == 0).collect()))


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = some_vectors(400, 8)
    rows += [(400 + k, rows[10][1], k % 4) for k in range(40)]  # one vector again and again
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert len(want) > 500 and mined(spark, rows) == want
    for name, value in (("LEAST", 8), ("MOST", 32), ("SAMPLE", 64), ("SEEDS", 10)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == want


def test_odd_rows_of_negatives(spark):
    rows = some_vectors(40, 4)
    rows += [(50, None, 1), (51, [1.0, None, 0.0, 0.0], 1), (52, [1.0, float("nan"), 0.0, 0.0], 1), (53, [float("inf"), 0.0, 0.0, 0.0], 2), (54, [1.0] * 4, None), (None, [1.0] * 4, 1), (55, [0.0] * 4, 1), (60, [0.0] * 4, 2)]
    rows += [rows[5], rows[5], (10, [0.5] * 4, 3)]  # repeated rows and an id that stands for two vectors
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == []
    extra = spark.createDataFrame(rows, ROWS).withColumns({"row": F.lit("x"), "cell": F.lit(1), "score": F.lit(2), "ID": F.lit("y")})
    assert sorted(map(tuple, negatives.mine(extra, F.col("id") % 5 == 0).collect())) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_large_components(spark):
    rng = random.Random(2)
    big = lambda size: [(i, [size * (1 + rng.random()) for _ in range(4)], i % 2) for i in range(30)]
    rows = big(3e4)
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 5 == 0)
    rows = big(1e6)  # scores around 2^58
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert want and max(r[4] for r in want) > 2**57 and mined(spark, rows) == want
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, big(1e17))


def test_node_pairs_bound_all_products():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 6)), rng.normal(size=(300, 6)) + 1
    a, b = BallTree(x, 9), BallTree(y, 11, np.arange(300) % 3, np.arange(300)[::-1])
    for k in range(len(a.left)):
        low, high = interval(a, k, b, np.arange(len(b.left)))
        for j in range(len(b.left)):
            products = x[a.order[a.start[k] : a.end[k]]] @ y[b.order[b.start[j] : b.end[j]]].T
            assert low[j] <= products.min() and products.max() <= high[j]
    leaves = np.flatnonzero(b.left < 0)
    assert sorted(np.concatenate([b.order[b.start[j] : b.end[j]] for j in leaves])) == list(range(300))
    assert BallTree(np.ones((50, 2)), 4).radius.max() == 0 and set(b.leaf_of(y)) <= set(leaves.tolist())


def test_whole_groups_are_pruned(monkeypatch):
    """Where labels and places agree, most pairs of leaves are never scored."""
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = np.random.default_rng(5)
    labels = np.repeat(np.arange(8), 100)
    x = np.floor(256 * (4 * np.eye(8)[labels] + 0.1 * rng.normal(size=(800, 8))))
    block, scored = negatives.Block(np.arange(800), np.arange(800), labels, x, False), []
    products = block.products
    block.products = lambda v, at: scored.append(len(v) * (at.stop - at.start)) or products(v, at)
    own = np.arange(0, 800, 10)
    anchors = negatives.Anchors(own, labels[own], x[own], np.full(80, -np.inf))
    found = block.search(anchors)
    assert sum(scored) < 0.3 * 800 * 80
    for k in range(80):
        s = np.where((labels == anchors.labels[k]) & (np.arange(800) != anchors.rows[k]), x @ anchors.vectors[k], -np.inf)
        assert found.ids[k, 0].tolist() == np.lexsort((np.arange(800), -s))[:5].tolist()


# -- 12: exact duplicates


def brute_groups(rows):
    """(doc_id, keep_id, group_size): how many rows have it, and how many of them are kept."""
    own = defaultdict(list)
    for i, t in rows:
        own[t or ""].append(i)
    out = Counter()
    for ids in own.values():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), False] += 1
        out[keep, keep, len(ids), False] -= 1
        out[keep, keep, len(ids), True] += 1
    return +out


DOCS = "doc_id long, text string"


def test_groups_equal_brute_force_whatever_the_digest(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(["one text", "two texts", None, "", "x" * 20_000, f"own {i}", f"own {i % 40}", " One text"])) for i in range(400)]
    rows += [(1000 + k, "hot") for k in range(300)] + [(7, "hot")] * 5 + [(None, "hot"), (None, "nameless"), (None, "nameless"), (-1, "one text"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    want = brute_groups(rows)
    counted = lambda d: Counter(tuple(r) for r in d.drop("digest").collect())
    assert counted(dedup.groups(df)) == want
    for weak in (lambda t: F.length(t).cast("string").cast("binary"), lambda t: F.lit(b"same")):
        assert counted(dedup.groups(df, digest=weak)) == want
    monkeypatch.setattr(dedup, "LEAST", 10_000)
    assert counted(dedup.groups(df)) == want
    assert counted(dedup.groups(df.limit(0))) == Counter()


def test_survivors_are_whole_rows(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "z"), (3, None, "n"), (4, "", "m"), (None, "b", "k"), (5, "A", "c"), (6, "q", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumns({"kept": F.lit("old"), "own": F.lit(1), "ROW": F.lit(2)})
    got = dedup.survivors(df)
    assert got.columns == df.columns
    kept = sorted((str(r.doc_id), r.text, r.kept) for r in got.collect())
    assert kept == [("2", "a", "old"), ("4", "", "old"), ("5", "A", "old"), ("6", "q", "old"), ("None", "b", "old")]
    lower = dedup.survivors(df, normal=F.lower)
    assert sorted(str(r.doc_id) for r in lower.collect()) == ["4", "5", "6", "None"]


# -- 13: divergence


def brute_divergence(rows):
    kept, of = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        kept[lang][source].update(found)
        of[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in of[lang].items() if n >= 3]
        shares = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[x] for x in terms) + len(terms)) for t in terms}  # noqa: B023, E731
        p = {s: shares(kept[lang][s]) for s in sources}
        q = shares(sum(kept[lang].values(), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o.encode(), o) for o in sources if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in terms if kept[lang][s][t] and p[s][t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(own)[:200])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(listed)]
    return sorted(out)


def audited(spark, rows, n=5):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(n)
    return sorted(map(tuple, divergence.audit(df).collect()))


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "THE", "und", "Straße", "ÄRGER", "ärger", "naïve", "漢字", "x"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    sources = ["web", "hot", "books", "", None, "Ünï"]
    return [(" ".join(rng.choice(words[: rng.choice((12, 100, 310))]) for _ in range(rng.randint(0, 60))) + rng.choice(["", "!1-2", "\x00a\x7fb", "_"]), rng.choice(["de", "en", None, ""]), rng.choice(sources + ["hot"] * 6)) for _ in range(n)]


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = texts(300) + [("word " * 30_000, "en", "long"), (None, "en", "quiet"), ("alone alone", "fr", "a"), ("alone", "fr", "b"), ("x", "it", "single")]
    want = brute_divergence(rows)
    assert {r[2] for r in want} == {"pair", "term"} and audited(spark, rows) == want
    assert [r[4] for r in want if r[0] == "fr"] == [0, 0] and not [r for r in want if r[0] == "it"]
    assert audited(spark, rows * 2) == brute_divergence(rows * 2)
    extra = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("t"), "n": F.lit(3), "DOCUMENT": F.lit(9), "p": F.lit(1)})
    assert sorted(map(tuple, divergence.audit(extra).collect())) == want
    assert audited(spark, []) == []


def test_runs_and_tables_of_bounded_size_change_nothing(monkeypatch):
    """Small tables, small blocks and runs over many batches: the same rows."""
    import pyarrow as pa

    rows = [(a or "", b or "", c or "", k) for k, (a, b, c) in enumerate(texts(120, 7))]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source", "document"), r, strict=True)) for r in rows[k : k + 10]]) for k in range(0, len(rows), 10)]

    def result(step):
        counted = [r for b in divergence.count_terms(iter(batches)) for r in b.to_pylist()]
        counted.sort(key=lambda r: (r["lang"].encode(), r["term"].encode(), r["source"].encode(), r["document"]))
        cut = [pa.RecordBatch.from_pylist(counted[k : k + step], schema=divergence.RUNS) for k in range(0, len(counted), step)]
        return [r for b in divergence.scan(3)(iter(cut)) for r in b.to_pylist()]

    want = result(10**6)
    shared = [{"lang": r["lang"], "term": r["term"], "source": r["source"], "p": 5 + 7 * r["n"], "p0": 3 + len(r["source"])} for r in want]

    def pairs(step):
        out = Counter()
        for b in divergence.together(iter([pa.RecordBatch.from_pylist(shared[k : k + step]) for k in range(0, len(shared), step)])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["item"]] += r["extra"]
        return out

    both = pairs(10**6)
    assert sum(r["first"] for r in want) == len({(r["lang"], r["term"]) for r in want}) > 100 and len(both) > 20
    for name, value in (("HELD", 50), ("PAIRS", 3), ("BLOCK", 4)):
        monkeypatch.setattr(divergence, name, value)
    assert result(10**6) == want and result(3) == want and pairs(10**6) == both and pairs(2) == both


def test_digests_of_texts(spark):
    row = dedup.groups(spark.createDataFrame([(1, "Grüße")], DOCS)).first()
    assert bytes(row.digest).hex() == hashlib.sha256("Grüße".encode()).hexdigest()


# -- 1, 4, 8, 9: sizes and names that were open


def test_topk_of_large_components(spark):
    from groundspark.llm import topk

    rng = random.Random(6)
    rows = lambda size: [(i, [size * (rng.random() - 0.3) for _ in range(64)]) for i in range(60)]
    for size in (0.5, 3e4, 9e5):
        own = rows(size)
        whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in own]
        want = []
        for q, v in whole[::20]:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
        df = spark.createDataFrame(own, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.search(df, F.col("id") % 20 == 0, 10).collect())) == sorted(want)
    assert 2**61 < max(r[3] for r in want) < 2**63
    with pytest.raises(Exception, match="64 bits"):
        topk.search(spark.createDataFrame(rows(1e17), "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 10).collect()


def test_names_that_differ_in_case_are_replaced(spark):
    from groundspark.llm import bpe, extract, pii

    df = spark.createDataFrame([(1, "mail a@b.co", "<p>Some words of a page.</p>")], "doc_id long, body string, html string").withColumns({c: F.lit("old") for c in ("PII", "Ids", "TEXT", "DEcoded")})
    found = pii.find(df, "body").first()
    assert found.pii[0].kind == "email" and "PII" not in found.asDict()
    coded = bpe.encode(df, bpe.default_vocabulary(), "body", decoded="decoded").first()
    assert coded.decoded == "mail a@b.co" and coded.ids and coded.TEXT == "old"
    assert extract.extract(df).first().text != "old"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>It is <strong>very</strong> good, and <i>cheap</i>.</p>", "It is very good, and cheap."),
        ("<p>H<sub>2</sub>O is water.</p>", "H2O is water."),
        ("<p>See <a href='x'>the link</a>, then <code>run()</code> it.</p><p>Next</p>", "See the link, then run() it.\n\nNext"),
        ("<div><b>Head</b>line <span>goes <em>on</em></span></div>tail", "Headline goes on\n\ntail"),
        ("<p>a<p><b>b</b> c<ul><li>x<li>y</ul>", "a\n\nb c\n\nx\n\ny"),
        ("<p>E=mc<sup>2</sup><br>holds</p>", "E=mc2 holds"),
    ],
)
def test_inline_elements_end_no_block(html, want):
    from groundspark.llm.dom import Page

    page = Page(html)
    assert page.blocks([True] * len(page.tag)) == want


# -- 7: hashes taken where pages are read


def test_fingerprints_equal_the_records_they_stand_for(spark):
    from groundspark.llm import warc
    from groundspark.llm.common import Scratch

    rows = [(k, f"u{k}", "<p>" + "x" * (k % 40) + "</p>") for k in range(300)] + [(5, "u5", "<p>xxxxx</p>"), (7, None, None), (102, "again", "y"), (None, "nameless", "z"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = ("file", "record_id", "length", "digest")
    shown = lambda d: sorted(tuple(r[c] for c in key) for r in d.collect())
    records, prints = warc.placed(pages, 4), warc.fingerprints(pages, 4)
    assert shown(warc.laid_out(pages, 4)) == shown(prints)
    single = spark.createDataFrame(rows[:300], pages.schema)
    assert sorted(map(tuple, warc.laid_out(single, 4).collect())) == sorted(map(tuple, warc.fingerprints(single, 4).drop("bad_length", "bad_digest").collect()))
    bad = warc.left_over(warc.fingerprints(single, 4)).select("file", "offset", "record_id", F.col("bad_length").alias("length"), F.col("bad_digest").alias("digest"))
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, warc.hashed(warc.damaged(warc.placed(single, 4))).collect()))
    assert {r.record_id: r.status for r in warc.audit(prints, warc.left_over(prints).withColumn("digest", F.col("bad_digest")).withColumn("length", F.col("bad_length")), Scratch(spark)).collect()}["5"] == "corrupt"
    ends = prints.orderBy("file", "offset").where("file = 1").collect()
    assert [r.offset for r in ends] == [sum(r.length for r in ends[:k]) for k in range(len(ends))] and records.count() == prints.count()
    node = prints._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().apply(0)
    shuffled = node.children().apply(0).output()
    assert {shuffled.apply(k).name() for k in range(shuffled.size())} == {"file", "page_id", "length", "digest", "bad_length", "bad_digest"}
