"""How far the sources of a language differ in their words, by sorting and scanning runs.

1. Each task counts the terms of its own documents into sorted runs (lang, term, source, first document, documents, count), so
   a term that every document has leaves a task once for each source, not once for each document. Tables of a task are
   emitted whenever they hold HELD entries, which bounds memory.
2. Runs are dealt by (lang, term), sorted by (lang, term, source, document) and scanned as a stream: where (lang, term)
   changes, a run has ended, with its document frequency, its count, and the count of each source. Terms of too few
   documents end here. Rows of one term are at most one for each source and task (or emitted table), however frequent it is.
3. Kept terms with the sums of their groups are sorted and scanned once more: each run of a term emits what its sources add to
   the divergence of their pairs (summed over a task before it is emitted), and its terms' own values.

Smoothed shares are integers, p = 1 + floor(UNIT * (count + 1) / (N + V)), and the divergence of p from q over a term is
f(p, q) = floor((p - q)^2 / q). A pair's value sums f over all kept terms of the language, also those that one or both
sources lack. With p0 for the share of a term that a source lacks,

    sum f(p, q) = V f(p0, q0) + sum over g's terms [f(p, q0) - f(p0, q0)] + sum over h's terms [f(p0, q) - f(p0, q0)]
                  + sum over common terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

so scans only see sources that have a term; the middle sums come from how often each count occurs in a source. A task emits
a row for each pair of sources that it has met, which is the size of the result, not of the data.

Contract: null text, lang and source count as ''. A document is a row, so repeated rows count each; further columns are
ignored. A language without kept terms gives its pairs the value 0; one with a single source gives no pairs; an empty table
gives an empty one. Values and counts beyond 64 bits raise an error, as Spark's ANSI arithmetic does.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundspark.llm.common import BYTES_OF_A_BATCH, Scratch, batches_of, lean, table

#: A share of 1; documents that a kept term is in; ranks of terms.
UNIT, LEAST_DOCUMENTS, TOP_TERMS = 1_000_000_000, 3, 200
#: Entries of a task's table of terms, of its table of pairs, and of one block of products.
HELD, PAIRS, BLOCK = 1_000_000, 2_000_000, 1 << 18
#: Bytes of one Arrow batch of texts, if no single text is longer.
TEXT_BYTES = 4 << 20
#: Letters and everything beyond ASCII, of lower-cased bytes.
TERM = re.compile(rb"[a-z\x80-\xff]+")

RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("documents", pa.int64()), ("n", pa.int64())])
RUNS_DDL = "lang string, term string, source string, document long, documents long, n long"
KEPT_DDL = "lang string, term string, source string, n long, total long, documents long, first int"


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # bytes.lower changes A to Z only


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 1: (text, lang, source, document) to runs."""
    documents: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
    counts: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
    first = held = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, source in sorted(counts):
            own, n = counts[lang, source], documents[lang, source]
            listed = sorted(own)
            for k in range(0, len(listed), 65_536):
                some = listed[k : k + 65_536]
                same = lambda value: pa.array([value], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(len(some), np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), pa.array(some, pa.binary()).cast(pa.string()), same(source), pa.array(np.full(len(some), first)), pa.array([n[t] for t in some], pa.int64()), pa.array([own[t] for t in some], pa.int64())], schema=RUNS)
        documents.clear()
        counts.clear()

    for batch in batches:
        raw = [batch.column(c).cast(pa.binary()).to_pylist() for c in ("text", "lang", "source")]
        for text, lang, source, document in zip(*raw, batch.column("document").to_pylist(), strict=True):
            if not counts:
                first = document
            found = terms_of(text)
            own = counts[lang, source]
            held -= len(own)
            own.update(found)
            held += len(own)
            documents[lang, source].update(set(found))
            if held > HELD:
                yield from emit()
                held = 0
    yield from emit()


def changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The batches of a sorted stream, cut so that no run of equal keys is divided. A run that spans batches is held back."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(changes(*(batch.column(k) for k in keys)))
        joined = bool(rest) and all(rest[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if rest and not joined:
            yield pa.Table.from_batches(rest)
            rest = []
        if len(starts) > 1:
            yield pa.Table.from_batches([*rest, batch.slice(0, starts[-1])])
            rest = [batch.slice(starts[-1])]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def scan(least: int):
    """Stage 2: over runs sorted by (lang, term, source, document), the kept terms: a row for each source that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("lang", "term")):
            t = t.combine_chunks()
            lang, term, source = (t.column(c).combine_chunks() for c in ("lang", "term", "source"))
            new_term = changes(lang, term)
            starts = np.flatnonzero(new_term | changes(source))
            n, documents = (np.add.reduceat(t.column(c).to_numpy(), starts) for c in ("n", "documents"))
            heads = np.flatnonzero(new_term[starts])  # among the sources' runs
            size = np.diff([*heads, len(starts)])
            total, spread = (np.repeat(np.add.reduceat(x, heads), size) for x in (n, documents))
            good = np.flatnonzero(spread >= least)
            at = pa.array(starts[good])
            yield pa.RecordBatch.from_arrays([lang.take(at), term.take(at), source.take(at), *(pa.array(x[good]) for x in (n, total, spread)), pa.array(new_term[starts][good].astype(np.int32))], names=["lang", "term", "source", "n", "total", "documents", "first"])

    return run


def kept_terms(docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, source, n (occurrences there), total (in the language), documents, first (1 on one row of each term)."""
    rows = docs.withColumn("document", F.monotonically_increasing_id())
    dealt = rows.mapInArrow(lean(count_terms), RUNS_DDL).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    with batches_of(docs.sparkSession, TEXT_BYTES, BYTES_OF_A_BATCH):
        return scratch.keep(dealt.mapInArrow(scan(least), KEPT_DDL))


def share(n, size: str = "size", terms: str = "terms"):
    """The smoothed share of a term that occurs ``n`` times, as an integer."""
    return F.expr(f"1L + (CAST({UNIT}L AS DECIMAL(38, 0)) * ({n} + 1L)) div ({size} + {terms})")


def apart(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 3: over (lang, term, source, p, p0) sorted by (lang, term, source), what common terms add to the pairs of each language."""
    held: dict[str, tuple[list[str], dict[str, int], dict[int, int]]] = {}

    def emit(lang: str) -> Iterator[pa.RecordBatch]:
        names, _, sums = held.pop(lang)
        codes = np.fromiter(sums.keys(), np.int64, len(sums))
        values = np.fromiter(sums.values(), np.int64, len(sums))
        for k in range(0, len(codes), 65_536):
            some = codes[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([names[c] for c in some >> 32]), pa.array([names[c] for c in some & 0xFFFFFFFF]), pa.array(values[k : k + 65_536])], names=["lang", "source", "item", "extra"])

    for t in runs(batches, ("lang", "term")):
        t = t.combine_chunks()
        langs, terms, sources = (t.column(c).combine_chunks() for c in ("lang", "term", "source"))
        p, p0 = t.column("p").to_numpy(), t.column("p0").to_numpy()
        edges = [*np.flatnonzero(changes(langs)), len(langs)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            lang = langs[int(a)].as_py()
            for other in [x for x in held if x != lang]:
                yield from emit(other)
            names, known, sums = held.setdefault(lang, ([], {}, {}))
            listed = sources.slice(a, b - a).dictionary_encode()
            own = []
            for name in listed.dictionary.to_pylist():
                if name not in known:
                    known[name] = len(names)
                    names.append(name)
                own.append(known[name])
            code = np.array(own, np.int64)[listed.indices.to_numpy()]
            starts = np.flatnonzero(changes(terms.slice(a, b - a)))
            sizes = np.diff([*starts, b - a])
            for k in np.unique(sizes[sizes > 1]):
                heads = starts[sizes == k]
                step = max(1, BLOCK // int(k * k))
                for c in range(0, len(heads), step):
                    rows = a + heads[c : c + step, None] + np.arange(k)
                    for d in range(0, k, max(1, BLOCK // int(k))):  # of very many sources some at a time
                        pair_sums(code[rows - a], p[rows], p0[rows], slice(d, d + max(1, BLOCK // int(k))), sums)
                        if len(sums) > PAIRS:
                            yield from emit(lang)
                            names, known, sums = held.setdefault(lang, (names, known, {}))
    for lang in list(held):
        yield from emit(lang)


def pair_sums(code: np.ndarray, p: np.ndarray, p0: np.ndarray, some: slice, sums: dict[int, int]) -> None:
    """Adds what terms add to each ordered pair of the sources that have them; a row for each term."""
    g, h = slice(None), np.newaxis
    far = lambda x, y: (x - y) * (x - y) // y
    own, own0 = p[:, some, h], p0[:, some, h]
    his, his0 = p[:, h, g], p0[:, h, g]
    value = far(own, his) - far(own, his0) - far(own0, his) + far(own0, his0)
    pairs, at = np.unique((code[:, some, h] << 32 | code[:, h, g]).ravel(), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, at.ravel(), value.ravel())
    for k, v in zip(pairs.tolist(), total.tolist(), strict=True):
        if k >> 32 != k & 0xFFFFFFFF:
            sums[k] = sums.get(k, 0) + v


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    scratch = Scratch(df.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = df.select(blank(text).alias("text"), blank(lang).alias("lang"), blank(source).alias("source"))
    kept = kept_terms(docs, scratch)
    langs = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    # A source's share of a term that it lacks; of no use where there are no terms.
    lacking = F.when(F.col("terms") > 0, share("0"))
    groups = scratch.keep(groups.withColumn("p0", lacking))
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share("n"))

    common = rows.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    extra = common.mapInArrow(together, "lang string, source string, item string, extra long").groupBy("lang", "source", "item").agg(F.sum("extra").alias("value"))
    # How often each share occurs in a source, against every other source of the language.
    often = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = often.join(other, "lang").where("source <> item")
    between = lambda p, q: F.col("n") * (apart(p, q) - (apart("p0", "q0") if p == "p" else apart("q0", "p0")))
    lone = met.select("lang", "source", "item", between("p", "q0").alias("value"))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), between("q0", "p").alias("value"))
    every = groups.select("lang", "source", "terms", "p0").join(other, "lang").where("source <> item")
    base = every.select("lang", "source", "item", F.coalesce(F.col("terms") * apart("p0", "q0"), F.lit(0)).alias("value"))
    pairs = base.unionByName(lone).unionByName(back).unionByName(extra).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = rows.withColumn("q", share("total", "lang_size"))
    terms = q.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term")))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS t FROM documents),
words AS (SELECT d, lang, source, unnest(t) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
sums AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(z.n, 0) + s.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.total + 1)) // (s.n + s.v))::BIGINT AS q
  FROM groups g JOIN sums s ON s.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN sizes z ON z.lang = g.lang AND z.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM listed) WHERE part = 'pair' OR rank <= 200
"""
