"""Documents to chunks with stable ids, and the replacement of documents in an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.batches import small_batches
from groundspark.functions.text import normalize_doc_id
from groundspark.settings import SETTINGS

KIND = "doc_id string, chunk_index int, text string, start_char int, end_char int"


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(index, start, end, text) of each non-empty piece of a stripped text.

    A piece ends at the last space of its final quarter if there is one; the next begins ``overlap`` before that end,
    moved back to the start of a word.
    """
    n, start, index = len(text), 0, 0
    while start < n:
        end = min(start + size, n)
        if end < n and (space := text.rfind(" ", end - size // 4, end)) > start:
            end = space
        piece = text[start:end].strip()
        if piece:
            yield index, start, end, piece
            index += 1
        if end >= n:
            return
        after = max(end - overlap, start + 1)
        if not text[after - 1].isspace() and (space := text.rfind(" ", start, after)) > start:
            after = space + 1
        start = after


def chunk(documents: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """chunk_id, doc_id, chunk_index, text, start_char, end_char. Empty and null documents give no chunks."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *s) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in spans((t or "").strip(), size, overlap)]
            columns = ([r[k] for r in rows] for k in (0, 1, 4, 2, 3))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "chunk_index", "text", "start_char", "end_char"])

    made = documents.select(normalize_doc_id(F.col("doc_id").cast("string")).alias("doc_id"), "text").mapInArrow(run, KIND)
    return made.select(F.concat_ws("::", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text", "start_char", "end_char")


#: Characters that the native chunker looks at together; offsets into a text cost time in proportion to them.
WINDOW = 16_384
#: White space as Python's str.isspace has it.
SPACE = r"[\s\x1c-\x1f]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable isn't inlined, as a repeated expression would be."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _last_space(text: Column, start: Column, end: Column) -> Column:
    """The place of the last space in text[start:end], counted from 0, or -1."""
    back = F.locate(" ", F.reverse(F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))))
    return F.when(back > 0, end - back).otherwise(F.lit(-1))


def _step(state: Column, window: Column, base: Column, n: Column, size: int, overlap: int) -> Column:
    """The state after one more piece: where the next one starts (n behind the last) and the pieces so far."""
    s, rest = state["start"] - base, n - base

    def placed(end: Column) -> Column:
        def moved(after: Column) -> Column:
            word = _let(_last_space(window, s, after), lambda space: F.when(space > s, space + 1).otherwise(after))
            start = F.when(end >= rest, n).when(F.rlike(F.substring(window, after, F.lit(1)), F.lit("(?U)" + SPACE)), base + after).otherwise(base + word)
            piece = F.struct(state["start"].alias("start_char"), (base + end).alias("end_char"), _trimmed(F.substring(window, s + 1, end - s)).alias("text"))
            return F.struct(start.alias("start"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))

        return _let(F.greatest(end - overlap, s + 1), moved)

    def cut(full: Column) -> Column:
        space = _last_space(window, F.greatest(full - size // 4, F.lit(0)), full)
        return _let(F.when(full < rest, _let(space, lambda at: F.when(at > s, at).otherwise(full))).otherwise(full), placed)

    return _let(F.least(s + size, rest), cut)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def native_chunk(documents: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """The same rows as ``chunk`` without a Python worker: a state machine as an ``aggregate`` over a bounded number of steps.

    A text is walked in windows of WINDOW characters, so the time follows its length. Two steps advance by three quarters of a
    piece less the overlap at least: after one that is moved back over a long word, the next isn't. That bounds the steps of a window.
    """
    advance = size - size // 4 - overlap
    if overlap >= size or advance < 1:
        raise ValueError("overlap must be smaller than three quarters of the chunk size")
    steps = 2 * (-(-WINDOW // advance)) + 2
    none = F.array().cast("array<struct<start_char:int,end_char:int,text:string>>")

    def walked(text: Column) -> Column:
        n = F.length(text)

        def through(state: Column, block: Column) -> Column:
            base = block * WINDOW

            def inside(window: Column) -> Column:
                at = F.struct(state["start"].alias("start"), none.alias("pieces"))
                go = lambda x: (x["start"] < base + WINDOW) & (x["start"] < n)
                end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), at, lambda x, _: F.when(go(x), _step(x, window, base, n, size, overlap)).otherwise(x))
                return _let(end, lambda x: F.struct(x["start"].alias("start"), F.concat(state["pieces"], x["pieces"]).alias("pieces")))

            return _let(F.substring(text, base + 1, F.lit(WINDOW + size)), inside)

        blocks = F.sequence(F.lit(0), F.floor(n / WINDOW).cast("int"))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("start"), none.alias("pieces")), through, lambda x: F.filter(x["pieces"], lambda p: p["text"] != ""))

    made = documents.select(normalize_doc_id(F.col("doc_id").cast("string")).alias("doc_id"), _trimmed(F.coalesce("text", F.lit(""))).alias("text"))
    each = made.select("doc_id", F.posexplode(walked(F.col("text"))).alias("chunk_index", "p"))
    return each.select(F.concat_ws("::", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "p.text", "p.start_char", "p.end_char")


def bulk_chunk(documents: DataFrame) -> DataFrame:
    return chunk(documents, SETTINGS.bulk_size, SETTINGS.bulk_overlap)


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def repeated_ids(documents: DataFrame) -> DataFrame:
    """Normalised ids that several raw ids of one batch share; an ingest refuses them."""
    ids = documents.select(F.col("doc_id").alias("raw"), normalize_doc_id(F.col("doc_id").cast("string")).alias("doc_id"))
    return ids.groupBy("doc_id").agg(F.count_distinct("raw").alias("n_raw")).where("n_raw > 1")


def replace_documents(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index after new chunks came in: documents with new chunks lose their old ones, those without keep them."""
    return index.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)
