"""The native chunker against the Arrow one and against the rule written out."""

import random

import pytest

from groundspark.operators import chunking


def awkward():
    rng = random.Random(4)
    own = ["", "   ", "word " * 2000, "x" * 5000, "a " + "b" * 3000 + " c", "ends with a space ", "tab\tand\nline " * 200, "ünï cödé 漢字 😀 " * 300, "a b " * 3, "\x1cfile\x1dseparators\x1f " * 100, " " * 900 + "late" + " " * 900, "long" * 10_000]
    own += ["".join(rng.choice("ab \n\t é漢") * rng.choice((1, 1, 1, 30)) for _ in range(rng.randint(1, 3000))) for _ in range(40)]
    return [(str(k), t) for k, t in enumerate(own)] + [("none", None), ("long", " ".join(rng.choice(("word", "s", "x" * 90)) for _ in range(30_000)))]


@pytest.mark.parametrize(("size", "overlap"), [(800, 120), (2000, 240), (40, 7), (9, 2)])
def test_native_chunks_equal_the_others(spark, size, overlap):
    texts = [(d, t if size > 100 or t is None else t[:3000]) for d, t in awkward()]
    df = spark.createDataFrame(texts, "doc_id string, text string").repartition(4)
    order = ("doc_id", "chunk_index")
    want = [tuple(r) for r in chunking.chunk(df, size, overlap).orderBy(*order).collect()]
    assert len(want) > 100 and [tuple(r) for r in chunking.native_chunk(df, size, overlap).orderBy(*order).collect()] == want
    plain = {(d, i): (p, a, b) for d, t in texts for i, a, b, p in chunking.spans((t or "").strip(), size, overlap)}
    assert {(r[1], r[2]): r[3:] for r in want} == plain


def test_native_chunks_need_no_python(spark):
    df = spark.createDataFrame([("a", "b c")], "doc_id string, text string")
    plan = chunking.native_chunk(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        chunking.native_chunk(df, 100, 90)
