"""The registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from groundspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    return f"{v:.7g}" if isinstance(v, float) else repr(v)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(told(v) for v in r) for r in df.select(*[df[c] for c in names]).collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(told(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert got == want


def test_blank_answers_equal_sql(spark, tmp_path):
    """Texts that are empty or blank at the end that the answer is taken from, and blank sources."""
    import duckdb

    texts = ["src1 fell. It rained.", "", "  ", "\n The src1 road.", "\tsrc1", None, "The end. ", "Roads end.\n"]
    docs = [(len(texts) * i + j, text, source) for i, source in enumerate(["src1", "", " ", "The", None]) for j, text in enumerate(texts)]
    turns = [(j, t, r, text) for j, text in enumerate(texts) for t, r in ((1, "user"), (2, "assistant"))]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("str_em", "citation_bench"):
        df = catalogue.queries()[name](spark, str(tmp_path))
        got = sorted(tuple(told(v) for v in r) for r in df.collect())
        result = con.execute(catalogue.oracle_sql()[name])
        assert [c[0] for c in result.description] == df.columns
        assert got == sorted(tuple(told(v) for v in r) for r in result.fetchall()), name


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
