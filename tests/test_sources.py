"""Readers, writers and the streaming extension."""

import json

import pytest
from pyspark.sql import functions as F

from groundspark.batches import ROWS_OF_A_BATCH, TEXTS
from groundspark.operators import chunking
from groundspark.sources import readers, sinks
from groundspark.streaming.ingest import ingest


def test_question_rows(spark):
    rows = spark.createDataFrame([(7, "Who?", '["a","b"]', "", "Subj", "occ"), (8, "What?", "plain", None, "", "occ")], "id long, question string, possible_answers string, s_wiki_title string, subj string, prop string")
    got = readers.qa_examples(rows).orderBy("qid").collect()
    assert (got[0].qid, got[0].answers, got[0].subject_title) == ("7", ["a", "b"], "Subj") and (got[1].answers, got[1].subject_title) == (["plain"], "")


def test_long_answers(spark, tmp_path):
    path = tmp_path / "asqa.json"
    path.write_text(json.dumps([{"sample_id": "s", "question": "q", "answer": "long", "qa_pairs": [{"short_answers": ["x", "y"]}, {"short_answers": ["z"]}], "docs": [{"id": "1", "title": "T", "text": "body"}, {"id": "2", "title": "", "text": "bare"}]}]))
    rows = readers.asqa(spark, str(path))
    assert rows.select(readers.all_short_answers(rows["short_answer_sets"]).alias("a")).first().a == ["x", "y", "z"]
    got = readers.supplied_context(rows, 5).orderBy("passage_no").collect()
    assert [(r.chunk_id, r.text) for r in got] == [("alce-s::0", "T\nbody"), ("alce-s::1", "bare")]


def test_last_duplicate_wins_and_resume(spark):
    lines = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "title string, text string, line_no long")
    assert readers.corpus(lines).first().text == "new"
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "title string, pos long")
    assert [(r.title, r.pos) for r in readers.titles_to_fetch(wanted, lines).collect()] == [("b", 2)]


def test_uploads(spark):
    files = spark.createDataFrame([("good.txt", bytearray(b"hi")), ("bad.zip", bytearray(b"x")), ("broken.pdf", bytearray(b"x")), ("latin.md", bytearray("é".encode("latin-1"))), ("none", None)], "filename string, content binary")
    got = {r.filename: (r.text, r.error is None) for r in readers.extracted(files).collect()}
    assert got["good.txt"] == ("hi", True) and got["latin.md"] == ("é", True)
    assert not got["bad.zip"][1] and not got["broken.pdf"][1] and not got["none"][1]


def test_admission(spark):
    rows = [(1, 0, "a.txt", 5, None), (1, 1, "b.txt", 0, None), (1, 2, "c.x.txt", 200, None), (1, 3, "d.txt", 5, "bad"), (1, 4, "e.txt", 900, None), (1, 5, "f.txt", 1, None)]
    got = {r.filename: r.status for r in readers.admission(spark.createDataFrame(rows, "request_id long, pos int, filename string, n_bytes long, error string"), 1000, 100).collect()}
    assert got == {"a.txt": "indexed", "b.txt": "skipped", "c.x.txt": "skipped", "d.txt": "failed", "e.txt": "skipped", "f.txt": "skipped"}


def test_result_values(spark):
    df = spark.createDataFrame([('{"a": {"b": 0.5}}',), ("broken",)], "j string")
    assert [r[0] for r in df.select(readers.result_value(df["j"], "a.b")).collect()] == [0.5, None]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0.5, "x|y"), ("B", None, "z")], "variant string, rate double, note string")
    sinks.write_csv(rows, str(tmp_path / "csv"), ["variant", "rate"])
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == "variant,rate\nA,0.5000\nB,\n"
    assert "x\\|y" in sinks.markdown(rows)
    got = readers.ablation_rows(spark, str(tmp_path / "csv"), ("rate",)).orderBy("variant").collect()
    assert [r.rate for r in got] == [0.5, None]
    sinks.save_index(rows, str(tmp_path / "index"))
    assert readers.index(spark, str(tmp_path / "index"), 2).count() == 2


def test_synthetic_documents_repeat(spark):
    make = lambda: [r.text for r in readers.synthetic_documents(spark, 3, 5, ["a", "b", "c"]).orderBy("doc_id").collect()]
    assert make() == make() and all(len(t.split()) == 5 for t in make())


def test_streamed_documents_replace_older_versions(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    put = lambda rows: spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.mode("append").parquet(source)
    put([("a", "old a"), ("b", "old b")])
    stream = lambda: spark.readStream.schema("doc_id string, text string").parquet(source)
    ingest(stream(), root, str(tmp_path / "ck")).awaitTermination()
    put([("a", "new a")])
    ingest(stream(), root, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{root}/v=1").collect()) == ["new a", "old b"]


@pytest.mark.parametrize("made", [lambda df: readers.extracted(df.select(F.lit("a.txt").alias("filename"), F.lit(b"a").alias("content"))), lambda df: chunking.chunk(df.select(F.col("id").alias("doc_id"), F.lit("a").alias("text")))])
def test_python_workers_get_small_batches_of_texts(spark, made):
    """A worker holds a batch several times over, and rows are whole files."""
    before = spark.conf.get(ROWS_OF_A_BATCH)
    try:
        for now, want in (("10000", TEXTS), ("0", TEXTS), ("7", 7)):
            spark.conf.set(ROWS_OF_A_BATCH, now)
            assert made(spark.range(600)).count() == 600 and int(spark.conf.get(ROWS_OF_A_BATCH)) == want
    finally:
        spark.conf.set(ROWS_OF_A_BATCH, before)
