"""The index by buckets: what is written, replays, writers that die or meet, and damage."""

import json
import os

import pytest
from pyspark.sql import functions as F

from groundspark.operators import chunking
from groundspark.sources import buckets
from groundspark.streaming.ingest import ingest_buckets


def chunks(spark, docs, dim=3):
    rows = [(f"{d}::{k}", d, k, t, [float(k)] * dim) for d, texts in docs.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_index int, text string, vector array<double>")


def held(spark, root, **more):
    return sorted((r.chunk_id, r.text) for r in buckets.read(spark, root, **more).collect())


def files(root):
    return {os.path.join(a, f): os.path.getmtime(os.path.join(a, f)) for a, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def test_updates_write_their_own_buckets_only(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = {f"d{k}": [f"text {k}", f"more {k}"] for k in range(200)}
    first = buckets.update(root, chunks(spark, docs), "b1", 32)
    assert (first.version, first.chunks, first.documents, first.dimension) == (1, 400, 200, 3)
    before = files(root)
    second = buckets.update(root, chunks(spark, {"d7": ["new"], "fresh": ["x", "y", "z"]}), "b2")
    added = set(files(root)) - set(before)
    assert before.items() <= files(root).items() and 1 <= len(added) <= 2
    changed = {b for b, h in second.held.items() if h[0] == 2}
    assert len(changed) <= 2 and second.chunks == 402 and second.documents == 201
    want = {f"d{k}::{i}": t for k in range(200) for i, t in enumerate(docs[f"d{k}"]) if k != 7} | {"d7::0": "new", "fresh::0": "x", "fresh::1": "y", "fresh::2": "z"}
    assert held(spark, root) == sorted(want.items())
    assert len(held(spark, root, version=1)) == 400
    again = buckets.update(root, chunks(spark, {"d7": ["other"]}), "b2")
    assert again == second and held(spark, root) == sorted(want.items())
    gone = buckets.update(root, chunks(spark, {}), "b3", removed=spark.createDataFrame([("d7",), ("d8",)], "doc_id string"))
    assert gone.documents == 199 and not [c for c, _ in held(spark, root) if c.startswith(("d7:", "d8:"))]


def test_equals_the_whole_rewrite(spark, tmp_path):
    root = str(tmp_path / "index")
    whole = None
    for n, step in enumerate([{"a": ["1", "2"], "b": ["3"]}, {"b": ["4", "5"], "c": []}, {"a": ["6"]}, {}]):
        fresh = chunks(spark, step)
        whole = fresh if whole is None else chunking.replace_documents(whole, fresh)
        buckets.update(root, fresh, str(n), 4)
        assert held(spark, root) == sorted((r.chunk_id, r.text) for r in whole.collect())


def test_half_written_versions_dont_exist_and_damage_is_refused(spark, tmp_path):
    root = str(tmp_path / "index")
    buckets.update(root, chunks(spark, {f"d{k}": ["t"] for k in range(20)}), "b1", 4)
    # A writer died before its manifest: data without one, and one beside that was never renamed.
    chunks(spark, {"x": ["half"]}).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/data/v=2")
    with open(f"{root}/manifests/000000000002.json.dead.tmp", "w") as f:
        f.write('{"version": 2, "buck')
    assert len(held(spark, root)) == 20 and buckets.versions(spark, root) == [1]
    second = buckets.update(root, chunks(spark, {"y": ["whole"]}), "b2")
    assert second.version == 2 and ("y::0", "whole") in held(spark, root) and ("x::0", "half") not in held(spark, root)
    # A file is lost, a bucket is lost, a manifest is cut, a manifest lies.
    bucket, (version, n, _) = next((b, h) for b, h in second.held.items() if h[0] == 1)
    folder = f"{root}/data/v={version}/bucket={bucket}"
    part = next(p for p in os.listdir(folder) if p.endswith(".parquet"))
    os.rename(f"{folder}/{part}", f"{root}/aside")
    with pytest.raises(buckets.DamagedIndex):
        buckets.read(spark, root)
    os.rename(folder, f"{root}/folder")
    with pytest.raises(buckets.DamagedIndex, match="missing"):
        buckets.read(spark, root)
    os.rename(f"{root}/folder", folder)
    os.rename(f"{root}/aside", f"{folder}/{part}")
    assert len(held(spark, root)) == 21
    for crc in (f"{root}/manifests/.000000000002.json.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    name = f"{root}/manifests/000000000002.json"
    good = open(name).read()
    with open(name, "w") as f:
        f.write(good[:50])
    with pytest.raises(buckets.DamagedIndex, match="manifest"):
        buckets.read(spark, root)
    lie = json.loads(good)
    lie["held"][bucket][1] += 1
    with open(name, "w") as f:
        f.write(json.dumps(lie))
    with pytest.raises(buckets.DamagedIndex, match=f"instead of {n + 1}"):
        buckets.read(spark, root)
    with pytest.raises(buckets.DamagedIndex, match="dimension"):
        buckets.read(spark, root, check=False, dimension=5)
    with pytest.raises(buckets.DamagedIndex):
        buckets.read(spark, str(tmp_path / "none"))


def test_vectors_and_columns_must_fit(spark, tmp_path):
    root = str(tmp_path / "index")
    buckets.update(root, chunks(spark, {"a": ["t"]}), "b1", 4)
    with pytest.raises(ValueError, match="dimensions"):
        buckets.update(root, chunks(spark, {"b": ["t"]}, 5), "b2")
    with pytest.raises(ValueError, match="columns"):
        buckets.update(root, chunks(spark, {"b": ["t"]}).drop("vector"), "b2")
    assert held(spark, root) == [("a::0", "t")]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    buckets.update(root, chunks(spark, {"a": ["1"]}), "b1", 2)
    publish, calls = buckets._Files.publish, []

    def late(self, name, text):
        calls.append(name)
        if len(calls) == 1:  # another writer is first
            buckets.update(root, chunks(spark, {"b": ["2"]}), "other")
        return publish(self, name, text)

    monkeypatch.setattr(buckets._Files, "publish", late)
    made = buckets.update(root, chunks(spark, {"c": ["3"]}), "mine")
    assert made.version == 3 and held(spark, root) == [("a::0", "1"), ("b::0", "2"), ("c::0", "3")]


def test_prune_keeps_what_versions_share(spark, tmp_path):
    root = str(tmp_path / "index")
    for n in range(4):
        buckets.update(root, chunks(spark, {f"d{n}": ["t"], "same": [str(n)]}), str(n), 8)
    want = held(spark, root)
    assert buckets.prune(spark, root, 1) == [4] and held(spark, root) == want
    assert {f.split("/data/")[1].split("/part")[0] for f in files(root)} == {f"v={h[0]}/bucket={b}" for b, h in buckets.manifest(spark, root).held.items()}


def test_streamed_batches_and_replays(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    put = lambda rows: spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("doc_id string, text string").parquet(source)
    put([("a", "old a"), ("b", "old b")])
    ingest_buckets(stream(), root, str(tmp_path / "ck"), 4).awaitTermination()
    put([("a", "new a"), ("c", None)])
    ingest_buckets(stream(), root, str(tmp_path / "ck"), 4).awaitTermination()
    assert [t for _, t in held(spark, root)] == ["new a", "old b"] and buckets.versions(spark, root) == [1, 2]
    for name in ("1", ".1.crc"):  # the batch ran, but its end wasn't noted
        os.remove(tmp_path / "ck" / "commits" / name)
    ingest_buckets(stream(), root, str(tmp_path / "ck"), 4).awaitTermination()
    assert buckets.versions(spark, root) == [1, 2]


def test_cached_replies_are_one_row_a_key(spark, tmp_path, monkeypatch):
    from groundspark.operators import drafting
    from groundspark.sources import readers, sinks

    path = str(tmp_path / "cache")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "key string, reply string")
    got = lambda: sorted(map(tuple, readers.replies(spark, path).collect()))
    assert got() == []
    requests = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "key string, n int")
    hits, misses = drafting.cached(requests, readers.replies(spark, path))
    assert hits.count() == 0 and sorted(r.key for r in misses.collect()) == ["k1", "k2"]
    sinks.store_replies(rows(("k1", "a"), ("k1", "b"), ("k2", "c")), path, "first")
    sinks.store_replies(rows(("k1", "a"), ("k1", "b"), ("k2", "c")), path, "first")
    assert got() == [("k1", "b"), ("k2", "c")] and buckets.versions(spark, path) == [1]
    assert sorted(r.n for r in drafting.cached(requests, readers.replies(spark, path))[0].collect()) == [1, 2, 3]
    publish, calls = buckets._Files.publish, []

    def late(self, name, text):
        calls.append(name)
        if len(calls) == 1:  # two callers missed the same and other keys
            sinks.store_replies(rows(("k2", "other"), ("k3", "other")), path)
        return publish(self, name, text)

    monkeypatch.setattr(buckets._Files, "publish", late)
    sinks.store_replies(rows(("k2", "mine"), ("k4", "mine")), path)
    assert got() == [("k1", "b"), ("k2", "mine"), ("k3", "other"), ("k4", "mine")]


def test_index_in_a_folder_is_checked_against_its_record(spark, tmp_path):
    from groundspark.sources import readers, sinks

    path = str(tmp_path / "index")
    sinks.save_index(chunks(spark, {"a": ["1", "2"], "b": ["3"]}), path)
    assert readers.index(spark, path, 3).count() == 3
    chunks(spark, {"c": ["4"]}).write.mode("append").parquet(path)
    with pytest.raises(buckets.DamagedIndex, match="chunks"):
        readers.index(spark, path)
