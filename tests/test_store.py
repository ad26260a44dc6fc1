import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.operators import ingest as I
from vecframe.streaming.store import KeyedStore, start_store_upsert

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
BATCH = "id long, seq long, text string"


def store_of(spark, path, n=2000, buckets=8):
    store = KeyedStore(spark, os.path.join(path, "store"), "id", SCHEMA, buckets)
    store.create(spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("text")))
    return store


def files(store):
    root = os.path.join(store.path, "data")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def content(store, version=None):
    rows = store.read(version).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.text for r in rows}


def test_upserts_touch_only_their_buckets(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path)
    before = files(store)
    store.upsert(spark.createDataFrame([(5, 1, "old"), (5, 2, "new"), (9999, 1, "ins")], BATCH), "seq", 1)
    after = files(store)
    assert {f: t for f, t in after.items() if f in before} == before
    assert 1 <= len(set(after) - set(before)) <= 2  # a delta for each bucket with a key
    wanted = {i: f"t{i}" for i in range(2000)} | {5: "new", 9999: "ins"}
    assert content(store) == wanted
    assert content(store, 0) == {i: f"t{i}" for i in range(2000)}  # the older version is still whole


def test_many_batches_against_a_dict_and_compaction(spark, tmpdir_path):
    store, wanted = store_of(spark, tmpdir_path, 300, 4), {i: f"t{i}" for i in range(300)}
    for v in range(1, 12):
        rows = [((v * 37 + i) % 320, i, f"v{v}-{i}") for i in range(12)]
        store.upsert(spark.createDataFrame(rows, BATCH), "seq", v)
        for i, _, text in sorted(rows, key=lambda r: r[1]):
            wanted[i] = text
        assert content(store) == wanted
    folders = store.folders()
    assert any(f["kind"] == "base" and f["v"] > 0 for f in folders)  # compacted
    assert max(sum(f["kind"] == "delta" and f["bucket"] == b for f in folders) for b in range(4)) < 8


def test_replay_and_unfinished_versions(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path, 50, 4)
    batch = spark.createDataFrame([(1, 1, "a"), (60, 1, "b")], BATCH)
    store.upsert(batch, "seq", 1)
    first = content(store)
    store.upsert(batch, "seq", 1)
    assert content(store) == first and store.versions() == [0, 1]
    os.remove(os.path.join(store.path, "manifest", "v=1", "_SUCCESS"))  # as if the batch had broken off
    assert content(store) == {i: f"t{i}" for i in range(50)}
    store.upsert(batch, "seq", 1)
    assert content(store) == first


def test_readers_are_unharmed_by_expiry(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path, 100, 2)
    reader = store.read()
    for v in range(1, 6):
        store.upsert(spark.createDataFrame([(i, v, f"v{v}") for i in range(100)], BATCH), "seq", v)
    assert store.expire(retain_seconds=3600) == 0
    assert {r.text for r in reader.collect()} == {f"t{i}" for i in range(100)}
    assert store.expire(retain_seconds=-1) > 0
    assert store.versions() == [4, 5] and set(content(store).values()) == {"v5"} and set(content(store, 4).values()) == {"v4"}


def test_bad_input(spark, tmpdir_path):
    store = store_of(spark, tmpdir_path, 10, 2)
    with pytest.raises(Exception, match="no key"):
        store.upsert(spark.createDataFrame([(None, 1, "x")], BATCH), "seq", 1)
    assert store.versions() == [0]
    store.upsert(spark.createDataFrame([], BATCH), "seq", 1)
    assert len(content(store)) == 10
    with pytest.raises(ValueError):
        KeyedStore(spark, "x", "id", T.StructType([*SCHEMA.fields, T.StructField("V", T.LongType())]))
    empty = KeyedStore(spark, os.path.join(tmpdir_path, "none"), "id", SCHEMA)
    assert empty.read().count() == 0
    empty.upsert(spark.createDataFrame([(1, 1, "a")], BATCH), "seq", 0)
    assert content(empty) == {1: "a"}


def test_stream_into_the_store(spark, tmpdir_path):
    store, src, ck = store_of(spark, tmpdir_path, 20, 4), *(os.path.join(tmpdir_path, x) for x in ("src", "ck"))
    schema = T.StructType([SCHEMA["id"], T.StructField("seq", T.LongType()), SCHEMA["text"]])
    wanted = {i: f"t{i}" for i in range(20)}
    for step in ([(1, 1, "a"), (2, 1, "b"), (2, 2, "b2")], [(2, 3, "b3"), (30, 1, "c")]):
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(src)
        start_store_upsert(store, src, schema, ck).awaitTermination()
        wanted |= {i: t for i, _, t in step}
        assert content(store) == wanted
    assert store.versions() == [0, 1, 2]


def test_newest_rows_agree_with_the_aggregate_and_need_no_sorted_one(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "x"), (2, None, "x"), (3, 5, None), (3, 4, "y"), (4, 1, "same"), (4, 1, "same")]
    batch = spark.createDataFrame(rows, BATCH)
    got = I.newest_rows(batch, "id", "seq", ["text"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, I._latest(batch, "id", "seq", ["text"]).collect()))
    named = batch.withColumn("seq", F.format_string("%05d", "seq"))  # a sequence that is no number
    assert sorted(map(tuple, I.newest_rows(named.where("id <> 2"), "id", "seq", ["text"]).collect())) == sorted(tuple(r) for r in got.collect() if r.id != 2)
    huge = spark.createDataFrame([(1, 2**63 - 1, "z"), (1, -(2**63), "a"), (2, -(2**63), "b"), (2, None, "c")], BATCH)
    assert sorted(map(tuple, I.newest_rows(huge, "id", "seq", ["text"]).collect())) == [(1, "z"), (2, "b")]
    first = I.newest_rows(batch, "id", "seq", ["text"], newest=False)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, I._latest(batch, "id", "seq", ["text"], newest=False).collect()))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_null_keys_never_conflict(spark):
    base = spark.createDataFrame([(1, "a"), (None, "n")], "id long, text string")
    batch = spark.createDataFrame([(1, 1, "b"), (None, 1, "x"), (None, 2, "x"), (2, 1, "c")], BATCH)
    up = I.upsert_last_wins(base, batch, "id", "seq")
    assert sorted(map(str, map(tuple, up.collect()))) == sorted(map(str, [(1, "b"), (2, "c"), (None, "n"), (None, "x"), (None, "x")]))
    ignored = I.insert_ignore(base, batch, "id", "seq")
    assert sorted(map(str, map(tuple, ignored.collect()))) == sorted(map(str, [(1, "a"), (2, "c"), (None, "n"), (None, "x"), (None, "x")]))
    for plan in (up, ignored):
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
