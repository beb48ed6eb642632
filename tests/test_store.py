"""The store: what an add reads, writers side by side, batches that are tried again, compaction."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from leakloom.plans.store import BlobStore, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=8)


def ids(spark, *values):
    return spark.createDataFrame([(str(v), int(v)) for v in values], "blob_id string, size long")


def test_an_add_reads_only_buckets_that_may_hold_its_keys(spark, store):
    store.add("blobs", ids(spark, *range(400)), "1")
    store.add("blobs", ids(spark, *range(400, 800)), "2")
    some = ids(spark, 5).withColumns({"row": F.lit(1).cast("long"), "hash": F.xxhash64("blob_id"), "bucket": store._bucket("blobs")})
    met = store._holding("blobs", some, {"b-1", "b-2"})
    read = store._stored("blobs", met)
    folders = {re.search(r"batch=([^/]+)/bucket=(\d+)", r[0]).groups() for r in read.select(F.input_file_name()).distinct().collect()}
    bucket = some.first().bucket
    assert ("b-1", str(bucket)) in folders and folders <= {("b-1", str(bucket)), ("b-2", str(bucket))}
    assert re.search(r"PartitionFilters: \[[^\]]*b-1/", read._jdf.queryExecution().executedPlan().toString())  # other files are not opened
    new = ids(spark, 5000).withColumns({"row": F.lit(1).cast("long"), "hash": F.xxhash64("blob_id"), "bucket": store._bucket("blobs")})
    assert store._known("blobs", new, {"b-1", "b-2"}) is None or store._known("blobs", new, {"b-1", "b-2"}).count() == 0
    assert store.exists("blobs", "5") and not store.exists("blobs", "5000") and not store.exists("rules", "x")


def test_keys_stay_single_and_batches_replace_themselves(spark, store):
    store.add("blobs", ids(spark, 1, 2, 2), "x")
    store.add("blobs", ids(spark, 2, 3), "y")
    store.add("blobs", ids(spark, 3, 4), "y")  # tried again with other rows
    assert sorted(r.size for r in store.read("blobs").collect()) == [1, 2, 3, 4] and store.read("blobs").columns == ["blob_id", "size"]
    assert sorted(r.size for r in store.unseen(ids(spark, 1, 4, 9)).collect()) == [9]
    assert sorted(r.size for r in store.unseen(ids(spark, 1, 4, 9), "y").collect()) == [4, 9]
    store.add("blobs", ids(spark).limit(0), "z")
    assert store.read("blobs").count() == 4


def test_writers_side_by_side_leave_no_key_twice(spark, store):
    store.add("blobs", ids(spark, *range(10)), "0")
    errors = []

    def write(name, low):
        try:
            Store(spark, store.path, 8).add("blobs", ids(spark, *range(low, low + 40)), name)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n, low)) for n, low in (("a", 0), ("b", 5), ("c", 20))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    assert not errors
    assert sorted(r.size for r in store.read("blobs").collect()) == list(range(60))


def test_compaction_keeps_rows_and_filters(spark, store):
    for i in range(6):
        store.add("blobs", ids(spark, *range(i * 5, i * 5 + 8)), f"{i}")
    assert store.compact("blobs", many=10) == 0 and store.compact("blobs", many=5, newest=2) == 4
    assert len(store._names("blobs")) == 3 == len(store._names("_filters/blobs"))
    store.add("blobs", ids(spark, *range(40)), "last")
    assert sorted(r.size for r in store.read("blobs").collect()) == list(range(40))


def test_annotations_and_contents(spark, store, tmp_path):
    note = lambda status, at: spark.createDataFrame([("finding", "f", status, "c", at)], "target_type string, target_id string, status string, comment string, at long")
    store.annotate(note("accept", 1))
    store.annotate(note("reject", 2))
    assert [(r.target_id, r.status) for r in store.annotations().collect()] == [("f", "reject")]
    blobs = BlobStore(spark, str(tmp_path / "contents"))
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("a", bytearray(b"1"))], "blob_id string, content binary")
    assert blobs.missing(rows).count() == 3 and blobs.get(rows.select("blob_id")).count() == 0
    blobs.put(rows, "1")
    blobs.put(rows, "1")
    blobs.put(rows)
    assert sorted((r.blob_id, bytes(r.content)) for r in blobs.get(rows.select("blob_id")).collect()) == [("a", b"1"), ("b", b"2")]
    assert blobs.missing(rows).count() == 0
