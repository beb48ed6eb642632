"""A store of scans: tables that grow by batches, each dealt over buckets by its key, with a Bloom filter a bucket.

An add looks its keys up in the filters of the buckets that they fall into, and reads only the
buckets of the batches that may hold one. Filters are tables too; nothing is gathered but the names
of what is to be read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.session import _hadoop, drop_path, materialize, ship_package

#: Buckets of a batch, bits of a filter for each key, places that a key sets.
BUCKETS, BITS, PLACES = 64, 16, 4
#: Batches from which compact() has something to do, and how many of the newest it leaves, as these may be tried again.
MANY, NEWEST = 16, 4
#: Seconds for which a writer waits for another one that was there before it; one that takes longer counts as dead.
PATIENCE = 600.0
_U = np.uint64
_FILTER = pa.schema([("bucket", pa.int32()), ("bits", pa.binary())])
_MET = pa.schema([("row", pa.int64()), ("batch", pa.string()), ("bucket", pa.int32())])


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of so many bits."""
    h, step = hashes.view(_U), (hashes.view(_U) >> _U(32)) | _U(1)
    return np.stack([(h + _U(i) * step) % _U(size) for i in range(PLACES)], 1)


def _filter_of(key: tuple, table: pa.Table) -> pa.Table:
    hashes = table.column("hash").to_numpy()
    bits = np.zeros(max(64, 1 << (len(hashes) * BITS - 1).bit_length()), bool)
    bits[_places(hashes, len(bits)).ravel()] = True
    return pa.Table.from_pylist([{"bucket": key[0].as_py(), "bits": np.packbits(bits).tobytes()}], _FILTER)


def _suspects(key: tuple, rows: pa.Table, filters: pa.Table) -> Iterator[pa.Table]:
    """Rows of a bucket with the batches whose filter may hold them."""
    ids, hashes, out = rows.column("row").to_numpy(), rows.column("hash").to_numpy(), []
    for batch, blob in zip(filters.column("batch").to_pylist(), filters.column("bits").to_pylist(), strict=True):
        bits = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
        out += [{"row": i, "batch": batch, "bucket": key[0].as_py()} for i in ids[bits[_places(hashes, len(bits))].all(1)].tolist()]
    return pa.Table.from_pylist(out, _MET)


class Store:
    """A scan store: a table an entity; what has a stored key is not written again.

    Writers may work side by side: each leaves its name before it looks at what is there, and when it
    has written, one of greater name waits for the others and drops what they have stored too.
    """

    KEYS = {"blobs": ["blob_id"], "rules": ["rule_id"], "matches": ["match_id"], "findings": ["finding_id"], "provenance": ["blob_id", "path"], "annotations": ["target_type", "target_id"], "contents": ["blob_id"]}

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        ship_package(spark)

    # --- names and files ---

    def _table(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _names(self, folder: str) -> set[str]:
        fs, path = _hadoop(self.spark, f"{self.path}/{folder}")
        return {s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(path)} if fs.exists(path) else set()

    def _mark(self, entity: str, name: str) -> None:
        fs, path = _hadoop(self.spark, f"{self.path}/_writing/{entity}/{name}")
        fs.create(path, True).close()

    def _hash(self, entity: str) -> Column:
        return F.xxhash64(*self.KEYS[entity])

    def _bucket(self, entity: str) -> Column:
        return F.pmod(self._hash(entity), F.lit(self.buckets)).cast("int")

    # --- reading ---

    def read(self, entity: str, but: str | None = None) -> DataFrame | None:
        """The rows of an entity, without those of one batch if it is given; None if there are none."""
        rows = self._table(f"{self.path}/{entity}")
        if rows is None:
            return None
        return (rows.filter(F.col("batch") != but) if but else rows).drop("batch", "bucket")

    def read_keys(self, entity: str, rows: DataFrame) -> DataFrame | None:
        """The stored rows with the keys of rows: only their buckets are read, as far as they are known beforehand."""
        stored = self._table(f"{self.path}/{entity}")
        if stored is None:
            return None
        keys = self.KEYS[entity]
        wanted = rows.select(*keys).distinct()
        touched = [r[0] for r in wanted.select(self._bucket(entity).alias("b")).distinct().collect()]  # buckets at most
        return stored.filter(F.col("bucket").isin(touched)).drop("batch", "bucket").join(wanted, keys, "left_semi")

    def exists(self, entity: str, *key) -> bool:
        """Whether a key is stored; one bucket is read."""
        one = self.spark.createDataFrame([key], ", ".join(f"{k} string" for k in self.KEYS[entity]))
        found = self.read_keys(entity, one)
        return found is not None and not found.isEmpty()

    def matches_of(self, blob_id: str) -> DataFrame | None:
        """The matches of a blob."""
        rows = self.read("matches")
        return None if rows is None else rows.filter(F.col("blob_id") == blob_id)

    def provenance_of(self, blob_id: str) -> DataFrame | None:
        """All places of a blob."""
        rows = self.read("provenance")
        return None if rows is None else rows.filter(F.col("blob_id") == blob_id)

    # --- adding ---

    def _holding(self, entity: str, staged: DataFrame, batches: set[str]) -> DataFrame | None:
        """(row, batch, bucket) of staged rows (row, hash, bucket) whose key may be in a batch, by the filters."""
        filters = self._table(f"{self.path}/_filters/{entity}")
        if filters is None or not batches:
            return None
        touched = [r[0] for r in staged.select("bucket").distinct().collect()]  # buckets at most
        filters = filters.filter(F.col("batch").isin(list(batches)) & F.col("bucket").isin(touched))
        met = staged.select("row", "hash", "bucket").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_suspects, "row long, batch string, bucket int")
        return materialize(met, "suspects")

    def _stored(self, entity: str, met: DataFrame) -> DataFrame:
        """Rows of the buckets of batches that may hold some key: no other file is read."""
        parts = [f"{r['batch']}/{r['bucket']}" for r in met.select("batch", "bucket").distinct().collect()]  # buckets of batches at most
        return self.spark.read.parquet(f"{self.path}/{entity}").filter(F.concat_ws("/", "batch", "bucket").isin(parts))

    def _known(self, entity: str, staged: DataFrame, batches: set[str]) -> DataFrame | None:
        """The numbers of staged rows whose key is in one of the batches."""
        met = self._holding(entity, staged, batches)
        if met is None or met.isEmpty():
            return None
        keys = self.KEYS[entity]
        suspect = staged.select("row", *keys).join(met.select("row").distinct(), "row", "left_semi")
        return suspect.join(self._stored(entity, met).select(*keys).distinct(), keys).select("row")

    def add(self, entity: str, rows: DataFrame, batch: str | None = None) -> None:
        """Append the rows whose key is new; of rows with one key in a batch one is kept.

        A batch that is added again under its name replaces what it wrote before, until it is compacted.
        Rows are written aside first; those that have to go are found by number, so that wide rows are
        not shuffled unless there are too many of these numbers to send them to all tasks.
        """
        name = f"b-{batch or uuid.uuid4().hex}"
        self._mark(entity, name)
        try:
            others = self._names(entity) - {name}
            numbered = rows.withColumns({"_row": F.monotonically_increasing_id(), "_hash": self._hash(entity), "bucket": self._bucket(entity)})
            numbered = materialize(numbered, "staged")
            keys = self.KEYS[entity]
            staged = numbered.select(F.col("_row").alias("row"), F.col("_hash").alias("hash"), "bucket", *keys)
            gone = staged.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("row"))).filter("n > 1").select("row")
            known = self._known(entity, staged, others)
            gone = gone if known is None else gone.unionByName(known)
            new = numbered.join(gone.select(F.col("row").alias("_row")).distinct(), "_row", "left_anti")
            self._write(entity, name, new.drop("_row", "_hash"))
            self._settle(entity, name, others)
        finally:
            drop_path(self.spark, f"{self.path}/_writing/{entity}/{name}")

    def _write(self, entity: str, name: str, rows: DataFrame) -> None:
        target = f"{self.path}/{entity}/batch={name}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = self._table(target)
        filters = f"{self.path}/_filters/{entity}/batch={name}"
        if written is None:
            drop_path(self.spark, filters)
            return
        hashed = written.select("bucket", self._hash(entity).alias("hash"))
        hashed.groupBy("bucket").applyInArrow(_filter_of, "bucket int, bits binary").write.mode("overwrite").parquet(filters)

    def _settle(self, entity: str, name: str, others: set[str]) -> None:
        """Leave to writers of smaller names, who were there meanwhile, what they have stored too."""
        until = time.monotonic() + PATIENCE
        while any(x < name for x in self._names(f"_writing/{entity}") - {name}) and time.monotonic() < until:
            time.sleep(0.2)
        late = {x for x in self._names(entity) - others - {name} if x < name}
        mine = self._table(f"{self.path}/{entity}/batch={name}") if late else None
        if mine is None:
            return
        rows = materialize(mine.withColumns({"row": F.monotonically_increasing_id(), "hash": self._hash(entity)}), "settled")
        known = self._known(entity, rows, late)
        if known is not None and not known.isEmpty():
            self._write(entity, name, rows.join(known.distinct(), "row", "left_anti").drop("row", "hash"))

    def unseen(self, blobs: DataFrame, batch: str | None = None) -> DataFrame:
        """Blobs that no other batch has stored."""
        rows = materialize(blobs.withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64("blob_id"), "_bucket": self._bucket("blobs")}), "unseen")
        staged = rows.select(F.col("_row").alias("row"), F.col("_hash").alias("hash"), F.col("_bucket").alias("bucket"), "blob_id")
        known = self._known("blobs", staged, self._names("blobs") - ({f"b-{batch}"} if batch else set()))
        rows = rows if known is None else rows.join(known.select(F.col("row").alias("_row")).distinct(), "_row", "left_anti")
        return rows.drop("_row", "_hash", "_bucket")

    def compact(self, entity: str, many: int = MANY, newest: int = NEWEST) -> int:
        """Write all batches but the newest as one, once there are many; returns how many it has replaced.

        Only one caller at a time; adds may go on, as theirs are the newest.
        """
        fs, path = _hadoop(self.spark, f"{self.path}/{entity}")
        found = sorted(fs.listStatus(path), key=lambda s: s.getModificationTime()) if fs.exists(path) else []
        old = [s.getPath().getName().removeprefix("batch=") for s in found][: max(0, len(found) - newest)]
        if len(found) < many or len(old) < 2:
            return 0
        rows = self.spark.read.parquet(f"{self.path}/{entity}").filter(F.col("batch").isin(old)).drop("batch")
        self._write(entity, f"a-{uuid.uuid4().hex}", materialize(rows, "compacted"))
        for name in old:
            drop_path(self.spark, f"{self.path}/{entity}/batch={name}")
            drop_path(self.spark, f"{self.path}/_filters/{entity}/batch={name}")
        return len(old)

    # --- annotations ---

    def annotate(self, rows: DataFrame, batch: str | None = None) -> None:
        """Set annotations (target_type, target_id, status, comment, at): later ones replace earlier ones when read."""
        name = f"b-{batch or uuid.uuid4().hex}"
        self._write("annotations", name, rows.withColumn("bucket", self._bucket("annotations")))

    def annotations(self) -> DataFrame | None:
        """The newest annotation of each target."""
        rows = self.read("annotations")
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in self.KEYS["annotations"]]
        return rows.groupBy(*self.KEYS["annotations"]).agg(F.max_by(F.struct(*rest), F.struct("at", *[c for c in rest if c != "at"])).alias("newest")).select(*self.KEYS["annotations"], "newest.*")


class BlobStore:
    """Contents by their blob id; what is there is not written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def put(self, blobs: DataFrame, batch: str | None = None) -> None:
        """Store blobs (blob_id, content); equal ones once. A batch that is put again under its name replaces what it wrote."""
        self.store.add("contents", blobs.select("blob_id", F.col("content").cast("binary").alias("content")), batch)

    def missing(self, blobs: DataFrame) -> DataFrame:
        """The rows whose blob is not stored; only ids are read, of the buckets that the rows fall into."""
        found = self.store.read_keys("contents", blobs)
        return blobs if found is None else blobs.join(found.select("blob_id"), "blob_id", "left_anti")

    def get(self, ids: DataFrame) -> DataFrame:
        """(blob_id, content) of the ids that are stored."""
        found = self.store.read_keys("contents", ids)
        return self.spark.createDataFrame([], "blob_id string, content binary") if found is None else found.select("blob_id", "content")
