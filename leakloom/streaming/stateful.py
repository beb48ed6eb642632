"""Streams with state of their own: what is new, with bounded memory, and a queue in which the latest content wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from leakloom.session import ship_package

#: Keys are dealt over so many buckets, of which each remembers so many at most; a full one forgets a share of the oldest.
BUCKETS, MOST, FORGOTTEN = 256, 10_000, 0.1
#: Bytes of a key that is remembered, a SHA-256.
KEY_BYTES = 32
#: Contents that a queue releases at a time.
RELEASED = 10
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _prepared(df: DataFrame) -> None:
    """State with several variables needs the store that keeps them on disk; a session that has chosen one keeps it."""
    ship_package(df.sparkSession)
    if "RocksDB" not in df.sparkSession.conf.get(STORE, ""):
        df.sparkSession.conf.set(STORE, ROCKS)


class FirstSeen(StatefulProcessor):
    """Of a bucket's rows those whose key it does not remember; keys are remembered in their order.

    What a bucket remembers is one value, read and written once a micro-batch: a call to the store for
    each key would cost more than all the rest.
    """

    def __init__(self, columns: list[str], most: int, ttl_ms: int | None):
        self.columns, self.most, self.ttl = columns, max(1, most), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "keys binary, times binary", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        joined, times = map(bytes, self.held.get()) if self.held.exists() else (b"", b"")
        order = [joined[i : i + KEY_BYTES] for i in range(0, len(joined), KEY_BYTES)]
        since = np.frombuffer(times, np.int64).tolist() if self.ttl else [0] * len(order)
        if self.ttl:
            alive = next((i for i, t in enumerate(since) if t + self.ttl > now), len(since))  # in the order of their times
            order, since = order[alive:], since[alive:]
        known = set(order)
        for part in rows:
            # Columns are taken by place: names that are no identifiers arrive changed.
            new = []
            for at, seen in enumerate(map(bytes, part.iloc[:, len(self.columns)].tolist())):
                if seen not in known:
                    known.add(seen)
                    order.append(seen)
                    new.append(at)
            since += [now] * len(new)
            if len(order) > self.most:
                step = max(1, int(self.most * FORGOTTEN))
                gone = -(-(len(order) - self.most) // step) * step
                known.difference_update(order[:gone])
                order, since = order[gone:], since[gone:]
            if new:
                yield part.iloc[new, : len(self.columns)].set_axis(self.columns, axis=1)
        self.held.update((b"".join(order), np.array(since, np.int64).tobytes() if self.ttl else b""))

    def close(self) -> None:
        pass


def first_seen(hits: DataFrame, keys: list[str] | None = None, most: int | None = MOST, buckets: int = BUCKETS, ttl_ms: int | None = None) -> DataFrame:
    """The first row of each key (by default rule and secret) over a whole stream, with bounded state.

    Keys are dealt over buckets by their hash, so one rule's secrets are many tasks' work. A bucket
    remembers `most` keys; a full one forgets its oldest tenth, of which a later row is new again, as
    are those whose time (ttl_ms, of the clock) has ended. A bucket's keys are written again in each
    micro-batch that reaches it, so more keys need more buckets rather than a greater `most`.
    Without a bound (most=None) nothing is forgotten: each key passes once however many there are, and
    Spark's own deduplication keeps them on disk, where the state grows with the keys.
    Keys that are null are keys like others. Restarts go on from the checkpoint. Sets the session's state store to RocksDB.
    """
    _prepared(hits)
    keys = keys or ["rule_id", "secret"]
    if most is None:
        if ttl_ms:
            raise ValueError("keys without a bound have no time to live")
        return hits.dropDuplicates(keys)
    said = [F.coalesce(F.concat(F.lit("+"), F.octet_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    columns = hits.columns
    rows = hits.withColumn("first_seen_key", F.unhex(F.sha2(F.concat(*said), 256))).withColumn("first_seen_bucket", F.pmod(F.xxhash64("first_seen_key"), F.lit(buckets)).cast("int"))
    return rows.groupBy("first_seen_bucket").transformWithStateInPandas(FirstSeen(columns, most, ttl_ms), hits.schema, "Append", "ProcessingTime" if ttl_ms else "None")


def unprocessed(items: DataFrame, url_col: str = "source", content_col: str = "content", **bounds) -> DataFrame:
    """Items whose URL was not yet processed with this content; the same URL with other content is new."""
    hashed = items.withColumn("content_hash", F.sha2(F.coalesce(F.col(content_col), F.lit("")).cast("binary"), 256))
    return first_seen(hashed, [url_col, "content_hash"], **bounds)


class LatestQueue(StatefulProcessor):
    """A bucket's queue of URLs, each with its latest content, released in batches once it has waited."""

    def __init__(self, wait_ms: int, size: int):
        self.wait, self.size = wait_ms, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "url string", "content string, at long")
        self.timer = handle.getValueState("timer", "due long, batch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, batch = self.timer.get() if self.timer.exists() else (0, 0)
        for part in rows:
            for url, content, at in zip(part["url"].tolist(), part["text"].tolist(), part["ms"].tolist(), strict=True):
                held = self.queue.getValue((url,)) if self.queue.containsKey((url,)) else None
                if held is None or at >= held[1]:
                    self.queue.updateValue((url,), (content, int(at)))
                if not due:
                    due = int(at) + self.wait
                    self.handle.registerTimer(due)
        self.timer.update((due, batch))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, batch = self.timer.get()
        waiting = sorted((at, url, content) for (url,), (content, at) in self.queue.iterator())
        for i in range(0, len(waiting), self.size):
            some = waiting[i : i + self.size]
            batch += 1
            yield pd.DataFrame({"bucket": key[0], "batch": batch, "source": [x[1] for x in some], "content": [x[2] for x in some], "queued_ms": [x[0] for x in some]})
        for _, url, _ in waiting:
            self.queue.removeKey((url,))
        self.timer.update((0, batch))

    def close(self) -> None:
        pass


def latest_batches(items: DataFrame, at: str, wait: str = "10 seconds", wait_ms: int = 10_000, url_col: str = "source", content_col: str = "content", buckets: int = BUCKETS, size: int = RELEASED) -> DataFrame:
    """(bucket, batch, source, content, queued_ms): the latest content of each URL, in batches of `size` of a bucket.

    at is the event time. A URL that comes again while it waits replaces what waits, unless that is
    newer; once the watermark (`wait` behind) has passed wait_ms after a queue's first entry, all that waits is
    released, oldest first. Rows without a URL or a time are left out. A bucket holds what came in about that time.
    """
    _prepared(items)
    ms = F.unix_millis(F.col(at))
    rows = items.filter(F.col(url_col).isNotNull() & F.col(at).isNotNull()).withWatermark(at, wait)
    rows = rows.select(F.pmod(F.xxhash64(url_col), F.lit(buckets)).cast("int").alias("bucket"), F.col(url_col).alias("url"), F.coalesce(F.col(content_col), F.lit("")).alias("text"), ms.alias("ms"), F.col(at).alias("event_time"))
    out = StructType.fromDDL("bucket int, batch long, source string, content string, queued_ms long")
    return rows.groupBy("bucket").transformWithStateInPandas(LatestQueue(wait_ms, size), out, "Append", "EventTime")
