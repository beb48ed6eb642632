"""Streams of content to scan: NDJSON requests, new findings only, and the latest content of each place."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.operators.match import scan
from leakloom.plans.rules import Rule

REQUEST = "type string, id string, payload struct<content:string,source:string,items:array<struct<source:string,content:string>>>"


def requests(spark: SparkSession, folder: str, files: int = 10) -> DataFrame:
    """A stream of requests from NDJSON files that arrive in a folder."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).json(folder)


def items(rows: DataFrame) -> DataFrame:
    """(source, content) of scan and scan_batch requests; other types are left out."""
    one = F.array(F.struct(F.col("payload.source").alias("source"), F.col("payload.content").alias("content")))
    listed = F.when(F.col("type") == "scan", one).when(F.col("type") == "scan_batch", F.col("payload.items"))
    return rows.select(F.explode(listed).alias("i")).select("i.source", "i.content").filter("content is not null")


def errors(rows: DataFrame) -> DataFrame:
    """The error answers to requests of unknown type."""
    return rows.filter(F.col("type").isNull() | ~F.col("type").isin("scan", "scan_batch", "validate", "close")).select("id", F.concat(F.lit("unknown request type: "), F.coalesce("type", F.lit("null"))).alias("error"))


def matches(contents: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Matches in a batch or stream of (source, content), keyed by the content's blob id."""
    from leakloom.functions.ids import blob_id

    return scan(contents.select(blob_id(F.col("content").cast("binary")).alias("blob_id"), "content"), rules)


def new_only(hits: DataFrame, keys: list[str] | None = None, within: str | None = None, at: str = "seen_at") -> DataFrame:
    """The first hit of each rule and secret over the whole stream.

    As nothing ends a secret's life, the state grows with the secrets; `within` (a duration of the
    event time column `at`) bounds it.
    """
    keys = keys or ["rule_id", "secret"]
    if within:
        return hits.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
    return hits.dropDuplicates(keys)


def _one_each(numbered: DataFrame) -> DataFrame:
    """One row of each blob id, of rows with _number: ids are compared, and contents move only if there are too many ids to send to all tasks."""
    again = numbered.select("blob_id", "_number").withColumn("_n", F.row_number().over(Window.partitionBy("blob_id").orderBy("_number"))).filter("_n > 1").select("_number")
    return numbered.join(again, "_number", "left_anti").drop("_number")


def incremental(stream: DataFrame, store, scan_new: Callable[[DataFrame], None], checkpoint: str):
    """Scan what no earlier batch or run has stored: each micro-batch is cut to unseen blobs, scanned, and stored."""

    named = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        this = f"{named}-{number}"  # a batch that is tried again sees and replaces its own rows
        numbered = rows.withColumn("_number", F.monotonically_increasing_id()).persist()
        fresh = store.unseen(_one_each(numbered), this).persist()
        try:
            scan_new(fresh)
            store.add("blobs", fresh.select("blob_id", "size"), this)
        finally:
            fresh.unpersist()
            numbered.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
