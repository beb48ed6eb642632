"""Best-fit-decreasing packing of token sequences.

Best fit decreasing depends on lengths alone, and lengths are integers up to the capacity. So the
plan is made over the histogram of lengths, which the capacity bounds, not over documents: a segment
tree over remaining capacities finds the tightest open bins for a length in logarithmic time, and all
bins of one remaining capacity take their pieces together. Documents then find their places by their
rank among pieces of equal length, which Spark computes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.tokens import encoder
from leakloom.session import materialize, ship_package


class OpenBins:
    """A segment tree over remaining capacities 0 to capacity; a leaf holds groups of like bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, left: int, first: int, bins: int) -> None:
        """Open bins first to first + bins - 1 have this much left."""
        if bins:
            self.groups[left].append((first, bins))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        found = self.groups[left].pop()
        self._mark(left)
        return found

    def _mark(self, left: int) -> None:
        at = left + self.size
        self.any[at] = bool(self.groups[left])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least length that some bin has, or None."""
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1:  # climb until a right neighbour holds something, then descend to its left end
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing of the pieces counted in histogram, as runs of like placements.

    A run (length, rank, pieces, first_bin, each, offset) says: the pieces of this length with ranks
    from rank on go into bins from first_bin on, each of them taking that many, the first at offset.
    """
    bins, made, runs = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = bins.tightest(length)
            if left is None:
                left, first, count = capacity, made, -(-todo // (capacity // length))
                made += count
            else:
                first, count = bins.take(left)
            each = left // length
            full, rest = divmod(todo, each)
            if full >= count:
                full, rest = count, 0
            placed = full * each + rest
            runs.append((length, rank, placed, first, each, capacity - left))
            bins.add(left - each * length, first, full)
            if rest:
                bins.add(left - rest * length, first + full, 1)
            used = full + (rest > 0)
            bins.add(left, first + used, count - used)
            rank, todo = rank + placed, todo - placed
    return runs


def piece_batches(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path), end_id.to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text or "") + last)
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    end = min(n, start + (n % capacity or capacity)) if piece == 0 else start + capacity
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, piece = end, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of all documents into sequences of at most capacity tokens.

    A document is its ids and end_id; a longer one is cut, from its end, into pieces of capacity
    tokens, so that its first piece may be shorter. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id and offset. A null text is an empty document, which has one token; repeated rows are
    packed each; an empty table gives no rows; other columns are not carried.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.mapInArrow(piece_batches(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # The block is the task that made a piece; ranks are counted within blocks first, so that no length meets in one task.
    pieces = materialize(cut.withColumn("block", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "pieces")
    per_block = pieces.groupBy("length", "block").agg(F.count("*").alias("pieces"))
    histogram = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}  # capacity rows at most
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, rank long, pieces long, first_bin long, each long, offset long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("length", "block", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("before"))
    ranked = (
        pieces.withColumn("rank_in_block", F.row_number().over(Window.partitionBy("length", "block").orderBy("at")) - 1)
        .join(starts, ["length", "block"])
        .withColumn("piece_rank", F.col("before") + F.col("rank_in_block"))
    )
    run = runs.select(F.col("length").alias("run_length"), "rank", F.col("pieces").alias("run_pieces"), "first_bin", "each", F.col("offset").alias("run_offset"))
    placed = ranked.join(run, (F.col("length") == F.col("run_length")) & (F.col("piece_rank") >= F.col("rank")) & (F.col("piece_rank") < F.col("rank") + F.col("run_pieces")))
    at = F.col("piece_rank") - F.col("rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (at % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
