"""Exact top-k search by inner product with a vector-approximation file.

Each component of a vector is quantised to one of 64 cells, and packed blocks of cells are the file
that queries scan: cells bound every score from below and from above. Blocks of queries meet blocks of
cells, two products of matrices a pair, and what cannot be among a query's best is left out. Exact
vectors are then read in the order of the bounds, best first, until nothing unread can change a
query's best. Equal vectors are one entry with its first rows, and equal queries are one search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.session import discard, materialize, ship_package

#: Units of a component, cells of a component, vectors from which the cells are fitted, and their components in all.
SCALE, CELLS, SAMPLE, SAMPLE_VALUES = 256, 64, 4096, 1 << 21
#: Components of a block of cells and of a block of queries, about.
CELL_VALUES, QUERY_VALUES = 1 << 19, 1 << 16
#: Exact vectors that the first round reads for a query; each further round may read four times as many.
FIRST_READ = 16
#: The square of the length, in units, from which a vector takes no part: below, scores fit 64 bits with room.
LONGEST = float(1 << 62)


def units(vector: Column) -> Column:
    """Components as whole units, or null for a vector that takes no part."""
    x = vector.cast("array<double>")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    small = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v * float(SCALE * SCALE)) < LONGEST
    return F.when(fine & small, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, units, id, members): distinct vectors with their first k + 1 rows (vec_id, row), and the least vec_id.

    Of equal vectors no later row can be among the best k, even where one of the first is the query's own.
    """
    first = Window.partitionBy("units").orderBy("vec_id", "row")
    kept = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    grouped = kept.groupBy("units").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    return grouped.select(F.monotonically_increasing_id().alias("v"), "units", F.col("members")[0]["vec_id"].alias("id"), "members")


def cuts(sample: list[list[int]]) -> np.ndarray:
    """For each component the least units of cells 1, 2, ...: quantiles of the sample, missing components as 0."""
    wide = _padded(sample, max(map(len, sample), default=0))
    if not wide.size:
        return np.zeros((0, CELLS - 1), np.int64)
    return np.quantile(wide, np.arange(1, CELLS) / CELLS, axis=0, method="higher").astype(np.int64).T


def _padded(vectors: list[np.ndarray] | list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


_CELLS = pa.schema([("block", pa.int64()), ("width", pa.int64()), ("v", pa.binary()), ("ids", pa.binary()), ("cells", pa.binary()), ("least", pa.binary()), ("most", pa.binary())])
_CELLS_DDL = "block long, width long, v binary, ids binary, cells binary, least binary, most binary"
_QUERIES = pa.schema([("group", pa.int64()), ("width", pa.int64()), ("q", pa.binary()), ("values", pa.binary())])
_QUERIES_DDL = "group long, width long, q binary, values binary"


def _wide(table: pa.Table) -> np.ndarray:
    listed = table.column("units").combine_chunks()
    sizes = np.diff(listed.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = listed.flatten().to_numpy()
    return out


def _pack_cells(inner: np.ndarray) -> Callable:
    """One row of a block's vectors, in the order of their ids: cells, and each component's least and most units."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        wide = _wide(table)
        cells = np.zeros(wide.shape, np.uint8)
        for d in range(min(wide.shape[1], len(inner))):
            cells[:, d] = np.searchsorted(inner[d], wide[:, d], "right")
        v, ids = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("v", "id"))
        return pa.Table.from_pylist([{"block": key[0].as_py(), "width": wide.shape[1], "v": v, "ids": ids, "cells": cells.tobytes(), "least": wide.min(0).tobytes(), "most": wide.max(0).tobytes()}], _CELLS)

    return run


def _pack_queries(key: tuple, table: pa.Table) -> pa.Table:
    wide = _wide(table)
    return pa.Table.from_pylist([{"group": key[0].as_py(), "width": wide.shape[1], "q": table.column("v").to_numpy().astype(np.int64).tobytes(), "values": wide.tobytes()}], _QUERIES)


def bounds(cells: np.ndarray, inner: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most units that each vector's components can have, by their cells."""
    low, high = np.empty(cells.shape), np.empty(cells.shape)
    for d in range(cells.shape[1]):
        edges = inner[d] if d < len(inner) else np.zeros(0, np.int64)
        low[:, d] = np.maximum(np.concatenate([least[d : d + 1], edges]), least[d])[cells[:, d]]
        high[:, d] = np.minimum(np.concatenate([edges - 1, most[d : d + 1]]), most[d])[cells[:, d]]
    return low, high


_MET = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
_MET_DDL = "q long, v long, id long, low double, high double"


def score_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all queries (rows) with all vectors (columns), from those of the components."""
    middle, half = queries @ (low + high).T, np.abs(queries) @ (high - low).T
    # Whole numbers below 2 ** 53 are exact; beyond, bounds give way by more than rounding can be.
    reach = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).max(0, initial=0)
    give = np.where(reach < float(1 << 51), 0.0, reach * 2.0**-40)[:, None]
    return (middle - half) / 2 - give, (middle + half) / 2 + give


def contenders(low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which vectors, in the order of their ids, may be among the best k by score and then id."""
    if len(low) <= k:
        return np.arange(len(low))
    kth = np.partition(low, len(low) - k)[len(low) - k]
    at = np.flatnonzero(low == kth)[k - 1 - int((low > kth).sum())]
    return np.flatnonzero((high > kth) | ((high == kth) & (ids <= ids[at])))


def _meet(inner: np.ndarray, k: int) -> Callable:
    """Rows of a block of cells with a block of queries: the pairs that may be among a query's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, ids, q = (np.frombuffer(row[c], np.int64) for c in ("v", "ids", "q"))
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(v), row["width"])
                low, high = bounds(cells, inner, np.frombuffer(row["least"], np.int64), np.frombuffer(row["most"], np.int64))
                values, width = np.frombuffer(row["values"], np.int64).reshape(len(q), row["query_width"]), min(row["width"], row["query_width"])
                low, high, values = low[:, :width], high[:, :width], values[:, :width].astype(float)
                step = max(1, (1 << 20) // max(1, len(v)))
                for a in range(0, len(q), step):
                    least, most = score_bounds(values[a : a + step], low, high)
                    out = [contenders(x, y, ids, k) for x, y in zip(least, most, strict=True)]
                    of, to = np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate(out)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[a + of], v[to], ids[to], least[of, to], most[of, to])], schema=_MET)

    return run


def _sized(rows: DataFrame, values: int, name: str) -> tuple[DataFrame, int]:
    """Add column name: numbered blocks of about so many components, each of vectors whose sizes differ by a factor of two at most."""
    size = F.ceil(F.log2(F.greatest(F.size("units"), F.lit(1)))).cast("int")
    counts = {r["bits"]: r["n"] for r in rows.groupBy(size.alias("bits")).agg(F.count("*").alias("n")).collect()}  # 32 rows at most
    blocks = {b: max(1, (n << b) // values) for b, n in counts.items()}
    first = dict(zip(blocks, accumulate(blocks.values(), initial=0), strict=False))
    of = lambda x: F.create_map(*[F.lit(y).cast("long") for pair in (x or {0: 1}).items() for y in pair])[size.cast("long")]
    return rows.withColumn(name, of(first) + F.pmod(F.xxhash64("v"), of(blocks))), sum(blocks.values())


def candidates(file: DataFrame, queries: DataFrame, n_blocks: int, n_groups: int, inner: np.ndarray, k: int) -> DataFrame:
    """Every block of cells with every block of queries; pairs of vectors that a block's bounds cannot rule out."""
    cells = file.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)).cast("array<long>")))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))).withColumnRenamed("width", "query_width")
    tasks = max(1, min(n_blocks * n_groups, 100_000))
    met = cells.repartition(tasks, "block", "group").join(asked.repartition(tasks, "block", "group"), ["block", "group"])
    return met.select("width", "v", "ids", "cells", "least", "most", "query_width", "q", "values").mapInArrow(_meet(inner, k), _MET_DDL)


def still_open(met: DataFrame, known: DataFrame, value: str, k: int) -> DataFrame:
    """Rows of met that may be among the best k, by the k best of known (q, value, id); all of a query with fewer."""
    best = Window.partitionBy("q").orderBy(F.col(value).desc(), "id")
    kth = known.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).groupBy("q").agg(F.max("place").alias("n"), F.min(F.struct(F.col(value), (-F.col("id")).alias("below"))).alias("kth"))
    kth = kth.filter(F.col("n") == k).select("q", F.col(f"kth.{value}").cast("double").alias("kth"), (-F.col("kth.below")).alias("kth_id"))
    out = met.join(kth, "q", "left")
    return out.filter(F.col("kth").isNull() | (F.col("high") > F.col("kth")) | ((F.col("high") == F.col("kth")) & (F.col("id") <= F.col("kth_id")))).drop("kth", "kth_id")


def exact(pairs: DataFrame, file: DataFrame) -> DataFrame:
    """(q, v, id, score): the inner products of exact vectors, missing components as 0."""
    both = pairs.join(file.select(F.col("v"), F.col("units").alias("a")), "v").join(file.select(F.col("v").alias("q"), F.col("units").alias("b")), "q")
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x * y, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("q", "v", "id", product.alias("score"))


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query(id) selects its k best of all other rows.

    The score is the inner product of components in units, floor(256 x); ties go to smaller ids. Rows
    are told apart, so a row that repeats an id and a vector is a candidate for its twin, and is a query too. A vector takes
    no part that is null, holds null or non-finite components, or has 2 ** 31 units of length or more,
    as scores then need not fit 64 bits; nor do rows without an id. Of vectors of different sizes
    missing components count as 0. Fewer than k other rows: all of them; an empty table gives no rows;
    other columns do not matter and are not carried. Cells are fitted to SAMPLE vectors at most, and
    hold for all whatever the fit. Lowers the session's Arrow batches (ship_package).
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), units(F.col(vector_col)).alias("units"))
    rows = materialize(rows.filter("vec_id is not null and units is not null"), "vectors")
    file = materialize(entries(rows, k), "entries")
    asked = rows.filter(is_query(F.col("vec_id"))).select("vec_id", "row", "units").join(file.select("v", "units"), "units").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q"))
    asked = materialize(asked, "queries")
    placed, n_blocks = _sized(file, CELL_VALUES, "block")
    searched = file.join(asked.select(F.col("q").alias("v")).distinct(), "v", "left_semi")
    grouped, n_groups = _sized(searched, QUERY_VALUES, "group")
    most = file.agg(F.max(F.size("units"))).first()[0] or 1
    few = file.orderBy(F.xxhash64("v"), "v").limit(max(1, min(SAMPLE, SAMPLE_VALUES // most))).select("units")
    inner = cuts([r[0] for r in few.collect()])
    cells = materialize(placed.groupBy("block").applyInArrow(_pack_cells(inner), _CELLS_DDL), "cells")
    packed = materialize(grouped.groupBy("group").applyInArrow(_pack_queries, _QUERIES_DDL), "packed")
    # k + 1: a query's own row is among the candidates until the end.
    met = materialize(candidates(cells, packed, n_blocks, n_groups, inner, k + 1), "met")
    left = materialize(still_open(met, met, "low", k + 1), "open")
    discard(met)
    scored, read = None, FIRST_READ
    while scored is None or not left.isEmpty():
        by_bound = Window.partitionBy("q").orderBy(F.col("high").desc(), "id", "v")
        now = left.withColumn("turn", F.row_number().over(by_bound)).filter(F.col("turn") <= read)
        new = materialize(exact(now, file), "scored")
        scored = new if scored is None else scored.unionByName(new)
        before, left = left, materialize(still_open(left.join(new.select("q", "v"), ["q", "v"], "left_anti"), scored, "score", k + 1), "open")
        discard(before)
        read *= 4
    found = scored.join(file.select("v", "members"), "v").select("q", "score", F.explode("members").alias("m")).select("q", "score", "m.*")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "row")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    ranked = Window.partitionBy("query_id", "query_row").orderBy("place")
    out = asked.join(found, "q").filter("row <> query_row").withColumn("rank", F.row_number().over(ranked))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_vafile_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


OP11_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT r, vec_id, list_transform(x, lambda v: CAST(floor({SCALE} * v) AS BIGINT)) AS u FROM e WHERE len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.u, c.u), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score FROM f AS q JOIN f AS c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM s) WHERE rank <= 5
"""
