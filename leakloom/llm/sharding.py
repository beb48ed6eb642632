"""Reproducible sharding: a Feistel permutation over global row numbers.

Rows are numbered by content (hash bucket, then id, then text checksum), the numbers are permuted by
a generalised Feistel network over Z_a x Z_b with a * b >= n, and numbers that leave [0, n) walk on
along their cycle. Shard and slot follow from the permuted number by arithmetic alone, so the place
of a row can be computed without sorting by random keys. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of the Feistel rounds; other keys give another shuffle.
KEYS = (101, 202, 303, 404)
#: Rows of a numbering bucket, about; a bucket is what one task sorts.
BUCKET_ROWS = 20_000
#: Copies of a row that one task numbers at a time.
COPIES = 10_000


def _word(text: Column) -> Column:
    """32 bits of an MD5 digest: other SQL engines have it too, so they can recompute a shuffle."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _turn(left: Column, right: Column, key: int, modulus: int) -> Column:
    """A Feistel round: left plus a keyed function of right."""
    return (left + _word(F.concat(right.cast("string"), F.lit(f":{key}")))) % F.lit(modulus)


def network(x: Column, a: int, b: int, keys=KEYS) -> Column:
    """One pass over x in [0, a * b), a bijection of that range."""
    left, right = x % F.lit(a), F.expr("0L") + F.floor(x / F.lit(a)).cast("long")
    for i, key in enumerate(keys):
        if i % 2 == 0:
            left = _turn(left, right, key, a)
        else:
            right = _turn(right, left, key, b)
    return left + right * F.lit(a)


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest nearly square domain that holds n numbers; a * b - n < a."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, -(-n // a)


def permute(df: DataFrame, number: str, n: int, out: str, keys=KEYS) -> DataFrame:
    """Add column out: a permutation of the numbers 0 to n - 1 in column number."""
    a, b = domain(n)
    left, right = "_left", "_right"
    df = df.withColumn(left, F.col(number) % F.lit(a)).withColumn(right, F.floor(F.col(number) / F.lit(a)).cast("long"))
    for i, key in enumerate(keys):  # a column a round, so that each half is computed once
        if i % 2 == 0:
            df = df.withColumn(left, _turn(F.col(left), F.col(right), key, a))
        else:
            df = df.withColumn(right, _turn(F.col(right), F.col(left), key, b))
    df = df.withColumn(out, F.col(left) + F.col(right) * F.lit(a)).drop(left, right)
    # A cycle has fewer than a numbers outside [0, n), so a steps always lead back inside.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(a)), F.col(out), lambda p, _: F.when(p < n, p).otherwise(network(p, a, b, keys)))
    return df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walked))


def number_rows(df: DataFrame, order: list[str], out: str, n: int) -> DataFrame:
    """The columns of order with column out: each row's number, 0 to n - 1, fixed by the values in these columns.

    Equal rows are counted first and numbered by their count, so a row with many copies is one row
    until these are dealt again. Distinct rows are dealt over hash buckets and numbered within them;
    only one count a bucket is gathered.
    """
    buckets = max(1, -(-n // BUCKET_ROWS))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    once = df.select(*order).groupBy(*order).agg(F.count("*").alias("_copies")).withColumn("_bucket", (_word(key) % F.lit(buckets)).cast("int"))
    counts = once.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    first = once.withColumn("_at", F.coalesce(F.sum("_copies").over(within), F.lit(0))).join(starts, "_bucket").withColumn("_first", F.col("_start") + F.col("_at"))
    each = first.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long")))).repartition(*order, "_from")
    copies = F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("_copies")) - 1)
    return each.withColumn("_copy", F.explode(copies)).select(*order, (F.col("_first") + F.col("_copy")).alias(out))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keys=KEYS) -> DataFrame:
    """Deal all rows over shards so that their counts differ by one at most (law `rows`).

    Returns the id, size (UTF-8 bytes plus 16), text_crc32 (null text: that of no bytes), row_number,
    position in the shuffle, law, shard and slot. Null ids and repeated rows are rows like others; an
    empty table gives no rows; other columns do not matter and are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    n = docs.count()
    out = permute(number_rows(rows, ["doc_id", "text_crc32", "size"], "row_number", n), "row_number", n, "position", keys)
    return out.withColumns({"law": F.lit("rows"), "shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / F.lit(shards)).cast("long")})


def op10_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document over 40 shards, by row count."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("grown_shard", F.lit(None).cast("int")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _crc_entries() -> str:
    """The 256 steps of CRC-32 (reflected polynomial 0xEDB88320), as a SQL list."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(f"{x}::UBIGINT")
    return "[" + ", ".join(out) + "]"


def _network_sql(x: str) -> str:
    """One pass of the network, as a SQL select of (x0, p) from a source that has x0, a, b and n."""
    word = lambda half, key: f"CAST('0x' || left(md5({half} || ':{key}'), 8) AS BIGINT)"
    inner = f"SELECT x0, a, b, n, {x} % a AS l, {x} // a AS r FROM src"
    for i, key in enumerate(KEYS):
        step = f"(l + {word('r', key)}) % a AS l, r" if i % 2 == 0 else f"l, (r + {word('l', key)}) % b AS r"
        inner = f"SELECT x0, a, b, n, {step} FROM ({inner})"
    return f"SELECT x0, a, b, n, l + r * a AS p FROM ({inner})"


OP10_SQL = f"""
WITH RECURSIVE size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
dom AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b, greatest(1, CAST(ceil(n / {BUCKET_ROWS}) AS BIGINT)) AS buckets FROM size),
t AS (SELECT {_crc_entries()} AS steps),
bytes AS (SELECT doc_id, coalesce(text, '') AS x, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS UBIGINT)) AS bs FROM documents),
d AS (SELECT doc_id, CAST(strlen(x) + 16 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, y: xor(c >> 8, steps[CAST(xor(c, y) & 255 AS INT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM bytes, t),
k AS (SELECT *, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || text_crc32 || '|' || size), 8) AS BIGINT) % buckets AS bucket FROM d, dom),
num AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS x0, a, b, n FROM k),
walk AS (
  {_network_sql('x0').replace('FROM src', 'FROM num')}
  UNION ALL {_network_sql('p').replace('FROM src', 'FROM walk WHERE p >= n')})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % 40 AS INT) AS shard, CAST(p // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM num JOIN walk USING (x0) WHERE p < walk.n
"""
