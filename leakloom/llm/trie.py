"""A prefix trie of conversations, by collapsing whole sequences.

Turns are told apart by digests, so their texts stay where they are read. A prefix is known by its
length and by sums over its turns of numbers that depend on turn and place: running sums, kept over
ranges of turns, so that a long conversation is dealt over tasks. Identical conversations become one sequence with a weight and a list of ends before
prefixes are made; sequences that no other one continues are the leaves; nodes are sums over weighted
prefixes. What a subtree sums up follows from each node's own conversation: the one with the least id
among those that pass, which is then the least in the deeper nodes on its way too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.sharding import _crc_entries
from leakloom.session import materialize, ship_package

#: Conversations of a family, which begin with the first turns of the family's first one, and the most of these turns.
FAMILY, MOST_SHARED = 5, 8
#: Characters of a piece of a list of ends, about.
PIECE = 1 << 16
#: The sums that tell prefixes apart: four numbers of 32 bits for each turn and place.
LANES = ("l0", "l1", "l2", "l3")
_KEY = ["depth", *LANES]


def _hex(text: Column, part: int) -> Column:
    return F.conv(F.substring(text, 8 * part + 1, 8), 16, 10).cast("long")


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes) of every turn that has a conv_id; null roles and texts become empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).filter("conv_id is not null")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], downward: bool = False) -> DataFrame:
    """Add running sums over each conversation's rows, in order; all rows of a part come before those of larger ones.

    Sums run within parts, and what former parts sum up to is added: no task has all rows of a long conversation.
    """
    parts = F.col("part").desc() if downward else F.col("part")
    before = Window.partitionBy("conv_id").orderBy(parts).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("conv_id", "part").agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    former = totals.select("conv_id", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"former_{c}") for c in sums])
    met = rows.join(former, ["conv_id", "part"])
    return met.withColumns({c: F.sum(x).over(within) + F.col(f"former_{c}") for c, x in sums.items()}).drop(*[f"former_{c}" for c in sums])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, depth, lanes, bytes): a row for every prefix of every rebuilt conversation, the empty one included.

    Conversation c is rebuilt from the first h turns of c - c % 5 and its own after its first h.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    narrow = materialize(turn_digests(turns), "digests")
    ranged = narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = materialize(running(materialize(ranged, "ranged"), order[1:], {"at": F.lit(1)}), "turns")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    convs = placed.select("conv_id").distinct().withColumns({"family": family, "h": shared})
    first = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("at") <= MOST_SHARED)).select(F.col("conv_id").alias("family"), "at", "digest", "bytes")
    base = first.groupBy("family").agg(F.count("*").alias("lead"))
    # Of the family's first conversation come h turns, or fewer if it has fewer.
    convs = convs.join(base, "family", "left").withColumn("given", F.least("h", F.coalesce("lead", F.lit(0))))
    columns = ("conv_id", "part", "at", "digest", "bytes")
    led = convs.join(first, "family").filter("at <= h").withColumn("part", F.lit(-1)).select(*columns)
    rest = placed.join(convs.select("conv_id", "h", "given"), "conv_id").filter("at > h").withColumn("at", F.expr("at - h + given")).select(*columns)
    nothing = convs.selectExpr("conv_id", "-1 AS part", "0L AS at", "cast(null AS string) AS digest", "0L AS bytes")
    mixed = led.unionByName(rest).unionByName(nothing).withColumn("mixed", F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("digest")), 256))
    numbers = mixed.select("conv_id", "part", F.col("at").alias("depth"), "bytes", *[F.coalesce(_hex(F.col("mixed"), i), F.lit(0)).alias(x) for i, x in enumerate(LANES)])
    return running(materialize(numbers, "numbers"), [F.col("depth")], {x: F.col(x) for x in LANES})


_PIECE = pa.schema([*[(c, pa.int64()) for c in (*_KEY, "first")], ("ids", pa.string())])
_PIECE_DDL = ", ".join(f"{c} long" for c in (*_KEY, "first")) + ", ids string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) as pieces of lists: the ids of a key that follow each other, comma-joined."""
    key, ids, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_KEY, key, strict=True)) | {"first": ids[0], "ids": ",".join(map(str, ids))}], _PIECE)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (row[:-1] != key or size > PIECE):
                yield piece()
                ids, size = [], 0
            key = row[:-1]
            ids.append(row[-1])
            size += len(str(row[-1])) + 1
    if ids:
        yield piece()


_ENDS = pa.schema([*[(c, pa.int64()) for c in _KEY], ("ends_sha256", pa.string())])
_ENDS_DDL = ", ".join(f"{c} long" for c in _KEY) + ", ends_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's list, from its pieces in order; of a list only the digest's state is held."""
    key, state = None, None

    def done() -> dict:
        return dict(zip(_KEY, key, strict=True)) | {"ends_sha256": state.hexdigest()}

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:5] != key:
                if state:
                    out.append(done())
                key, state = row[:5], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row[-1].encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, _ENDS)
    if state:
        yield pa.RecordBatch.from_pylist([done()], _ENDS)


def end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): a digest of each key's conv_ids, ascending and comma-joined.

    Pieces of the lists are made over ranges of key and conv_id, so a key with many ids is dealt over
    many tasks; who joins the pieces streams them through the digest.
    """
    ranged = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = ranged.mapInArrow(_pieces, _PIECE_DDL)
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").select(*_KEY, "ids").mapInArrow(_joined, _ENDS_DDL)


def trie(turns: DataFrame) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations.

    conv_id (the least member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns of a conversation are ordered by turn, null first, and where that
    ties by the SHA-256 of the role's length, a colon, role and text; repeated turns are turns like others. Null roles and
    texts are empty; rows without a conv_id take no part; a negative conv_id belongs to the family of
    its remainder's sign; without rows there are no nodes; other columns do not matter and are not
    carried. Lowers the session's Arrow batches (ship_package).
    """
    ship_package(turns.sparkSession)
    prefixes = materialize(rebuilt(turns), "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*_KEY), "depth").alias("k")).select("conv_id", "k.*")
    ends = materialize(whole, "ends")
    # One sequence for all identical conversations, with the number of them; the least id stands for it.
    sequences = materialize(ends.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "sequences")
    ways = prefixes.join(sequences.select("conv_id", "weight", F.col("depth").alias("last")), "conv_id")
    ways = materialize(ways, "ways")
    # A sequence that is a proper prefix of another one is no leaf.
    leaves = sequences.join(ways.filter("depth < last").select(*_KEY).distinct(), _KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    held = ways.join(leaves, "conv_id", "left")
    nodes = materialize(
        held.groupBy(*_KEY).agg(F.min("conv_id").alias("node_conv"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.max("bytes").alias("bytes")), "nodes"
    )
    # Each node's own savings stand on its own conversation's way, at its depth; sums from below, then over the ways.
    own = nodes.select(F.col("node_conv").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    owned = materialize(ways.join(own, ["conv_id", "depth"], "left"), "owned")
    summed = running(owned, [F.col("depth").desc()], {"below": F.coalesce("saved", F.lit(0))}, downward=True)
    saved = summed.groupBy(*_KEY).agg(F.sum("below").alias("saved_tokens"))
    # A node's parent is the prefix before it on its own conversation's way.
    up = ways.select("conv_id", (F.col("depth") + 1).alias("at"), F.struct(*_KEY).alias("parent"))
    child = nodes.filter("depth > 0").select(*_KEY, "node_conv").join(up, (F.col("node_conv") == F.col("conv_id")) & (F.col("depth") == F.col("at"))).select(*_KEY, "parent")
    child = materialize(child, "children")
    parents = nodes.select(F.struct(*_KEY).alias("parent"), F.col("node_conv").alias("parent_conv_id"))
    named = child.join(parents, "parent").select(*_KEY, "parent_conv_id")
    children = child.groupBy("parent").agg(F.count("*").alias("n_children")).select("parent.*", "n_children")
    lists = end_lists(ends)
    out = nodes.join(saved, _KEY).join(named, _KEY, "left").join(children, _KEY, "left").join(lists, _KEY, "left")
    return out.select(
        F.col("node_conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = f"""
WITH t AS (SELECT {_crc_entries()} AS steps),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS x, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY i) AS xs, list(b ORDER BY i) AS bs FROM o GROUP BY conv_id),
crc AS (SELECT conv_id, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))), lambda c, y: xor(c >> 8, steps[CAST(xor(c, y) & 255 AS INT) + 1])), 4294967295::UBIGINT) AS BIGINT) % 9 AS h FROM c, t),
r AS (SELECT c.conv_id, list_concat(coalesce(f.xs, [])[1:h], c.xs[h + 1:]) AS xs, list_concat(coalesce(f.bs, [])[1:h], c.bs[h + 1:]) AS bs
  FROM c JOIN crc USING (conv_id) LEFT JOIN c AS f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS (SELECT conv_id, len(xs) AS n, unnest(range(0, len(xs) + 1)) AS d, xs, bs FROM r),
k AS (SELECT conv_id, d, n, list_transform(xs[1:d], lambda x: md5(x)) AS node, list_transform(xs[1:d - 1], lambda x: md5(x)) AS up, CASE WHEN d = 0 THEN 0 ELSE bs[d] END AS b FROM p),
nodes AS (SELECT node, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS e FROM k GROUP BY node, d),
kids AS (SELECT up AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
v AS (SELECT x.node, x.d, x.conv_id, n_convs, coalesce(n, 0) AS n_children, (n_convs - 1) * b AS own, e, up FROM nodes x LEFT JOIN kids USING (node, d)),
s AS (SELECT node, d, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT list_slice(node, 1, q) AS node, q AS d, own, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS q FROM v)) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, w.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.e) AS ends_sha256
FROM v JOIN s ON s.node = v.node AND s.d = v.d LEFT JOIN v AS w ON w.node = v.up AND w.d = v.d - 1 AND v.d > 0
"""
