"""Near-duplicate documents by one-permutation MinHash.

A document's shingle hashes fall into bins by their leading bits, the least in each bin is its
minimum, and empty bins borrow from full ones by optimal densification. Bands of bins give buckets.
Documents with equal shingle sets are one node. A bucket gives star-shaped candidate edges from its
most central node only: one pair less than it has nodes. Candidates are confirmed on the full sets,
once sizes and short signatures of the sets allow them. Buckets whose nodes are then still in different
components go on: their nodes are dealt anew, by the rarest of their shingles, of which any similar two
must share one, and in these finer buckets the nodes outside the main component become further hubs,
round by round, until no bucket is open. So no link between nodes that share a bucket is lost.

Pairs of the further rounds are bounded as in a prefix join: only nodes of different components that
share a prefix shingle are compared, and only those are confirmed on full sets whose sizes, places of
the shingle and signatures leave room for the similarity. In a group of documents that all lie just
below the similarity, comparisons still grow faster than the group; confirmed pairs are then about
those within a tenth of the difference that the similarity allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.llm.graph import components
from leakloom.llm.words import SPACED, Words, grams, mix, slices, whole
from leakloom.session import discard, materialize, release_shuffles, ship_package

#: Words of a shingle, and the similarity from which on documents are linked.
SHINGLE, SIMILARITY = 5, 0.85
#: Bins (2 ** BITS), bands of BAND bins: a pair at 0.85 misses all 42 buckets with probability 2e-9.
BITS, BAND = 8, 6
#: Further hubs of an open bucket in the first round, about; twice as many in each further one.
SMALL = 64
#: 64-bit words of a set's signature: for each of so many cells whether an odd number of its shingles falls there.
SIGNATURE = 4
_SIGNS = [f"g{i}" for i in range(SIGNATURE)]


def sets_of(w: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than k words the whole sequence is one."""
    h = w.hashes()
    g, inside = grams(h, w.bounds, k)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(np.array([whole(h, a, b)] if b > a else [], np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation sketches (a row a set, none of which is empty)."""
    bins, n = 1 << BITS, len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    at = (flat >> np.uint64(64 - BITS)).astype(np.int64)
    cell = owner * bins + at
    first = np.concatenate([[True], cell[1:] != cell[:-1]])  # sets are sorted: the first in a bin is its least
    out, full = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    out[cell[first]], full[cell[first]] = flat[first], True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):  # each empty bin draws bins, the same ones in all documents, until one is full
        attempt += 1
        drawn = mix((empty % bins).astype(np.uint64) * np.uint64(0x100000001) + np.uint64(attempt)) >> np.uint64(64 - BITS)
        source = empty // bins * bins + drawn.astype(np.int64)
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    return out.reshape(n, bins)


def buckets(sketches: np.ndarray) -> np.ndarray:
    """Bucket hashes of each band (a row a set)."""
    bands = sketches.shape[1] // BAND
    x = sketches[:, : bands * BAND].reshape(len(sketches), bands, BAND)
    total = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(x), 1))
    for j in range(BAND):
        total = mix(total + x[:, :, j])
    return total.view(np.int64)


def _set_sums(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two independent 64-bit sums over each set, which tell sets apart."""
    a = [int(mix(s + np.uint64(17)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    b = [int(mix(s ^ np.uint64(0x5DEECE66D5DEECE6)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    return a, b


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Parities of the shingles in each cell (a row a set): where two differ, the sets have a shingle that the other lacks."""
    cells = 64 * SIGNATURE
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * cells + (flat % np.uint64(cells)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * cells) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(sets), SIGNATURE)


def _document_batches(k: int, whole_sets: bool) -> Callable:
    """Of (doc_id, text, ...) the size, digests and values of the set: all of them, or its buckets with its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, w in slices(batch.column(1), SPACED, True):
                sets = sets_of(w, k)
                a, b = _set_sums(sets)
                columns = [batch.column(0).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                names = ["doc_id", "n_shingles", "s1", "s2", "values"]
                if whole_sets:
                    columns.append(pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
                else:
                    some = [i for i, s in enumerate(sets) if len(s)]
                    found = dict(zip(some, buckets(sketch([sets[i] for i in some])), strict=True)) if some else {}
                    columns.append(pa.array([found.get(i, np.zeros(0, np.int64)) for i in range(len(sets))], pa.list_(pa.int64())))
                    columns += [pa.array(g) for g in signatures(sets).T] + [c.slice(low, high - low) for c in batch.columns[2:]]
                    names += _SIGNS + batch.schema.names[2:]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


_SETS = "doc_id long, n_shingles long, s1 long, s2 long, values array<long>"
_SKETCHES = _SETS + "".join(f", {g} long" for g in _SIGNS)


def _least_shared(na: Column, nb: Column, per_cent: int) -> Column:
    """The fewest shingles that sets of these sizes share at the similarity: 100 c >= p (na + nb - c)."""
    return F.floor((per_cent * (na + nb) + (100 + per_cent - 1)) / (100 + per_cent)).cast("long")


def _may_link(x: str, y: str, per_cent: int) -> Column:
    """Whether sizes and signatures of x and y leave room for the similarity; no pair that has it fails."""
    na, nb = F.col(f"{x}n"), F.col(f"{y}n")
    apart = F.lit(0)
    for g in _SIGNS:
        apart = apart + F.bit_count(F.col(f"{x}{g}").bitwiseXOR(F.col(f"{y}{g}")))
    return (100 * na >= per_cent * nb) & (100 * nb >= per_cent * na) & (apart <= na + nb - 2 * _least_shared(na, nb, per_cent))


def allowed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those that sizes and signatures do not rule out."""
    brief = ["n", *_SIGNS]
    left = sets.select(F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in brief])
    right = sets.select(F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in brief])
    return pairs.join(left, "a").join(right, "b").filter(_may_link("a_", "b_", round(similarity * 100))).select("a", "b")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose full sets (node, n, values) are similar enough."""
    per_cent = round(similarity * 100)
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("values").alias("va"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("values").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("va", "vb")).cast("long"))
    return both.filter(100 * F.col("both") >= per_cent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _open(members: DataFrame, comps: DataFrame, tasks: int) -> DataFrame:
    """The members (bucket, node, ...) of buckets whose nodes lie in several components, with their root; written."""
    rooted = members.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    still = materialize(still, "still", tasks)  # a table, so that Spark can split a large bucket here
    out = materialize(rooted.join(still, "bucket"), "open", tasks)
    discard(still)
    return out


def _prefixes(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, node, at, n, signature) of members of open buckets, where a bucket now is a shingle of
    the node's prefix and at its place there.

    A pair at the similarity s shares at least s / (1 + s) of the sum of its sizes, and the least size
    that a partner can have is that of the smallest member of the same buckets, or s times its own.
    With all shingles ordered by the number of members that hold them, similar members have one in
    common among the first n - shared + 1 of each. Edits come first in that order, so that copies
    with too many of them meet only those with the same edits.
    """
    involved = members.select("node").distinct().join(sets, "node").select("node", "n", "values", *_SIGNS)
    sized = members.select("bucket", "node").join(involved.select("node", "n"), "node")
    floor = sized.groupBy("bucket").agg(F.min("n").alias("least"))
    bound = sized.join(floor, "bucket").groupBy("node").agg(F.first("n").alias("n"), F.min("least").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * F.lit(similarity) - 1e-9))
    shared = F.ceil((F.col("n") + partner) * F.lit(similarity / (1 + similarity)) - 1e-9)
    length = bound.select("node", (F.col("n") - F.least(shared, F.col("n")) + 1).cast("int").alias("length"))
    held = involved.select("node", F.explode("values").alias("v"))
    counted = held.join(held.groupBy("v").agg(F.count("*").alias("c")), "v")
    ordered = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("values"))  # as many as a document has shingles
    first = ordered.join(length, "node").select("node", F.posexplode(F.expr("slice(values, 1, length)")).alias("at", "x"))
    placed = first.filter("x.c > 1").select(F.col("x.v").alias("bucket"), "node", "at")
    return placed.join(involved.select("node", "n", *_SIGNS), "node")


def link(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and chosen of every row, and row_col if given: numbers that tell rows apart.

    component_id is the smallest id reachable by links of that similarity. Rows with equal sets link;
    null and empty texts have no shingles and link with nothing; a row without an id counts as
    linked but never gives the id of a component that has another; rows that repeat an id are judged
    each by their own text; an empty table gives no rows. kept says whether a row has its component's
    id; chosen is true for one row of each component, of that id, and for all rows without shingles.
    """
    spark, per_cent = docs.sparkSession, round(similarity * 100)
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    rows = texts.mapInArrow(_document_batches(k, False), _SKETCHES + ", row long" * bool(row_col))
    rows = materialize(rows if row_col else rows.withColumn("row", F.monotonically_increasing_id()), "sketches")
    tasks = max(24, texts.rdd.getNumPartitions() // 8)  # for tables of links: they are small beside the texts
    some = rows.filter("n_shingles > 0")
    # Documents with equal sets are one node, named by the row of the least id.
    head = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = some.groupBy("s1", "s2").agg(F.min(head).alias("x"), F.first("values").alias("values"), F.first("n_shingles").alias("n"), *[F.first(g).alias(g) for g in _SIGNS])
    nodes = materialize(nodes.select("s1", "s2", F.col("x.row").alias("node"), F.col("x.doc_id").alias("doc_id"), "n", "values", *_SIGNS), "nodes")
    placed = nodes.select("node", F.explode("values").alias("bucket"))
    shared = materialize(placed.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    members = materialize(placed.join(shared, "bucket"), "members")
    # The hub of a bucket is the node that meets most others in all its buckets: what others were copied from.
    score = members.groupBy("node").agg(F.sum("c").alias("score"))
    hubs = materialize(members.join(score, "node").groupBy("bucket").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("hub")), "hubs")
    first, members = members, materialize(members.select("bucket", "node").join(hubs, "bucket"), "members")
    discard(first, shared, hubs)
    release_shuffles(spark)
    involved = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "s1", "s2", *_SIGNS)
    found = texts.select("doc_id", "text").join(involved.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_document_batches(k, True), _SETS)
    full = [F.col("n_shingles").alias("n"), "values", *_SIGNS]
    named = found.join(involved.filter("doc_id is not null"), ["doc_id", "s1", "s2"]).select("node", *full)
    nameless = texts.select("doc_id", "text").filter("doc_id is null").mapInArrow(_document_batches(k, True), _SETS).join(involved.filter("doc_id is null").drop("doc_id"), ["s1", "s2"])
    sets = materialize(named.unionByName(nameless.select("node", *full)).dropDuplicates(["node"]), "sets")
    release_shuffles(spark)
    pairs = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialize(confirm(allowed(pairs, sets, similarity), sets, similarity), "links", tasks)
    comps = components(links, tasks)
    shut = _open(members.filter("node <> hub").select("bucket", "node"), comps, tasks)
    prefixes = materialize(_prefixes(shut, sets, similarity), "prefixes", tasks)
    left, turn = _open(prefixes, comps, tasks), 0
    discard(members, shut, prefixes)
    release_shuffles(spark)
    while not left.isEmpty():
        # Pairs inside the main component of a bucket need no test, so all others are its hubs: at once
        # if they are few, else a part of them that grows from round to round, chosen by a hash.
        sizes = left.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).select("bucket", F.col("m.root").alias("main"), (F.col("all") - F.col("m.c")).alias("others"))
        every = F.greatest(F.lit(1), F.expr(f"others div {SMALL << turn}"))
        hub = (F.col("root") != F.col("main")) & ((F.col("others") <= SMALL << turn) | (F.pmod(F.xxhash64("node", F.lit(turn)), every) == 0))
        before, main = left, materialize(main, "main", tasks)
        left = materialize(left.join(main, "bucket").withColumn("hub", hub).drop("main", "others"), "open", tasks)
        discard(before, main)
        x, y = (left.select("bucket", "hub", "root", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "at", "n", *_SIGNS)]).withColumnsRenamed({"hub": f"{side}_hub", "root": f"{side}_root"}) for side in "xy")
        # Of what the shingle's places leave, enough has to be shared.
        ahead = F.least("x_at", "y_at") + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
        room = (ahead >= _least_shared(F.col("x_n"), F.col("y_n"), per_cent)) & _may_link("x_", "y_", per_cent)
        once = (F.col("x_root") != F.col("y_root")) & (~F.col("x_hub") | (F.col("x_node") > F.col("y_node")))
        met = x.withColumnRenamed("bucket", "of").join(y.filter("y_hub"), (F.col("of") == F.col("bucket")) & once & room)
        pairs = met.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()
        fewer, links = links, materialize(links.unionByName(confirm(pairs, sets, similarity)), "links", tasks)
        comps = components(links, tasks)
        before, left = left, _open(left.filter("not hub").drop("root", "hub"), comps, tasks)
        discard(before, fewer)
        turn += 1
    discard(left, links, sets)
    named = nodes.select("s1", "s2", "node", "doc_id").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("m")).select("root", F.col("m.doc_id").alias("component_id"), F.col("m.node").alias("head"))
    of_set = named.join(least, "root").select("s1", "s2", "component_id", "head")
    out = rows.select("doc_id", "n_shingles", "s1", "s2", "row").join(of_set, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = out.withColumn("chosen", (F.col("n_shingles") == 0) | F.col("row").eqNullSafe(F.col("head")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "chosen", *([F.col("row").alias(row_col)] if row_col else []))


def op5_minhash_components(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("chosen")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - {SHINGLE}, 0) + 1), lambda i: array_to_string(w[i + 1:i + {SHINGLE}], ' '))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {round(100 * SIMILARITY)} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
