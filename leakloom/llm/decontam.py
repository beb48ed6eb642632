"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item gives windows of consecutive words, a window gives shingles, and a document word is
hit when it lies in an occurrence of a window. Items of the same words are one class, and the items of
a set of windows are looked up once. Spark tasks cut documents to the runs of words in which each
shingle may be the benchmark's (a Bloom filter of bounded size) and a whole window may fit; equal runs
are then handled once. Shingles are ordered by the number of documents that hold them. As containment
is to be complete, the prefix of a window that must join is its one rarest shingle; positions bound
where the window can lie, and its words are compared one for one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakloom.llm.words import ALNUM, grams, slices
from leakloom.session import materialize, ship_package

#: Words of a window and of a shingle; a shorter item is one window, a shorter window one shingle.
WINDOW, SHINGLE = 10, 5
#: Bits of the Bloom filter for each of the benchmark's shingles, and the least and most bits in all: at most 16 MB are
#: gathered and broadcast. Beyond 8 million shingles more of the texts pass the filter; what it lets pass is joined in any case.
BLOOM_PER, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 20, 1 << 27
#: Bytes of the filter that one task puts together, of which the driver gets a row.
BLOCK = 1 << 16
#: Shingles of a run that are cut from it at once.
PIECE = 1024
# Fixed value: the characters between words, once A-Z are lower-cased.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"[^{BETWEEN}]+"), F.lit(0))


def item_classes(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(words, n, item_ids): the word sequences of items, joined by one space, with the ids of the items that have them, as strings."""
    w = words_of(F.col(text_col))
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.array_join(w, " ").alias("words"), F.size(w).alias("n"))
    return rows.filter("n > 0").groupBy("words", "n").agg(F.collect_set("item_id").alias("item_ids"))


def class_windows(classes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, size, classes): the distinct windows, words joined by one space, with the classes that have them."""
    w = F.col("w")
    cut = F.when(F.size(w) < window, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0))), lambda i: F.slice(w, i + 1, F.lit(window))))
    rows = classes.select("class", F.split("words", " ").alias("w")).select("class", F.explode(cut).alias("c"))
    return rows.select("class", F.size("c").alias("size"), F.array_join("c", " ").alias("win")).groupBy("win", "size").agg(F.collect_set("class").alias("classes"))


def _bits(g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of so many bits, a power of two."""
    return (g & np.uint64(size - 1)).astype(np.int64), ((g >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def _shingle_batches(k: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.minimum(np.asarray(batch.column(1)), k)
            for low, high, w in slices(batch.column(0), ALNUM, False):
                h = w.hashes()
                out = [np.zeros(0, np.uint64)]
                for n in np.unique(sizes[low:high]):
                    g, inside = grams(h, w.bounds, int(n))
                    out.append(g[inside & np.repeat(sizes[low:high] == n, w.counts)])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_bits(np.concatenate(out), size))))], ["bit"])

    return run


def _block(cells: pa.Table) -> pa.Table:
    """The bytes of a block of the filter, from its words of 64 bits."""
    at, out = cells["cell"].to_numpy() % (BLOCK // 8), np.zeros(BLOCK // 8, "<i8")
    out[at] = cells["set"].to_numpy()
    return pa.table({"block": cells["block"][:1], "held": pa.array([out.tobytes()], pa.binary())})


def bloom(classes: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> np.ndarray:
    """The Bloom filter of all shingles of the classes' windows; tasks make its blocks, and BLOOM_MOST / 8 bytes at most are gathered."""
    shingles = classes.agg(F.sum(F.col("n") - F.least("n", F.lit(min(window, k))) + 1)).first()[0] or 0
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_PER * shingles).bit_length()))
    bits = classes.select("words", "n").mapInArrow(_shingle_batches(min(window, k), size), "bit long")
    cells = bits.groupBy(F.expr("bit div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set"))
    out = np.zeros(size // 8, np.uint8)
    for r in cells.withColumn("block", F.expr(f"cell div {BLOCK // 8}")).groupBy("block").applyInArrow(_block, "block long, held binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["held"], np.uint8)
    return out


def _held(bloom_bytes: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds."""
    a, b = _bits(g, 8 * len(bloom_bytes))
    return ((bloom_bytes[a >> 3] >> (a & 7).astype(np.uint8)) & (bloom_bytes[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _run_batches(filter_bits, sizes: list[int], k: int) -> Callable:
    """Of (carried, text) the number of words and the runs that windows may cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, w in slices(batch.column(1), ALNUM, True):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(w.counts.astype(np.int64)), pa.array(_runs(w, filter_bits.value, sizes, k), pa.list_(pa.string()))], ["carried", "n_words", "runs"]
                )

    return run


def _runs(w, held: np.ndarray, sizes: list[int], k: int) -> list[list[str]]:
    """Of each text the runs of words that windows of these sizes may cover, by the filter."""
    h, n = w.hashes(), len(w.starts)
    cover = np.zeros(n + 1, np.int32)
    may: dict[int, np.ndarray] = {}
    for size in sizes:
        s = min(size, k)
        if s not in may:
            g, inside = grams(h, w.bounds, s)
            may[s] = inside & _held(held, g)
        fits = may[s].copy()
        for j in range(1, size - s + 1):  # all its shingles have to be there, in one text
            fits[: max(0, n - j)] &= may[s][j:]
            fits[max(0, n - j) :] = False
        at = np.flatnonzero(fits)
        if size > s:
            at = at[at + size <= w.bounds[np.searchsorted(w.bounds, at, "right")]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
    covered = np.cumsum(cover[:n]) > 0
    edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[str]] = [[] for _ in range(len(w.bounds) - 1)]
    for a, b in zip(begin, end, strict=True):
        while a < b:  # a run may touch the next text's
            text = int(np.searchsorted(w.bounds, a, "right")) - 1
            stop = min(b, int(w.bounds[text + 1]))
            out[text].append(" ".join(w.text(a, stop)))
            a = stop
    return out


def _shingle(words: Column, at: Column, s: Column) -> Column:
    """A hash of s words; equal hashes only propose a place, where words are compared."""
    return F.xxhash64(F.array_join(F.slice(words, at + 1, s), " ")).alias("shingle")


def run_shingles(runs: DataFrame, sizes: list[int], k: int = SHINGLE) -> DataFrame:
    """(run_id, docs, at, shingle, lead, around) of runs (run_id, run, docs), for windows of these sizes.

    around has the words that a window over the shingle can have, lead of them before it: so many at
    most whatever the length of the run, which is cut in pieces.
    """
    most = {min(size, k): size for size in sorted(sizes)}
    kinds = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("most")) for s, m in most.items()])
    words, part, s, wide = F.col("words"), F.col("piece.part"), F.col("kind.s"), F.col("kind.most")

    def piece(low: Column) -> Column:
        before = F.least(low, wide - s)
        return F.struct((low - before).alias("low"), before.alias("before"), F.slice(words, low - before + 1, before + wide + F.lit(PIECE - 1)).alias("part"))

    def spot(i: Column) -> Column:
        lead = F.least(i, wide - s)
        return F.struct((F.col("piece.low") + i).alias("at"), _shingle(part, i, s), lead.alias("lead"), F.slice(part, i - lead + 1, lead + wide).alias("around"))

    each = runs.select("run_id", "docs", F.split("run", " ").alias("words"), F.explode(kinds).alias("kind")).filter(F.size("words") >= s)
    each = each.select("run_id", "docs", "kind", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - s, F.lit(PIECE)), piece)).alias("piece"))
    first = F.col("piece.before")
    return each.select("run_id", "docs", F.explode(F.transform(F.sequence(first, F.least(first + F.lit(PIECE - 1), F.size(part) - s)), spot)).alias("x")).select("run_id", "docs", "x.*")


def occurrences(runs: DataFrame, windows: DataFrame, sizes: list[int], k: int = SHINGLE) -> DataFrame:
    """(run_id, first, size, window) of each occurrence of windows (window, size, win) in runs (run_id, run, docs)."""
    held = run_shingles(runs, sizes, k)
    rarity = held.groupBy("shingle").agg(F.sum("docs").alias("docs"))
    s = F.least("size", F.lit(k))
    w = windows.select("window", "size", F.split("win", " ").alias("w"))
    order = w.select("window", "size", F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - s), lambda i: F.struct(i.alias("at"), _shingle(F.col("w"), i, s)))).alias("x"))
    order = order.select("window", "size", "x.*").join(rarity, "shingle")
    # A window with a shingle that no run holds cannot occur; of the others the rarest shingle has to join.
    whole = order.groupBy("window", "size").agg(F.count("*").alias("n"), F.min(F.struct("docs", "shingle", "at")).alias("p")).filter(F.col("n") == F.col("size") - s + 1)
    prefix = whole.select("window", "size", F.col("p.shingle").alias("shingle"), F.col("p.at").alias("offset")).join(windows.select("window", "win"), "window")
    begin = F.col("lead") - F.col("offset")
    met = held.join(prefix, "shingle").filter((begin >= 0) & (begin + F.col("size") <= F.size("around")))
    met = met.filter(F.array_join(F.slice("around", begin + 1, F.col("size")), " ") == F.col("win"))
    return met.select("run_id", (F.col("at") - F.col("offset")).alias("first"), "size", "window")


def _met(docs: DataFrame, carried: Column, text: Column, items: DataFrame, window: int, k: int, item_id_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """All written but `met`: rows (row, carried, n_words, runs), classes (class, item_ids), windows (window, classes), distinct runs (run_id, run); each (row, run); met by occurrences()."""
    spark = docs.sparkSession
    ship_package(spark)
    classes = materialize(item_classes(items, item_id_col, item_text_col).withColumn("class", F.monotonically_increasing_id()), "classes")
    # Items are short and have many windows: a file or partition of them is dealt over all tasks.
    dealt = classes.select("class", "words").repartition(max(2, spark.sparkContext.defaultParallelism), "class")
    windows = materialize(class_windows(dealt, window).withColumn("window", F.monotonically_increasing_id()), "windows")
    sizes = sorted(r["size"] for r in classes.select(F.least("n", F.lit(window)).alias("size")).distinct().collect())  # as many as a window has words at most
    bits = spark.sparkContext.broadcast(bloom(classes, window, k))
    rows = docs.select(carried.alias("carried"), text.alias("text"))
    schema = T.StructType([rows.schema["carried"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StringType()))])
    kept = materialize(rows.mapInArrow(_run_batches(bits, sizes, k), schema).withColumn("row", F.monotonically_increasing_id()), "runs")
    each = kept.select("row", F.explode("runs").alias("run"))
    runs = materialize(each.groupBy("run").agg(F.count("*").alias("docs")).withColumn("run_id", F.monotonically_increasing_id()), "distinct-runs")
    return kept, each, runs, classes, windows, occurrences(runs, windows, sizes or [window], k)


def _contamination(docs: DataFrame, items: DataFrame, window: int, k: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str, of_items: list[Column]) -> DataFrame:
    """doc_id, n_words, n_hit, and the columns of_items, which are of the sorted item_ids of a document; null without hits."""
    kept, each, runs, classes, windows, met = _met(docs, F.col(id_col).cast("long"), F.col(text_col), items, window, k, item_id_col, item_text_col)
    end = F.col("first") + F.col("size")
    before = F.coalesce(F.max(end).over(Window.partitionBy("run_id").orderBy("first", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covers = met.select("run_id", "window", F.greatest(end - F.greatest("first", before), F.lit(0)).alias("more"))  # words that none before covers
    of_run = covers.groupBy("run_id").agg(F.sum("more").alias("n_hit"), F.collect_set("window").alias("windows"))
    of_run = materialize(runs.join(of_run, "run_id").select("run", "n_hit", "windows"), "hit-runs")
    held = F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows"))))
    of_row = each.join(of_run, "run").groupBy("row").agg(F.sum("n_hit").alias("n_hit"), held.alias("windows"))
    of_row = materialize(of_row.withColumn("key", F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256)), "hit-rows")
    # Documents with the same windows have the same items: these are gathered once, and from classes, not windows.
    sets = of_row.groupBy("key").agg(F.min("windows").alias("windows")).select("key", F.explode("windows").alias("window"))
    sets = sets.join(windows.select("window", "classes"), "window").select("key", F.explode("classes").alias("class")).distinct()
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    of_set = materialize(sets.join(classes.select("class", "item_ids"), "class").groupBy("key").agg(ids.alias("item_ids")).select("key", *of_items), "hit-sets")
    hits = of_row.select("row", "n_hit", "key").join(of_set, "key").drop("key")
    out = kept.select("row", F.col("carried").alias("doc_id"), "n_words").join(hits, "row", "left").drop("row")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit and the sorted item_ids of every document (as strings).

    Null and empty texts have no words; items without words have no windows; repeated rows are judged
    each, items with equal texts all count; an empty benchmark hits nothing.
    """
    out = _contamination(docs, items, window, k, id_col, text_col, item_id_col, item_text_col, [F.col("item_ids")])
    return out.withColumn("item_ids", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")))


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, in whose text no window of the benchmark occurs.

    Rows are told apart by their place, so null and repeated ids do not matter and each row is judged
    by its own text. Only the rows that the filter finds runs in are shuffled.
    """
    kept, each, runs, _, _, met = _met(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(text_col), items, window, k, item_id_col, item_text_col)
    hit = materialize(runs.join(met.select("run_id").distinct(), "run_id").select("run"), "hit-runs")
    clean = kept.filter(F.size("runs") == 0).select("carried.*")
    return clean.unionByName(kept.filter(F.size("runs") > 0).join(each.join(hit, "run").select("row").distinct(), "row", "left_anti").select("carried.*"))


def op1_benchmark_hits(spark, sf_dir: str) -> DataFrame:
    """Words of every document that occur in windows of the benchmark."""
    of_items = [F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")]
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = _contamination(docs, items, WINDOW, SHINGLE, "doc_id", "text", "item_id", "text", of_items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{BETWEEN}]+')"
OP1_SQL = f"""
WITH dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, unnest(list_transform(range(0, greatest(len(w) - {WINDOW}, 0) + 1), lambda i: array_to_string(w[i + 1:i + {WINDOW}], ' '))) AS win
  FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM dw, sizes WHERE len(w) >= size),
hit AS (SELECT DISTINCT spot.doc_id, spot.i, spot.size, win.item_id FROM spot JOIN win ON win.size = spot.size AND win.win = array_to_string(spot.w[spot.i + 1:spot.i + spot.size], ' ')),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
