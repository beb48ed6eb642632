"""Periodic runs of words: a dictionary of basic factors proposes periods, extension makes them maximal.

Basic factors are the blocks of 2 ** k words; equal blocks of a text get equal names, and the names of
one length make those of the next by pairs. Where a block occurs again within twice its length, and
that occurrence again at the same distance, the three are an arithmetic progression: the distance is
a period of what they cover. Blocks that occur once in their text cannot be parts of larger ones that
occur twice, so of ordinary texts little is left after two or three lengths. Texts are handled where
they are read, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.llm.sharding import _crc_entries
from leakloom.llm.words import SPACED, mix, slices
from leakloom.session import ship_package

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_U = np.uint64
_BASE = _U(0xA0761D6478BD642F)
#: (doc_id, words) -> (start, period): from word start on, the words of a text are those of its first period.
Fold = Callable[[int | None, int], tuple[int, int] | None]

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _groups(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names 0, 1, ... of equal keys, each place's distance to the next of its name (0: none), and which names occur twice."""
    by = np.argsort(keys, kind="stable")
    same = keys[by[1:]] == keys[by[:-1]]
    name, gap, twice = np.empty(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    name[by] = np.cumsum(np.concatenate([[0], ~same]))
    gap[by[:-1][same]] = (at[by[1:]] - at[by[:-1]])[same]
    twice[by[:-1][same]] = True
    twice[by[1:][same]] = True
    return name, gap, twice


def _progressions(at: np.ndarray, gap: np.ndarray, size: int) -> np.ndarray:
    """Rows (first, end, period) of stretches that blocks of this size at neighbouring places cover with one period.

    Places follow each other with the same gap for longer than the gap: some block has its next
    occurrence, and that one its own, at the same distance.
    """
    near = (gap > 0) & (gap <= 2 * size)
    at, gap = at[near], gap[near]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(gap) != 0), [True]]))
    first, last = cut[:-1], cut[1:] - 1
    far = at[last] - at[first] + 1 > gap[first]
    first, last = first[far], last[far]
    return np.stack([at[first], at[last] + size + gap[first], gap[first]], 1)


class _Stretch:
    """Whether words repeat at a distance, for many places at once, by sums of the words' hashes times powers."""

    def __init__(self, h: np.ndarray):
        self.power = np.full(len(h) + 1, _BASE, _U)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.total = np.zeros(len(h) + 1, _U)
        np.cumsum(h * self.power[:-1], out=self.total[1:])

    def repeats(self, low: np.ndarray, high: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether words low to high - 1 are those at one period further on."""
        return (self.total[high] - self.total[low]) * self.power[period] == self.total[high + period] - self.total[low + period]

    def longest(self, most: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The largest number up to most for which holds, which then holds for all smaller ones."""
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = holds(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def find_runs(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs (start, length, period) of word hashes h, by start and then period; text i has words bounds[i]:bounds[i + 1].

    A run is a maximal stretch within a text, of at least LEAST_WORDS words and LEAST_PERIODS of its
    smallest period. A run of period q shows at the least block length that is not below q: in it each
    block's next occurrence is q words on, as a nearer one would give the run a smaller period.
    """
    n = len(h)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low, high = bounds[:-1][of], bounds[1:][of]
    at, keys, size, found = np.arange(n), mix(h ^ mix(of.astype(_U) + _U(1))), 1, []
    names = np.empty(n, np.int64)
    while len(at):
        name, gap, twice = _groups(keys, at)
        found.append(_progressions(at, gap, size))
        names[:] = -1
        names[at[twice]] = name[twice]
        at = at[twice]
        at = at[at + 2 * size <= high[at]]
        at = at[names[at + size] >= 0]
        keys, size = names[at] * n + names[at + size], 2 * size
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    if not len(runs):
        return runs
    first, end, q = runs.T
    words = _Stretch(mix(h))
    left = words.longest(first - low[first], lambda m: words.repeats(first - m, first, q))
    right = words.longest(high[first] - end, lambda m: words.repeats(end - q, end - q + m, q))
    start, length = first - left, end - first + left + right
    runs = np.stack([start, q, length], 1)[length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)]
    return np.unique(runs, axis=0)[:, [0, 2, 1]]


def _batches(fold: Fold | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            for low, high, w in slices(texts, SPACED, False):
                place, counts = np.arange(len(w.starts)), w.counts.tolist()
                if fold:
                    for i, (a, b) in zip(ids[low:high], pairwise(w.bounds.tolist()), strict=True):
                        if b > a and (how := fold(i, b - a)):
                            place[a + how[0] : b] = a + how[0] + np.arange(b - a - how[0]) % how[1]
                runs = find_runs(w.hashes()[place], w.bounds)
                gone = np.zeros(len(place) + 1, np.int32)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                stays = np.cumsum(gone)[:-1] == 0
                of = np.searchsorted(w.bounds, runs[:, 0], "right") - 1
                kept = []
                for text, a, b in zip(texts[low:high].cast(pa.large_binary()).to_pylist(), *(w.bounds[x].tolist() for x in (slice(-1), slice(1, None))), strict=True):
                    words = text.split()  # bytes are split at the same white space
                    if fold:
                        words = [words[i] for i in (place[a:b] - a).tolist()]
                    kept.append(b" ".join(compress(words, stays[a:b].tolist())).decode())
                listed = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - w.bounds[of], runs[:, 1], runs[:, 2])], fields=list(_RUN))
                offsets = pa.array(np.searchsorted(of, np.arange(high - low + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high], pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, listed), pa.array(kept, pa.string())], schema=_OUT)

    return run


def periodic_runs(docs: DataFrame, fold: Fold | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every row.

    Runs may overlap and nest. Collapsed is the text's words, joined by one space, without those that
    any run holds after its first period. fold, if given, makes texts periodic first. Null and empty
    texts have no words and no runs; rows without an id and rows that repeat an id or a text are rows
    like others; an empty table gives no rows; other columns do not matter and are not carried. Lowers
    the session's Arrow batches (ship_package).
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_batches(fold), _DDL)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The query's fold: a tenth of the ids get a periodic end; a row without an id stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of words in every document: their number, the longest, and digests of all and of the collapsed text."""
    out = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    out = out.withColumn("top", longest).withColumn("said", F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), "top.length", (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2("said", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = f"""
WITH t AS (SELECT {_crc_entries()} AS steps),
ids AS (SELECT DISTINCT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT)) AS bs FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, y: xor(c >> 8, steps[CAST(xor(c, y) & 255 AS INT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS h FROM ids, t),
o AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS fold, h // 10 AS g FROM o LEFT JOIN crc USING (doc_id)),
p AS (SELECT r, doc_id, w, n, fold, CASE WHEN fold THEN g % n END AS a, CASE WHEN fold THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM f),
d AS (SELECT r, doc_id, n, CASE WHEN fold THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
word AS (SELECT r, n, unnest(w) AS x, unnest(range(0, n)) AS i FROM d),
pair AS (SELECT a.r, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // {LEAST_PERIODS}),
island AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair) GROUP BY r, q, k),
run AS (SELECT r, s, l, min(q) AS q FROM island WHERE l >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q) GROUP BY r, s, l),
runs AS (SELECT r, count(*) AS n_runs, max(struct_pack(l := l, s := -s, q := -q)) AS m, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-m.s AS BIGINT) AS start, CAST(m.l AS BIGINT) AS length, CAST(-m.q AS BIGINT) AS period, CAST(1000 * m.l // -m.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN runs USING (r) LEFT JOIN kept USING (r)
"""
