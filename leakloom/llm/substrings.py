"""Substring dedup with a log-structured index of fingerprints.

A window is a run of consecutive words. Its fingerprint in the index is the least hash of the shorter
runs inside it (winnowing), so that equal windows have equal fingerprints while neighbours mostly
share theirs. Documents are dealt by a hash into slices of bounded size, and a slice sends its distinct
fingerprints, sorted, to buckets. A bucket merge-joins a batch with the sorted, immutable runs of
earlier batches, tells all holders of a fingerprint that another slice has too, and writes what is new
as a run; once a tier has a few runs, the same pass writes them as one of the next tier, so that an
entry is written again as often as there are tiers. Candidates are then verified on
whole windows: slices send the 96-bit digests of windows with a shared fingerprint, and buckets say
which of them start earlier elsewhere. Slices remove the covered words with these answers and with the
repeats inside the slice.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm.words import SPACED, Words, grams, mix, slices
from leakloom.session import drop_at_exit, drop_path, materialize, shared_dir, ship_package

#: Words of a window, and of the runs of which the least hash is its fingerprint.
WINDOW, ANCHOR = 20, 7
#: Bytes of text of a slice, and of all text for each bucket, about.
SLICE_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
#: Batches in which a whole table passes the index, and runs of one tier that become one of the next.
BATCHES, FANOUT = 2, 2
#: Bytes of text and number of fingerprints that a task gathers before it sends them.
HELD_BYTES, HELD = 16 << 20, 2_000_000
#: Slices of different calls have different numbers: the call's number stands above these bits.
CALL_BITS = 32
_U = np.uint64
_NO_ID = np.iinfo(np.int64).min


def anchors(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprint of the window that starts at each word, the first place in it that gives this, and whether it lies in one text."""
    k = min(ANCHOR, window)
    g, _ = grams(h, w.bounds, k)
    n = len(h)
    out, at, inside = np.zeros(n, _U), np.zeros(n, np.int64), np.repeat(w.bounds[1:], w.counts) - np.arange(n) >= window
    if n >= window:
        least, place, span, width = g[: n - k + 1], np.arange(n - k + 1), 1, window - k + 1
        while span < width:
            step = min(span, width - span)
            right = least[step:] < least[:-step]
            least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
            span += step
        out[: len(least)], at[: len(least)] = least, place
    return out, at, inside


def digests(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes, of 64 and of 32 bits, of the window that starts at each word."""
    other, _ = grams(w.hashes(second=True), w.bounds, window)
    return grams(h, w.bounds, window)[0], (other >> _U(32)).astype(np.uint32)


def bucket_of(fps: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(fps + _U(1)) % _U(buckets)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Sorted numbers as gaps of equal width: a byte for the width, then the low bytes of each gap."""
    return narrow(np.diff(x, prepend=_U(0)))


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(widened(blob), dtype=_U)


def narrow(x: np.ndarray) -> bytes:
    """Numbers of equal width: a byte for the width, then the low bytes of each."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(blob: bytes) -> np.ndarray:
    width = blob[0]
    low = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    return out.view("<u8").reshape(-1)


def _runs_of(*keys: np.ndarray) -> np.ndarray:
    """The places where a run of equal keys starts, and the end."""
    n = len(keys[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for k in keys:
        new[1:n] |= k[1:] != k[:-1]
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def _table(rows: list[tuple], fields: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


_SENT = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("fps", pa.binary())])
_SENT_DDL = "bucket long, slice long, fps binary"


def _anchor_batches(window: int, buckets: int) -> Callable:
    """Of (slice, text) the distinct fingerprints of each slice, sorted, by bucket."""

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        of, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        at = bucket_of(fps, buckets)
        by = np.lexsort((fps, of, at))
        fps, of, at = fps[by], of[by], at[by]
        first = _runs_of(fps, of, at)[:-1]
        fps, of, at = fps[first], of[first], at[first]
        cut = _runs_of(of, at)
        return _table([(int(at[a]), int(of[a]), packed(fps[a:b])) for a, b in itertools.pairwise(cut.tolist())], _SENT).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            of = batch.column(0).to_numpy()
            for low, high, w in slices(batch.column(1), SPACED, False):
                fps, place, inside = anchors(w, w.hashes(), window)
                if inside.any():
                    first = _runs_of(place[inside])[:-1]  # neighbours mostly agree
                    held.append((np.repeat(of[low:high], w.counts)[inside][first], fps[inside][first]))
                    n += len(first)
                if n > HELD:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    return run


_MERGED = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("fps", pa.binary()), ("owners", pa.binary())])
_MERGED_DDL = "kind int, key long, fps binary, owners binary"


def _merge(every: bool) -> Callable:
    """Merge-join what slices sent to a bucket with its runs.

    Gives answers (kind 0, key: a slice) with the fingerprints that another slice has too, and the new
    run (kind 1, key: the bucket): its fingerprints with the slice that has them (and one added), with
    what those runs held that it replaces. Of a fingerprint of several slices, which have then been told,
    every keeps all of them for later calls; else one entry stays, with 0.
    """

    def run(key: tuple, runs: pa.Table, sent: pa.Table) -> pa.Table:
        pieces = [unpacked(x) for x in runs.column("fps").to_pylist()]
        owners = [widened(x).astype(np.int64) for x in runs.column("owners").to_pylist()]
        old = sum(map(len, pieces))
        pieces += [unpacked(x) for x in sent.column("fps").to_pylist()]
        if not pieces:
            return _table([], _MERGED)
        owners += [np.full(len(p), o + 1) for p, o in zip(pieces[len(owners) :], sent.column("slice").to_pylist(), strict=True)]
        fps, owner = np.concatenate(pieces), np.concatenate(owners)
        new, moved = np.arange(len(fps)) >= old, np.zeros(len(fps), bool)
        moved[:old] = np.repeat(runs.column("moved").to_numpy(), [len(p) for p in pieces[: runs.num_rows]])
        by = np.lexsort((moved, new, owner, fps))
        by = by[_runs_of(fps[by], owner[by])[:-1]]  # a slice may have sent it in several parts
        fps, owner, new, moved = fps[by], owner[by], new[by], moved[by]
        cut = _runs_of(fps)
        first, size = cut[:-1], np.diff(cut)
        least, most = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
        told, fresh = least == 0, np.maximum.reduceat(new, first)
        met = told | (least != most)
        tell = np.repeat(met & fresh, size) & (owner > 0) & (new | every | ~np.repeat(told, size))
        rows, to = [], owner[tell] - 1
        if len(to):
            turn = np.argsort(to, kind="stable")
            to, said = to[turn], fps[tell][turn]
            for a, b in itertools.pairwise(_runs_of(to).tolist()):
                rows.append((0, int(to[a]), packed(said[a:b]), b""))
        if every:
            kept = new | moved
            if kept.any():
                rows.append((1, key[0].as_py(), packed(fps[kept]), narrow(owner[kept].astype(_U))))
            return _table(rows, _MERGED)
        kept = np.maximum.reduceat(moved, first) | fresh & ~told
        if kept.any():
            rows.append((1, key[0].as_py(), packed(fps[first][kept]), narrow(np.where(met, 0, least)[kept].astype(_U))))
        return _table(rows, _MERGED)

    return run


class FingerprintIndex:
    """Runs of sorted fingerprints with their slices, as files that are added and never changed.

    Without a number of buckets, the first call's size gives it. With texts kept, later calls verify their windows against those of former ones. Runs
    have tiers: where a batch would be the fanout-th run of a tier, the pass that merges it writes that
    tier's runs with it, as a run of the next tier, and drops them; and so on upward.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT, texts: bool = True):
        self.spark, self.buckets, self.fanout, self.texts = spark, buckets, fanout, texts
        self.path = f"{shared_dir(spark).rstrip('/')}/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[tuple[str, int]] = []
        self.kept: list[str] = []
        self.calls = 0
        drop_at_exit(spark, self.path)

    def add(self, sent: DataFrame) -> DataFrame:
        """Merge a batch into the index; returns its answers: (slice, fps), fingerprints that several slices have."""
        path, tier, moved = f"{self.path}/run-{uuid.uuid4().hex}", 0, []
        while len(same := [r for r in self.runs if r[1] == tier]) + 1 >= self.fanout:
            moved += same
            tier += 1
            if not same:
                break
        runs = self.spark.createDataFrame([], f"{_MERGED_DDL}, moved boolean")
        for old in self.runs:
            runs = runs.unionByName(self.spark.read.schema(_MERGED_DDL).parquet(old[0]).filter("kind = 1").withColumn("moved", F.lit(old in moved)))
        runs = runs.select(F.col("key").alias("bucket"), "fps", "owners", "moved")
        runs.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_merge(self.texts), _MERGED_DDL).write.partitionBy("kind").parquet(path)
        merged = self.spark.read.schema(_MERGED_DDL).parquet(path)
        for old in moved:
            drop_path(self.spark, f"{old[0]}/kind=1")  # its answers stay
        self.runs = [r for r in self.runs if r not in moved] + [(path, tier)]
        return merged.filter("kind = 0").select(F.col("key").alias("slice"), "fps")

    def keep(self, dealt: DataFrame) -> None:
        """Keep the texts of a call for later ones."""
        path = f"{self.path}/texts-{uuid.uuid4().hex}"
        dealt.write.parquet(path)
        self.kept.append(path)

    def former(self, slices: DataFrame) -> DataFrame | None:
        """The kept texts of those slices."""
        if not self.kept:
            return None
        return self.spark.read.schema(_DEALT_DDL).parquet(*self.kept).join(slices, "slice", "left_semi")

    def drop(self) -> None:
        """Delete all files of the index."""
        drop_path(self.spark, self.path)


_DEALT = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("texts", pa.binary())])
_DEALT_DDL = "slice long, ids array<long>, ends array<long>, texts binary"


def _deal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, doc_id, text) as compressed blocks of a slice's texts, so that texts travel small."""
    codec = pa.Codec("zstd", compression_level=3)

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        of = table.column(0).to_numpy()
        by = np.argsort(of, kind="stable")
        of, ids = of[by], table.column(1).combine_chunks().take(pa.array(by))
        texts = pc.fill_null(table.column(2).cast(pa.large_string()).combine_chunks().take(pa.array(by)), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        rows = []
        for a, b in itertools.pairwise(_runs_of(of).tolist()):
            rows.append((int(of[a]), ids[a:b].to_pylist(), ends[a + 1 : b + 1] - ends[a], codec.compress(data[int(ends[a]) : int(ends[b])], asbytes=True)))
        return _table(rows, _DEALT).combine_chunks().to_batches()[0]

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > HELD_BYTES:
            yield blocks(held)
            held, size = [], 0
    if held:
        yield blocks(held)


class _Slice:
    """The documents of a slice in the order of their ids, with the windows that may repeat."""

    def __init__(self, dealt: pa.Table, met: list[bytes], window: int):
        self.ids, texts = [], []
        codec = pa.Codec("zstd")
        for ids, ends, blob in zip(*(dealt.column(c).to_pylist() for c in ("ids", "ends", "texts")), strict=True):
            data = codec.decompress(blob, decompressed_size=ends[-1], asbytes=True) if ends[-1] else b""
            self.ids += ids
            texts += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        order = sorted(range(len(texts)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0, texts[i]))
        self.ids, self.texts = [self.ids[i] for i in order], [texts[i] for i in order]
        column = pa.array(self.texts, pa.large_binary()).view(pa.large_string())
        told = np.unique(np.concatenate([unpacked(x) for x in met])) if met else np.zeros(0, _U)
        counts, starts, fps, checks, shared, found, at = [], [], [], [], [], [], 0
        for _, _, w in slices(column, SPACED, False):
            h = w.hashes()
            found.append((w, h, *anchors(w, h, window)))
        # Equal windows have equal fingerprints at different places, so both of these are met here or elsewhere.
        mine = [a[inside][_runs_of(place[inside])[:-1]] for _, _, a, place, inside in found if inside.any()]
        seen, times = np.unique(np.concatenate(mine) if mine else np.zeros(0, _U), return_counts=True)
        twice = seen[times > 1]
        for w, h, a, _, inside in found:
            outside = _within(a, told)
            may = np.flatnonzero(inside & (outside | _within(a, twice)))
            if len(may):
                f, c = digests(w, h, window)
                starts.append(may + at)
                fps.append(f[may])
                checks.append(c[may])
                shared.append(outside[may])
            counts.append(w.counts)
            at += len(h)
        empty = np.zeros(0, np.int64)
        self.counts = np.concatenate(counts) if counts else empty
        self.starts = np.concatenate(starts) if starts else empty
        self.fps = np.concatenate(fps) if fps else np.zeros(0, _U)
        self.checks = np.concatenate(checks) if checks else np.zeros(0, np.uint32)
        shared = np.concatenate(shared) if shared else np.zeros(0, bool)
        self.words = at
        # Equal windows side by side, the earliest first.
        self.by = np.lexsort((self.starts, self.checks, self.fps))
        self.cut = _runs_of(self.fps[self.by], self.checks[self.by])
        self.first = self.by[self.cut[:-1]]
        self.asked = np.flatnonzero(shared[self.first]) if len(self.first) else empty  # equal windows share this

    def owners(self) -> np.ndarray:
        """The id of the document that holds the first of each group of equal windows that is asked for."""
        ends = np.cumsum(self.counts)
        ids = np.array([_NO_ID if i is None else i for i in self.ids], np.int64)
        return ids[np.searchsorted(ends, self.starts[self.first[self.asked]], "right")]

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with the groups, places in asked, that it is asked for; sorted by digest."""
        at = bucket_of(self.fps[self.first[self.asked]], buckets)
        order = np.argsort(at, kind="stable")
        for a, b in itertools.pairwise(_runs_of(at[order]).tolist()):
            yield int(at[order[a]]), order[a:b]


def _within(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of x are in held, which is sorted."""
    if not len(held):
        return np.zeros(len(x), bool)
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


_ASKED = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("fps", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())])
_ASKED_DDL = "bucket long, slice long, fps binary, checks binary, ids binary"


def _ask(window: int, buckets: int) -> Callable:
    """The digests of a slice's windows with a shared fingerprint, each once, with the id that holds its first."""

    def run(key: tuple, dealt: pa.Table, answers: pa.Table) -> pa.Table:
        met = answers.column("fps").to_pylist()
        if not met or not dealt.num_rows:
            return _table([], _ASKED)
        s = _Slice(dealt, met, window)
        ids, rows = s.owners(), []
        for bucket, groups in s.by_bucket(buckets):
            at, own = s.first[s.asked[groups]], ids[groups]
            low = int(own.min())
            rows.append((bucket, key[0].as_py(), packed(s.fps[at]), s.checks[at].tobytes(), low.to_bytes(8, "little", signed=True) + narrow((own - low).view(_U))))
        return _table(rows, _ASKED)

    return run


_ANSWER = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_ANSWER_DDL = "slice long, bucket long, bits binary"


def _verify(key: tuple, asked: pa.Table) -> pa.Table:
    """For each slice which of its windows start earlier in another: in a former call, or a smaller id."""
    of = asked.column("slice").to_pylist()
    fps = [unpacked(x) for x in asked.column("fps").to_pylist()]
    checks = np.concatenate([np.frombuffer(x, np.uint32) for x in asked.column("checks").to_pylist()])
    ids = np.concatenate([widened(x[8:]).view(np.int64) + np.int64(int.from_bytes(x[:8], "little", signed=True)) for x in asked.column("ids").to_pylist()])
    size = [len(x) for x in fps]
    slice_, fps = np.repeat(np.array(of, np.int64), size), np.concatenate(fps)
    by = np.lexsort((slice_, ids, slice_ >> CALL_BITS, checks, fps))
    again = np.ones(len(fps), bool)
    again[by[_runs_of(fps[by], checks[by])[:-1]]] = False
    rows, at = [], 0
    for s, n in zip(of, size, strict=True):
        bits = again[at : at + n]
        at += n
        if bits.any():
            rows.append((s, key[0].as_py(), np.packbits(bits).tobytes()))
    return _table(rows, _ANSWER)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _kept(window: int, buckets: int) -> Callable:
    """Remove a slice's covered words, by the answers to it (fps: what it shares; bits: what starts earlier elsewhere)."""

    def run(key: tuple, dealt: pa.Table, answers: pa.Table) -> pa.Table:
        if not dealt.num_rows:
            return _table([], _KEPT)
        s = _Slice(dealt, [x for x in answers.column("fps").to_pylist() if x is not None], window)
        bits = {b: x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True) if x is not None}
        again = np.ones(len(s.starts), bool)
        again[s.first] = False
        for bucket, groups in s.by_bucket(buckets):
            if bucket in bits:
                earlier = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(groups)).astype(bool)
                again[s.first[s.asked[groups[earlier]]]] = True
        cover = np.zeros(s.words + window + 1, np.int32)
        np.add.at(cover, s.starts[again], 1)
        np.add.at(cover, s.starts[again] + window, -1)
        covered = np.cumsum(cover)[: s.words] > 0
        removed, kept, at = [], [], 0
        for text, n in zip(s.texts, s.counts.tolist(), strict=True):
            gone = covered[at : at + n]
            removed.append(int(gone.sum()))
            words = text.split()  # bytes are split at the same white space
            kept.append(b" ".join(itertools.compress(words, (~gone).tolist()) if removed[-1] else words).decode())
            at += n
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((s.ids, s.counts, removed, kept), _KEPT, strict=True)], schema=_KEPT)

    return run


def slice_of(doc_id: Column, text: Column, n: int, window: int) -> Column:
    """The slice of a row, by a hash of its id and text; a text too short for a window stays with its partition's."""
    short = F.coalesce(F.octet_length(text), F.lit(0)) < 2 * window - 1
    return F.pmod(F.when(short, F.xxhash64(F.spark_partition_id())).otherwise(F.xxhash64(doc_id, text)), F.lit(n)).cast("long")


def dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, index: FingerprintIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one space) of every row.

    A word goes if a window that covers it also starts earlier: in a row of a smaller id, earlier in
    the same row, or in an index given from former calls. Null and empty texts have no words; rows
    without an id come first, and rows that repeat an id are ordered by a hash of their texts; rows
    equal in both are handled in one slice, where all but one of them lose their windows; an empty
    table gives no rows. All rows are judged on the input, not on what is left of it.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // SLICE_BYTES))
    index = index or FingerprintIndex(spark, texts=False)
    index.buckets = index.buckets or max(12, -(-size // BUCKET_BYTES))
    call = F.lit(index.calls << CALL_BITS)
    index.calls += 1
    placed = rows.withColumn("slice", slice_of(F.col("doc_id"), F.col("text"), n, window) + call)
    shared = None
    for b in range(batches):  # a batch is a part of the slices
        part = placed.filter(F.pmod("slice", F.lit(batches)) == b).filter(F.octet_length("text") >= 2 * window - 1)
        answers = index.add(part.select("slice", "text").mapInArrow(_anchor_batches(window, index.buckets), _SENT_DDL))
        shared = answers if shared is None else shared.unionByName(answers)
    dealt = placed.select("slice", "doc_id", "text").mapInArrow(_deal_batches, _DEALT_DDL)
    if index.texts:
        former = index.former(shared.select("slice").distinct())
        index.keep(dealt)
        every = dealt if former is None else dealt.unionByName(former)
    else:
        every = dealt
    asked = every.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(_ask(window, index.buckets), _ASKED_DDL)
    bits = materialize(asked.groupBy("bucket").applyInArrow(_verify, _ANSWER_DDL), "earlier")
    told = shared.withColumns({"bucket": F.lit(None).cast("long"), "bits": F.lit(None).cast("binary")})
    told = told.unionByName(bits.withColumn("fps", F.lit(None).cast("binary")))
    return dealt.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_kept(window, index.buckets), "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows of 20 words cover, and a digest of the others."""
    index = FingerprintIndex(spark, texts=False)
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), index=index)
    out = materialize(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "substrings")
    index.drop()
    return out


OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
lost AS (SELECT DISTINCT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
