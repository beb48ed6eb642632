"""Matching rules against blobs: the lateral join of every blob with every rule whose pattern it holds."""

from __future__ import annotations

import contextlib
import re
import signal
import sys
import threading
import time
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.operators.prefilter import Prefilter
from leakloom.plans.rules import Rule, compiled
from leakloom.session import materialize, ship_package

#: Seconds that one rule may take on one blob.
TIMEOUT = 5.0

MATCHES = (
    "blob_id string, rule_id string, rule_place int, start long, end long, groups array<string>, named map<string,string>, "
    "before string, matching string, after string, start_line long, start_column long, end_line long, end_column long"
)
_FIELDS = pa.schema(
    [("blob_id", pa.string()), ("rule_id", pa.string()), ("rule_place", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("groups", pa.list_(pa.string())), ("named", pa.map_(pa.string(), pa.string()))]
    + [(n, pa.string()) for n in ("before", "matching", "after")]
    + [(n, pa.int64()) for n in ("start_line", "start_column", "end_line", "end_column")]
)
_REPORT = pa.schema([*_FIELDS, ("status", pa.string()), ("blobs", pa.int64()), ("millis", pa.float64())])
_REPORT_DDL = ", status string, blobs long, millis double"


def context(text: str, start: int, end: int, lines: int) -> tuple[str | None, str | None]:
    """What stands around a match: the rest of its lines and so many whole lines on either side."""
    if lines <= 0:
        return None, None
    low = start
    for i in range(lines + 1):
        found = text.rfind("\n", 0, low - (i > 0)) if low - (i > 0) > 0 else -1
        low = found + 1
        if found < 0:
            break
    high = end + (text[end : end + 1] == "\n")
    begin = high
    for _ in range(lines):
        found = text.find("\n", high)
        high = len(text) if found < 0 else found + 1
        if found < 0:
            break
    return text[low:start], text[begin:high]


class _Bytes:
    """Byte offsets, lines and byte columns of positions in one text; each line and stretch is looked at once."""

    def __init__(self, text: str):
        self.text, self.ascii, self.at, self.bytes = text, text.isascii(), 0, 0
        self.newlines: list[int] | None = None
        self.begin, self.begin_bytes = 0, 0

    def offset(self, position: int) -> int:
        if self.ascii:
            return position
        if position < self.at:
            self.at = self.bytes = 0
        self.bytes += len(self.text[self.at : position].encode("utf-8", "surrogateescape"))
        self.at = position
        return self.bytes

    def place(self, position: int) -> tuple[int, int]:
        """The line, from 1, and the byte column, from 1."""
        if self.newlines is None:
            self.newlines = [m.start() for m in re.finditer("\n", self.text)]
        line = bisect_left(self.newlines, position)
        begin = self.newlines[line - 1] + 1 if line else 0
        if begin != self.begin:
            self.begin, self.begin_bytes = begin, self.offset(position) - len(self.text[begin:position].encode("utf-8", "surrogateescape"))
        return line + 1, self.offset(position) - self.begin_bytes + 1


class _TooLong(Exception):
    pass


@contextlib.contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Raise _TooLong in the block once so many seconds have passed; Python's engine looks for signals while it matches."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise _TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


#: What may become of a rule on a blob, the worst last.
STATUSES = ("none", "matched", "timeout", "error")


class Tally:
    """What became of rules on blobs: counts and times by rule and status, and each blob on which a rule was given up."""

    def __init__(self):
        self.counts: dict[tuple[str, str], list[float]] = {}
        self.given_up: list[tuple[str, str, str]] = []

    def add(self, blob: str | None, rule_id: str, status: str, began: float) -> None:
        kept = self.counts.setdefault((rule_id, status), [0, 0.0])
        kept[0] += 1
        kept[1] += 1000 * (time.perf_counter() - began)
        if status in STATUSES[2:]:
            self.given_up.append((blob, rule_id, status))


def found_in(text: str, pattern: re.Pattern, timeout: float | None, start: int = 0, stop: int | None = None) -> tuple[list[re.Match], str]:
    """The matches of a pattern that begin from start on and before stop, and a status.

    A pattern that takes longer than the timeout is given up: what it found before stays, and its status tells.
    """
    out: list[re.Match] = []
    try:
        with deadline(timeout):
            for m in pattern.finditer(text, start):
                if stop is not None and m.start() >= stop:
                    break
                out.append(m)
    except _TooLong:
        return out, "timeout"
    except (RecursionError, MemoryError, RuntimeError):
        return out, "error"
    return out, "matched" if out else "none"


def matches_in(
    text: str, rules: list[tuple[str, tuple[str, ...], re.Pattern]], lines: int, dedupe: str | None, prefilter: Prefilter | None = None, timeout: float | None = TIMEOUT, tally: Tally | None = None, blob: str | None = None
) -> Iterator[tuple]:
    """Matches of each rule in turn, in the whole text whatever its size; groups that took no part are left out.

    What became of the rules that were tried goes to the tally. Rules are not timed outside a main thread.
    """
    of = _Bytes(text)
    for place in (prefilter or Prefilter((k, p) for _, k, p in rules)).candidates(text):
        rule_id, _, pattern = rules[place]
        seen, began = set(), time.perf_counter()
        found, status = found_in(text, pattern, timeout)
        if tally:
            tally.add(blob, rule_id, status, began)
        for m in found:
            groups = [g for g in m.groups() if g is not None]
            key = tuple(groups) if dedupe == "content" else m.span()
            if key in seen:
                continue
            seen.add(key)
            yield row_of(text, m, of, rule_id, place, lines)


def row_of(text: str, m: re.Match, of: _Bytes, rule_id: str, place: int, lines: int) -> tuple:
    """The columns of MATCHES from the rule on."""
    start, end = of.offset(m.start()), of.offset(m.end())
    before, after = context(text, m.start(), m.end(), lines)
    groups, named = [g for g in m.groups() if g is not None], [(k, v) for k, v in m.groupdict().items() if v is not None]
    return rule_id, place, start, end, groups, named, before, m[0], after, *of.place(m.start()), *of.place(m.end())


def decoded(content: bytes | str | None) -> str:
    return content.decode("utf-8", "surrogateescape") if isinstance(content, bytes) else content or ""


def _scan_batches(rules: list[Rule], lines: int, dedupe: str | None, timeout: float | None, report: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(r.id, r.keywords, compiled(r.pattern)) for r in rules]
        prefilter, tally = Prefilter((k, p) for _, k, p in ready), Tally()
        for batch in batches:
            rows = []
            for blob, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in matches_in(decoded(content), ready, lines, dedupe, prefilter, timeout, tally, blob):
                    rows.append((blob, *(_clean(x) for x in row)))
                if len(rows) > 5000:
                    yield _rows(rows, report)
                    rows = []
            yield _rows(rows, report)
        if report:
            yield _told(tally)
        for blob, rule_id, status in tally.given_up:
            print(f"rule {rule_id} was given up on blob {blob}: {status}", file=sys.stderr)

    return run


def _clean(value):
    """Bytes that are no UTF-8 become the replacement character."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    if isinstance(value, list):
        return [tuple(map(_clean, x)) if isinstance(x, tuple) else _clean(x) for x in value]
    return value


def _rows(rows: list[tuple], report: bool = False) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
    fields = _REPORT if report else _FIELDS
    columns += [[None] * len(rows)] * (len(fields) - len(_FIELDS))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def match_rows(batch: pa.RecordBatch, ready: tuple) -> pa.RecordBatch:
    """The matches in a batch whose first columns are blob_id and content; ready: what matches_in() takes after the text."""
    rows = []
    for blob, content in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
        rows += [(blob, *(_clean(x) for x in row)) for row in matches_in(decoded(content), *ready)]
    return _rows(rows)


def _told(tally: Tally) -> pa.RecordBatch:
    """A tally as rows without matches: one for each rule and status, and one for each blob on which a rule was given up."""
    rows = [{"rule_id": r, "status": s, "blobs": n, "millis": ms} for (r, s), (n, ms) in tally.counts.items()]
    rows += [{"blob_id": b, "rule_id": r, "status": s} for b, r, s in tally.given_up]
    return pa.RecordBatch.from_pylist([{f.name: None for f in _REPORT} | x for x in rows], schema=_REPORT)


def scan(blobs: DataFrame, rules: Iterable[Rule], lines: int = 3, dedupe: str | None = "content", timeout: float | None = TIMEOUT) -> DataFrame:
    """All matches of the rules in blobs (blob_id, content as text or binary); offsets and columns count bytes.

    dedupe "content" keeps a rule's first match of each list of groups in a blob, "location" one match
    of each range; as a blob's matches arise in one place, neither needs a shuffle. Rules are tried only
    on blobs that hold one of their keywords, if they have any, and one of the strings that their
    pattern needs. A rule that takes longer than timeout on a blob is given up there; other rules and
    what it found before stay, and scan_reported() has a row that tells. A later rule of the same id replaces an earlier.
    """
    ship_package(blobs.sparkSession)
    last = list({r.id: r for r in rules}.values())
    return blobs.select("blob_id", "content").mapInArrow(_scan_batches(last, lines, dedupe, timeout, False), MATCHES)


def scan_reported(blobs: DataFrame, rules: Iterable[Rule], lines: int = 3, dedupe: str | None = "content", timeout: float | None = TIMEOUT) -> tuple[DataFrame, DataFrame]:
    """The matches of scan(), and of the same pass what became of the rules (see rule_status() and given_up()).

    Both are read from one table, which is written once.
    """
    ship_package(blobs.sparkSession)
    last = list({r.id: r for r in rules}.values())
    tagged = materialize(blobs.select("blob_id", "content").mapInArrow(_scan_batches(last, lines, dedupe, timeout, True), MATCHES + _REPORT_DDL), "scan")
    told = ["status", "blobs", "millis"]
    return tagged.filter("status is null").drop(*told), tagged.filter("status is not null").select("blob_id", "rule_id", *told)


def rule_status(told: DataFrame) -> DataFrame:
    """(rule_id, status, tried, given_up, millis): the worst status of each rule that was tried, over how many blobs, and its time."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    by = told.filter("blobs is not null").withColumn("rank", rank).groupBy("rule_id")
    out = by.agg(F.max("rank").alias("rank"), F.sum("blobs").alias("tried"), F.sum(F.when(F.col("rank") > 2, F.col("blobs")).otherwise(0)).alias("given_up"), F.sum("millis").alias("millis"))
    return out.select("rule_id", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("rank").cast("int")).alias("status"), "tried", "given_up", "millis")


def given_up(told: DataFrame) -> DataFrame:
    """(blob_id, rule_id, status) of each blob on which a rule was given up: what it found there may not be all."""
    return told.filter("blobs is null").select("blob_id", "rule_id", "status")
