"""Matching large blobs in pieces: many tasks match one blob, with the result of its whole text.

The parse tree of a pattern tells how wide its matches can be and how far it looks around them. A
piece brings so much more text along that every match that begins in it is seen as in the whole.
Matches do not overlap, so where one crosses into the next piece, that piece's first matches may not
be those of the whole text: the piece before goes on until both sequences meet, and says from where
on the next piece's matches hold. Patterns that are not bounded but stay within a line are matched in
pieces that end at lines; and one that repeats a class of characters without bound is as wide as the
runs of these characters in the text are long, which a piece that holds no long run knows to be short.
Other patterns, texts with long runs, and sequences that do not meet are matched in the whole text.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from re import _compiler, _parser
from re import _constants as K  # the parsed form of patterns

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.operators.match import _FIELDS, MATCHES, TIMEOUT, Tally, _Bytes, _clean, decoded, found_in, matches_in, row_of, scan
from leakloom.operators.prefilter import Prefilter
from leakloom.plans.rules import Rule, compiled
from leakloom.session import materialize, ship_package

#: Bytes of a piece, about; a blob of more is cut.
PIECE = 4 << 20
#: The widest match, in characters, of a pattern that is matched by its width.
WIDEST = 1 << 14
#: Characters of a run that is long.
RUN = 1024
#: Widths that a sequence of matches is followed beyond its piece, to meet the next piece's.
FOLLOWED = 8
_REPEATS = (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT)
_ONE = (K.IN, K.LITERAL, K.NOT_LITERAL, K.ANY, K.CATEGORY)
_NEWLINE = 10


@dataclass(frozen=True)
class Reach:
    """How a pattern is matched in pieces ("width", "lines" or "whole"), the width of its matches and how far it looks around them.

    Width and around hold for texts in which none of the runs is found.
    """

    kind: str
    width: int = 0
    around: int = 0
    runs: tuple[re.Pattern, ...] = ()


def _held(arg: list) -> bool:
    """Whether a class has the newline."""
    found, negated = False, False
    for kind, x in arg:
        if kind is K.NEGATE:
            negated = True
        elif kind is K.LITERAL:
            found |= x == _NEWLINE
        elif kind is K.RANGE:
            found |= x[0] <= _NEWLINE <= x[1]
        elif kind is K.CATEGORY:
            found |= x in (K.CATEGORY_SPACE, K.CATEGORY_NOT_DIGIT, K.CATEGORY_NOT_WORD)
    return found != negated


def _walk(items: Iterable, flags: int) -> tuple[int, bool, bool]:
    """How far a pattern looks around its matches, whether it can take in a newline, and whether it knows the text's ends."""
    around, crosses, ends = 0, False, False
    for op, arg in items:
        parts: list[tuple[Iterable, int]] = []
        if op is K.AT:
            around = max(around, 2)
            ends |= arg in (K.AT_BEGINNING_STRING, K.AT_END_STRING) or not flags & re.MULTILINE and arg in (K.AT_BEGINNING, K.AT_END)
        elif op in (K.ASSERT, K.ASSERT_NOT):
            inner, c, e = _walk(arg[1], flags)
            around, crosses, ends = max(around, arg[1].getwidth()[1] + inner), crosses | c, ends | e
        elif op is K.LITERAL:
            crosses |= arg == _NEWLINE
        elif op is K.NOT_LITERAL:
            crosses |= arg != _NEWLINE
        elif op is K.ANY:
            crosses |= bool(flags & re.DOTALL)
        elif op is K.IN:
            crosses |= _held(arg)
        elif op is K.SUBPATTERN:
            parts = [(arg[3], (flags | arg[1]) & ~arg[2])]
        elif op is K.ATOMIC_GROUP:
            parts = [(arg, flags)]
        elif op is K.BRANCH:
            parts = [(x, flags) for x in arg[1]]
        elif op in _REPEATS:
            parts = [(arg[2], flags)]
        elif op is K.GROUPREF_EXISTS:
            parts = [(x, flags) for x in arg[1:] if x]
        for x, f in parts:
            a, c, e = _walk(x, f)
            around, crosses, ends = max(around, a), crosses | c, ends | e
    return around, crosses, ends


def _capped(tree: _parser.SubPattern, runs: list, run: int) -> _parser.SubPattern:
    """The tree with unbounded repeats of one character bounded by run; what they repeat goes to runs."""
    out = []
    for op, arg in tree:
        if op in _REPEATS:
            low, high, inner = arg
            if high is K.MAXREPEAT and len(inner) == 1 and inner[0][0] in _ONE:
                runs.append(inner)
                high = max(run, low)
            arg = (low, high, _capped(inner, runs, run))
        elif op is K.SUBPATTERN:
            arg = (*arg[:3], _capped(arg[3], runs, run))
        elif op is K.ATOMIC_GROUP:
            arg = _capped(arg, runs, run)
        elif op in (K.ASSERT, K.ASSERT_NOT):
            arg = (arg[0], _capped(arg[1], runs, run))
        elif op is K.BRANCH:
            arg = (arg[0], [_capped(x, runs, run) for x in arg[1]])
        elif op is K.GROUPREF_EXISTS:
            arg = (arg[0], *[x and _capped(x, runs, run) for x in arg[1:]])
        out.append((op, arg))
    return _parser.SubPattern(tree.state, out)


def _long(inner: _parser.SubPattern, flags: int, run: int) -> list[re.Pattern]:
    """Patterns of long runs of what is repeated; parts of a pattern may ignore case, so both ways."""
    repeat = [(K.MAX_REPEAT, (run, K.MAXREPEAT, inner))]
    out = []
    for f in (flags & ~re.IGNORECASE, flags | re.IGNORECASE):
        state = _parser.State()
        state.flags = f
        out.append(_compiler.compile(_parser.SubPattern(state, repeat), f))
    return out


def reach(pattern: re.Pattern, run: int = RUN) -> Reach:
    """How a pattern can be matched in pieces of a text; a run of so many characters is long."""
    tree = _parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE | pattern.flags & re.ASCII)
    least, most = tree.getwidth()
    flags = tree.state.flags
    around, crosses, ends = _walk(tree, flags)
    if not least:  # matches of nothing depend on what came before
        return Reach("whole")
    if most <= WIDEST and around <= WIDEST:
        return Reach("width", most, around)
    if not (crosses or ends):
        return Reach("lines")
    runs: list = []
    capped = _capped(tree, runs, run)
    most, around = capped.getwidth()[1], _walk(capped, flags)[0]
    if most <= WIDEST and around <= WIDEST:
        return Reach("width", most, around, tuple(x for inner in runs for x in _long(inner, flags, run)))
    return Reach("whole")


_PIECE = pa.schema(
    [("blob_id", pa.string()), ("piece", pa.int64()), ("content", pa.binary())]
    + [(n, pa.int64()) for n in ("base", "low", "high", "line_base", "line_start")] + [(n, pa.bool_()) for n in ("lined", "last")]
)
_PIECE_DDL = "blob_id string, piece long, content binary, base long, low long, high long, line_base long, line_start long, lined boolean, last boolean"


def _at_character(data: bytes, at: int) -> int:
    """The first place from at on where a character begins, or that is no UTF-8."""
    for i in range(at, min(at + 4, len(data))):
        if data[i] & 0xC0 != 0x80:
            return i
    return min(at, len(data))


def cuts(data: bytes, size: int) -> tuple[list[int], bool]:
    """Where the pieces of a text begin, and its end; each begins a line if the text has newlines enough, and whether all do."""
    out, lined = [0], True
    while len(data) - out[-1] > 2 * size:
        at = data.find(b"\n", out[-1] + size - 1, out[-1] + 2 * size - 1) + 1
        if not at:
            at, lined = _at_character(data, out[-1] + size), False
        out.append(at)
    return [*out, len(data)], lined


def _back(data: bytes, at: int, lines: int) -> int:
    for _ in range(lines):
        at = data.rfind(b"\n", 0, max(0, at - 1)) + 1
    return at


def _on(data: bytes, at: int, lines: int) -> int:
    for _ in range(lines):
        at = data.find(b"\n", at) + 1
        if not at:
            return len(data)
    return at


def _cut_batches(size: int, margin: int, lines: int) -> Callable:
    """Rows (blob_id, content) as pieces: with each what stands around it, as far as patterns and contexts look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blob, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = data.encode("utf-8", "surrogateescape") if isinstance(data, str) else data
                places, lined = cuts(data, size)
                at, newlines = 0, 0
                for k, (low, high) in enumerate(zip(places, places[1:], strict=False)):
                    base, end = _at_character(data, low - 4 * margin) if low > 4 * margin else 0, _at_character(data, min(len(data), high + 4 * margin))
                    if lines > 0:
                        base, end = min(base, _back(data, low, lines + 2)), _on(data, end, lines + 2)
                    newlines, at = newlines + data.count(b"\n", at, base) if base >= at else data.count(b"\n", 0, base), base
                    row = (blob, k, data[base:end], base, low, high, newlines, data.rfind(b"\n", 0, base) + 1, lined, high == len(data))
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PIECE, strict=True)], schema=_PIECE)

    return run


class _Placed(_Bytes):
    """Offsets, lines and columns in the whole text of positions in a piece."""

    def __init__(self, text: str, base: int, line_base: int, line_start: int):
        super().__init__(text)
        self.base, self.line_base, self.line_start = base, line_base, line_start
        self.inside = _Bytes(text)

    def offset(self, position: int) -> int:
        return self.base + self.inside.offset(position)

    def place(self, position: int) -> tuple[int, int]:
        line, column = self.inside.place(position)
        return line + self.line_base, column + (self.base - self.line_start if line == 1 else 0)


def reconciled(pattern: re.Pattern, text: str, cut: int, end: int, limit: int, last: bool) -> tuple[list[re.Match], int] | None:
    """Where a match that began before the cut ends at end: the matches after it, and the place from which those that go on from the cut hold.

    None if both sequences do not meet before limit, up to where the text is as in the whole; last: the text ends as the whole does.
    """
    theirs, ours = pattern.finditer(text, cut), pattern.finditer(text, end)
    limit = len(text) + 1 if last else limit
    a, b, extra, at = next(theirs, None), next(ours, None), [], [cut, end]
    while True:
        x, y = (m.start() if m else limit for m in (a, b))
        if min(x, y) >= limit:
            return (extra, limit) if max(at) <= limit else None
        if x == y:
            return extra, x
        if x < y:
            at[0] = a.end()
            a = next(theirs, None)
        else:
            extra.append(b)
            at[1] = b.end()
            b = next(ours, None)


#: Kinds of rows that pieces give: a match; the place (start) from which a piece's matches of a rule hold; a rule to be
#: matched in the whole text; a keyword of a rule seen; a rule given up.
MATCH, HOLDS, WHOLE, KEYWORD, GIVEN_UP = range(5)
_TAGGED = pa.schema([*_FIELDS, ("piece", pa.int64()), ("tag", pa.int32()), ("status", pa.string())])
_TAGGED_DDL = f"{MATCHES}, piece long, tag int, status string"


def _piece_batches(rules: list[Rule], run_length: int, lines: int, timeout: float | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(r.id, r.keywords, compiled(r.pattern)) for r in rules]
        kinds = [reach(p, run_length) for _, _, p in ready]
        prefilter = Prefilter(((), p) for _, _, p in ready)  # a keyword may stand in another piece
        names = [f.name for f in _TAGGED]
        for batch in batches:
            for blob, piece, content, base, low, high, line_base, line_start, lined, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, out, tally = decoded(content), [], Tally()
                of = _Placed(text, base, line_base, line_start)
                begin, stop = len(decoded(content[: low - base])), len(decoded(content[: high - base]))

                def tagged(place: int, tag: int, piece: int = piece, blob: str = blob, out: list = out, **more) -> None:
                    out.append({"blob_id": blob, "rule_id": ready[place][0], "rule_place": place, "piece": piece, "tag": tag} | more)

                def matched(place: int, m: re.Match, text: str = text, of: _Placed = of, tagged: Callable = tagged) -> None:
                    row = row_of(text, m, of, ready[place][0], place, lines)
                    tagged(place, MATCH, **dict(zip([f.name for f in _FIELDS][1:], map(_clean, row), strict=True)))

                for place, (rule_id, words, pattern) in enumerate(ready):
                    if kinds[place].kind == "lines" and not lined and not piece:
                        tagged(place, WHOLE)
                    if words and any(w in text for w in words):
                        tagged(place, KEYWORD)
                for place in prefilter.candidates(text):
                    rule_id, _, pattern = ready[place]
                    kind = kinds[place]
                    if kind.kind == "whole" or kind.kind == "lines" and not lined:
                        continue
                    if any(x.search(text) for x in kind.runs):
                        tagged(place, WHOLE)
                        continue
                    began, whole = time.perf_counter(), text
                    if kind.kind == "lines":  # the piece's lines, and nothing after them
                        whole = text[: stop if not last else len(text)]
                    found, status = found_in(whole, pattern, timeout, begin, stop if not last else None)
                    tally.add(blob, rule_id, status, began)
                    for m in found:
                        matched(place, m)
                    if kind.kind == "width" and found and not last and found[-1].end() > stop and status == "matched":
                        met = reconciled(pattern, text, stop, found[-1].end(), len(text) - kind.width - kind.around, base + len(content) == high and last)
                        if met is None:
                            tagged(place, WHOLE)
                            continue
                        for m in met[0]:
                            matched(place, m)
                        tagged(place, HOLDS, piece=piece + 1, start=of.offset(min(met[1], len(text))))
                places = {r[0]: i for i, r in enumerate(ready)}
                for _, rule_id, status in tally.given_up:
                    tagged(places[rule_id], GIVEN_UP, status=status)
                yield pa.RecordBatch.from_pylist([{n: None for n in names} | x for x in out], schema=_TAGGED)

    return run


def _whole_batches(rules: list[Rule], lines: int, timeout: float | None) -> Callable:
    """Rows (blob_id, content, places): the rules at those places, in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(r.id, r.keywords, compiled(r.pattern)) for r in rules]
        names = [f.name for f in _TAGGED]
        for batch in batches:
            for blob, content, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some, tally = [ready[i] for i in places], Tally()
                out = []
                for row in matches_in(decoded(content), some, lines, None, None, timeout, tally, blob):
                    row = (row[0], places[row[1]], *row[2:])
                    out.append({"blob_id": blob, "piece": -1, "tag": MATCH} | dict(zip([f.name for f in _FIELDS][1:], map(_clean, row), strict=True)))
                at = {ready[i][0]: i for i in places}
                out += [{"blob_id": blob, "rule_id": r, "rule_place": at[r], "piece": -1, "tag": GIVEN_UP, "status": s} for _, r, s in tally.given_up]
                yield pa.RecordBatch.from_pylist([{n: None for n in names} | x for x in out], schema=_TAGGED)

    return run


def scan_pieces(blobs: DataFrame, rules: Iterable[Rule], lines: int = 3, dedupe: str | None = "content", timeout: float | None = TIMEOUT, size: int = PIECE, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """The matches of scan(), with blobs of more than size bytes matched in pieces by many tasks; and (blob_id, rule_id, status) of what was given up on these.

    The matches are those of the whole text, whatever the cuts; a rule's time is that of a piece. Blobs
    of size bytes or fewer take the way of scan(). Only pieces of large blobs are shuffled, and the few
    match rows of these. Equal blob ids are one blob. A piece grows to four times what stands around it.
    """
    spark = blobs.sparkSession
    ship_package(spark)
    last = list({r.id: r for r in rules}.values())
    kinds = [reach(compiled(r.pattern), run) for r in last]
    wide = [k for k in kinds if k.kind == "width"]
    margin = max([FOLLOWED * k.width + k.around for k in wide] + [len(w) for r in last for w in r.keywords] + [4])
    rows = blobs.select("blob_id", F.col("content").cast("binary").alias("content"))
    small, large = rows.filter(F.coalesce(F.octet_length("content"), F.lit(0)) <= size), rows.filter(F.octet_length("content") > size)
    pieces = large.mapInArrow(_cut_batches(max(size, 16 * margin), margin, lines), _PIECE_DDL)
    # A number of its own, as Spark else joins partitions up to its advisory size, which is many pieces.
    pieces = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "blob_id", "piece")
    tagged = materialize(pieces.mapInArrow(_piece_batches(last, run, lines, timeout), _TAGGED_DDL), "pieces")
    always = [i for i, k in enumerate(kinds) if k.kind == "whole"]
    again = tagged.filter(F.col("tag") == WHOLE).groupBy("blob_id").agg(F.collect_set("rule_place").alias("again"))  # rules at most
    places = F.array_sort(F.array_union(F.array(*map(F.lit, always)).cast("array<int>"), F.coalesce("again", F.array().cast("array<int>"))))
    whole = large.join(again, "blob_id", "left" if always else "inner").select("blob_id", "content", places.alias("places"))
    whole = materialize(whole.mapInArrow(_whole_batches(last, lines, timeout), _TAGGED_DDL), "whole")
    key = ["blob_id", "rule_place"]
    holds = tagged.filter(F.col("tag") == HOLDS).groupBy(*key, "piece").agg(F.max("start").alias("holds"))
    redone = tagged.filter(F.col("tag") == WHOLE).select(*key).distinct()
    found = tagged.filter(F.col("tag") == MATCH).join(holds, [*key, "piece"], "left").filter("holds is null or start >= holds").join(redone, key, "left_anti")
    keyed = [i for i, r in enumerate(last) if r.keywords]
    seen = tagged.filter(F.col("tag") == KEYWORD).select(*key, F.lit(True).alias("seen")).distinct()
    found = found.join(seen, key, "left").filter(F.col("seen") | ~F.col("rule_place").isin(keyed))
    columns = _FIELDS.names
    found = found.select(*columns).unionByName(whole.filter(F.col("tag") == MATCH).select(*columns))
    same = ["blob_id", "rule_place", *(["groups"] if dedupe == "content" else ["start", "end"])]
    first = Window.partitionBy(*same).orderBy("start", "end")
    found = found.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
    lost = tagged.unionByName(whole).filter(F.col("tag") == GIVEN_UP).select("blob_id", "rule_id", "status").distinct()
    return scan(small, last, lines, dedupe, timeout).unionByName(found), lost
