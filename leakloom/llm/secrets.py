"""Secret scans: base patterns, and Markov models of random strings against ordinary identifiers.

Two first-order character models are trained from labelled samples; a token is reported when its
log-likelihood ratio favours the random model by more than the limit of its length. Everything is DataFrame functions: a pattern's
matches and the pieces between them give the positions, and the trained table of ratios, whose size
the alphabet bounds, becomes a constant of the scoring expression.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.session import materialize

# The base patterns and the least length of what they report.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: Characters of the models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Places of pairs of characters, by checksum: with so many, all pairs of ASCII characters have one of their own.
PAIRS = 1 << 15
#: Tokens that the models score: runs of the alphabet that are long enough to reach their limit.
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
#: Characters of a token that is scored, at least: base patterns report no shorter secret either.
LEAST = 6
INT_MAX = 2**31 - 1
#: Weight of the uniform distribution in each row of a model, as a number of transitions.
PRIOR_RANDOM, PRIOR_ORDINARY = 200.0, 2.0
#: Mean log-likelihood ratio a transition above which a token is reported; one of fewer characters than
#: EVEN needs the sum of a token of EVEN. Tokens of LENGTHS characters and more share a limit.
THRESHOLD, EVEN, LENGTHS = 0.5, 20, 64
#: Share of the ordinary tokens of a length that its limit may let pass, where the sample has enough of them to tell.
FALSE_RATE = 1e-4
#: Steps of a limit that is raised, within 1.
LIMIT_STEPS = 1000


#: Elements that one inner loop of gathered() handles.
_STRIDE = 256


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def gathered(items: Column, state: Column, step, element: str) -> Column:
    """Walk along an array with a state; step(state, item) gives the next state and an array of what to gather.

    An array that grows element by element is copied at each, so elements are gathered in strides.
    """
    last = lambda xs: F.greatest(F.floor((F.size(xs) - 1) / _STRIDE), F.lit(0)).cast("int")
    strides = let(items, lambda xs: F.transform(F.sequence(F.lit(0), last(xs)), lambda i: F.slice(xs, i * _STRIDE + 1, F.lit(_STRIDE))))

    def inner(acc: Column, item: Column) -> Column:
        return let(F.struct(*(c.alias(n) for c, n in zip(step(acc["state"], item), ("state", "more"), strict=True))), lambda r: F.struct(r["state"].alias("state"), F.when(F.size(r["more"]) > 0, F.concat(acc["out"], r["more"])).otherwise(acc["out"]).alias("out")))

    def outer(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), F.expr(f"cast(array() as array<{element}>)").alias("out")), inner)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{element}>>)").alias("out"))
    return F.aggregate(strides, start, outer, lambda acc: F.flatten(acc["out"]))


_SPAN = "struct<start:int,end:int,kind:int>"


def _positions(text: Column, pattern: str, kind: int, keep, quick: str | None = None, group: int = 0) -> Column:
    """array<struct<start, end, kind>> of the pattern's matches, in code points, end exclusive.

    keep takes what the group matched. quick is a pattern that any kept match implies; without it in
    the text, nothing else is computed.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(pieces.alias("before"), matches.alias("match"), held.alias("held"))
    parts = F.transform(parts, lambda x: F.struct(F.length(x["before"]).alias("skip"), F.length(x["match"]).alias("long"), (x["match"].isNotNull() & keep(x["held"])).alias("keep")))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["skip"]
        span = F.struct(start.alias("start"), (start + x["long"]).alias("end"), F.lit(kind).alias("kind"))
        return start + F.coalesce(x["long"], F.lit(0)), F.when(x["keep"], F.array(span)).otherwise(none)

    return F.when(text.rlike(quick or pattern), gathered(parts, F.lit(0), step, _SPAN)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, kind by kind; the first non-overlapping matches, then the length rule."""
    return F.concat(
        _positions(text, ASSIGN, 0, lambda x: F.length(x) >= ASSIGN_LEAST, ASSIGN[:-1][:-1] + "{%d,})" % ASSIGN_LEAST, 2),
        _positions(text, ACCESS, 1, lambda x: F.length(x) >= ACCESS_LEAST, "AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4)),
        # Runs are maximal, so a shorter run never changes where a long one starts.
        _positions(text, "[0-9a-f]{%d,}" % HEX_LEAST, 2, lambda x: F.lit(True)),
    )


def _byte(data: Column, i: Column) -> Column:
    """The i-th byte, from 1: of bytes it is found at once, of text by walking through all characters before."""
    return F.ascii(F.substring(data, i, 1).cast("string"))


def _counted(samples: DataFrame) -> DataFrame:
    """Samples with n, how often each occurs; where they do not say so, each row is one."""
    return samples if "n" in samples.columns else samples.withColumn("n", F.lit(1).cast("long"))


def _transitions(samples: DataFrame) -> DataFrame:
    """Counts n of each pair of characters (a, b as bytes) by label, over all samples; ordinary ones in three forms."""
    # An ordinary word is one in capitals too, and with a first capital.
    word = F.col("text")
    forms = F.when(F.col("label") == 0, F.array_distinct(F.array(word, F.upper(word), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, INT_MAX))))).otherwise(F.array(word))
    words = _counted(samples).filter((F.length("text") > 1) & ~F.col("text").rlike(r"[^\x00-\x7F]")).groupBy("label", "text").agg(F.sum("n").alias("n"))
    pairs = let(F.col("text").cast("binary"), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: _byte(t, i) * 128 + _byte(t, i + 1)))
    rows = words.withColumn("text", F.explode(forms)).select("label", "n", F.explode(pairs).alias("p"))
    return rows.groupBy("label", "p").agg(F.sum("n").alias("n")).select("label", F.floor(F.col("p") / 128).cast("int").alias("a"), (F.col("p") % 128).alias("b"), "n")


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, from samples (text, label and, if there, n; 1: random, 0: ordinary).

    At most 2 * 128 ** 2 counts reach the driver. Null texts and labels and texts with characters beyond
    ASCII are left out, as are transitions outside ALPHABET; without samples of a label, its model is uniform.
    """
    k = len(ALPHABET)
    counts = [[[0] * k for _ in range(k)] for _ in range(2)]
    for r in _transitions(samples.filter("text is not null and label in (0, 1)")).collect():
        if chr(r["a"]) in ALPHABET and chr(r["b"]) in ALPHABET:
            counts[r["label"]][ALPHABET.index(chr(r["a"]))][ALPHABET.index(chr(r["b"]))] = r["n"]
    table = []
    for a in range(k):
        rows = [(counts[label][a], sum(counts[label][a]), prior) for label, prior in ((1, PRIOR_RANDOM), (0, PRIOR_ORDINARY))]
        for b in range(k):
            random, ordinary = ((row[b] + prior / k) / (total + prior) for row, total, prior in rows)
            table.append(math.log(random / ordinary))
    return table


def _pair_place(pair: bytes) -> int:
    return zlib.crc32(pair) % PAIRS


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a transition of a token written in ALPHABET, in time linear in its length.

    A pair of characters is looked up by the checksum of its two bytes, which one function gives.
    """
    by_pair = ["0"] * PAIRS
    for i, a in enumerate(ALPHABET):
        for j, b in enumerate(ALPHABET):
            by_pair[_pair_place(f"{a}{b}".encode())] = f"{table[i * len(ALPHABET) + j]:.5f}"
    constant = F.from_json(F.lit("[" + ",".join(by_pair) + "]"), "array<double>")  # folded once
    pair = lambda t, i: (F.crc32(F.substring(t, i, 2)) % PAIRS).cast("int")
    total = lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t) - 1), F.lit(0.0), lambda s, i: s + F.get(constant, pair(t, i)))
    return let(token.cast("binary"), total) / (F.length(token) - 1)


def limits(samples: DataFrame | None = None, table: list[float] | None = None) -> list[float]:
    """The mean log-likelihood ratio that a token has to exceed, by its length from 1 to LENGTHS.

    Where the samples hold 1 / FALSE_RATE ordinary tokens of a length or more, at most that share of
    them exceeds its limit: all of them are counted, and a limit that has to be raised is the least
    multiple of 1 / LIMIT_STEPS that will do. Fewer tell nothing of such a share, and one secret among
    them would hide others. At most LENGTHS rows reach the driver.
    """
    out = [THRESHOLD * max(1.0, (EVEN - 1) / max(1, n - 1)) for n in range(1, LENGTHS + 1)]
    if samples is not None and table is not None:
        inside = F.col("text").rlike("^" + TOKEN % 2 + "$")
        scored = _counted(samples).filter((F.col("label") == 0) & inside).select(F.least(F.length("text"), F.lit(LENGTHS)).alias("length"), ratio(F.col("text"), table).alias("r"), "n")
        least = F.element_at(F.array(*map(F.lit, out)), F.col("length"))
        steps = scored.withColumn("step", F.when(F.col("r") > least, F.ceil(F.col("r") * LIMIT_STEPS))).groupBy("length", "step").agg(F.sum("n").alias("n"))  # null: passes at no limit
        by_length = Window.partitionBy("length")
        over = F.coalesce(F.sum("n").over(by_length.orderBy(F.desc_nulls_last("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        told = steps.select("length", "step", over.alias("over"), F.sum("n").over(by_length).alias("all")).filter((F.col("all") >= 1 / FALSE_RATE) & (F.col("over") <= F.col("all") * FALSE_RATE))
        for row in told.groupBy("length").agg(F.min("step").alias("step"), F.bool_or(F.col("step").isNull()).alias("enough")).collect():
            if not row["enough"]:
                out[row["length"] - 1] = row["step"] / LIMIT_STEPS
    return out


def shortest(table: list[float], limit: list[float]) -> int:
    """The least length, from LEAST on, at which any token exceeds its limit: no shorter one needs a score."""
    k = len(ALPHABET)
    best = [0.0] * k  # the greatest sum of a token that ends in each character
    for n in range(2, LENGTHS):
        best = [max(best[a] + table[a * k + b] for a in range(k)) for b in range(k)]
        if n >= LEAST and max(best) / (n - 1) > limit[n - 1]:
            return n
    return LENGTHS


def markov_spans(text: Column, table: list[float], limit: list[float] | None = None) -> Column:
    limit = limit or limits()
    constant = F.from_json(F.lit("[" + ",".join(f"{x:.5f}" for x in limit) + "]"), "array<double>")
    keep = lambda x: ratio(x, table) > F.element_at(constant, F.least(F.length(x), F.lit(LENGTHS)))
    pattern = TOKEN % shortest(table, limit)
    # Most texts have no such token: each word of a text is scored once, and places are looked for only where one exceeds its limit.
    held = F.exists(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), keep)
    return F.when(held, _positions(text, pattern, 3, keep)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled samples (text, label, n) from all documents; n is how often a text occurs.

    Random strings: what the base patterns report. Ordinary tokens: all words, numbers and identifiers
    of each document in which the base patterns report nothing; beside what they report, there may be
    secrets of other forms. One pass over the texts writes them all, each distinct one once.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    shown = F.array_union(
        F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= ASSIGN_LEAST),
        F.array_union(F.regexp_extract_all("t", F.lit("AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4)), F.lit(0)), F.regexp_extract_all("t", F.lit("[0-9a-f]{%d,}" % HEX_LEAST), F.lit(0))),
    )
    any_base = F.col("t").rlike("(?:%s)|AKIA[A-Z0-9]{%d,}|[0-9a-f]{%d,}" % (ASSIGN, ACCESS_LEAST - 4, HEX_LEAST))
    words = F.struct(F.regexp_extract_all("t", F.lit(TOKEN % 2), F.lit(0)).alias("texts"), F.lit(0).alias("label"))
    told = F.when(any_base, let(shown, lambda s: F.when(F.size(s) > 0, F.struct(s.alias("texts"), F.lit(1).alias("label"))).otherwise(words))).otherwise(words)
    each = rows.select(told.alias("told")).select(F.explode("told.texts").alias("text"), "told.label")
    return materialize(each.groupBy("label", "text").agg(F.count("*").alias("n")).select("text", "label", "n"), "samples")


def all_spans(text: Column, table: list[float], limit: list[float] | None = None) -> Column:
    """array<struct<start, end, kind>> of all spans of a text, by start and then by kind; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(base_spans(text), markov_spans(text, table, limit)), _by_place)


def with_spans(df: DataFrame, table: list[float], text_col: str = "text", out: str = "secret_spans", limit: list[float] | None = None) -> DataFrame:
    """Add column out with all_spans(), in the place of a column of that name if there is one. Nothing is shuffled."""
    return df.withColumn(out, all_spans(F.col(text_col), table, limit))


def mask_texts(df: DataFrame, table: list[float], limit: list[float] | None = None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of df, with their columns, in whose text secrets are masked; length_col, if there, follows.

    Null and empty texts and those without secrets stay as they are, each row by itself.
    """
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), all_spans(F.col(text_col), table, limit).alias("spans"))
    some = F.size("spans") > 0
    text = redacted(F.col("whole")[text_col], F.col("spans"))
    out = whole.select("whole", "spans", text.alias("masked"))
    new = {text_col: F.col("masked"), length_col: F.when(some, F.length("masked").cast("long")).otherwise(F.col("whole")[length_col]) if length_col in df.columns else None}
    return out.select(*[(new[c] if c in new else F.col("whole")[c]).alias(c) for c in df.columns])


def _by_place(x: Column, y: Column) -> Column:
    less = (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind"] < y["kind"]))
    more = (x["start"] > y["start"]) | ((x["start"] == y["start"]) & (x["kind"] > y["kind"]))
    return F.when(less, -1).when(more, 1).otherwise(0)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with what the spans, sorted by start, cover replaced by mask: once where spans overlap."""
    # Four bytes a character: a piece is then cut at once, wherever it is.
    part = lambda data, start, end: F.decode(F.substring(data, 4 * start + 1, 4 * (end - start)), "UTF-32")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.struct(at.alias("start"), s["start"].alias("end"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(gap)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))

    def masked(data: Column) -> Column:
        pieces = F.transform(gathered(spans, F.lit(0), step, "struct<start:int,end:int>"), lambda g: part(data, g["start"], g["end"]))
        return F.concat(F.array_join(F.concat(pieces, F.array(F.lit(""))), mask), part(data, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), masked)).otherwise(text)


def redact(df: DataFrame, spans: str, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace what the spans cover in the text by mask; a text without spans stays as it is."""
    return df.withColumn(text_col, redacted(F.col(text_col), F.col(spans), mask))


def op6_markov_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans and their digest, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sample = samples(docs)
    table = train(sample)
    found = with_spans(docs, table, limit=limits(sample, table))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secret_spans")).alias("spans"))
