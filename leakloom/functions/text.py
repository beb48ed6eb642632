"""Scalar functions over texts, secrets and URLs, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation that counts as special characters.
SPECIAL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def shannon_entropy(value: Column) -> Column:
    """Bits per byte of a value; 0 when it is null or empty."""
    pairs = F.regexp_extract_all(F.hex(value.cast("binary")), F.lit("(..)"), F.lit(1))
    n = F.size(pairs).cast("double")
    share = lambda c: F.size(F.filter(pairs, lambda x: x == c)) / n
    bits = F.aggregate(F.transform(F.array_distinct(pairs), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.coalesce(F.octet_length(value), F.lit(0)) > 0, bits).otherwise(F.lit(0.0))


def line_of(content: Column, offset: Column) -> Column:
    """The 1-based line of a byte offset into binary content."""
    before = F.hex(F.substring(content, F.lit(1), offset))
    return F.size(F.filter(F.regexp_extract_all(before, F.lit("(..)"), F.lit(1)), lambda x: x == "0A")) + 1


def snippet_window(before: Column, matching: Column, after: Column, most: int = 500) -> Column:
    """Match and context cut to about `most` characters around the match, with `...` where something is cut."""
    full, at, long = F.concat(before, matching, after), F.length(before), F.length(matching)
    total, half = F.length(full), F.floor((F.lit(most) - long - 6) / 2).cast("int")
    low0, high0 = at - half, at + long + half
    low1, high1 = F.greatest(low0, F.lit(0)), F.when(low0 < 0, high0 - low0).otherwise(high0)
    low = F.when(high1 > total, F.greatest(low1 - (high1 - total), F.lit(0))).otherwise(low1)
    high = F.least(high1, total)
    cut = F.concat(F.when(low > 0, F.lit("...")).otherwise(""), F.substring(full, low + 1, high - low), F.when(high < total, F.lit("...")).otherwise(""))
    whole = F.concat(F.lit("..."), F.substring(matching, F.lit(1), F.lit(most - 6)), F.lit("..."))
    return F.when(total <= most, full).when(long >= most, whole).otherwise(cut)


def printable(text: Column) -> Column:
    """For display: each byte that is neither a newline nor printable ASCII becomes a dot."""
    return F.regexp_replace(F.decode(text.cast("binary"), "ISO-8859-1"), r"[^\n\x20-\x7E]", ".")


def truncated(text: Column, most: int) -> Column:
    """At most so many characters of a text, the last three of them dots if it is cut and there is room."""
    if most <= 3:
        return F.substring(text, 1, max(0, most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def wrapped(text: Column, width: int) -> Column:
    """The lines of a text, longer ones cut into pieces of the width, as an array; without a width the text as it is."""
    if width <= 0:
        return F.array(text)
    pieces = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(line) - 1) / width), F.lit(0)).cast("int")), lambda i: F.substring(line, i * width + 1, F.lit(width)))
    return F.flatten(F.transform(F.split(text, "\n"), pieces))


def mask(secret: Column) -> Column:
    """The first and last four characters of a secret of 12 or more; shorter ones stay."""
    return F.when(F.length(secret) >= 12, F.concat(F.substring(secret, 1, 4), F.lit("..."), F.substring(secret, -4, 4))).otherwise(secret)


def preview(secret: Column, named: Column | None = None) -> Column:
    """At most 20 characters of a secret; several named groups show 12 each, 40 in all."""
    one = F.when(F.coalesce(F.length(secret), F.lit(0)) == 0, F.lit("[empty]")).when(F.length(secret) <= 20, secret).otherwise(F.concat(F.substring(secret, 1, 20), F.lit("...")))
    if named is None:
        return one
    short = F.transform(F.map_values(named), lambda v: F.when(F.length(v) > 12, F.concat(F.substring(v, 1, 12), F.lit("..."))).otherwise(v))
    pair = F.array_join(short, ":")
    return F.when(F.size(named) > 1, F.when(F.length(pair) > 40, F.concat(F.substring(pair, 1, 40), F.lit("..."))).otherwise(pair)).otherwise(one)


def url_base(url: Column) -> Column:
    """A URL without its query, unless the query mark comes first; null becomes empty."""
    at = F.instr(url, "?")
    return F.when(url.isNull(), F.lit("")).when(at > 1, F.substring(url, F.lit(1), at - 1)).otherwise(url)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def file_uri(path: Column) -> Column:
    """Absolute paths as file URIs, others as they are."""
    return F.when(path.startswith("/"), F.concat(F.lit("file://"), path)).otherwise(path)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


# The severity of rule categories.
SEVERITIES = {
    "HIGH": "aws azure gcp cloud auth api oauth jwt database db postgres mysql mongodb private ssh rsa".split(),
    "MEDIUM": "slack github gitlab npm pypi password secret".split(),
    "LOW": ["generic"],
}


def severity(rule_id: Column, overrides: dict[str, str] | None = None) -> Column:
    """A rule's severity: its own, else its category's, else MEDIUM.

    The category is the second part of a dotted id of three, else what stands before an underscore,
    else the first known category (in alphabetical order) that the id contains.
    """
    lower, of = F.lower(rule_id), {c: level for level, names in SEVERITIES.items() for c in names}
    dotted = F.when(F.size(F.split(lower, r"\.")) >= 3, F.split(lower, r"\.")[1])
    underscored = F.when(F.instr(lower, "_") > 0, F.split(lower, "_")[0])
    contained = F.coalesce(*[F.when(F.contains(lower, F.lit(c)), F.lit(c)) for c in sorted(of)])
    levels = F.create_map(*[F.lit(x) for pair in sorted(of.items()) for x in pair])
    out = F.coalesce(F.try_element_at(levels, F.coalesce(dotted, underscored, contained)), F.lit("MEDIUM"))
    for rule, level in sorted((overrides or {}).items()):
        out = F.when(rule_id == rule, F.lit(level)).otherwise(out)
    return out


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """Fill {{name}}, {{ name }}, {{.name}} and {{ .name }}."""
    for name, value in values.items():
        for form in (f"{{{{{name}}}}}", f"{{{{ {name} }}}}", f"{{{{.{name}}}}}", f"{{{{ .{name} }}}}"):
            template = F.replace(template, F.lit(form), value)
    return template


def size_of(text: str) -> int:
    """Bytes of a size such as 10MB; units are powers of 1024."""
    found = re.fullmatch(r"\s*(\d+)\s*(B|KB|MB|GB)?\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"no size: {text!r}")
    return int(found[1]) * 1024 ** ("B", "KB", "MB", "GB").index((found[2] or "B").upper())
