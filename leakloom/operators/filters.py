"""Predicates over matches, and over HTTP traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions.text import SPECIAL, shannon_entropy
from leakloom.operators.prefilter import Prefilter, candidate_batches
from leakloom.session import ship_package


def secret(groups: Column, named: Column) -> Column:
    """The secret of a match: a group named token, else the first named one, else the second group, else the first."""
    token = F.get(F.map_values(F.map_filter(named, lambda k, _: F.lower(k) == "token")), F.lit(0))
    return F.coalesce(token, F.get(F.map_values(named), F.lit(0)), F.get(groups, F.lit(1)), F.get(groups, F.lit(0)))


def meets(value: Column, need: Column) -> Column:
    """Whether a secret has the character classes a rule requires and none of its ignored strings."""
    special = F.when(F.coalesce(need["special_chars"], F.lit("")) == "", F.lit(SPECIAL)).otherwise(need["special_chars"])
    rest = F.regexp_replace(value, r"[\p{Nd}\p{Lu}\p{Ll}]", "")
    specials = F.size(F.filter(F.split(rest, ""), lambda c: (c != "") & (F.instr(special, c) > 0)))
    ignored = F.exists(F.coalesce(need["ignore_if_contains"], F.array()), lambda x: F.contains(F.lower(value), F.lower(x)))
    classes = [(r"\p{Nd}", "min_digits"), (r"\p{Lu}", "min_uppercase"), (r"\p{Ll}", "min_lowercase")]
    ok = ~ignored & (specials >= need["min_special_chars"])
    for pattern, name in classes:
        ok = ok & (F.regexp_count(value, F.lit(pattern)) >= need[name])
    return need.isNull() | F.coalesce(ok, F.lit(False))


def postfilter(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches (with `secret`) that pass their rule's entropy and requirements; those of unknown rules pass."""
    known = rules.select("rule_id", "rule_name", "rule_sid", "categories", "min_entropy", "requirements")
    given = matches.withColumn("secret", secret(F.col("groups"), F.col("named"))).join(known, "rule_id", "left")
    entropy = F.coalesce(F.col("min_entropy"), F.lit(0.0))
    dense = (entropy == 0) | (shannon_entropy(F.coalesce("secret", F.lit(""))) > entropy)
    return given.filter(dense & meets(F.coalesce("secret", F.lit("")), F.col("requirements"))).drop("min_entropy", "requirements")


def candidates(blobs: DataFrame, rules: DataFrame) -> DataFrame:
    """(blob_id, rule_id) that keywords do not rule out: rules without any, and those of which the content holds one.

    All keywords are looked for in one pass over each content, next to the scan.
    """
    ship_package(blobs.sparkSession)
    listed = [(r["rule_id"], tuple(r["keywords"])) for r in rules.select("rule_id", "keywords").collect()]  # the rules alone: small
    run = candidate_batches(Prefilter((words, None) for _, words in listed), [rule for rule, _ in listed])
    return blobs.select("blob_id", "content").mapInArrow(run, "blob_id string, rule_id string")


# Content that cannot hold secrets as text, and words in the names of headers that may.
SKIPPED_TYPES = ("image/", "video/", "audio/", "font/", "application/octet-stream", "application/zip", "application/gzip", "application/x-gzip", "application/pdf", "application/x-shockwave-flash")
SKIPPED_ENDINGS = "png jpg jpeg gif ico svg webp bmp tiff woff woff2 ttf otf eot mp3 mp4 webm ogg wav avi mov zip gz tar rar 7z pdf swf".split()
HEADER_WORDS = ("auth", "token", "api", "key", "secret", "password", "credential")
LEAST_BODY, MOST_BODY = 10, 10 << 20


def scannable_response(body: Column, content_type: Column, most: int = MOST_BODY) -> Column:
    size, kind = F.coalesce(F.length(body), F.lit(0)), F.lower(F.coalesce(content_type, F.lit("")))
    skipped = F.lit(False)
    for prefix in SKIPPED_TYPES:
        skipped = skipped | kind.startswith(prefix)
    return (size >= LEAST_BODY) & (size <= most) & ~skipped


def scannable_request(body: Column, url: Column, headers: Column, most: int = MOST_BODY) -> Column:
    """A body of more than ten bytes, a query in the URL, or a header whose name hints at credentials."""
    size = F.coalesce(F.length(body), F.lit(0))
    hint = F.exists(F.coalesce(headers, F.array().cast("array<string>")), lambda h: F.lower(h).rlike("|".join(HEADER_WORDS)))
    return ((size > LEAST_BODY) & (size <= most)) | F.coalesce(F.contains(url, F.lit("?")), F.lit(False)) | hint


def scannable_url(url: Column) -> Column:
    """Whether a URL's path has none of the endings of media, fonts and archives."""
    return ~F.coalesce(F.split(url, r"\?")[0], F.lit("")).rlike(r"(?i)\.(" + "|".join(SKIPPED_ENDINGS) + ")$")
