"""From matches to findings: deduplication, clustering across rules, joins, summaries and facets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.functions.ids import finding_id, match_id
from leakloom.session import ship_package


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def identified(matches: DataFrame) -> DataFrame:
    """Add match_id and finding_id to matches with rule_sid."""
    groups = F.col("groups")
    return matches.withColumns({"match_id": match_id(F.col("rule_sid"), F.col("blob_id"), F.col("start"), F.col("end")), "finding_id": finding_id(F.col("rule_sid"), groups)})


def dedupe(matches: DataFrame, mode: str = "content") -> DataFrame:
    """The first match of each rule and groups in a blob, or of each rule and range."""
    keys = ["blob_id", "rule_id"] + (["groups"] if mode == "content" else ["start", "end"])
    return first_by(matches, keys, ["start", "end"])


def _clusters(key: tuple, table: pa.Table) -> Iterator[pa.Table]:
    """The cluster of each match of a blob: matches that share a group's value, directly or through others."""
    groups = table.column("groups").to_pylist()
    parent = list(range(len(groups)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holder: dict[str, int] = {}
    for i, values in enumerate(groups):
        for v in values or ():
            if v:
                j = holder.setdefault(v, i)
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return table.append_column("cluster", pa.array([root(i) for i in range(len(groups))], pa.int32()))


def winners(matches: DataFrame, rules: DataFrame, validated: list[str] | None = None) -> DataFrame:
    """Of each cluster of a blob's matches the one to report.

    A rule with a validator (if a list of those rules is given) comes first, then more groups, more
    bytes in groups, a longer pattern, and the earlier match. A blob's matches are bounded by the blob.
    """
    ship_package(matches.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema) + ", cluster int"
    clustered = matches.groupBy("blob_id").applyInArrow(_clusters, schema)
    given = clustered.join(rules.select("rule_id", F.length("pattern").alias("pattern_length")), "rule_id", "left")
    has = F.col("rule_id").isin(validated) if validated else F.lit(False)
    bytes_held = F.aggregate(F.coalesce("groups", F.array()), F.lit(0), lambda a, g: a + F.octet_length(g))
    order = [has.desc(), F.size("groups").desc(), bytes_held.desc(), F.col("pattern_length").desc_nulls_last(), "start", "end", "rule_place"]
    return first_by(given, ["blob_id", "cluster"], order).drop("pattern_length", "cluster")


def findings(matches: DataFrame) -> DataFrame:
    """One row for each finding: rule, groups and number of matches."""
    return matches.groupBy("finding_id", "rule_id").agg(F.first("groups").alias("groups"), F.count("*").alias("matches"))


def summary(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings and matches by rule; an unknown rule is named by its id."""
    by = found.groupBy("rule_id").agg(F.count("*").alias("findings"), F.sum("matches").alias("matches"))
    named = by.join(rules.select("rule_id", "rule_name"), "rule_id", "left")
    return named.select("rule_id", F.coalesce("rule_name", "rule_id").alias("rule_name"), "findings", "matches").orderBy(F.desc("findings"), "rule_id")


def with_matches(found: DataFrame, matches: DataFrame) -> DataFrame:
    """Findings with their matches: by finding id, and for findings without any by rule and groups."""
    own = found.select("finding_id", "rule_id", "groups").join(matches.select("finding_id", "match_id", "blob_id", "start", "end"), "finding_id", "left")
    none = own.filter("match_id is null").select("finding_id", "rule_id", "groups")
    loose = none.join(matches.select("rule_id", "groups", "match_id", "blob_id", "start", "end"), ["rule_id", "groups"], "left")
    columns = ["finding_id", "rule_id", "groups", "match_id", "blob_id", "start", "end"]
    return own.filter("match_id is not null").select(columns).unionByName(loose.select(columns))


def top_matches(matches: DataFrame, n: int = 3) -> DataFrame:
    """The first n matches of each finding, with their number and how many there are.

    Numbers and counts are apart, so that tasks cut to n rows a finding before they are exchanged.
    """
    order = Window.partitionBy("finding_id").orderBy("blob_id", "start", "end")
    first = matches.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= n)
    return first.join(matches.groupBy("finding_id").agg(F.count("*").alias("of")), "finding_id")


def with_provenance(matches: DataFrame, provenance: DataFrame, first: bool = True) -> DataFrame:
    """Matches with where their blobs came from; without provenance the place is the blob's id."""
    given = provenance.select("blob_id", "path", "seq")
    if first:
        given = given.groupBy("blob_id").agg(F.min_by("path", "seq").alias("path"))
    else:
        given = given.groupBy("blob_id").agg(F.array_sort(F.collect_set("path")).alias("path"))
    return matches.join(given, "blob_id", "left").withColumn("path", F.coalesce("path", F.col("blob_id") if first else F.array("blob_id")))


def capped(matches: DataFrame, n: int) -> DataFrame:
    """The first n matches of each blob, by rule and place; tasks cut to n before rows are exchanged."""
    order = Window.partitionBy("blob_id").orderBy("rule_place", "start", "end")
    return matches.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def repositories(matches: DataFrame, provenance: DataFrame, of: Column) -> DataFrame:
    """The distinct (finding_id, repository) of the places where a finding's blobs are; of gives a place's repository."""
    places = provenance.select("blob_id", of.alias("repository")).distinct()
    return matches.select("finding_id", "blob_id").distinct().join(places, "blob_id").select("finding_id", "repository").distinct()


def without_repository(found: DataFrame, repositories: DataFrame, text: str) -> DataFrame:
    """Findings of which no repository's name holds a text, as written."""
    return found.join(repositories.filter(F.contains("repository", F.lit(text))).select("finding_id"), "finding_id", "left_anti")


def with_commits(blobs: DataFrame, commits: DataFrame, order: list[str]) -> DataFrame:
    """Blobs with the first commit (path, commit_id, ...) of their path, if there is one."""
    return blobs.join(first_by(commits, ["path"], order), "path", "left")


def ordered(found: DataFrame, by: str) -> DataFrame:
    """Findings in ascending order of a column, equal ones by their id."""
    return found.orderBy(by, "finding_id")


def newest(rows: DataFrame, n: int, at: list[str]) -> DataFrame:
    """The n newest rows: what a grid of bounded size keeps."""
    return rows.orderBy(*[F.desc(c) for c in at]).limit(n)


def annotated(found: DataFrame, annotations: DataFrame, kind: str = "finding", key: str = "finding_id") -> DataFrame:
    """Rows with the status and comment of the annotation of their id."""
    notes = latest(annotations.filter(F.col("target_type") == kind), ["target_id"], "updated_at")
    return found.join(notes.select(F.col("target_id").alias(key), F.col("status").alias("annotation"), "comment"), key, "left")


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key: an upsert, or a queue in which the latest content wins."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("_at"), *[F.col(c) for c in rest])).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def toggled(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply status changes: the status a target has already is cleared, another replaces it."""
    keys = ["target_type", "target_id"]
    now = annotations.select(*keys, F.col("status").alias("old"), F.col("comment").alias("old_comment"), F.col("updated_at").alias("old_at"))
    new = changes.select(*keys, F.col("status").alias("new"), F.col("updated_at").alias("new_at"))
    both = now.join(new, keys, "full")
    status = F.when(F.col("new").isNull(), F.col("old")).when(F.col("new") == F.col("old"), F.lit("")).otherwise(F.col("new"))
    return both.select(*keys, status.alias("status"), F.col("old_comment").alias("comment"), F.coalesce("new_at", "old_at").alias("updated_at"))


def facet_values(scalar: list[str], listed: list[str]) -> Column:
    """All (facet, value) of a row: of scalar columns one value each, of listed ones each of their values."""
    pair = lambda c, v: F.struct(F.lit(c).alias("facet"), v.alias("value"))
    each = lambda c: F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), lambda v: pair(c, v))
    one = F.array(*[pair(c, F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in scalar]) if scalar else F.expr("cast(array() as array<struct<facet:string,value:string>>)")
    return F.concat(one, *map(each, listed))


def facets(rows: DataFrame, scalar: list[str], listed: list[str]) -> DataFrame:
    """Counts (facet, value, n) of each value of scalar and of listed columns, in one pass over the rows."""
    return rows.select(F.explode(facet_values(scalar, listed)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def facet_filter(rows: DataFrame, chosen: dict[str, list[str]], listed: tuple[str, ...] = ()) -> DataFrame:
    """Rows that have any chosen value of each facet; facets without choice do not narrow."""
    for name, values in chosen.items():
        if values:
            has = F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])) if name in listed else F.coalesce(F.col(name), F.lit("-")).isin(values)
            rows = rows.filter(has)
    return rows


def facet_recount(rows: DataFrame, chosen: dict[str, list[str]], scalar: list[str], listed: list[str]) -> DataFrame:
    """Facet counts over the rows that pass all filters; values that none of them has stay, with 0."""
    every = facets(rows, scalar, listed).select("facet", "value")
    now = facets(facet_filter(rows, chosen, tuple(listed)), scalar, listed)
    return every.join(now, ["facet", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rolled_up(hits: DataFrame) -> DataFrame:
    """Each secret of a rule over all places: hits (rule_id, secret, url, seen_at)."""
    from leakloom.functions.ids import secret_key
    from leakloom.functions.text import url_base, url_host

    rows = hits.withColumns({"base": url_base(F.col("url")), "host": url_host(F.col("url"))})
    by = rows.groupBy("rule_id", "secret").agg(F.array_sort(F.collect_set("base")).alias("urls"), F.array_sort(F.collect_set("host")).alias("hosts"), F.count("*").alias("occurrences"), F.min("seen_at").alias("first_seen"))
    return by.withColumn("key", secret_key(F.col("rule_id"), F.col("secret")))


def validation_rollup(results: DataFrame) -> DataFrame:
    """A finding's status from those of its matches: valid before invalid before undetermined; mean confidence."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    status = F.when(has("valid"), "valid").when(has("invalid"), "invalid").when(has("undetermined"), "undetermined")
    return results.groupBy("finding_id").agg(status.alias("status"), F.avg("confidence").alias("confidence"))


def not_stored(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs that an earlier scan has not seen."""
    return blobs.join(stored.select("blob_id"), "blob_id", "left_anti")


def combined(sources: list[DataFrame]) -> DataFrame:
    """Sources one after the other; of equal blobs the first in that order stays."""
    rows = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_place", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return first_by(rows, ["blob_id"], ["source_place", "seq"])


def count_by(rows: DataFrame, *by: Column | str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def status_breakdown(rows: DataFrame, by: str) -> DataFrame:
    """Rows by a column with how many are valid, invalid, undetermined, unchecked and false positives."""
    count = lambda c: F.count_if(c)
    status, false = F.col("status"), F.coalesce("false_positive", F.lit(False))
    parts = [count((status == s) & ~false).alias(s) for s in ("valid", "invalid", "undetermined")]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *parts, count(status.isNull() & ~false).alias("unchecked"), count(false).alias("false_positives")).orderBy(F.desc("n"), by)


def dashboard(rows: DataFrame, rule: str = "", text: str = "", sort: str = "seen_at", descending: bool = True) -> DataFrame:
    """Rows of a rule that hold a text in secret, URL or source, sorted without regard to case."""
    if rule:
        rows = rows.filter(F.col("rule_name") == rule)
    if text:
        held = F.lit(False)
        for c in ("secret", "url", "source"):
            held = held | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        rows = rows.filter(held)
    by = F.lower(sort) if dict(rows.dtypes)[sort] == "string" else F.col(sort)
    return rows.orderBy(by.desc() if descending else by.asc())


def grid(rows: DataFrame, host: str = "", method: str = "", status_class: int = 0, with_secrets: bool | None = None, kind: str = "", url: str = "") -> DataFrame:
    """Requests that meet all conditions given: host and method in any case, status class, secrets, parts of type and URL."""
    for column, value in (("host", host), ("method", method)):
        if value:
            rows = rows.filter(F.lower(column) == value.lower())
    for column, value in (("types", kind), ("url", url)):
        if value:
            rows = rows.filter(F.contains(F.lower(column), F.lit(value.lower())))
    if status_class:
        rows = rows.filter(F.floor(F.col("status_code") / 100) == status_class)
    return rows if with_secrets is None else rows.filter((F.col("secrets") > 0) == with_secrets)
