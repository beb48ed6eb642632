"""Reports: JSON, SARIF and text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakloom.functions.ids import base64_of
from leakloom.functions.text import file_uri
from leakloom.plans.store import BlobStore, Store  # noqa: F401  # part of what a report module gives

SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"


def match_json(matches: DataFrame) -> DataFrame:
    """Each match as a JSON object; bytes are base64."""
    b64 = lambda c: base64_of(F.coalesce(F.col(c), F.lit("")))
    point = lambda p: F.struct(F.col(f"{p}_line").alias("Line"), F.col(f"{p}_column").alias("Column"))
    location = F.struct(F.struct(F.col("start").alias("Start"), F.col("end").alias("End")).alias("Offset"), F.struct(point("start").alias("Start"), point("end").alias("End")).alias("Source"))
    fields = F.struct(
        F.col("blob_id").alias("BlobID"), F.col("match_id").alias("StructuralID"), F.col("finding_id").alias("FindingID"), F.col("rule_id").alias("RuleID"), F.col("rule_name").alias("RuleName"),
        location.alias("Location"), F.transform("groups", base64_of).alias("Groups"), F.struct(b64("before").alias("Before"), b64("matching").alias("Matching"), b64("after").alias("After")).alias("Snippet"),
    )
    return matches.select("match_id", F.to_json(fields).alias("json"))


def sarif_result(path: Column) -> Column:
    """The SARIF result of a match, as JSON."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"), F.struct(F.col("matching").alias("text")).alias("snippet"))
    place = F.struct(F.struct(F.struct(file_uri(path).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("rule_name").alias("text")).alias("message"), F.array(place).alias("locations")))


def finding_json(matches: DataFrame) -> DataFrame:
    """Each finding as a JSON object with its matches' ids and places, in the order of the ids."""
    of = F.array_sort(F.collect_list(F.struct(F.col("match_id").alias("StructuralID"), F.col("blob_id").alias("BlobID"), F.col("start").alias("Start"), F.col("end").alias("End"))))
    by = matches.groupBy("finding_id", "rule_id").agg(F.first("groups").alias("groups"), F.count("*").alias("n"), of.alias("matches"))
    fields = F.struct(F.col("finding_id").alias("ID"), F.col("rule_id").alias("RuleID"), F.transform("groups", base64_of).alias("Groups"), F.col("n").alias("MatchCount"), F.col("matches").alias("Matches"))
    return by.select("finding_id", F.to_json(fields).alias("json"))


def finding_parts(matches: DataFrame, size: int = 1000) -> DataFrame:
    """finding_json() in parts: (finding_id, part, json), each with at most so many of a finding's matches, and the number of all.

    Matches are numbered in the order of their ids, so that no row holds all of a finding that has many.
    """
    of = Window.partitionBy("finding_id").orderBy("match_id")
    numbered = matches.withColumn("part", F.floor((F.row_number().over(of) - 1) / size))
    total = matches.groupBy("finding_id").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("match_id").alias("StructuralID"), F.col("blob_id").alias("BlobID"), F.col("start").alias("Start"), F.col("end").alias("End"))))
    by = numbered.groupBy("finding_id", "rule_id", "part").agg(F.first("groups").alias("groups"), listed.alias("matches")).join(total, "finding_id")
    fields = F.struct(F.col("finding_id").alias("ID"), F.col("rule_id").alias("RuleID"), F.transform("groups", base64_of).alias("Groups"), F.col("n").alias("MatchCount"), F.col("part").alias("Part"), F.col("matches").alias("Matches"))
    return by.select("finding_id", "part", F.to_json(fields).alias("json"))


def human(found: DataFrame, top: DataFrame, rules: DataFrame) -> DataFrame:
    """A block of text for each finding: its rule, its groups and its first matches (see findings.top_matches)."""
    line = F.format_string("  %d. blob %s, bytes %d to %d", "number", "blob_id", "start", "end")
    shown = top.groupBy("finding_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("shown"), F.max("number").alias("k"))  # a few each
    named = found.join(rules.select("rule_id", "rule_name"), "rule_id", "left").join(shown, "finding_id")
    head = F.concat(F.coalesce("rule_name", "rule_id"), F.lit(" ("), "rule_id", F.lit(")\n  groups: "), F.array_join("groups", ", "))
    return named.select("finding_id", F.concat(head, F.format_string("\n  showing %d/%d\n", F.col("k"), F.col("matches")), "shown").alias("text"))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with their first category and how many more they have."""
    more = F.when(F.size("categories") > 1, F.concat(F.lit(" (+"), (F.size("categories") - 1).cast("string"), F.lit(")"))).otherwise("")
    return rules.select("rule_id", "rule_name", F.concat(F.coalesce(F.get("categories", F.lit(0)), F.lit("-")), more).alias("category"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """A summary by rule as lines of text, a row a rule."""
    return summary.select("rule_id", F.format_string("%s: %d findings, %d matches", "rule_name", "findings", "matches").alias("line"))


def summary_json(summary: DataFrame) -> DataFrame:
    """A summary by rule and its totals, as JSON objects."""
    fields = ["findings", "matches"]
    total = summary.agg(F.lit("total").alias("rule_id"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in fields])
    return summary.select("rule_id", *fields).unionByName(total).select("rule_id", F.to_json(F.struct("rule_id", *fields)).alias("json"))


def export_json(rolled: DataFrame) -> DataFrame:
    """Secrets over all places (see findings.rolled_up) as JSON objects."""
    fields = F.struct(F.col("rule_id").alias("ruleId"), F.col("key"), F.col("urls"), F.col("hosts"), F.col("occurrences"), F.col("first_seen").alias("firstSeen"))
    return rolled.select("key", F.to_json(fields).alias("json"))


def write_sarif(results: DataFrame, rules, path: str, tool: str = "leakloom", version: str = "1") -> None:
    """One SARIF file from rows with column `result`: rows stream through one writer, none is gathered."""
    listed = [{"id": r.id, "name": r.name, "shortDescription": {"text": r.description}} | ({"helpUri": r.references[0]} if r.references else {}) for r in rules]
    head = json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION})[:-1] + ', "runs": [{"tool": ' + json.dumps({"driver": {"name": tool, "version": version, "rules": listed}}) + ', "results": ['
    with open(path, "w", encoding="utf-8") as f:
        f.write(head)
        for i, row in enumerate(results.select("result").toLocalIterator()):
            f.write(("," if i else "") + row["result"])
        f.write("]}]}")


def lines_of(summary: DataFrame) -> list[str]:
    """A summary by rule, as text: as many lines as there are rules."""
    rows = summary.collect()
    return [f"{r['rule_name']} ({r['rule_id']}): {r['findings']} findings, {r['matches']} matches" for r in rows] + [f"total: {sum(r['findings'] for r in rows)} findings, {sum(r['matches'] for r in rows)} matches"]
