"""A scanner for programs: strings, files and batches in, findings out; and an NDJSON loop over it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.operators import filters, findings
from leakloom.operators.match import STATUSES, rule_status, scan
from leakloom.operators.prefilter import Prefilter
from leakloom.operators.validation import Validator, check, first_validators
from leakloom.plans import rules as R
from leakloom.sources import blobs as B


class Scanner:
    """Scans with a fixed list of rules; batches of any size run as one Spark job."""

    def __init__(self, spark: SparkSession, rules: Iterable[R.Rule] = R.CREDENTIAL_PACK, lines: int = 2, dedupe: str = "content"):
        self.spark, self.rules, self.lines, self.dedupe = spark, list(rules), lines, dedupe
        faults = [f"{r.id}: {x}" for r in self.rules for x in R.faults_of(r)]
        if faults or not self.rules:
            raise ValueError("; ".join(faults) or "no rules")
        self.frame = R.frame(spark, self.rules)

    def matches(self, blobs: DataFrame) -> DataFrame:
        """Matches of blobs (blob_id, content), filtered, deduplicated and identified."""
        return findings.identified(filters.postfilter(scan(blobs, self.rules, self.lines, self.dedupe), self.frame))

    def scan_batch(self, items: Iterable[tuple[str, str]]) -> list[dict]:
        """The matches of each (source, content) item; an item without content has none."""
        items = list(items)
        if not items:
            return []
        blobs = B.from_items(self.spark, [(s, c or "") for s, c in items])
        rows = blobs.select("seq", "blob_id").join(self.matches(blobs.dropDuplicates(["blob_id"])), "blob_id").orderBy("seq", "start", "end", "rule_place")
        out = [{"source": s, "matches": []} for s, _ in items]
        for r in rows.collect():  # what the caller asked for
            out[r["seq"]]["matches"].append({k: v for k, v in r.asDict(recursive=True).items() if k not in ("seq", "rule_sid", "rule_place")})
        return out

    def scan_string(self, content: str, source: str = "string") -> list[dict]:
        return self.scan_batch([(source, content)])[0]["matches"]

    def scan_file(self, path: str) -> DataFrame:
        return self.matches(B.from_files(self.spark, path))


def serve(scanner: Scanner, requests: TextIO, validators: Iterable[Validator] = (), send: Callable[[dict], tuple[int, str]] | None = None) -> Iterator[str]:
    """Answers, as JSON lines, to requests scan, scan_batch, validate and close; others get an error answer.

    validate takes a rule's id, its named groups and its groups, and needs validators and a sender.

    A line that is no JSON ends the loop with an error, as does the end of the input without one.
    """
    known = first_validators(list(validators))
    yield json.dumps({"type": "ready", "rules": len(scanner.rules)})
    for line in requests:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as e:
            yield json.dumps({"type": "error", "error": str(e)})
            return
        kind, payload = request.get("type"), request.get("payload") or {}
        if kind == "close":
            return
        if kind == "scan":
            found = scanner.scan_string(payload.get("content", ""), payload.get("source", ""))
            yield json.dumps({"type": "scan", "source": payload.get("source", ""), "matches": found}, default=str)
        elif kind == "scan_batch":
            results = scanner.scan_batch([(i.get("source", ""), i.get("content", "")) for i in payload.get("items", [])])
            yield json.dumps({"type": "scan_batch", "results": results, "total": sum(len(r["matches"]) for r in results)}, default=str)
        elif kind == "validate":
            v = known.get(payload.get("rule_id", "")) if send else None
            status, confidence = check(v, payload.get("named") or {}, payload.get("groups") or [], send)
            yield json.dumps({"type": "validate", "status": status, "confidence": confidence})
        else:
            yield json.dumps({"type": "error", "error": f"unknown request type: {kind}"})


_made: dict[tuple, tuple] = {}


def _ready(rules: list[R.Rule]) -> tuple:
    """What matches_in() takes after the text; a worker makes it once for the same rules, as each row may have a table function of its own."""
    key = tuple((r.id, r.keywords, r.pattern) for r in rules)
    if key not in _made:
        ready = [(i, k, R.compiled(p)) for i, k, p in key]
        _made[key] = (ready, 0, "content", Prefilter((k, p) for _, k, p in ready))
    return _made[key]


def register(spark: SparkSession, rules: Iterable[R.Rule] = R.CREDENTIAL_PACK) -> None:
    """Make `git_blob_id(binary)` and the table functions `scan_secrets(string)` and `scan_blobs(TABLE)` known to SQL.

    scan_secrets stands in a lateral join, a call a row; scan_blobs takes a table whose first columns are
    a blob's id and content, a batch a call, and gives all columns of matches.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udtf, udtf

    from leakloom.operators.match import MATCHES, match_rows, matches_in
    from leakloom.session import ship_package

    ship_package(spark)
    packed = list(rules)

    class ScanSecrets:
        """Rows come one by one, but patterns and prefilter are made once a task."""

        def __init__(self):
            self.ready = _ready(packed)

        def eval(self, content: str):
            for m in matches_in(content or "", *self.ready):
                yield m[0], m[2], m[3], m[7]

    class ScanBlobs:
        def __init__(self):
            self.ready = _ready(packed)

        def eval(self, batch: pa.RecordBatch):
            yield pa.Table.from_batches([match_rows(batch, self.ready)])

    spark.udtf.register("scan_blobs", arrow_udtf(ScanBlobs, returnType=MATCHES))
    spark.udtf.register("scan_secrets", udtf(ScanSecrets, returnType="rule_id string, start long, end long, matching string", useArrow=True))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION git_blob_id(content BINARY) RETURNS STRING RETURN sha1(concat(CAST(concat('blob ', CAST(octet_length(content) AS STRING)) AS BINARY), X'00', content))")


def rule_stats(matches: DataFrame, rules: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Each rule with its matches and its status; with what scan_reported() tells, the worst status over all blobs."""
    n = matches.groupBy("rule_id").agg(F.count("*").alias("matches"))
    out = rules.select("rule_id", "rule_name").join(n, "rule_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(F.col("matches") > 0, "matched").otherwise("none")
    if told is None:
        return out.withColumn("status", status)
    worst = rule_status(told).select("rule_id", F.col("status").alias("worst"))
    return out.join(worst, "rule_id", "left").withColumn("status", F.when(F.col("worst").isin(*STATUSES[2:]), F.col("worst")).otherwise(status)).drop("worst")
