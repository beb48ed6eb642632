"""Results of validations that are kept between runs, checks that are tried again, and few at once for each host.

Secrets are kept as digests. A run joins its secrets to the results that are young enough; what has
none is dealt by host and slot, so that the checks of one host are some tasks' work, one after the
other in each, and the new results are a further batch of the table.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.operators.validation import Validator, cached_secret, check, first_validators
from leakloom.session import drop_path, materialize, ship_package

#: Seconds for which a result counts, tries of a check, seconds before the second try (each further one waits twice as long), checks of a host at once.
MAX_AGE, TRIES, WAIT, PER_HOST = 7 * 86_400.0, 3, 0.5, 4
#: Response codes after which a check is tried again.
BUSY = (429, 500, 502, 503, 504)
_RESULT = "digest string, status string, confidence double, checked_at double"


class ResultTable:
    """Results (digest, status, confidence, checked_at) as batches of Parquet files; the newest of a digest counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, since: float = 0.0) -> DataFrame:
        """The newest result of each digest, from that time on."""
        try:
            rows = self.spark.read.schema(_RESULT).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], _RESULT)
        rows = rows.filter(F.col("checked_at") >= since)
        return rows.groupBy("digest").agg(F.max_by(F.struct("status", "confidence", "checked_at"), F.struct("checked_at", "status")).alias("r")).select("digest", "r.*")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Write a batch, in the place of one of that name if there is one; returns it."""
        path = f"{self.path}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_RESULT).parquet(path)

    def forget(self, before: float) -> int:
        """Write what is at least that young as one batch in the place of all others; returns how many rows are left."""
        kept = materialize(self.read(before), "results")
        names = [r[0] for r in self.spark.read.parquet(self.path).select("batch").distinct().collect()]
        self.add(kept, f"all-{uuid.uuid4().hex}")
        for name in names:
            drop_path(self.spark, f"{self.path}/batch={name}")
        return kept.count()


def host_of(v: Validator) -> str:
    """The host of a validator's requests; its name, where a match fills the host in."""
    found = re.match(r"\w+://(?:[^/@]*@)?([^/:?#]+)", v.url)
    return found[1] if found and "{{" not in found[1] else f"validator {v.name}"


def retried(send: Callable[[dict], tuple[int, str]], tries: int = TRIES, wait: float = WAIT, busy: tuple[int, ...] = BUSY, sleep: Callable[[float], None] = time.sleep) -> Callable[[dict], tuple[int, str]]:
    """send, tried again after lost answers and busy codes, with waits that double; the last outcome counts."""

    def run(request: dict) -> tuple[int, str]:
        for i in range(tries):
            last = i == tries - 1
            try:
                status, body = send(request)
                if last or status not in busy:
                    return status, body
            except (OSError, EOFError):
                if last:
                    raise
            sleep(wait * 2**i)
        raise OSError("no try is left")

    return run


def validated(
    matches: DataFrame, validators: list[Validator], send: Callable[[dict], tuple[int, str]], table: ResultTable, max_age: float = MAX_AGE, now: float | None = None, per_host: int = PER_HOST, tries: int = TRIES, wait: float = WAIT, batch: str | None = None
) -> DataFrame:
    """Matches (rule_id, named, groups, secret, and matching and rule_place if known) with status, confidence and fresh.

    Each secret is looked up in the table by a digest of its validator and itself, and checked once if
    the table has no conclusive result of it that is young enough; fresh tells whether it was. At most per_host
    checks of a host run at once. Only answers that tell valid from invalid are kept; without a
    validator, a secret or an answer the status is undetermined. A batch that is tried again under its name replaces its results.
    """
    spark = matches.sparkSession
    ship_package(spark)
    first, at = first_validators(validators), time.time() if now is None else now
    hosts = {v.name: host_of(v) for v in first.values()}
    slots = max(1, len(set(hosts.values())) * per_host)
    sender = retried(send, tries, wait)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = [check(first.get(r["rule_id"]), dict(r["named"] or ()), r["groups"] or [], sender) for r in rows.to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([at] * len(out), pa.float64())], ["digest", "status", "confidence", "checked_at"])

    known = F.create_map(*[F.lit(x) for rule, v in first.items() for x in (rule, v.name)]) if first else F.create_map(F.lit(""), F.lit(""))
    host = F.create_map(*[F.lit(x) for pair in hosts.items() for x in pair]) if hosts else F.create_map(F.lit(""), F.lit(""))
    secret = cached_secret(F.col("named"), F.col("matching" if "matching" in matches.columns else "secret"))
    keyed = materialize(matches.withColumns({"_secret": secret, "_validator": F.try_element_at(known, F.col("rule_id"))}), "keyed")
    of = F.struct(*(["rule_place"] if "rule_place" in matches.columns else []), "rule_id", "groups", F.map_entries("named").alias("named"), F.col("_validator").alias("validator"))  # maps have no order
    once = keyed.filter("_secret <> ''").groupBy("_secret").agg(F.min(of).alias("m")).filter("m.validator is not null")
    digest = F.sha2(F.concat(F.octet_length(F.col("m.validator")).cast("string"), F.lit(":"), F.col("m.validator"), F.col("_secret")), 256)
    once = materialize(once.select("_secret", digest.alias("digest"), "m.rule_id", F.map_from_entries("m.named").alias("named"), "m.groups", F.try_element_at(host, F.col("m.validator")).alias("host")), "secrets")
    held = table.read(at - max_age).filter(F.col("status").isin("valid", "invalid"))
    missing = once.join(held.select("digest"), "digest", "left_anti").withColumn("slot", F.pmod(F.xxhash64("digest"), F.lit(per_host)))
    dealt = missing.repartition(slots, "host", "slot").select("digest", "rule_id", "named", "groups")
    new = table.add(dealt.mapInArrow(run, _RESULT), batch or uuid.uuid4().hex).withColumn("fresh", F.lit(True))
    told = new.unionByName(held.join(new.select("digest"), "digest", "left_anti").withColumn("fresh", F.lit(False)))
    found = keyed.join(once.select("_secret", "digest").join(told, "digest").drop("digest", "checked_at"), "_secret", "left")
    return found.drop("_secret", "_validator").withColumns({"status": F.coalesce("status", F.lit("undetermined")), "confidence": F.coalesce("confidence", F.lit(0.0)), "fresh": F.coalesce("fresh", F.lit(False))})
