"""Validation of secrets: requests from templates, evaluation of responses, each secret once."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.session import ship_package

# The groups that may hold the secret, in this order.
SECRET_GROUPS = ("secret", "token", "key", "password", "secret_key", "api_key")


def evaluated(status: Column, body: Column, success: Column, failure: Column, success_body: Column, failure_body: Column) -> Column:
    """struct<status, confidence> of a response: what the body rules out, then codes, else undetermined."""
    holds = lambda text: (F.coalesce(text, F.lit("")) != "") & F.contains(F.coalesce(body, F.lit("")), F.coalesce(text, F.lit("")))
    result = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    good = F.array_contains(success, status)
    plain = F.coalesce(success_body, F.lit("")) == ""
    return (
        F.when(holds(failure_body), result("invalid", 1.0))
        .when(good & (plain | holds(success_body)), result("valid", 1.0))
        .when(good, result("invalid", 1.0))
        .when(F.array_contains(failure, status), result("invalid", 1.0))
        .otherwise(result("undetermined", 0.5))
    )


def cached_secret(named: Column, snippet: Column) -> Column:
    """What a validation is remembered by: the first of the known groups, else the matched text."""
    return F.coalesce(*[F.try_element_at(named, F.lit(g)) for g in SECRET_GROUPS], snippet)


@dataclass(frozen=True)
class Validator:
    """An HTTP check of one or more rules' secrets."""

    name: str
    rule_ids: tuple[str, ...]
    url: str
    method: str = "GET"
    body: str = ""
    headers: tuple[tuple[str, str], ...] = ()
    auth: str = "none"
    secret_group: str = ""
    username: str = ""
    header_name: str = ""
    query_name: str = ""
    key_prefix: str = "key="
    success_codes: tuple[int, ...] = (200,)
    failure_codes: tuple[int, ...] = (401, 403)
    success_body: str = ""
    failure_body: str = ""


def filled(text: str, groups: dict[str, str]) -> str:
    return re.sub(r"\{\{ ?\.?(\w+) ?\}\}", lambda m: groups.get(m[1], m[0]), text)


def request_of(v: Validator, groups: dict[str, str], positional: list[str]) -> dict | None:
    """The request that checks a secret, or None if the match lacks it."""
    secret = groups.get(v.secret_group) if v.secret_group else next((groups[g] for g in SECRET_GROUPS if g in groups), positional[0] if positional else None)
    if secret is None and v.secret_group.isdigit() and 0 < int(v.secret_group) <= len(positional):
        secret = positional[int(v.secret_group) - 1]
    if secret is None and v.auth != "none":
        return None
    url, headers = filled(v.url, groups), {k: filled(x, groups) for k, x in v.headers}
    if v.auth == "bearer":
        headers["Authorization"] = f"Bearer {secret}"
    elif v.auth == "basic":
        headers["Authorization"] = "Basic " + base64.b64encode(f"{filled(v.username, groups) or secret}:{secret if v.username else ''}".encode()).decode()
    elif v.auth == "header":
        headers[v.header_name] = secret
    elif v.auth == "query":
        url += ("&" if "?" in url else "?") + f"{v.query_name}={secret}"
    elif v.auth == "api_key":
        headers["Authorization"] = v.key_prefix + secret
    elif v.auth != "none":
        raise ValueError(f"unsupported auth: {v.auth}")
    return {"method": v.method, "url": url, "headers": headers, "body": filled(v.body, groups)}


def _judge(v: Validator, status: int, body: str) -> tuple[str, float]:
    if v.failure_body and v.failure_body in body:
        return "invalid", 1.0
    if status in v.success_codes:
        return ("valid" if not v.success_body or v.success_body in body else "invalid"), 1.0
    return ("invalid", 1.0) if status in v.failure_codes else ("undetermined", 0.5)


def load_validators(folder: str) -> list[Validator]:
    """The validators of the YAML files in a folder, in the order of names; a file may hold many."""
    import glob
    import os

    import yaml

    out = []
    for name in sorted(glob.glob(os.path.join(folder, "*.y*ml"))):
        with open(name, encoding="utf-8") as f:
            for raw in (yaml.safe_load(f) or {}).get("validators") or ():
                http = raw["http"]
                auth = http.get("auth") or {}
                codes = lambda k, http=http: tuple(int(c) for c in http.get(k) or ())
                out.append(
                    Validator(
                        str(raw["name"]), tuple(map(str, raw.get("rule_ids") or ())), str(http["url"]), str(http.get("method") or "GET"), str(http.get("body") or ""),
                        tuple((str(h["name"]), str(h["value"])) for h in http.get("headers") or ()), str(auth.get("type") or "none"), str(auth.get("secret_group") or ""), str(auth.get("username") or ""),
                        str(auth.get("header_name") or ""), str(auth.get("query_param") or ""), str(auth.get("key_prefix") or "key="), codes("success_codes"), codes("failure_codes"),
                        str(http.get("success_body_contains") or ""), str(http.get("failure_body_contains") or ""),
                    )
                )
    return out


def first_validators(validators: list[Validator]) -> dict[str, Validator]:
    """The validator of each rule: the first that names it."""
    out: dict[str, Validator] = {}
    for v in validators:
        for rule in v.rule_ids:
            out.setdefault(rule, v)
    return out


def with_validator(matches: DataFrame, validators: list[Validator]) -> DataFrame:
    """Matches with the name of the validator of their rule, null if it has none."""
    names = [(rule, v.name) for rule, v in first_validators(validators).items()]
    return matches.join(F.broadcast(matches.sparkSession.createDataFrame(names, "rule_id string, validator string")), "rule_id", "left")  # a list of the driver's


def check(v: Validator | None, named: dict[str, str], groups: list[str], send: Callable[[dict], tuple[int, str]]) -> tuple[str, float]:
    """Status and confidence of one secret; without a validator, a secret or an answer it is undetermined, 0."""
    if v is None:
        return "undetermined", 0.0
    request = request_of(v, named, groups)
    if request is None:
        return "undetermined", 0.0
    try:
        status, body = send(request)
    except (OSError, EOFError):  # no answer; other errors are the program's
        return "undetermined", 0.0
    return _judge(v, status, body)


def validated(matches: DataFrame, validators: list[Validator], send: Callable[[dict], tuple[int, str]], workers: int = 4) -> DataFrame:
    """Matches (rule_id, named, groups, secret, and matching and rule_place if known) with status and confidence.

    Each secret (see cached_secret) is checked once, as the match of its first rule, by that rule's first
    validator; send(request) gives a response's code and body, runs in tasks, at most workers of them
    at once in each, and may raise OSError if there is no answer.
    """
    ship_package(matches.sparkSession)
    first = first_validators(validators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                out = list(pool.map(lambda r: check(first.get(r["rule_id"]), dict(r["named"] or ()), r["groups"] or [], send), batch.to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["checked", "status", "confidence"])

    keyed = matches.withColumn("checked", cached_secret(F.col("named"), F.col("matching" if "matching" in matches.columns else "secret")))
    of = F.struct(*(["rule_place"] if "rule_place" in matches.columns else []), "rule_id", "groups", F.map_entries("named").alias("named"))  # maps have no order
    once = keyed.filter("checked <> ''").groupBy("checked").agg(F.min(of).alias("m")).select("checked", "m.rule_id", F.map_from_entries("m.named").alias("named"), "m.groups")
    found = keyed.join(once.mapInArrow(run, "checked string, status string, confidence double"), "checked", "left").drop("checked")
    return found.withColumns({"status": F.coalesce("status", F.lit("undetermined")), "confidence": F.coalesce("confidence", F.lit(0.0))})
