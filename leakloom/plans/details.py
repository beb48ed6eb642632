"""Further registered queries: places and context, rules, joins, reports, validation, sources and traffic."""

from __future__ import annotations

import hashlib
import io
import json
import sqlite3
import tarfile
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from leakloom import api
from leakloom.functions import text as T
from leakloom.operators import findings, validation, validation_cache
from leakloom.operators.match import scan, scan_reported
from leakloom.plans import queries as Q
from leakloom.plans import report
from leakloom.plans import rules as R
from leakloom.plans.queries import PACK, SQL, query, table
from leakloom.session import drop_at_exit, shared_dir, ship_package
from leakloom.sources import blobs as B
from leakloom.sources.extract import members
from leakloom.sources.pages import items_of
from leakloom.streaming import stream

_quoted = Q._quoted
_M, _IDS, _RULES = Q._MATCHES_SQL, Q._IDS_SQL, Q._RULES_SQL

# --- places and context of matches ---


@query(f"WITH {_M}, z AS ({Q._PLACES_SQL} m) SELECT blob_id, rule_id, s AS start, start_line, start_column, end_line, end_column FROM z")
def match_lines(spark, sf_dir):
    """Line and byte column of both ends of every match."""
    return Q.document_matches(spark, sf_dir).select("blob_id", "rule_id", "start", "start_line", "start_column", "end_line", "end_column")


@query(f"WITH {_M}, z AS ({Q._AROUND_SQL.format(rows='m')}) SELECT blob_id, rule_id, s AS start, before, after FROM z")
def match_context(spark, sf_dir):
    """The rest of every match's lines and three lines on either side."""
    return Q.document_matches(spark, sf_dir).select("blob_id", "rule_id", "start", "before", "after")


_WINDOW = (
    "z AS (SELECT *, length(before) AS a, length(matching) AS w, length(before || matching || after) AS n, before || matching || after AS x FROM c), y AS (SELECT *, (80 - w - 6) // 2 AS h FROM z), u AS (SELECT *, a - h AS l0, a + w + h AS h0 FROM y),"
    " v AS (SELECT *, greatest(l0, 0) AS l1, CASE WHEN l0 < 0 THEN h0 - l0 ELSE h0 END AS h1 FROM u), k AS (SELECT *, CASE WHEN h1 > n THEN greatest(l1 - (h1 - n), 0) ELSE l1 END AS lo, least(h1, n) AS hi FROM v)"
)


@query(
    f"WITH {_M}, c AS ({Q._AROUND_SQL.format(rows='m')}), {_WINDOW} SELECT blob_id, rule_id, s AS start, CASE WHEN n <= 80 THEN x WHEN w >= 80 THEN '...' || left(matching, 74) || '...'"
    " ELSE CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(x, lo + 1, hi - lo) || CASE WHEN hi < n THEN '...' ELSE '' END END AS snippet FROM k"
)
def match_windows(spark, sf_dir):
    """The window of 80 characters around every match, cut from its context."""
    found = Q.document_matches(spark, sf_dir)
    return found.select("blob_id", "rule_id", "start", T.snippet_window(F.col("before"), F.col("matching"), F.col("after"), 80).alias("snippet"))


_NAMED = [(r, name, g) for r in R.CREDENTIAL_PACK for name, g in R.compiled(r.pattern).groupindex.items()]


@query(
    f"WITH {Q._PLANTED_SQL}, x AS ("
    + " UNION ALL ".join(f"SELECT {_quoted(r.id)} AS rule_id, {_quoted(name)} AS name, unnest(regexp_extract_all(text, {_quoted(r.pattern)}, {g})) AS v FROM pl" for r, name, g in _NAMED)
    + ") SELECT rule_id, name, count(*) AS captures, count(DISTINCT v) AS captured FROM x GROUP BY rule_id, name"
)
def named_captures(spark, sf_dir):
    """Named groups of the credentials planted in the documents."""
    rows = Q._planted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("blob_id"), F.col("text").alias("content"))
    pairs = scan(rows, R.CREDENTIAL_PACK, dedupe="location").select("rule_id", F.explode("named").alias("name", "v"))
    return pairs.groupBy("rule_id", "name").agg(F.count("*").alias("captures"), F.countDistinct("v").alias("captured"))


# --- rules ---


@query(f"WITH {_M}, {_RULES} SELECT r.rule_id, r.rule_name, count(m.rule_id) AS matches, CASE WHEN count(m.rule_id) > 0 THEN 'matched' ELSE 'none' END AS status FROM r LEFT JOIN m USING (rule_id) GROUP BY r.rule_id, r.rule_name")
def rule_statistics(spark, sf_dir):
    """Every rule with its matches and its worst status over all documents, from one pass."""
    hits, told = scan_reported(Q.document_blobs(spark, sf_dir), PACK)
    return api.rule_stats(hits.dropDuplicates(["blob_id", "rule_id", "start", "end"]), R.frame(spark, PACK), told)


@query(f"WITH {_M} SELECT blob_id, rule_id, s AS start FROM m QUALIFY row_number() OVER (PARTITION BY blob_id ORDER BY place, s, e) <= 2")
def capped_matches(spark, sf_dir):
    """At most two matches of each blob."""
    return findings.capped(Q.document_matches(spark, sf_dir), 2).select("blob_id", "rule_id", "start")


_SET = R.Ruleset("assets", "Assets", ("lk.email.1", "lk.ipv4.1", "lk.unknown.1"))
_IN_SET = R.chosen(PACK, ruleset=_SET)


@query(f"WITH {Q._BLOBS_SQL}, raw AS ({Q._raw_sql('d', _IN_SET)}) SELECT rule_id, count(*) AS matches, CAST(sum(s) AS BIGINT) AS starts FROM raw GROUP BY rule_id")
def ruleset_matches(spark, sf_dir):
    """Matches of the rules of a ruleset, which names a rule that nobody knows."""
    blobs = B.from_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    found = scan(blobs, _IN_SET, dedupe="location").dropDuplicates(["blob_id", "rule_id", "start"])
    return found.groupBy("rule_id").agg(F.count("*").alias("matches"), F.sum("start").alias("starts"))


_AGAIN = R.Rule("lk.ipv4.1", "IPv4 address, first part of three digits", r"\b(\d{3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b")


@query(f"WITH {Q._BLOBS_SQL}, raw AS ({Q._raw_sql('d', [_AGAIN])}) SELECT blob_id, s AS start, matching FROM raw")
def last_rule_wins(spark, sf_dir):
    """Matches of a rule whose id an earlier one had."""
    found = scan(Q.document_blobs(spark, sf_dir), [*PACK, _AGAIN], dedupe="location").filter(F.col("rule_id") == _AGAIN.id)
    return found.dropDuplicates(["blob_id", "start"]).select("blob_id", "start", "matching")


@query(f"WITH {_M}, {_RULES} SELECT r.rule_id, r.rule_name, r.categories[1] || CASE WHEN len(r.categories) > 1 THEN ' (+' || (len(r.categories) - 1) || ')' ELSE '' END AS category, count(DISTINCT m.blob_id) AS blobs FROM r LEFT JOIN m USING (rule_id) GROUP BY ALL")
def rule_listing(spark, sf_dir):
    """The table of rules, with the blobs in which each matches."""
    blobs = Q.document_matches(spark, sf_dir).groupBy("rule_id").agg(F.countDistinct("blob_id").alias("blobs"))
    return report.rule_table(R.frame(spark, PACK)).join(blobs, "rule_id", "left").withColumn("blobs", F.coalesce("blobs", F.lit(0)))


# --- joins and groups of findings ---


@query(
    f"WITH {_IDS}, g AS (SELECT DISTINCT finding_id, rule_id, groups FROM f), k AS (SELECT CASE WHEN left(blob_id, 1) < '8' THEN NULL ELSE finding_id END AS fid, rule_id, groups, match_id FROM f),"
    " own AS (SELECT g.*, k.match_id FROM g LEFT JOIN k ON k.fid = g.finding_id)"
    " SELECT finding_id, match_id FROM own WHERE match_id IS NOT NULL UNION ALL SELECT own.finding_id, k.match_id FROM own LEFT JOIN k ON k.rule_id = own.rule_id AND k.groups = own.groups WHERE own.match_id IS NULL"
)
def fallback_matches(spark, sf_dir):
    """Findings with their matches, of which some have lost the finding's id and are found by rule and groups."""
    rows = Q.passed(spark, sf_dir)
    lost = rows.withColumn("finding_id", F.when(F.substring("blob_id", 1, 1) >= "8", F.col("finding_id")))
    return findings.with_matches(findings.findings(rows), lost).select("finding_id", "match_id")


_COMMITS = 997


@query(f"WITH {Q._BLOBS_SQL}, c AS (SELECT event_id % {_COMMITS} AS k, arg_min(event_id, (ts, event_id)) AS commit_id FROM events GROUP BY 1) SELECT b.seq AS doc_id, b.blob_id, coalesce(c.commit_id, -1) AS commit_id FROM b LEFT JOIN c ON c.k = b.seq")
def blob_commits(spark, sf_dir):
    """Documents with the first commit of their path, for which events stand; -1 for those without any."""
    blobs = Q.document_blobs(spark, sf_dir).withColumn("path", F.concat(F.lit("doc/"), F.col("seq").cast("string")))
    commits = table(spark, sf_dir, "events").select(F.concat(F.lit("doc/"), (F.col("event_id") % _COMMITS).cast("string")).alias("path"), F.col("event_id").alias("commit_id"), "ts")
    return findings.with_commits(blobs.select("seq", "blob_id", "path"), commits, ["ts", "commit_id"]).select(F.col("seq").alias("doc_id"), "blob_id", F.coalesce("commit_id", F.lit(-1)).alias("commit_id"))


_CLUSTERS = Q.SQL["cross_rule_winners"].replace("ORDER BY len(groups) DESC", "ORDER BY (rule_id = 'lk.hex.1') DESC, len(groups) DESC")


@query(_CLUSTERS)
def validator_winners(spark, sf_dir):
    """Of matches that share a value the one to report, if rules with a validator come first."""
    return findings.winners(Q.passed(spark, sf_dir), R.frame(spark, PACK), ["lk.hex.1"]).select("blob_id", "rule_id", "start", "secret")


@query(f"WITH {_IDS} SELECT DISTINCT f.finding_id, split_part(b.path, '/', 1) AS repository FROM f JOIN b USING (blob_id)")
def finding_repositories(spark, sf_dir):
    """The repositories of each finding, for which the documents' sources stand."""
    return findings.repositories(Q.passed(spark, sf_dir), Q.document_blobs(spark, sf_dir), F.substring_index("path", "/", 1))


@query(f"WITH {_IDS}, x AS (SELECT DISTINCT f.finding_id FROM f JOIN b USING (blob_id) WHERE contains(split_part(b.path, '/', 1), 'src1')) SELECT DISTINCT finding_id, rule_id FROM f ANTI JOIN x USING (finding_id)")
def excluded_repositories(spark, sf_dir):
    """Findings outside the repositories whose names hold a text."""
    rows = Q.passed(spark, sf_dir)
    places = findings.repositories(rows, Q.document_blobs(spark, sf_dir), F.substring_index("path", "/", 1))
    return findings.without_repository(findings.findings(rows), places, "src1").select("finding_id", "rule_id")


@query(f"WITH {_IDS}, g AS (SELECT finding_id, rule_id, count(*) AS n FROM f GROUP BY ALL) SELECT finding_id, n AS matches FROM g ORDER BY n, finding_id")
def ordered_findings(spark, sf_dir):
    """Findings by their matches, fewest first."""
    return findings.ordered(findings.findings(Q.passed(spark, sf_dir)), "matches").select("finding_id", "matches")


@query(f"WITH {_IDS}, t AS (SELECT f.match_id, name AS rule_name, secret, 'http://' || path AS url, split_part(path, '/', 1) AS source, seq FROM f JOIN d USING (blob_id)) SELECT match_id, secret, url FROM t WHERE rule_name = 'IPv4 address' AND (contains(lower(secret), '.1') OR contains(lower(url), '.1') OR contains(lower(source), '.1'))")
def dashboard_rows(spark, sf_dir):
    """Matches of a rule that hold a text in secret, URL or source, sorted."""
    rows = findings.with_provenance(Q.passed(spark, sf_dir), Q.document_blobs(spark, sf_dir))
    rows = rows.select("match_id", "rule_name", "secret", F.concat(F.lit("http://"), "path").alias("url"), F.substring_index("path", "/", 1).alias("source"))
    return findings.dashboard(rows, rule="IPv4 address", text=".1", sort="secret", descending=False).select("match_id", "secret", "url")


# --- reports ---


_SUMMARY = f"WITH {_IDS}, g AS (SELECT finding_id, rule_id, any_value(name) AS rule_name, count(*) AS n FROM f GROUP BY finding_id, rule_id), s AS (SELECT rule_id, any_value(rule_name) AS rule_name, count(*) AS findings, CAST(sum(n) AS BIGINT) AS matches FROM g GROUP BY rule_id)"


@query(f"{_SUMMARY} SELECT rule_id, rule_name || ': ' || findings || ' findings, ' || matches || ' matches' AS line FROM s")
def summary_lines(spark, sf_dir):
    """The summary by rule as lines of text."""
    return report.summary_lines(Q.QUERIES["summary_by_rule"](spark, sf_dir))


@query(
    f"{_SUMMARY}, t AS (SELECT rule_id, findings, matches FROM s UNION ALL SELECT 'total', CAST(sum(findings) AS BIGINT), CAST(sum(matches) AS BIGINT) FROM s)"
    " SELECT rule_id, CAST(to_json({'rule_id': rule_id, 'findings': findings, 'matches': matches}) AS VARCHAR) AS json FROM t"
)
def summary_json(spark, sf_dir):
    """The summary by rule and its totals as JSON."""
    return report.summary_json(Q.QUERIES["summary_by_rule"](spark, sf_dir))


@query(
    f"WITH {_IDS}, o AS (SELECT finding_id, rule_id, groups, match_id, blob_id, s, e FROM f ORDER BY match_id), g AS (SELECT finding_id, rule_id, any_value(groups) AS groups, count(*) AS n, list({{'StructuralID': match_id, 'BlobID': blob_id, 'Start': s, 'End': e}} ORDER BY match_id) AS ms FROM o GROUP BY finding_id, rule_id)"
    " SELECT finding_id, CAST(to_json({'ID': finding_id, 'RuleID': rule_id, 'Groups': list_transform(groups, lambda x: to_base64(encode(x))), 'MatchCount': n, 'Matches': ms}) AS VARCHAR) AS json FROM g"
)
def json_findings(spark, sf_dir):
    """Findings with their matches as JSON."""
    return report.finding_json(Q.passed(spark, sf_dir))


@query(
    f"WITH {_IDS}, o AS (SELECT *, CAST((row_number() OVER (PARTITION BY finding_id ORDER BY match_id) - 1) // 3 AS BIGINT) AS part, count(*) OVER (PARTITION BY finding_id) AS n FROM f),"
    " g AS (SELECT finding_id, rule_id, part, any_value(groups) AS groups, any_value(n) AS n, list({'StructuralID': match_id, 'BlobID': blob_id, 'Start': s, 'End': e} ORDER BY match_id) AS ms FROM o GROUP BY finding_id, rule_id, part)"
    " SELECT finding_id, part, CAST(to_json({'ID': finding_id, 'RuleID': rule_id, 'Groups': list_transform(groups, lambda x: to_base64(encode(x))), 'MatchCount': n, 'Part': part, 'Matches': ms}) AS VARCHAR) AS json FROM g"
)
def json_finding_parts(spark, sf_dir):
    """Findings as JSON in parts of three matches."""
    return report.finding_parts(Q.passed(spark, sf_dir), 3)


@query(
    f"WITH {_IDS}, t AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY finding_id) AS n FROM f WINDOW w AS (PARTITION BY finding_id ORDER BY blob_id, s, e) QUALIFY row_number() OVER w <= 3),"
    " g AS (SELECT finding_id, any_value(name) AS name, any_value(rule_id) AS rule_id, any_value(groups) AS groups, max(k) AS k, any_value(n) AS n, string_agg('  ' || k || '. blob ' || blob_id || ', bytes ' || s || ' to ' || e, chr(10) ORDER BY k) AS shown FROM t GROUP BY finding_id)"
    " SELECT finding_id, name || ' (' || rule_id || ')' || chr(10) || '  groups: ' || array_to_string(groups, ', ') || chr(10) || '  showing ' || k || '/' || n || chr(10) || shown AS text FROM g"
)
def human_report(spark, sf_dir):
    """A block of text for each finding."""
    rows = Q.passed(spark, sf_dir)
    return report.human(findings.findings(rows), findings.top_matches(rows), R.frame(spark, PACK))


@query(
    Q.SQL["secret_rollup"].replace(" SELECT rule_id, sha256", ", z AS (SELECT rule_id, sha256").replace("GROUP BY rule_id, secret", "GROUP BY rule_id, secret)")
    + " SELECT key, CAST(to_json({'ruleId': rule_id, 'key': key, 'urls': string_split(urls, ','), 'hosts': string_split(hosts, ','), 'occurrences': occurrences, 'firstSeen': first_seen}) AS VARCHAR) AS json FROM z"
)
def exported_secrets(spark, sf_dir):
    """Secrets over all places as JSON."""
    rows = Q.QUERIES["secret_rollup"](spark, sf_dir)
    return report.export_json(rows.withColumns({"urls": F.split("urls", ","), "hosts": F.split("hosts", ",")}))


@query(f"WITH {_IDS}, g AS (SELECT count(DISTINCT finding_id) AS n, count(*) AS m FROM f) SELECT 'findings' AS entity, CAST(n AS BIGINT) AS stored FROM g UNION ALL SELECT 'matches', CAST(m AS BIGINT) FROM g")
def stored_rows(spark, sf_dir):
    """Rows of a store to which the same matches and findings are added twice."""
    path = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    store, rows = report.Store(spark, path), Q.passed(spark, sf_dir)
    for _ in range(2):
        store.add("matches", rows.select("match_id", "finding_id", "rule_id"))
        store.add("findings", findings.findings(rows).select("finding_id", "rule_id"))
    counts = [store.read(e).select(F.lit(e).alias("entity")).groupBy("entity").agg(F.count("*").alias("stored")) for e in ("matches", "findings")]
    return counts[0].unionByName(counts[1])


@query(f"WITH {Q._BLOBS_SQL} SELECT blob_id, size, sha256(text) AS sha256 FROM d WHERE blob_id IN (SELECT blob_id FROM b WHERE seq % 2 = 0)")
def stored_blobs(spark, sf_dir):
    """Contents of the blobs of even documents, from a store to which all have been added twice."""
    path = f"{shared_dir(spark).rstrip('/')}/blobs-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    store, blobs = report.BlobStore(spark, path), Q.document_blobs(spark, sf_dir)
    for _ in range(2):
        store.put(blobs)
    return store.get(blobs.filter("seq % 2 = 0")).select("blob_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@query(
    "WITH p AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN regexp_matches(c, '^[ -~\n]$') THEN c ELSE repeat('.', strlen(c)) END), '') AS x FROM documents),"
    " l AS (SELECT doc_id, x, flatten(list_transform(string_split(x, chr(10)), lambda y: list_transform(range(0, greatest((length(y) - 1) // 40, 0) + 1), lambda i: substr(y, i * 40 + 1, 40)))) AS ls FROM p)"
    " SELECT doc_id, CASE WHEN length(x) <= 60 THEN x ELSE left(x, 57) || '...' END AS head, len(ls) AS lines, sha256(array_to_string(ls, '|')) AS wrapped_sha256 FROM l"
)
def display_texts(spark, sf_dir):
    """Documents as a terminal shows them: printable, cut and wrapped."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.printable(F.coalesce("text", F.lit(""))).alias("x")).withColumn("ls", T.wrapped(F.col("x"), 40))
    return rows.select("doc_id", T.truncated(F.col("x"), 60).alias("head"), F.size("ls").cast("long").alias("lines"), F.sha2(F.array_join("ls", "|"), 256).alias("wrapped_sha256"))


# --- validation ---


_CHECKS = [
    validation.Validator("tokens", ("lk.token.1", "lk.hex.1"), "https://example.com/check", auth="bearer", success_body="ACCEPTED"),
    validation.Validator("others", ("lk.hex.1", "lk.email.1"), "https://example.com/{{ key }}", auth="query", query_name="k"),
    validation.Validator("cards", ("lk.card.1",), "https://example.com/card", method="POST", auth="header", header_name="X-Card", failure_body="DENIED"),
]
_ANSWERS = (200, 401, 403, 429, 500, 200)


def _answer(request: dict) -> tuple[int, str]:
    """A service that answers by a hash of the secret it is sent."""
    headers = request["headers"]
    secret = headers.get("X-Card") or headers.get("Authorization", "").removeprefix("Bearer ") or request["url"].partition("?k=")[2]
    n = int(hashlib.sha256(secret.encode()).hexdigest()[:6], 16)
    if n % 13 == 5:
        raise OSError("no answer")
    return _ANSWERS[n % 6], "ACCEPTED" if n % 2 else "DENIED"


@query(f"WITH {_M} SELECT blob_id, rule_id, s AS start, CASE WHEN rule_id IN ('lk.token.1', 'lk.hex.1') THEN 'tokens' WHEN rule_id = 'lk.email.1' THEN 'others' WHEN rule_id = 'lk.card.1' THEN 'cards' END AS validator FROM m")
def first_validators(spark, sf_dir):
    """The validator of each match: the first that names its rule."""
    return validation.with_validator(Q.document_matches(spark, sf_dir), _CHECKS).select("blob_id", "rule_id", "start", "validator")


@query(
    f"WITH {_M}, k AS (SELECT secret, arg_min(rule_id, place) AS rule_id, CAST('0x' || left(sha256(secret), 6) AS BIGINT) AS n FROM m GROUP BY secret),"
    " a AS (SELECT *, [200, 401, 403, 429, 500, 200][n % 6 + 1] AS code, n % 2 = 1 AS accepted, n % 13 = 5 AS lost FROM k),"
    " v AS (SELECT secret, CASE WHEN lost OR rule_id NOT IN ('lk.token.1', 'lk.hex.1', 'lk.email.1', 'lk.card.1') THEN 'none' WHEN rule_id = 'lk.card.1' AND NOT accepted THEN 'invalid'"
    " WHEN code = 200 THEN CASE WHEN rule_id IN ('lk.token.1', 'lk.hex.1') AND NOT accepted THEN 'invalid' ELSE 'valid' END WHEN code IN (401, 403) THEN 'invalid' ELSE 'undetermined' END AS r FROM a)"
    " SELECT m.blob_id, m.rule_id, m.s AS start, CASE WHEN r = 'none' THEN 'undetermined' ELSE r END AS status, CASE r WHEN 'none' THEN 0.0::DOUBLE WHEN 'undetermined' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM m JOIN v USING (secret)"
)
def validated_matches(spark, sf_dir):
    """Matches with the status of their secret, each of which is checked once by its rule's first validator."""
    return validation.validated(Q.document_matches(spark, sf_dir), _CHECKS, _answer).select("blob_id", "rule_id", "start", "status", "confidence")


@query(
    f"WITH x AS ({SQL['validated_matches']}) SELECT run, status, count(*) AS matches, CAST(sum(CASE WHEN confidence = 0.5 OR confidence = 1 AND run = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fresh"
    " FROM x, (VALUES (1), (2)) r(run) GROUP BY run, status"
)
def cached_validations(spark, sf_dir):
    """Matches by status and by whether their secret was answered in this run, in a first run and a second one: the second asks again only what was not conclusive."""
    path = f"{shared_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    table, hits = validation_cache.ResultTable(spark, path), Q.document_matches(spark, sf_dir)
    out = None
    for run in (1, 2):
        told = validation_cache.validated(hits, _CHECKS, _answer, table, now=1e9 + run, tries=1)
        n = told.groupBy("status").agg(F.count("*").alias("matches"), F.sum((F.col("fresh") & (F.col("confidence") > 0)).cast("long")).alias("fresh")).withColumn("run", F.lit(run))
        out = n if out is None else out.unionByName(n)
    return out.select("run", "status", "matches", "fresh")


_EVENTS = f"e AS (SELECT *, {Q._CODE} AS code FROM events)"


def _requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    code = F.get(F.array(*[F.lit(c) for c in (200, 401, 403, 429, 500)]), (F.col("event_id") % 5).cast("int"))
    host = F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string"), F.lit(".Example"))
    return rows.withColumns({"status_code": code, "host": host, "method": F.col("event_type"), "types": F.col("props"), "url": F.concat(F.lit("/Path/"), F.col("event_id").cast("string")), "secrets": (F.col("event_id") % 3).cast("int")})


@query(f"WITH {_EVENTS} SELECT event_id FROM e WHERE user_id % 7 = 3 AND event_type = 'click' AND code // 100 = 4 AND event_id % 3 > 0 AND contains(lower(props), 'k') AND contains('/path/' || event_id, 'th/1')")
def grid_rows(spark, sf_dir):
    """Requests that meet all conditions of a grid; host, method, type and URL in any case."""
    return findings.grid(_requests(spark, sf_dir), host="H3.EXAMPLE", method="CLICK", status_class=4, with_secrets=True, kind="K", url="TH/1").select("event_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def grid_newest(spark, sf_dir):
    """What a grid of 500 rows keeps: the newest."""
    return findings.newest(table(spark, sf_dir, "events"), 500, ["ts", "event_id"]).select("event_id", "user_id")


_SHOWN = "CASE WHEN code = 200 THEN 'valid' WHEN code IN (401, 403) THEN 'invalid' WHEN code = 429 THEN 'undetermined' END"


@query(
    f"WITH {_EVENTS}, s AS (SELECT event_type, {_SHOWN} AS status, event_id % 11 = 0 AS fp FROM e)"
    " SELECT event_type, count(*) AS n, CAST(count_if(status = 'valid' AND NOT fp) AS BIGINT) AS valid, CAST(count_if(status = 'invalid' AND NOT fp) AS BIGINT) AS invalid, CAST(count_if(status = 'undetermined' AND NOT fp) AS BIGINT) AS undetermined, CAST(count_if(status IS NULL AND NOT fp) AS BIGINT) AS unchecked, CAST(count_if(fp) AS BIGINT) AS false_positives FROM s GROUP BY event_type"
)
def status_counts(spark, sf_dir):
    """Requests by type with how many are valid, invalid, undetermined, unchecked and false positives."""
    code = F.col("status_code")
    status = F.when(code == 200, "valid").when(code.isin(401, 403), "invalid").when(code == 429, "undetermined")
    rows = _requests(spark, sf_dir).withColumns({"status": status, "false_positive": F.col("event_id") % 11 == 0})
    return findings.status_breakdown(rows, "event_type")


@query(
    "WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS old FROM events WHERE event_id % 2 = 0 GROUP BY user_id), w AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS new FROM events WHERE event_id % 2 = 1 GROUP BY user_id)"
    " SELECT CAST(coalesce(o.user_id, w.user_id) AS VARCHAR) AS target_id, CASE WHEN new IS NULL THEN old WHEN new = old THEN '' ELSE new END AS status FROM o FULL JOIN w ON o.user_id = w.user_id"
)
def toggled_annotations(spark, sf_dir):
    """Annotations after changes: a status that is set again is cleared."""
    rows = table(spark, sf_dir, "events").select(F.lit("user").alias("target_type"), F.col("user_id").cast("string").alias("target_id"), F.col("event_type").alias("status"), F.lit("").alias("comment"), F.struct("ts", "event_id").alias("updated_at"), "event_id")
    of = lambda odd: findings.latest(rows.filter(F.col("event_id") % 2 == odd).drop("event_id"), ["target_type", "target_id"], "updated_at")
    return findings.toggled(of(0), of(1)).select("target_id", "status")


# --- sources, pages and requests ---


@query("SELECT doc_id, doc_id % 3 = 0 AND strlen(coalesce(text, '')) < 8192 AS binary FROM documents")
def binary_contents(spark, sf_dir):
    """Which contents are binary; every third document has a zero byte at its end."""
    rows = table(spark, sf_dir, "documents")
    content = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.expr("X'00'")).otherwise(F.expr("X''")))
    return rows.select("doc_id", B.is_binary(content).alias("binary"))


_PATHS = (".py", ".min.js", "/Cargo.lock", "/node_modules/aws-sdk/dist/a.js", "/xgo.sum", "/go.sum", "/openssl-3/test/recipes/30/evppkey_a.txt")


@query(f"WITH p AS (SELECT doc_id, 'repo/' || source || '/' || doc_id || [{', '.join(map(_quoted, _PATHS))}][doc_id % {len(_PATHS)} + 1] AS path FROM documents) SELECT doc_id, path, doc_id % {len(_PATHS)} IN (1, 2, 3, 5, 6) AS ignored FROM p")
def ignored_paths(spark, sf_dir):
    """Which paths are not scanned by default."""
    tail = F.get(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % len(_PATHS)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("repo/"), "source", F.lit("/"), F.col("doc_id").cast("string"), tail).alias("path"))
    return rows.withColumn("ignored", F.col("path").rlike(B.ignore_pattern(B.IGNORED)))


_ENDS = ("", ".git", "/", ".git/", "/tree/main")


@query(
    f"WITH p AS (SELECT doc_id, ['https://github.com/', 'gitlab.com/', 'https://example.com/'][doc_id % 3 + 1] || source || '/r' || doc_id || [{', '.join(map(_quoted, _ENDS))}][doc_id % 5 + 1] AS url FROM documents)"
    " SELECT doc_id, url, CASE WHEN doc_id % 3 < 2 AND doc_id % 5 < 4 THEN split_part(url, '/', CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 2 END) || '/r' || doc_id END AS repository FROM p"
)
def repository_names(spark, sf_dir):
    """Owner and name of repositories, by their URLs."""
    n = F.col("doc_id")
    head = F.get(F.array(*map(F.lit, ("https://github.com/", "gitlab.com/", "https://example.com/"))), (n % 3).cast("int"))
    url = F.concat(head, "source", F.lit("/r"), n.cast("string"), F.get(F.array(*map(F.lit, _ENDS)), (n % 5).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", url.alias("url")).withColumn("repository", B.repository_of(F.col("url")))


@query("SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain_sha256, CASE WHEN page_id % 2 = 0 THEN 'file:///pages/' || page_id ELSE 'pages/' || page_id END AS uri, page_id || '-' || length(html) || '-' || page_id || ' {{c}}' AS filled FROM pages")
def page_texts(spark, sf_dir):
    """Pages without tags, their file URIs, and a filled template."""
    path = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("/")).otherwise(""), F.lit("pages/"), F.col("page_id").cast("string"))
    values = {"a": F.col("page_id").cast("string"), "b": F.length("html").cast("string")}
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.without_tags(F.col("html")), 256).alias("plain_sha256"), T.file_uri(path).alias("uri"), T.substitute(F.lit("{{a}}-{{ b }}-{{.a}} {{c}}"), values).alias("filled"))


@query(
    "WITH s AS (SELECT page_id, 'script' AS kind, regexp_extract_all(html, '<script>((?:.|\\n)*?)</script>', 1) AS xs FROM pages UNION ALL SELECT page_id, 'style', regexp_extract_all(html, '<style>((?:.|\\n)*?)</style>', 1) FROM pages),"
    " i AS (SELECT page_id, kind, xs, unnest(range(0, len(xs))) AS k FROM s)"
    " SELECT page_id, kind || ':inline:' || k AS source, sha256(trim(xs[k + 1])) AS sha256 FROM i UNION ALL SELECT page_id, 'html:full', sha256(html) FROM pages"
)
def page_item_digests(spark, sf_dir):
    """Each inline script, inline style and whole of the pages."""
    return items_of(table(spark, sf_dir, "pages")).select("page_id", "source", F.sha2("content", 256).alias("sha256"))


@query(
    "WITH RECURSIVE pg AS (SELECT page_id, coalesce(html, '') AS text FROM pages), raw AS (" + Q._raw_sql("pg", PACK, "page_id") + "), m AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY page_id, rule_id, groups ORDER BY s) = 1)"
    " SELECT rule_id, count(*) AS findings, count(DISTINCT url) AS urls FROM m JOIN pages USING (page_id) GROUP BY rule_id"
)
def site_statistics(spark, sf_dir):
    """Matches in web pages and the URLs that hold them, by rule."""
    pages = table(spark, sf_dir, "pages")
    found = scan(pages.select(F.col("page_id").cast("string").alias("blob_id"), F.col("html").alias("content")), PACK)
    placed = found.join(pages.select(F.col("page_id").cast("string").alias("blob_id"), "url"), "blob_id")
    return placed.groupBy("rule_id").agg(F.count("*").alias("findings"), F.countDistinct("url").alias("urls"))


_KINDS = ("scan", "scan_batch", "validate", "what")


def _lines(spark, sf_dir):
    """Conversation turns as NDJSON requests of four types."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("turn") % 4).cast("int"))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    item = F.struct(F.concat(name, F.lit("/text")).alias("source"), F.col("text").alias("content"))
    other = F.struct(F.concat(name, F.lit("/role")).alias("source"), F.col("role").alias("content"))
    payload = F.struct(F.col("text").alias("content"), name.alias("source"), F.array(item, other).alias("items"))
    line = F.to_json(F.struct(kind.alias("type"), name.alias("id"), payload.alias("payload")))
    return table(spark, sf_dir, "conversations").select(F.from_json(line, stream.REQUEST).alias("r")).select("r.*")


@query(
    "WITH c AS (SELECT *, 'c' || conv_id || '/' || turn AS name FROM conversations) SELECT name AS source, sha256(text) AS sha256 FROM c WHERE turn % 4 = 0 AND text IS NOT NULL"
    " UNION ALL SELECT name || '/text', sha256(text) FROM c WHERE turn % 4 = 1 AND text IS NOT NULL UNION ALL SELECT name || '/role', sha256(role) FROM c WHERE turn % 4 = 1 AND role IS NOT NULL"
)
def request_items(spark, sf_dir):
    """What requests ask to scan: one content, or a batch of them."""
    return stream.items(_lines(spark, sf_dir)).select("source", F.sha2("content", 256).alias("sha256"))


@query("SELECT 'c' || conv_id || '/' || turn AS id, 'unknown request type: what' AS error FROM conversations WHERE turn % 4 = 3")
def request_errors(spark, sf_dir):
    """The answers to requests of unknown type."""
    return stream.errors(_lines(spark, sf_dir))


#: Containers that documents are put into, by their id, with the name of the member that has the text.
_CONTAINERS = ("a.zip", "a.tar.gz", "a.ipynb", "a.eml", "a.sqlite", "a.docx", "a.xlsx", "a.pptx", "a.odt", "b.tar", "a.rtf", "a.jar")
_INSIDE = ("t.txt", "t.txt", "cell_0_code", "email", "tables", "word/document.xml", "xl/sharedStrings.xml", "ppt/slides/slide1.xml", "content.xml", "in.zip:t.txt", "content", "t.txt")


def _zipped(name: str, content: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, content)
    return out.getvalue()


def _tarred(name: str, content: bytes, mode: str) -> bytes:
    out, info = io.BytesIO(), tarfile.TarInfo(name)
    info.size = len(content)
    with tarfile.open(fileobj=out, mode=mode) as t:
        t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def _contained(kind: str, text: bytes) -> bytes:
    """A file of that name which holds the text, or the text's digest where a format keeps no white space."""
    digest = hashlib.md5(text).hexdigest()
    xml = f"<d><p>{digest[:16]}</p> <p>{digest[16:]}</p></d>".encode()
    name = _INSIDE[_CONTAINERS.index(kind)]
    if kind in ("a.zip", "a.jar"):
        return _zipped(name, text)
    if kind == "b.tar":
        return _tarred("in.zip", _zipped("t.txt", text) + b"\x00", "w")
    if kind == "a.tar.gz":
        return _tarred(name, text, "w:gz")
    if kind == "a.ipynb":
        return json.dumps({"cells": [{"cell_type": "code", "source": [text.decode(), "\n#"]}]}).encode()
    if kind == "a.eml":
        return text
    if kind == "a.rtf":
        return b"{\\rtf1 " + digest.encode() + b"}"
    if kind == "a.sqlite":
        with tempfile.NamedTemporaryFile(suffix=".db") as f:
            db = sqlite3.connect(f.name)
            # A file of this task alone needs no journal and no wait for the disk, which all tasks of a machine would share.
            db.execute("PRAGMA journal_mode = OFF")
            db.execute("PRAGMA synchronous = OFF")
            db.execute("CREATE TABLE t (i INTEGER, x TEXT)")
            db.execute("INSERT INTO t VALUES (1, ?)", (digest,))
            db.commit()
            db.close()
            return open(f.name, "rb").read()
    return _zipped(name, xml)


def _contained_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kind = _CONTAINERS[doc_id % len(_CONTAINERS)]
            rows += [(doc_id, n, hashlib.sha256(c).hexdigest()) for n, c in members(kind, _contained(kind, (text or "").encode()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "member", "sha256"])


_DIGEST = "md5(t)"


@query(
    f"WITH x AS (SELECT doc_id, doc_id % {len(_CONTAINERS)} AS k, coalesce(text, '') AS t FROM documents)"
    f" SELECT doc_id, [{', '.join(map(_quoted, _INSIDE))}][k + 1] AS member, sha256(CASE WHEN k = 2 THEN t || chr(10) || '#' WHEN k = 4 THEN {_DIGEST} || chr(10) WHEN k IN (5, 6, 7, 8) THEN left({_DIGEST}, 16) || ' ' || right({_DIGEST}, 16) WHEN k = 10 THEN {_DIGEST} ELSE t END) AS sha256 FROM x"
)
def extracted_members(spark, sf_dir):
    """Documents in archives, office files, notebooks, mails and databases, and what is found in these."""
    ship_package(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_contained_batches, "doc_id long, member string, sha256 string")
