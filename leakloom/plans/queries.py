"""The registered queries over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions import text as T
from leakloom.functions.ids import blob_id
from leakloom.operators import filters, findings, validation
from leakloom.operators.match import scan
from leakloom.plans import report, rules as R
from leakloom.sources import blobs as B
from leakloom.sources.pages import items_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PACK = R.TEXT_PACK
CATEGORIES = {r.id: list(r.categories) for r in PACK}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL building blocks: the same steps as the operators, over the views of the tables ---


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLOBS_SQL = """
t0 AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT sha1('blob ' || strlen(t) || chr(0) || t) AS blob_id, t AS text, CAST(strlen(t) AS BIGINT) AS size, source || '/' || doc_id AS path, doc_id AS seq FROM t0),
d AS (SELECT blob_id, min(seq) AS seq, arg_min(path, seq) AS path, any_value(text) AS text, any_value(size) AS size FROM b GROUP BY blob_id)"""


def _raw_sql(source: str, pack=PACK, key: str = "blob_id") -> str:
    """Matches (key, rule_id, place, name, sid, plen, text, s, e: bytes, cs: characters before, matching, groups, secret) of a pack in a table with text."""
    parts = []
    for place, r in enumerate(pack):
        p, c = _quoted(r.pattern), R.compiled(r.pattern)
        groups = ", ".join(f"regexp_extract_all(text, {p}, {g})[i]" for g in range(1, c.groups + 1))
        names = sorted(c.groupindex, key=c.groupindex.get)
        at = c.groupindex.get("token") or (c.groupindex[names[0]] if names else (2 if c.groups > 1 else 1))
        parts.append(
            f"SELECT {key}, '{r.id}' AS rule_id, {place} AS place, {_quoted(r.name)} AS name, '{r.structural_id}' AS sid, {len(r.pattern)} AS plen, text,"
            f" coalesce(list_sum(list_transform(pieces[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: strlen(x))), 0) AS s,"
            f" coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS cs,"
            f" strlen(ms[i]) AS w, ms[i] AS matching, [{groups}] AS groups, regexp_extract_all(text, {p}, {at})[i] AS secret"
            f" FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {key}, text, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS pieces FROM {source} WHERE regexp_matches(text, {p})))"
        )
    union = " UNION ALL ".join(parts)
    return f"SELECT {key}, rule_id, place, name, sid, plen, text, CAST(s AS BIGINT) AS s, CAST(s + w AS BIGINT) AS e, CAST(cs AS BIGINT) AS cs, matching, groups, secret FROM ({union})"


_MATCHES_SQL = f"{_BLOBS_SQL}, raw AS ({_raw_sql('d')}), m AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY blob_id, rule_id, groups ORDER BY s) = 1)"
_ENTROPY = "list_entropy(string_split(secret, ''))"
_PASS_SQL = f"""
p AS (SELECT * FROM m WHERE CASE
  WHEN rule_id = 'lk.token.1' THEN {_ENTROPY} > 3.0 AND length(regexp_replace(secret, '[^0-9]', '', 'g')) >= 2
  WHEN rule_id = 'lk.hex.1' THEN {_ENTROPY} > 3.0
  WHEN rule_id = 'lk.card.1' THEN {_ENTROPY} > 2.0 AND NOT contains(secret, '0000') ELSE true END)"""
_FINDING = """sha1(sid || chr(0) || '[' || array_to_string(list_transform(groups, lambda g: '"' || to_base64(encode(g)) || '"'), ',') || ']')"""
_IDS_SQL = f"{_MATCHES_SQL}, {_PASS_SQL}, f AS (SELECT *, sha1(encode(sid) || '\\x00'::BLOB || unhex(blob_id) || '\\x00'::BLOB || encode(CAST(s AS VARCHAR)) || '\\x00'::BLOB || encode(CAST(e AS VARCHAR))) AS match_id, {_FINDING} AS finding_id FROM p)"
_RULES_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', {_quoted(r.name)}, [{', '.join(map(_quoted, r.categories))}])" for r in PACK) + ") v(rule_id, rule_name, categories))"


# --- sources ---


def document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def document_matches(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Matches in distinct documents. Equal blobs have equal matches, so those meet instead of the texts."""
    return scan(document_blobs(spark, sf_dir), PACK, **how).dropDuplicates(["blob_id", "rule_id", "start", "end"])


def passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.identified(filters.postfilter(document_matches(spark, sf_dir), R.frame(spark, PACK)))


@query(f"WITH {_BLOBS_SQL} SELECT seq AS doc_id, blob_id, size FROM b")
def blob_ids(spark, sf_dir):
    """Git blob ids and sizes of the documents."""
    return document_blobs(spark, sf_dir).select(F.col("seq").alias("doc_id"), "blob_id", "size")


@query(f"WITH {_BLOBS_SQL} SELECT blob_id, seq, path, size FROM d")
def blobs_distinct(spark, sf_dir):
    """The first document of each blob."""
    return B.distinct(document_blobs(spark, sf_dir)).select("blob_id", "seq", "path", "size")


@query(
    f"WITH {_BLOBS_SQL}, c AS (SELECT sha1('blob ' || strlen(t) || chr(0) || t) AS blob_id, 'conversation/' || conv_id || '/' || turn AS path, conv_id * 100000 + turn AS seq FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)),"
    " u AS (SELECT 0 AS place, blob_id, path, seq FROM b UNION ALL SELECT 1, blob_id, path, seq FROM c)"
    " SELECT place, count(*) AS blobs, min(path) AS least_path, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY blob_id ORDER BY place, seq) = 1) GROUP BY place"
)
def combined_sources(spark, sf_dir):
    """Documents, then conversation turns; of equal blobs the first source's stays."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("seq"), F.concat_ws("/", F.lit("conversation"), "conv_id", "turn").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("c"))
    turns = turns.select(blob_id(F.col("c")).alias("blob_id"), "path", "seq")
    kept = findings.combined([document_blobs(spark, sf_dir).select("blob_id", "path", "seq"), turns])
    return kept.groupBy(F.col("source_place").alias("place")).agg(F.count("*").alias("blobs"), F.min("path").alias("least_path"), F.sum("seq").alias("seqs"))


@query(f"WITH {_BLOBS_SQL}, old AS (SELECT DISTINCT blob_id FROM b WHERE seq % 2 = 0) SELECT blob_id, seq FROM d WHERE blob_id NOT IN (SELECT blob_id FROM old)")
def incremental_blobs(spark, sf_dir):
    """Blobs of odd documents that no even document, the stored ones, has."""
    rows = document_blobs(spark, sf_dir)
    stored = rows.filter(F.col("seq") % 2 == 0)
    return findings.not_stored(B.distinct(rows), stored).select("blob_id", "seq")


# --- matching ---


@query(f"WITH {_MATCHES_SQL} SELECT blob_id, rule_id, s AS start, e AS \"end\", matching, array_to_string(groups, '|') AS groups, 1 + length(t) - length(replace(t, chr(10), '')) AS start_line FROM (SELECT *, left(text, cs) AS t FROM m)")
def matches_first_places(spark, sf_dir):
    """The first place of each match's groups in its blob: byte range, groups and line."""
    return document_matches(spark, sf_dir).select("blob_id", "rule_id", "start", "end", "matching", F.array_join("groups", "|").alias("groups"), "start_line")


@query(f"WITH {_MATCHES_SQL} SELECT blob_id, rule_id, s AS start, e AS \"end\", matching, array_to_string(groups, '|') AS groups FROM m")
def matches_by_content(spark, sf_dir):
    """All matches, one for each rule and groups in a blob."""
    return document_matches(spark, sf_dir).select("blob_id", "rule_id", "start", "end", "matching", F.array_join("groups", "|").alias("groups"))


@query(f"WITH {_BLOBS_SQL}, raw AS ({_raw_sql('d')}) SELECT rule_id, count(*) AS located, count(DISTINCT (blob_id, groups)) AS distinct_groups FROM raw GROUP BY rule_id")
def dedup_modes(spark, sf_dir):
    """Matches by rule, by location and by content."""
    at = document_matches(spark, sf_dir, dedupe="location")
    once = findings.dedupe(at, "content").groupBy("rule_id").agg(F.count("*").alias("distinct_groups"))
    return at.groupBy("rule_id").agg(F.count("*").alias("located")).join(once, "rule_id")


@query(f"WITH {_MATCHES_SQL}, {_PASS_SQL} SELECT blob_id, rule_id, secret, round({_ENTROPY}, 6) AS entropy FROM p WHERE secret <> ''")
def postfiltered(spark, sf_dir):
    """Matches that pass entropy and requirements, with their secret."""
    return passed(spark, sf_dir).select("blob_id", "rule_id", "secret", F.round(T.shannon_entropy(F.col("secret")), 6).alias("entropy"))


@query(f"WITH {_IDS_SQL} SELECT match_id, finding_id, rule_id FROM f")
def match_identities(spark, sf_dir):
    """Structural ids of matches and findings."""
    return passed(spark, sf_dir).select("match_id", "finding_id", "rule_id")


@query(
    f"WITH RECURSIVE {_MATCHES_SQL}, {_PASS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY s, e, place) AS k FROM p),"
    " v AS (SELECT blob_id, k, unnest(groups) AS x FROM n), ed AS (SELECT DISTINCT a.blob_id, a.k AS a, b.k AS b FROM v a JOIN v b ON a.blob_id = b.blob_id AND a.x = b.x AND a.x <> ''),"
    " reach AS (SELECT blob_id, a, b FROM ed UNION SELECT r.blob_id, r.a, ed.b FROM reach r JOIN ed ON ed.blob_id = r.blob_id AND ed.a = r.b),"
    " cl AS (SELECT blob_id, a AS k, min(b) AS c FROM reach GROUP BY blob_id, a)"
    " SELECT blob_id, rule_id, s AS start, secret FROM n JOIN cl USING (blob_id, k) QUALIFY row_number() OVER (PARTITION BY blob_id, c ORDER BY len(groups) DESC, list_sum(list_transform(groups, lambda g: strlen(g))) DESC, plen DESC, s, e, place) = 1"
)
def cross_rule_winners(spark, sf_dir):
    """Of matches of several rules that share a value the one to report."""
    return findings.winners(passed(spark, sf_dir), R.frame(spark, PACK)).select("blob_id", "rule_id", "start", "secret")


@query(f"WITH {_BLOBS_SQL} SELECT rule_id, count(*) AS candidates FROM ({' UNION ALL '.join(f'SELECT {_quoted(r.id)} AS rule_id FROM d WHERE ' + (' OR '.join(f'contains(text, {_quoted(k)})' for k in r.keywords) or 'true') for r in PACK)}) GROUP BY rule_id")
def keyword_candidates(spark, sf_dir):
    """Blobs by rule that the keyword prefilter leaves."""
    left = filters.candidates(document_blobs(spark, sf_dir), R.frame(spark, PACK)).distinct()
    return left.groupBy("rule_id").agg(F.count("*").alias("candidates"))


_CHOSEN = R.chosen(PACK, include=R.patterns_of(r"token, hex, ipv4"), exclude=[r"hex"])


@query(f"WITH {_BLOBS_SQL}, raw AS ({_raw_sql('d', _CHOSEN)}) SELECT rule_id, count(DISTINCT blob_id) AS blobs FROM raw GROUP BY rule_id")
def chosen_rules(spark, sf_dir):
    """Blobs with matches of the rules that include and exclude patterns leave."""
    return scan(document_blobs(spark, sf_dir), _CHOSEN).groupBy("rule_id").agg(F.countDistinct("blob_id").alias("blobs"))


def _planted(spark, sf_dir):
    rows, n = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), len(R.CREDENTIAL_PACK)
    extra = F.array(*[F.lit(r.examples[0]) for r in R.CREDENTIAL_PACK])
    return rows.withColumn("text", F.concat("text", F.lit("\n"), F.get(extra, (F.col("doc_id") % n).cast("int")), F.lit("\n")))


_PLANTED_SQL = f"pl AS (SELECT doc_id, coalesce(text, '') || chr(10) || [{', '.join(_quoted(r.examples[0]).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) for r in R.CREDENTIAL_PACK)}][doc_id % {len(R.CREDENTIAL_PACK)} + 1] || chr(10) AS text FROM documents)"


@query(f"WITH {_PLANTED_SQL}, raw AS ({_raw_sql('pl', R.CREDENTIAL_PACK, 'doc_id')}) SELECT rule_id, count(*) AS matches, count(DISTINCT doc_id) AS documents, CAST(sum(s) AS BIGINT) AS starts FROM raw GROUP BY rule_id")
def planted_credentials(spark, sf_dir):
    """Credentials of known formats, planted at the end of every document by its id."""
    rows = _planted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("blob_id"), F.col("text").alias("content"))
    found = scan(rows, R.CREDENTIAL_PACK, dedupe="location")
    return found.groupBy("rule_id").agg(F.count("*").alias("matches"), F.countDistinct("blob_id").alias("documents"), F.sum("start").alias("starts"))


_TURNS_SQL = "t AS (SELECT conv_id, coalesce(text, '') || chr(10) || [" + ", ".join(_quoted(r.examples[0]).replace(chr(10), "' || chr(10) || '") for r in R.CREDENTIAL_PACK) + f"][turn % {len(R.CREDENTIAL_PACK)} + 1] AS text FROM conversations)"


@query(f"WITH {_TURNS_SQL}, raw AS ({_raw_sql('t', R.CREDENTIAL_PACK, 'conv_id')}) SELECT conv_id, count(*) AS total, count(DISTINCT rule_id) AS rules FROM raw GROUP BY conv_id")
def planted_conversations(spark, sf_dir):
    """Each conversation as a batch of items, with a credential planted in each turn: its matches in all."""
    examples = F.array(*[F.lit(r.examples[0]) for r in R.CREDENTIAL_PACK])
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.get(examples, (F.col("turn") % len(R.CREDENTIAL_PACK)).cast("int")))
    found = scan(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("blob_id"), content.alias("content")), R.CREDENTIAL_PACK, dedupe="location")
    return found.groupBy(F.col("blob_id").cast("long").alias("conv_id")).agg(F.count("*").alias("total"), F.countDistinct("rule_id").alias("rules"))


# --- findings ---


@query(f"WITH {_IDS_SQL} SELECT finding_id, rule_id, count(*) AS matches FROM f GROUP BY finding_id, rule_id")
def finding_list(spark, sf_dir):
    """Findings and their matches."""
    return findings.findings(passed(spark, sf_dir)).select("finding_id", "rule_id", "matches")


@query(f"WITH {_IDS_SQL}, g AS (SELECT finding_id, rule_id, any_value(name) AS rule_name, count(*) AS n FROM f GROUP BY finding_id, rule_id) SELECT rule_id, any_value(rule_name) AS rule_name, count(*) AS findings, CAST(sum(n) AS BIGINT) AS matches FROM g GROUP BY rule_id")
def summary_by_rule(spark, sf_dir):
    """Findings and matches by rule."""
    return findings.summary(findings.findings(passed(spark, sf_dir)), R.frame(spark, PACK))


@query(f"WITH {_IDS_SQL} SELECT f.finding_id, match_id, seq FROM f JOIN d USING (blob_id)")
def finding_matches(spark, sf_dir):
    """Findings with their matches and the first document of each."""
    rows = passed(spark, sf_dir)
    joined = findings.with_matches(findings.findings(rows), rows)
    return joined.join(B.distinct(document_blobs(spark, sf_dir)).select("blob_id", "seq"), "blob_id").select("finding_id", "match_id", "seq")


@query(f"WITH {_IDS_SQL} SELECT finding_id, match_id, row_number() OVER w AS number, count(*) OVER (PARTITION BY finding_id) AS \"of\" FROM f WINDOW w AS (PARTITION BY finding_id ORDER BY blob_id, s, e) QUALIFY row_number() OVER w <= 3")
def top_matches(spark, sf_dir):
    """The first three matches of each finding."""
    return findings.top_matches(passed(spark, sf_dir)).select("finding_id", "match_id", "number", "of")


@query(f"WITH {_IDS_SQL}, pr AS (SELECT blob_id, list_sort(list(DISTINCT path)) AS paths FROM b GROUP BY blob_id) SELECT match_id, array_to_string(paths, ',') AS paths FROM f JOIN pr USING (blob_id)")
def match_places(spark, sf_dir):
    """All places of each match's blob."""
    out = findings.with_provenance(passed(spark, sf_dir), document_blobs(spark, sf_dir), first=False)
    return out.select("match_id", F.array_join("path", ",").alias("paths"))


@query(f"WITH {_IDS_SQL} SELECT match_id, path FROM f JOIN d USING (blob_id)")
def match_first_place(spark, sf_dir):
    """The first place of each match's blob."""
    return findings.with_provenance(passed(spark, sf_dir), document_blobs(spark, sf_dir)).select("match_id", "path")


_FACET_ROWS = f"{_IDS_SQL}, {_RULES_SQL}, fr AS (SELECT f.match_id, r.rule_name, r.categories, split_part(d.path, '/', 1) AS source FROM f JOIN r USING (rule_id) JOIN d USING (blob_id))"


def _facet_rows(spark, sf_dir):
    out = findings.with_provenance(passed(spark, sf_dir), document_blobs(spark, sf_dir))
    return out.select("match_id", "rule_name", "categories", F.substring_index("path", "/", 1).alias("source"))


def _facet_sql(rows: str) -> str:
    return f"SELECT 'rule_name' AS facet, rule_name AS value, count(*) AS n FROM {rows} GROUP BY rule_name UNION ALL SELECT 'source', source, count(*) FROM {rows} GROUP BY source UNION ALL SELECT 'categories', c, count(*) FROM (SELECT unnest(categories) AS c FROM {rows}) GROUP BY c"


@query(f"WITH {_FACET_ROWS} {_facet_sql('fr')}")
def facet_counts(spark, sf_dir):
    """Matches by rule, source and category."""
    return findings.facets(_facet_rows(spark, sf_dir), ["rule_name", "source"], ["categories"])


@query(f"WITH {_FACET_ROWS}, k AS (SELECT * FROM fr WHERE list_has_any(categories, ['secret', 'payment']) AND source IN ('src1', 'src2', 'src3', 'src4')), a AS ({_facet_sql('fr')}), z AS ({_facet_sql('k')}) SELECT a.facet, a.value, coalesce(z.n, 0) AS n FROM a LEFT JOIN z ON a.facet = z.facet AND a.value = z.value")
def facet_recounts(spark, sf_dir):
    """The same under a choice of categories and sources; values that drop out show 0."""
    return findings.facet_recount(_facet_rows(spark, sf_dir), {"categories": ["secret", "payment"], "source": ["src1", "src2", "src3", "src4"]}, ["rule_name", "source"], ["categories"])


@query(
    f"WITH {_IDS_SQL}, h AS (SELECT f.rule_id, f.secret, 'http://' || b.path || '?x=1' AS url, b.seq FROM f JOIN b USING (blob_id))"
    " SELECT rule_id, sha256(rule_id || ':' || secret) AS key, array_to_string(list_sort(list(DISTINCT split_part(url, '?', 1))), ',') AS urls, array_to_string(list_sort(list(DISTINCT split_part(url, '/', 3))), ',') AS hosts, count(*) AS occurrences, min(seq) AS first_seen FROM h GROUP BY rule_id, secret"
)
def secret_rollup(spark, sf_dir):
    """Each secret over all documents that hold it."""
    places = document_blobs(spark, sf_dir).select("blob_id", "path", "seq")
    hits = passed(spark, sf_dir).join(places, "blob_id").select("rule_id", "secret", F.concat(F.lit("http://"), "path", F.lit("?x=1")).alias("url"), F.col("seq").alias("seen_at"))
    out = findings.rolled_up(hits)
    return out.select("rule_id", "key", F.array_join("urls", ",").alias("urls"), F.array_join("hosts", ",").alias("hosts"), "occurrences", "first_seen")


_LEVELS = "CASE WHEN x IN ({}) THEN 'HIGH' WHEN x IN ({}) THEN 'MEDIUM' WHEN x IN ('generic') THEN 'LOW' ELSE 'MEDIUM' END".format(*(", ".join(map(_quoted, T.SEVERITIES[k])) for k in ("HIGH", "MEDIUM")))


@query(f"WITH {_IDS_SQL} SELECT match_id, {_LEVELS} AS severity, CASE WHEN length(secret) >= 12 THEN left(secret, 4) || '...' || right(secret, 4) ELSE secret END AS masked, CASE WHEN length(secret) <= 20 THEN secret ELSE left(secret, 20) || '...' END AS preview FROM (SELECT *, split_part(rule_id, '.', 2) AS x FROM f)")
def masked_secrets(spark, sf_dir):
    """Severity, mask and preview of each match's secret."""
    secret = F.col("secret")
    return passed(spark, sf_dir).select("match_id", T.severity(F.col("rule_id")).alias("severity"), T.mask(secret).alias("masked"), T.preview(secret).alias("preview"))


@query(
    f"WITH {_MATCHES_SQL}, q AS (SELECT blob_id, rule_id, s, matching, left(text, cs) AS b0, text FROM m), c AS (SELECT *, right(b0, 100) AS bf, substr(text, length(b0) + length(matching) + 1, 100) AS af FROM q),"
    " z AS (SELECT *, length(bf) AS a, length(matching) AS w, length(bf || matching || af) AS n, bf || matching || af AS x FROM c), y AS (SELECT *, (80 - w - 6) // 2 AS h FROM z), u AS (SELECT *, a - h AS l0, a + w + h AS h0 FROM y),"
    " v AS (SELECT *, greatest(l0, 0) AS l1, CASE WHEN l0 < 0 THEN h0 - l0 ELSE h0 END AS h1 FROM u), k AS (SELECT *, CASE WHEN h1 > n THEN greatest(l1 - (h1 - n), 0) ELSE l1 END AS lo, least(h1, n) AS hi FROM v)"
    " SELECT blob_id, rule_id, s AS start, CASE WHEN n <= 80 THEN x WHEN w >= 80 THEN '...' || left(matching, 74) || '...' ELSE CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(x, lo + 1, hi - lo) || CASE WHEN hi < n THEN '...' ELSE '' END END AS snippet FROM k"
)
def snippets(spark, sf_dir):
    """The window of 80 characters around each match, cut from 100 characters on either side."""
    found = document_matches(spark, sf_dir).select("blob_id", "rule_id", "start", "end", "matching")
    found = found.join(B.distinct(document_blobs(spark, sf_dir)).select("blob_id", F.col("content").cast("binary").alias("content")), "blob_id")
    # Bytes that hold 100 characters and some; a character that is cut stands beyond these.
    part = lambda start, n: F.substring(F.col("content"), (start + 1).cast("int"), n.cast("int")).cast("string")
    low = F.greatest(F.col("start") - 404, F.lit(0))
    before, after = F.expr("right(held, 100)"), F.left(part(F.col("end"), F.lit(404)), F.lit(100))
    found = found.withColumn("held", part(low, F.col("start") - low))
    return found.select("blob_id", "rule_id", "start", T.snippet_window(before, F.col("matching"), after, 80).alias("snippet"))


@query(f"WITH {_IDS_SQL}, an AS (SELECT user_id % 64 AS k, arg_max(event_type, (ts, event_id)) AS annotation FROM events GROUP BY user_id % 64), ff AS (SELECT DISTINCT finding_id FROM f) SELECT finding_id, annotation FROM ff LEFT JOIN an ON an.k = CAST('0x' || left(finding_id, 4) AS BIGINT) % 64")
def annotated_findings(spark, sf_dir):
    """Findings with the latest annotation of their bucket, for which the events of some users stand."""
    bucket = F.conv(F.substring("finding_id", 1, 4), 16, 10).cast("long") % 64
    found = findings.findings(passed(spark, sf_dir)).select("finding_id", bucket.cast("string").alias("bucket"))
    notes = table(spark, sf_dir, "events").select(F.lit("bucket").alias("target_type"), (F.col("user_id") % 64).cast("string").alias("target_id"), F.col("event_type").alias("status"), F.lit("").alias("comment"), F.struct("ts", "event_id").alias("updated_at"))
    return findings.annotated(found, notes, "bucket", "bucket").select("finding_id", "annotation")


@query(f"WITH {_IDS_SQL} SELECT count(*) AS matches, count(DISTINCT finding_id) AS findings, (SELECT count(*) FROM d) AS blobs, (SELECT CAST(sum(size) AS BIGINT) FROM d) AS bytes FROM f")
def scan_stats(spark, sf_dir):
    """What a scan has seen and found."""
    of = B.distinct(document_blobs(spark, sf_dir)).agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))
    return passed(spark, sf_dir).agg(F.count("*").alias("matches"), F.countDistinct("finding_id").alias("findings")).join(of, F.lit(True))


# Line and byte column, from 1, of a place with the text t before it.
_PLACE_SQL = "CAST(1 + length({t}) - length(replace({t}, chr(10), '')) AS BIGINT) AS {n}_line, CAST(strlen(string_split({t}, chr(10))[-1]) + 1 AS BIGINT) AS {n}_column"
_PLACES_SQL = f"SELECT *, {_PLACE_SQL.format(t='left(text, cs)', n='start')}, {_PLACE_SQL.format(t='left(text, cs + length(matching))', n='end')} FROM "
# The rest of a match's lines and three more on either side.
_AFTER = "CASE WHEN substr(text, cs + length(matching) + 1, 1) = chr(10) THEN substr(text, cs + length(matching) + 2) ELSE substr(text, cs + length(matching) + 1) END"
_AROUND_SQL = (
    "SELECT * EXCLUDE (l, r, rs), array_to_string(list_slice(l, greatest(len(l) - 3, 1), len(l)), chr(10)) AS before, CASE WHEN len(rs) > 3 THEN array_to_string(rs[1:3], chr(10)) || chr(10) ELSE r END AS after"
    f" FROM (SELECT *, string_split(r, chr(10)) AS rs FROM (SELECT *, string_split(left(text, cs), chr(10)) AS l, {_AFTER} AS r FROM {{rows}}))"
)


def _json_sql(pairs: str) -> str:
    return f"CAST(to_json({{{pairs}}}) AS VARCHAR)"


_SARIF = _json_sql(
    "'ruleId': rule_id, 'level': 'warning', 'message': {'text': name}, 'locations': [{'physicalLocation': {'artifactLocation': {'uri': path}, 'region':"
    " {'startLine': start_line, 'startColumn': start_column, 'endLine': end_line, 'endColumn': end_column, 'snippet': {'text': matching}}}}]"
)
_MATCH_JSON = _json_sql(
    "'BlobID': blob_id, 'StructuralID': match_id, 'FindingID': finding_id, 'RuleID': rule_id, 'RuleName': name, 'Location': {'Offset': {'Start': s, 'End': e}, 'Source': {'Start': {'Line': start_line, 'Column': start_column},"
    " 'End': {'Line': end_line, 'Column': end_column}}}, 'Groups': list_transform(groups, lambda g: to_base64(encode(g))), 'Snippet': {'Before': to_base64(encode(before)), 'Matching': to_base64(encode(matching)), 'After': to_base64(encode(after))}"
)


@query(f"WITH {_IDS_SQL}, z AS ({_PLACES_SQL} f JOIN d USING (blob_id, text)) SELECT match_id, {_SARIF} AS result FROM z")
def sarif_results(spark, sf_dir):
    """Matches as SARIF results."""
    out = findings.with_provenance(passed(spark, sf_dir), document_blobs(spark, sf_dir))
    return out.select("match_id", report.sarif_result(F.col("path")).alias("result"))


@query(f"WITH {_IDS_SQL}, z AS ({_PLACES_SQL} ({_AROUND_SQL.format(rows='f')})) SELECT match_id, {_MATCH_JSON} AS json FROM z")
def json_matches(spark, sf_dir):
    """Matches as JSON objects."""
    return report.match_json(passed(spark, sf_dir))


# --- web pages, traffic, validation ---


@query("SELECT page_id, NOT regexp_matches(split_part(url, '?', 1), '(?i)\\.(" + "|".join(filters.SKIPPED_ENDINGS) + ")$') AS by_url, (strlen(html) >= 10 AND strlen(html) <= 10485760) AS by_response, contains(url, '?') OR page_id % 3 = 0 AS by_request FROM pages")
def traffic_filters(spark, sf_dir):
    """Which pages the traffic filters let pass."""
    rows = table(spark, sf_dir, "pages")
    headers = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("X-Api-Version"))).otherwise(F.array(F.lit("Accept")))
    return rows.select("page_id", filters.scannable_url(F.col("url")).alias("by_url"), filters.scannable_response(F.col("html").cast("binary"), F.lit("text/html")).alias("by_response"), filters.scannable_request(F.lit(""), F.col("url"), headers).alias("by_request"))


@query("SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host FROM pages) GROUP BY host")
def pages_by_host(spark, sf_dir):
    """Pages by host."""
    return findings.count_by(table(spark, sf_dir, "pages").select(T.url_host(F.col("url")).alias("host")), "host")


@query("SELECT split_part(url, '?', 1) AS base, count(*) AS pages, max(url) AS latest_url FROM pages GROUP BY 1")
def pages_by_base_url(spark, sf_dir):
    """Pages by URL without query."""
    return table(spark, sf_dir, "pages").groupBy(T.url_base(F.col("url")).alias("base")).agg(F.count("*").alias("pages"), F.max("url").alias("latest_url"))


@query("SELECT page_id, strlen(html) AS bytes, (length(html) - length(replace(html, '<script>', ''))) // 8 AS scripts, (length(html) - length(replace(html, '<style>', ''))) // 7 AS styles FROM pages")
def page_parts(spark, sf_dir):
    """Inline scripts and styles of each page, and the size of the whole."""
    parts = items_of(table(spark, sf_dir, "pages"))
    count = lambda p: F.sum(F.col("source").startswith(p).cast("long"))
    by = parts.groupBy("page_id").agg(F.max(F.when(F.col("source") == "html:full", F.octet_length("content").cast("long"))).alias("bytes"), count("script:inline:").alias("scripts"), count("style:inline:").alias("styles"))
    return by.select("page_id", "bytes", "scripts", "styles")


_CODE = "[200, 401, 403, 429, 500][event_id % 5 + 1]"


@query(f"SELECT event_id, CASE WHEN contains(coalesce(props, ''), '\"k\": 13') THEN 'invalid' WHEN {_CODE} = 200 AND event_type <> 'view' THEN 'valid' WHEN {_CODE} = 200 THEN 'invalid' WHEN {_CODE} IN (401, 403) THEN 'invalid' ELSE 'undetermined' END AS status, CASE WHEN contains(coalesce(props, ''), '\"k\": 13') OR {_CODE} IN (200, 401, 403) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM events")
def validation_results(spark, sf_dir):
    """Events as responses to checks: codes by id, bodies from their texts."""
    rows = table(spark, sf_dir, "events").withColumn("code", F.get(F.array(*[F.lit(c) for c in (200, 401, 403, 429, 500)]), (F.col("event_id") % 5).cast("int")))
    body = F.concat(F.coalesce("props", F.lit("")), F.when(F.col("event_type") != "view", F.lit("ACCEPTED")).otherwise(""))
    result = validation.evaluated(F.col("code"), body, F.array(F.lit(200)), F.array(F.lit(401), F.lit(403)), F.lit("ACCEPTED"), F.lit('"k": 13'))
    return rows.select("event_id", result.alias("r")).select("event_id", "r.status", "r.confidence")


@query(f"WITH v AS (SELECT user_id, {_CODE} AS code FROM events) SELECT CAST(user_id AS VARCHAR) AS finding_id, CASE WHEN max(CAST(code = 200 AS INT)) = 1 THEN 'valid' WHEN max(CAST(code IN (401, 403) AS INT)) = 1 THEN 'invalid' ELSE 'undetermined' END AS status, round(avg(CASE WHEN code IN (200, 401, 403) THEN 1.0 ELSE 0.5 END), 6) AS confidence FROM v GROUP BY user_id")
def validation_rollup(spark, sf_dir):
    """Results of several checks of one finding, here of a user, in one status."""
    rows = table(spark, sf_dir, "events").withColumn("code", F.get(F.array(*[F.lit(c) for c in (200, 401, 403, 429, 500)]), (F.col("event_id") % 5).cast("int")))
    result = validation.evaluated(F.col("code"), F.lit(""), F.array(F.lit(200)), F.array(F.lit(401), F.lit(403)), F.lit(""), F.lit(""))
    out = findings.validation_rollup(rows.select(F.col("user_id").cast("string").alias("finding_id"), result.alias("r")).select("finding_id", "r.status", "r.confidence"))
    return out.select("finding_id", "status", F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_content(spark, sf_dir):
    """The latest event of each user: a queue in which the latest content wins."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    return findings.latest(rows, ["user_id"], "at").select("user_id", "event_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 AND event_type <> 'view' GROUP BY event_type")
def request_grid(spark, sf_dir):
    """Requests by type under a conjunction of filters, most first."""
    rows = table(spark, sf_dir, "events").withColumn("secrets", ((F.col("value") > 10) & (F.col("event_type") != "view")).cast("int"))
    return findings.count_by(findings.grid(rows, with_secrets=True), "event_type")


from leakloom.plans import details, steps  # noqa: E402, F401  # further queries, which use what is above
