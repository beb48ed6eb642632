"""Further registered queries: matching in pieces, indexes, caches and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leakloom.operators.chunks import scan_pieces
from leakloom.operators.facet_index import FacetIndex
from leakloom.operators.match import scan
from leakloom.plans import queries as Q
from leakloom.plans import rules as R
from leakloom.plans.queries import PACK, query, table
from leakloom.session import drop_at_exit, shared_dir
from leakloom.sources import blobs as B
from leakloom.sources.commits import first_commits
from leakloom.sources.walk import ignored, ignored_with_parents
from leakloom.streaming.stateful import first_seen


@query(Q.SQL["matches_by_content"])
def chunked_matches(spark, sf_dir):
    """All matches, one for each rule and groups in a blob, with documents of over 1,000 bytes matched in pieces."""
    hits, _ = scan_pieces(Q.document_blobs(spark, sf_dir).dropDuplicates(["blob_id"]), PACK, size=1000, run=128)
    return hits.select("blob_id", "rule_id", "start", "end", "matching", F.array_join("groups", "|").alias("groups"))


#: Three choices of facets, and their SQL.
_CHOICES = (
    ({}, "true"),
    ({"categories": ["secret", "payment"], "source": ["src1", "src2", "src3", "src4"]}, "list_has_any(categories, ['secret', 'payment']) AND source IN ('src1', 'src2', 'src3', 'src4')"),
    ({"rule_name": ["IPv4 address"], "source": ["src0", "src5"], "categories": ["network", "api"]}, "rule_name = 'IPv4 address' AND source IN ('src0', 'src5') AND list_has_any(categories, ['network', 'api'])"),
)


def _counted(where: str) -> str:
    return f"SELECT facet, value, n FROM ({Q._facet_sql('(SELECT * FROM fr WHERE ' + where + ')')})"


@query(
    f"WITH {Q._FACET_ROWS}, every AS ({Q._facet_sql('fr')}), "
    + ", ".join(f"c{i} AS ({_counted(where)})" for i, (_, where) in enumerate(_CHOICES))
    + " ".join(f"{' UNION ALL' if i else ''} SELECT {i} AS choice, e.facet, e.value, coalesce(c{i}.n, 0) AS n FROM every e LEFT JOIN c{i} ON e.facet = c{i}.facet AND e.value = c{i}.value" for i in range(len(_CHOICES)))
)
def indexed_recounts(spark, sf_dir):
    """Facet counts under three choices, from one index; the matches are read once."""
    index = FacetIndex(Q._facet_rows(spark, sf_dir), ["rule_name", "source"], ["categories"])
    counts = [index.counts(chosen).select(F.lit(i).alias("choice"), "facet", "value", "n") for i, (chosen, _) in enumerate(_CHOICES)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


#: Ignore rules in order: a source, all but some of its documents' files again, a kind of file, and one of these again.
_RULES = ("src1/", "!src1/*7.txt", "*.log", "!/src2/**/keep*.log", "src3/en", "!src3/en/*.txt")
_PATH = "source || '/' || coalesce(lang, 'none') || '/' || CASE WHEN doc_id % 3 = 0 THEN 'keep' ELSE 'd' END || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.log' ELSE '.txt' END"


@query(
    f"WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents),"
    " m AS (SELECT *, regexp_matches(path, '(^|/)src1/') AS a, regexp_matches(path, '^src1/[^/]*7.txt(/|$)') AS b, regexp_matches(path, '(^|/)[^/]*.log(/|$)') AS c, regexp_matches(path, '^src2/(.*/)?keep[^/]*.log(/|$)') AS d, regexp_matches(path, '^src3/en(/|$)') AS e, regexp_matches(path, '^src3/en/[^/]*.txt(/|$)') AS f FROM p)"
    " SELECT doc_id, path, CASE WHEN f THEN false WHEN e THEN true WHEN d THEN false WHEN c THEN true WHEN b THEN false ELSE a END AS ignored, a OR e OR CASE WHEN d THEN false ELSE c END AS ignored_with_parents FROM m"
)
def ordered_ignores(spark, sf_dir):
    """Which paths rules in order leave out, with and without what is below ignored folders."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} AS path")
    return rows.select("doc_id", "path", ignored(F.col("path"), _RULES).alias("ignored"), ignored_with_parents(F.col("path"), _RULES).alias("ignored_with_parents"))


@query(
    "WITH RECURSIVE c AS (SELECT DISTINCT doc_id AS c FROM documents WHERE doc_id IS NOT NULL), e AS (SELECT c, c - 1 AS p FROM c WHERE c % 8 <> 0 UNION SELECT c, c // 2 FROM c WHERE c % 8 = 0 AND c > 0 UNION SELECT c, c // 3 FROM c WHERE c % 8 = 0 AND c > 0),"
    " k AS (SELECT e.c, e.p FROM e JOIN c ON e.p = c.c), w AS (SELECT c, c AS a, 0 AS n FROM c UNION SELECT w.c, k.p, w.n + 1 FROM w JOIN k ON w.a = k.c), g AS (SELECT c, max(n) + 1 AS generation FROM w GROUP BY c),"
    " f AS (SELECT doc_id AS c, md5(coalesce(text, '')) AS blob_id, coalesce(source, '') || '/' || doc_id AS path, coalesce(n_chars, 0) AS made FROM documents)"
    " SELECT blob_id, CAST(c AS VARCHAR) AS commit_id, CAST(generation AS BIGINT) AS generation, path FROM f JOIN g USING (c) QUALIFY row_number() OVER (PARTITION BY blob_id ORDER BY generation, made, CAST(c AS VARCHAR), path) = 1"
)
def first_commits_of_blobs(spark, sf_dir):
    """Documents as files of commits that form chains and merges by their ids: the first commit of each content."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    commits = docs.selectExpr("cast(doc_id as string) AS commit_id", "coalesce(n_chars, 0) AS committed_at", "transform(CASE WHEN doc_id % 8 <> 0 THEN array(doc_id - 1) WHEN doc_id > 0 THEN array(doc_id div 2, doc_id div 3) ELSE array() END, x -> cast(x as string)) AS parents")
    files = docs.selectExpr("cast(doc_id as string) AS commit_id", "md5(cast(coalesce(text, '') as binary)) AS blob_id", "concat(coalesce(source, ''), '/', doc_id) AS path")
    return first_commits(files, commits).select("blob_id", "commit_id", "generation", "path")


def _streamed(spark, sf_dir: str, name: str, build):
    """A stream over a table's files, run to its end: what it has written, as a table."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    files = f"{sf_dir}/events.parque[t]"  # a pattern, as a stream's path may not be one file
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(files)
    out, held = build(stream), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(held), 8)))  # a stream keeps its number of partitions, each with a store of its own
    try:
        query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id, event_type")
def streamed_new_pairs(spark, sf_dir):
    """Events as a stream of which only the first of each user and type passes: each pair once, however many there are."""
    seen = _streamed(spark, sf_dir, "new-pairs", lambda s: first_seen(s.select("user_id", "event_type"), ["user_id", "event_type"], most=None))
    return seen.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://github.com/' || host || '/repo' || page_id || '.git/' WHEN page_id % 3 = 1 THEN url ELSE '/data/' || host || '//' END AS target, CASE WHEN page_id % 3 = 0 THEN 'repo' || page_id WHEN page_id % 3 = 1 THEN coalesce(nullif(regexp_extract(rtrim(url, '/'), '([^/]*)$', 1), ''), 'output') ELSE host END || '.ds' AS name FROM (SELECT page_id, url, split_part(url, '/', 3) AS host FROM pages)")
def store_names(spark, sf_dir):
    """Names of stores for scans of repositories, pages and folders."""
    host = "split_part(url, '/', 3)"
    target = F.expr(f"CASE WHEN page_id % 3 = 0 THEN concat('https://github.com/', {host}, '/repo', page_id, '.git/') WHEN page_id % 3 = 1 THEN url ELSE concat('/data/', {host}, '//') END")
    return table(spark, sf_dir, "pages").select("page_id", target.alias("target")).withColumn("name", B.store_name(F.col("target")))


#: Rules in free-spacing form, which other engines take once it is expanded.
_SPACED = (
    R.Rule("lk.email.2", "Mail address", "(?x) \\b ( [A-Za-z0-9._%+-]+   # who\n @ [A-Za-z0-9.-]+ \\. [A-Za-z]{2,} )  # where\n \\b"),
    R.Rule("lk.ipv4.2", "IPv4 address", "(?x) \\b ( \\d{1,3} (?# three more ) (?: \\. \\d{1,3} ){3} ) \\b"),
    R.Rule("lk.assigned.2", "Assigned value", "(?ix) ( token | secret ) [ ]=[ ] \" [#0-9a-f]+"),
)


@query(
    "WITH "
    + ", ".join(f"p{i} AS (SELECT {Q._quoted(r.id)} AS rule_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), {Q._quoted(R.expanded(r.pattern))}))) AS BIGINT) AS matches FROM documents)" for i, r in enumerate(_SPACED))
    + " "
    + " UNION ALL ".join(f"SELECT rule_id, matches, matches AS by_rlike FROM p{i}" for i in range(len(_SPACED)))
)
def free_spacing_rules(spark, sf_dir):
    """Matches of rules in free-spacing form, by the scan and by Spark's own engine, which takes them expanded."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("blob_id"), F.coalesce("text", F.lit("")).alias("content"))
    found = scan(docs, _SPACED, 0, "location").groupBy("rule_id").agg(F.count("*").alias("matches"))
    counts = [docs.agg(F.sum(F.regexp_count("content", F.lit(R.expanded(r.pattern)))).cast("long").alias("by_rlike")).withColumn("rule_id", F.lit(r.id)) for r in _SPACED]
    own = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return own.join(found, "rule_id", "left").select("rule_id", F.coalesce("matches", F.lit(0)).alias("matches"), "by_rlike")
