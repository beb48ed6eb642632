"""The registered queries of the subpackage against SQL, and the pipeline against its parts."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from leakloom.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    for f in glob.glob(f"{SMALL}/*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SMALL).toArrow(), duckdb.sql(queries.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and len(got)
    rows = lambda x: sorted(str([r[c] for c in sorted(r)]) for r in x.to_pylist())  # noqa: E731  # Arrow keeps nulls and whole numbers apart
    assert rows(got) == rows(want)


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, columns = docs.count(), docs.columns
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "benchmark decontamination", "secret scan", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= before
        if name == "secret scan":
            assert kept == before
    texts = [r.text or "" for r in docs.collect()]
    assert not any('token = "' in t and "[SECRET]" not in t for t in texts) and len(texts) > n // 2
    last = corpus_pipeline.run(spark, SMALL)
    assert last.select("doc_id").distinct().count() == len(texts)


def test_pipeline_drops_near_copies_from_a_similarity_of_80_per_cent(spark):
    words = [f"w{i}" for i in range(200)]
    near, far = list(words[:100]), list(words[100:])
    near[30], near[70] = "x", "y"  # 86 of 106 shingles in common
    for i in (20, 50, 80):  # 81 of 111
        far[i] = "z"
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words[:100], near, words[100:], far))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()} == {0, 2, 3}
