"""The SARIF sink: parts by tasks, one log by the commit."""

import json
import os

import pytest
from pyspark.sql import functions as F

from leakloom.operators import filters, findings
from leakloom.operators.match import scan
from leakloom.plans import report, sarif
from leakloom.plans import rules as R


@pytest.fixture
def hits(spark):
    rule = R.Rule("t", "Name", r"(k\d+)", description="d", references=("http://r",))
    blobs = spark.createDataFrame([(f"{i:040}", f"x k{i}\n") for i in range(40)], "blob_id string, content string").repartition(4)
    rows = findings.identified(filters.postfilter(scan(blobs, [rule]), R.frame(spark, [rule])))
    return rule, rows.select(report.sarif_result(F.concat(F.lit("/p/"), "blob_id")).alias("result"))


def test_tasks_write_parts_and_the_commit_refers_to_them(spark, hits, tmp_path):
    rule, results = hits
    sarif.write_log(results, [rule], str(tmp_path))
    log = json.loads((tmp_path / sarif.LOG).read_text())
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and run["tool"]["driver"]["rules"][0]["helpUri"] == "http://r"
    named = run["externalPropertyFileReferences"]["results"]
    assert len(named) == 4 and sum(p["itemCount"] for p in named) == 40
    texts = [r["locations"][0]["physicalLocation"]["region"]["snippet"]["text"] for p in named for r in json.loads((tmp_path / p["location"]["uri"]).read_text())["results"]]
    assert sorted(texts) == sorted(f"k{i}" for i in range(40))
    assert {json.loads(r.result)["ruleId"] for r in sarif.read_log(spark, str(tmp_path)).collect()} == {"t"} and sarif.read_log(spark, str(tmp_path)).count() == 40
    sarif.write_log(results.limit(0), [rule], str(tmp_path))
    assert sarif.read_log(spark, str(tmp_path)).count() == 0 and len([x for x in os.listdir(tmp_path) if not x.startswith(".")]) <= 2


def test_one_file(hits, tmp_path):
    rule, results = hits
    sarif.write_log(results, [rule], str(tmp_path), single=True, tool="x", version="2")
    run = json.loads((tmp_path / sarif.LOG).read_text())["runs"][0]
    assert len(run["results"]) == 40 and run["tool"]["driver"]["name"] == "x" and sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == [sarif.LOG]


def test_a_failed_write_leaves_no_log(spark, tmp_path):
    sarif.register(spark)
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise("{}").cast("string").alias("result"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("sarif").mode("overwrite").option("path", f"file://{tmp_path}").save()
    assert [x for x in os.listdir(tmp_path) if not x.startswith(".")] == []
    with pytest.raises(Exception, match="one column"):
        spark.range(1).write.format("sarif").mode("overwrite").option("path", f"file://{tmp_path}").save()
