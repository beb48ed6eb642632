"""The facet index against passes over the rows."""

import random

from pyspark.sql import functions as F

from leakloom.operators import findings
from leakloom.operators.facet_index import FacetIndex


def test_index_counts_as_passes_over_the_rows_do(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", "c", None]), r.choice(["x", "y"]), r.choice([[], ["p"], ["p", "q"], ["q", "q", "z"], None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, one string, two string, many array<string>").repartition(5)
    index = FacetIndex(df, ["one", "two"], ["many"])
    key = lambda d: sorted((x.facet, x.value, x.n) for x in d.collect())
    for chosen in ({}, {"one": ["a", "-"]}, {"one": ["b"], "two": ["x"], "many": ["q", "none"]}, {"many": ["nothing"]}, {"two": []}):
        assert key(index.counts(chosen)) == key(findings.facet_recount(df, chosen, ["one", "two"], ["many"]))
        want = {x.id for x in findings.facet_filter(df, chosen, ("many",)).collect()}
        got = index.passing(chosen)
        assert got.columns == df.columns and {x.id for x in got.collect()} == want
        apart = {(x.facet, x.value): x.n for x in index.counts(chosen, apart=True).collect()}
        for facet in ("one", "two", "many"):
            others = {f: v for f, v in chosen.items() if f != facet}
            for x in findings.facet_recount(df, others, ["one", "two"], ["many"]).filter(F.col("facet") == facet).collect():
                assert apart[facet, x.value] == x.n
    plan = index.counts({"one": ["a"]})._jdf.queryExecution().executedPlan().toString()
    assert "facet-bitmaps" in plan and "facet-rows" not in plan


def test_index_of_no_rows(spark):
    index = FacetIndex(spark.createDataFrame([], "one string, many array<string>"), ["one"], ["many"])
    assert index.counts({"one": ["a"]}).count() == 0 and index.passing({"one": ["a"]}).count() == 0
