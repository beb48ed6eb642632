"""Generations of commit graphs and first commits, against plain versions."""

import random

from pyspark.sql import functions as F

from leakloom.sources import commits as C


def test_generations_and_first_commits_of_random_graphs(spark):
    r = random.Random(7)
    parents = {f"c{i:03}": [f"c{i - 1:03}"] if i % 9 and i else [f"c{r.randrange(i):03}" for _ in range(r.randint(0, 3))] if i else [] for i in range(200)}
    parents["c050"] = ["gone"]  # a parent that is not there, as of a shallow clone
    generation = {}
    for c in sorted(parents):
        generation[c] = 1 + max((generation[p] for p in parents[c] if p in generation), default=0)
    table = spark.createDataFrame([(c, p, r.randint(0, 5), f"m{c}") for c, p in parents.items()], "commit_id string, parents array<string>, committed_at long, message string")
    table = table.unionByName(table.limit(5)).unionByName(spark.createDataFrame([("circle", ["circle"], 0, ""), (None, None, None, None)], table.schema))
    assert {x.commit_id: x.generation for x in C.generations(table).collect()} == generation
    files = [(r.choice(sorted(parents)), f"p{r.randint(0, 3)}", f"b{r.randint(0, 40)}") for _ in range(400)] + [("unknown", "p", "b0")]
    at = {x.commit_id: x.committed_at for x in table.filter("commit_id like 'c0%' or commit_id like 'c1%'").collect()}
    want = {}
    for c, p, b in files:
        if c in parents:
            want[b] = min(want.get(b, (10**9,)), (generation[c], at[c], c, p))
    got = C.first_commits(spark.createDataFrame(files, "commit_id string, path string, blob_id string"), table).collect()
    assert {x.blob_id: (x.generation, x.committed_at, x.commit_id, x.path) for x in got} == want and all(x.message == f"m{x.commit_id}" for x in got)


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.range(3000).select(F.col("id").cast("string").alias("commit_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("parents"))
    assert C.generations(chain).agg(F.max("generation"), F.count("*")).first()[:] == (3000, 3000)
