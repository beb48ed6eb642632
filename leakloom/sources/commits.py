"""The commit in which a blob first appears, over a commit graph given as tables.

A commit's generation is one more than the greatest of its parents'; one without parents has 1. Of
commits that hold a blob the first is the one of the least generation, and of these the earliest: no
walk of the history on the driver decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.session import discard, materialize


def _ways(single: DataFrame) -> DataFrame:
    """(commit_id, anchor, steps) of commits with one parent: the first commit back with none or several, and how far.

    Pointers double their reach in each round, so the rounds grow with the logarithm of the longest chain;
    what still moves when each could have reached all commits goes round in a circle, and is left out.
    """
    most = single.count().bit_length() + 1
    ways = materialize(single.select("commit_id", F.col("parent").alias("anchor"), F.lit(1).cast("long").alias("steps")), "ways")
    for _ in range(most):
        on = ways.select(F.col("commit_id").alias("anchor"), F.col("anchor").alias("further"), F.col("steps").alias("more"))
        longer = ways.join(on, "anchor", "left")
        before, ways = ways, materialize(longer.select("commit_id", F.coalesce("further", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")), "ways")
        discard(before)
        if ways.filter("moved").isEmpty():
            return ways.drop("moved")
        ways = ways.drop("moved")
    return ways.join(single.select(F.col("commit_id").alias("anchor")), "anchor", "left_anti")


def generations(commits: DataFrame) -> DataFrame:
    """(commit_id, generation) of commits (commit_id, parents).

    Chains of commits with one parent are bridged first; the rounds that follow grow with the merges on
    the longest way. Parents that are not in the table do not count; repeated commits are one; a commit on
    a circle, which git has none of, gets no row.
    """
    known = commits.filter("commit_id is not null").select("commit_id", F.explode_outer(F.array_distinct(F.coalesce("parents", F.array().cast("array<string>")))).alias("parent"))
    ids = known.select("commit_id").distinct()
    there = known.filter("parent is not null").distinct().join(ids.select(F.col("commit_id").alias("parent")), "parent", "left_semi")
    counted = there.groupBy("commit_id").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    nodes = materialize(ids.join(counted, "commit_id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "commits")
    ways = _ways(nodes.filter("n = 1").select("commit_id", "parent"))
    merged = there.join(nodes.filter("n > 1").select("commit_id"), "commit_id", "left_semi")
    bridged = merged.join(ways.select(F.col("commit_id").alias("parent"), "anchor", "steps"), "parent", "left")
    # Of a merge the anchors of its parents, and how far these are.
    needs = materialize(bridged.groupBy("commit_id", F.coalesce("anchor", "parent").alias("anchor")).agg((F.max(F.coalesce("steps", F.lit(0))) + 1).alias("steps")), "merges")
    done = nodes.filter("n = 0").select("commit_id", F.lit(1).cast("long").alias("generation"))
    while True:
        met = needs.join(done.select(F.col("commit_id").alias("anchor"), "generation"), "anchor", "left")
        by = met.groupBy("commit_id").agg(F.max(F.col("generation") + F.col("steps")).alias("generation"), F.count("*").alias("n"), F.count("generation").alias("k")).filter("n = k")
        new = materialize(by.select("commit_id", "generation").join(done.select("commit_id"), "commit_id", "left_anti"), "generation")
        if new.isEmpty():
            break
        done = materialize(done.unionByName(new), "generations")
    chained = ways.join(done.select(F.col("commit_id").alias("anchor"), "generation"), "anchor").select("commit_id", (F.col("generation") + F.col("steps")).alias("generation"))
    return done.unionByName(chained)


def first_commits(files: DataFrame, commits: DataFrame, keys: tuple[str, ...] = ("blob_id",)) -> DataFrame:
    """For each blob (or other keys of files) the first commit that holds it, with its path, generation and commit columns.

    files: (commit_id, path, blob_id), the files of each commit, all or those that it changes; commits:
    (commit_id, parents, committed_at, ...). Files of commits that are not in the table are left out. Ties: earliest, then least commit_id and path.
    """
    placed = generations(commits).join(commits.dropDuplicates(["commit_id"]).drop("parents"), "commit_id")
    rest = [c for c in placed.columns if c not in ("generation", "committed_at", "commit_id")]
    first = F.min(F.struct("generation", "committed_at", "commit_id", "path"))
    found = files.join(placed.select("commit_id", "generation", "committed_at"), "commit_id").groupBy(*keys).agg(first.alias("f")).select(*keys, "f.*")
    return found.join(placed.select("commit_id", *rest), "commit_id") if rest else found
