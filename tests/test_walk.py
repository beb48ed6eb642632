"""Walks over folders, and ignore rules in order."""

import os

import pytest
from pyspark.sql import functions as F

from leakloom.sources import walk as W


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.txt": "1", "x/b.txt": "2", "x/y/c.log": "3", "x/y/keep.log": "4", "node_modules/@aws-sdk/d.txt": "5", "go.sum": "6", "z/bin": "\0", "z/é.txt": "7"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    os.symlink("..", tmp_path / "x" / "up")  # a circle
    os.symlink("y", tmp_path / "x" / "again")
    os.symlink("a.txt", tmp_path / "link.txt")
    os.symlink("nowhere", tmp_path / "broken")
    return str(tmp_path)


def paths(df):
    return sorted(r.path for r in df.filter("kind = 'file'").collect())


def test_walks_end_in_circles_and_take_each_folder_once(spark, tree):
    assert paths(W.walk(spark, tree)) == ["a.txt", "x/b.txt", "x/y/c.log", "x/y/keep.log", "z/bin", "z/é.txt"]
    followed = W.walk(spark, tree, follow=True)
    assert paths(followed) == ["a.txt", "link.txt", "x/again/c.log", "x/again/keep.log", "x/b.txt", "z/bin", "z/é.txt"]
    assert [r.path for r in followed.filter("kind = 'error'").collect()] == ["broken"]
    assert "node_modules/@aws-sdk/d.txt" in paths(W.walk(spark, tree, ignore=None))
    assert paths(W.walk(spark, tree, ignore=["*.log", "!keep.log", "z/"])) == ["a.txt", "go.sum", "node_modules/@aws-sdk/d.txt", "x/b.txt", "x/y/keep.log"]


def test_texts_of_a_walk(spark, tree):
    rows = {r.path: bytes(r.content) for r in W.from_walk(spark, tree, ignore=["x/"]).collect()}
    assert rows == {"a.txt": b"1", "node_modules/@aws-sdk/d.txt": b"5", "go.sum": b"6", "z/é.txt": b"7"}
    assert W.from_walk(spark, tree, most=0).count() == 5


def test_the_last_rule_that_matches_decides(spark, tmp_path):
    lines = ["# comment", "", "*.log", "!keep.log", "build/", "!build/out.txt", "keep.log/", "\\!odd", "/top.txt", "a/**/b"]
    (tmp_path / "rules").write_text("\n".join(lines))
    assert W.rules_in(spark, str(tmp_path / "rules")) == lines
    want = {"x.log": True, "keep.log": False, "d/keep.log": False, "build/a": True, "build/out.txt": False, "!odd": True, "top.txt": True, "d/top.txt": False, "a/b": True, "a/x/y/b": True, "a/bc": False, "plain": False}
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.i for r in rows.select("p", W.ignored(F.col("p"), lines).alias("i")).collect()} == want
    pruned = {r.p: r.i for r in rows.select("p", W.ignored_with_parents(F.col("p"), lines).alias("i")).collect()}
    assert pruned == want | {"build/out.txt": True}
    assert W.ignored(F.col("p"), []) is not None and rows.filter(W.ignored(F.col("p"), ["# none"])).count() == 0
