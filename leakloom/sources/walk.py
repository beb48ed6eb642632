"""Walking folders by tasks, and ignore rules in order: the last that matches a path decides.

A walk goes level by level: tasks list the folders of a level, and what they hold is a table. A folder
is known by its device and inode, so one that is reached twice, by links or in a circle, is listed
once. Folders that the rules leave out are not listed.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.functions.ids import blob_id
from leakloom.session import discard, materialize, ship_package
from leakloom.sources.blobs import IGNORED, MOST_FILE, ignore_pattern, is_binary


def rules_of(lines: Iterable[str]) -> list[tuple[bool, str]]:
    """(negated, pattern) of the lines of an ignore file; blank lines and comments are none, a backslash takes a first ! or # as it is."""
    out = []
    for line in lines:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p
        out.append((negated, p[1:] if p[:2] in ("\\!", "\\#") else p))
    return out


def rules_in(spark: SparkSession, path: str) -> list[str]:
    """The lines of an ignore file, from any path that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0].splitlines()


def ignored(path: Column, lines: Iterable[str], folder: bool = False) -> Column:
    """Whether a relative path is ignored: the last rule that matches it decides, and one with ! takes it in again.

    Rules of one kind that follow each other are one regular expression. folder: the path is a folder's.
    A rule that matches a folder matches what is below it.
    """
    path = F.concat(path, F.lit("/")) if folder else path
    decided = [F.when(path.rlike(ignore_pattern([p if p[0] not in "#" else "[#]" + p[1:] for _, p in some])), F.lit(not negated)) for negated, some in groupby(rules_of(lines), key=lambda r: r[0])]
    return F.coalesce(*reversed(decided), F.lit(False)) if decided else F.lit(False)


def ignored_with_parents(path: Column, lines: Iterable[str]) -> Column:
    """ignored(), where nothing below an ignored folder is taken in again."""
    lines = list(lines)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.exists(above, lambda p: ignored(p, lines, True))).otherwise(False) | ignored(path, lines)


_ENTRY = pa.schema([("path", pa.string()), ("kind", pa.string()), ("link", pa.bool_()), ("size", pa.int64()), ("inode", pa.string())])
_ENTRY_DDL = "path string, kind string, link boolean, size long, inode string"


def _list_batches(root: str, follow: bool) -> Callable:
    """The entries of folders given by relative paths. What cannot be read is an entry of kind error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for e in sorted(entries, key=lambda e: e.name):
                            path = os.path.join(folder, e.name)
                            try:
                                s = e.stat(follow_symlinks=follow)
                                kind = "folder" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
                                rows.append((path, kind, e.is_symlink(), s.st_size, f"{s.st_dev}:{s.st_ino}"))
                            except OSError:
                                rows.append((path, "error", e.is_symlink(), None, None))
                except OSError:
                    rows.append((folder, "error", False, None, None))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array([x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in c], f.type) for c, f in zip(columns, _ENTRY, strict=True)], schema=_ENTRY)

    return run


def walk(spark: SparkSession, root: str, follow: bool = False, ignore: Iterable[str] | None = IGNORED) -> DataFrame:
    """(path, kind, link, size, inode) of the files below a folder that all executors can reach; kind is file or error.

    Links are left out, or followed. A folder is listed once, under the least of its paths on the
    first level on which it is met, so circles end; files under two names are two files. Folders that are
    ignored are not listed; within the others the rules decide on each file.
    """
    ship_package(spark)
    rules = list(ignore or ())
    top = os.stat(root)
    seen = spark.createDataFrame([("", f"{top.st_dev}:{top.st_ino}")], "path string, inode string")
    level, found, levels = seen, None, []
    while True:
        folders = level.select("path")
        entries = materialize(folders.repartition(F.col("path")).mapInArrow(_list_batches(root, follow), _ENTRY_DDL), "entries")
        levels.append(entries)
        files = entries.filter("kind in ('file', 'error')" + ("" if follow else " and not link"))
        files = files.filter(~ignored(F.col("path"), rules))
        found = files if found is None else found.unionByName(files)
        below = entries.filter("kind = 'folder'" + ("" if follow else " and not link")).filter(~ignored(F.col("path"), rules, True))
        first = Window.partitionBy("inode").orderBy("path")
        below = below.withColumn("n", F.row_number().over(first)).filter("n = 1").select("path", "inode")
        level = materialize(below.join(seen.select("inode"), "inode", "left_anti").select("path", "inode"), "folders")
        if level.isEmpty():
            discard(level)
            return found
        seen = reduce(DataFrame.unionByName, [seen, level])


def _read_batches(root: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    return run


def from_walk(spark: SparkSession, root: str, follow: bool = False, most: int = MOST_FILE, ignore: Iterable[str] | None = IGNORED) -> DataFrame:
    """Text blobs (blob_id, content, size, path, seq) of the files of a walk; size and path are decided before a file is read."""
    files = walk(spark, root, follow, ignore).filter("kind = 'file'")
    files = files.filter(F.col("size") <= most) if most else files
    rows = files.select("path").repartition(F.col("path")).mapInArrow(_read_batches(root), "path string, content binary").filter("content is not null").filter(~is_binary(F.col("content")))
    return rows.select(blob_id(F.col("content")).alias("blob_id"), "content", F.octet_length("content").cast("long").alias("size"), "path", F.xxhash64("path").alias("seq"))
