"""Sources of blobs: tables, files, items in memory, git repositories, and members of archives."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions.ids import blob_id
from leakloom.session import ship_package
from leakloom.sources.extract import Limits, extension, members

#: Bytes that decide whether content is binary, and the largest file by default.
SNIFFED, MOST_FILE = 8192, 10 << 20
# Paths that are not scanned by default, as patterns like git's.
IGNORED = (
    "**/objects/pack/pack-*.pack", "**/objects/pack/pack-*.idx", "**/packed-refs",
    "**/site-packages/botocore/**", "**/site-packages/boto3/**", "**/site-packages/awscli/**", "**/site-packages/moto/**", "**/site-packages/ecdsa/**",
    "**/site-packages/tornado/test/**", "**/site-packages/flask/testsuite/**", "**/node_modules/@aws-sdk/**", "**/node_modules/aws-sdk/dist/**",
    "Cargo.lock", "package-lock.json", "Pipfile.lock", "go.sum", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "poetry.lock",
    "**/*.min.js", "**/*.min.css", "libgnutls.a", "libgnutls.so.*", "**/openssl*/test/recipes/**/evppkey*.txt", "/dev/**", "/proc/**", "/sys/**", "**/botocore/data/**/examples-1.json",
)


def from_texts(rows: DataFrame, id_col: str, text_col: str, source_col: str | None = None) -> DataFrame:
    """Blobs (blob_id, content, size, path, seq) of a table of texts; a null text is an empty one."""
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    path = F.concat_ws("/", F.col(source_col), F.col(id_col).cast("string")) if source_col else F.col(id_col).cast("string")
    return rows.select(blob_id(content).alias("blob_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"), F.octet_length(content).cast("long").alias("size"), path.alias("path"), F.col(id_col).alias("seq"))


def distinct(blobs: DataFrame) -> DataFrame:
    """One row for each blob, of the least seq; content stays out of the choice, and equal blobs have equal content."""
    rest = [c for c in blobs.columns if c not in ("blob_id", "seq")]
    return blobs.groupBy("blob_id").agg(F.min("seq").alias("seq"), *[(F.min_by(c, "seq") if c != "content" else F.first(c)).alias(c) for c in rest])


def is_binary(content: Column) -> Column:
    return F.instr(F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1"), "\x00") > 0


def ignore_pattern(patterns: Iterable[str]) -> str:
    """One regular expression for git-like patterns (without negation): a path that it finds is ignored."""
    out = []
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        anchored = "/" in p.rstrip("/")
        text = p.strip("/")
        regex = ""
        for token in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\]|.", text):
            regex += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or (token if token[0] == "[" and len(token) > 1 else re.escape(token))
        out.append(("^" if anchored else "(?:^|/)") + regex + ("/" if p.endswith("/") else "(?:/|$)"))
    return "|".join(out)


def from_files(spark: SparkSession, root: str, most: int = MOST_FILE, ignore: Iterable[str] | None = IGNORED, extract: str = "", limits: Limits | None = None) -> DataFrame:
    """Text blobs of the files below a folder, and on wish members of its archives and documents.

    Size and path are decided before a file's content is read. A binary file is left out, or replaced
    by its members when its extension is among those named in extract (`all`, or a comma list).
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.filter(F.col("length") <= most) if most else files
    base = re.sub(r"/+$", "", root)
    files = files.withColumn("path", F.regexp_replace("path", r"^file:/+", "/")).withColumn("relative", F.regexp_replace("path", "^" + re.escape(base) + "/", ""))
    if ignore:
        files = files.filter(~F.col("relative").rlike(ignore_pattern(ignore)))
    rows = files.select("relative", "content", is_binary(F.col("content")).alias("binary"))
    text = rows.filter(~F.col("binary")).select(F.col("relative").alias("path"), "content")
    if extract:
        inside = rows.filter("binary").select("relative", "content").mapInArrow(_members(extract, limits or Limits()), "path string, content binary")
        text = text.unionByName(inside)
    return text.select(blob_id(F.col("content")).alias("blob_id"), "content", F.octet_length("content").cast("long").alias("size"), "path", F.xxhash64("path").alias("seq"))


def selected(name: str, chosen: str) -> bool:
    """Whether a file's extension is chosen: `all`, or one of a comma list."""
    return chosen.strip().lower() == "all" or extension(name) in [x.strip().lower() for x in chosen.split(",")]


def _members(chosen: str, limits: Limits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(members(path, content, limits)) if selected(path, chosen) else []
                yield pa.RecordBatch.from_arrays([pa.array([f"{path}:{n}" for n, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], ["path", "content"])

    return run


def from_items(spark: SparkSession, items: Iterable[tuple[str, str]]) -> DataFrame:
    """Blobs of (source, content) items held in memory."""
    return from_texts(spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(items)], "seq long, source string, content string").withColumnRenamed("content", "text"), "seq", "text", "source")


#: Bytes of objects that one call of git gives a task.
CALLED = 32 << 20


def _sizes(call: list[str], names: list[str]) -> list[int]:
    """The size of each object that is a blob, else -1: others, and objects that are missing, as in a shallow clone."""
    listed = subprocess.run([*call, "cat-file", "--batch-check"], input="\n".join(names).encode() + b"\n", capture_output=True, check=True).stdout
    told = [line.split() for line in listed.splitlines()]
    return [int(t[2]) if len(t) == 3 and t[1] == b"blob" else -1 for t in told]


def _some_objects(call: list[str], names: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of names whose objects have CALLED bytes together, or one object of more; sizes are asked for before contents."""
    low, held = 0, 0
    for i, size in enumerate(_sizes(call, names)):
        size = size if 0 <= size <= most else 0
        if i > low and held + size > CALLED:
            yield low, i
            low, held = i, 0
        held += size
    if names:
        yield low, len(names)


def _contents(call: list[str], names: list[str], most: int) -> list[bytes | None]:
    """The contents of text blobs of at most that size, else None."""
    sizes = _sizes(call, names)
    wanted = [n for n, size in zip(names, sizes, strict=True) if 0 <= size <= most]
    raw = subprocess.run([*call, "cat-file", "--batch"], input="\n".join(wanted).encode() + b"\n", capture_output=True, check=True).stdout if wanted else b""
    at, out = 0, []
    for size in sizes:
        if not 0 <= size <= most:
            out.append(None)
            continue
        at = raw.index(b"\n", at) + 1
        body = raw[at : at + size]
        out.append(None if b"\x00" in body[:SNIFFED] else body)
        at += size + 1
    return out


def from_git(spark: SparkSession, repository: str, history: bool = True, most: int = MOST_FILE) -> DataFrame:
    """Text blobs of a git repository that all executors can reach: of all its history, or of HEAD's tree.

    Hashes and first paths are listed once; contents are read by tasks, of CALLED bytes a call, and of
    objects of more than most bytes only the size is.
    """
    ship_package(spark)
    call = ["git", "-C", repository]
    listed = subprocess.run([*call, *(["rev-list", "--all", "--objects"] if history else ["ls-tree", "-r", "HEAD"])], capture_output=True, text=True, check=True).stdout
    seen: dict[str, str] = {}
    for line in listed.splitlines():
        name, path = (line.partition(" ")[::2]) if history else (line.split()[2], line.partition("\t")[2])
        if path:
            seen.setdefault(name, path)
    rows = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(seen.items())], "seq long, blob_id string, path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in _some_objects(call, batch.column(1).to_pylist(), most):
                part = batch.slice(low, high - low)
                content = _contents(call, part.column(1).to_pylist(), most)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], ["seq", "blob_id", "path", "content"])

    found = rows.repartition(max(1, len(seen) // 2000 + 1)).mapInArrow(run, "seq long, blob_id string, path string, content binary").filter("content is not null")
    return found.select("blob_id", "content", F.octet_length("content").cast("long").alias("size"), "path", "seq")


def commits_of(spark: SparkSession, repository: str, first_added: bool = False) -> DataFrame:
    """The first commit met in the log for each path: commit, author, mail, time and subject."""
    call = ["git", "-C", repository, "log", "--all", "--name-only", "--format=%x01%H%x02%an%x02%ae%x02%cI%x02%s"] + (["--diff-filter=A"] if first_added else [])
    rows: dict[str, tuple] = {}
    for entry in subprocess.run(call, capture_output=True, text=True, check=True).stdout.split("\x01")[1:]:
        head, *paths = entry.splitlines()
        for p in filter(None, paths):
            rows.setdefault(p, (p, *head.split("\x02")))
    return spark.createDataFrame(list(rows.values()), "path string, commit_id string, author string, author_email string, committed_at string, message string")


# The hosts of repositories, and the form of their URLs.
REPOSITORY = r"^(?:https?://)?(?:github\.com|gitlab\.com)/([^/]+)/([^/]+?)(?:\.git)?/?$"


def repository_of(url: Column) -> Column:
    """owner/name of a hosted repository's URL, null if it is none."""
    name = F.concat(F.regexp_extract(url, REPOSITORY, 1), F.lit("/"), F.regexp_extract(url, REPOSITORY, 2))
    return F.when(url.rlike(REPOSITORY), name)


def listing(url: str) -> tuple[str, str] | None:
    """Owner and name of a hosted repository's URL."""
    found = re.search(REPOSITORY, url)
    return (found[1], found[2]) if found else None


def store_name(target: Column) -> Column:
    """The name of a store for what is scanned: of a hosted repository its name, else the last part of the path; `output` if there is none."""
    bare = F.regexp_replace(target, "/+$", "")
    hosted = F.regexp_extract(bare, r"^(?:[^:]*://)?(?:github|gitlab)\.com/[^/]*/(.+?)(?:\.git)?$", 1)
    last = F.regexp_extract(bare, "([^/]*)$", 1)
    return F.concat(F.when(hosted != "", hosted).when(last.isin("", "."), "output").otherwise(last), F.lit(".ds"))


def base_url(url: str) -> bool:
    """Whether a service's base URL is insecure; other schemes than http and https are errors."""
    scheme = url.partition("://")[0].lower() if "://" in url else ""
    if scheme not in ("http", "https"):
        raise ValueError(f"no http URL: {url}")
    return scheme == "http"


