"""A SARIF sink: tasks write the results, a commit makes the log of them.

`results.write.format("sarif").option("path", folder)` writes one part a task, each a valid file of
external properties, and a log that refers to them; with option `single` the commit copies the parts'
bytes into one file instead. Parts get their names at the commit: what a failed task or a second try
of a task has left is not part of the log, and goes.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from leakloom.session import ship_package

SCHEMA, VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
EXTERNAL = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/os/schemas/sarif-external-property-file-schema-2.1.0.json"
LOG = "results.sarif"
_COPIED = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    name: str
    results: int


class SarifWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.single = options.get("single", "false").lower() == "true"
        self.driver = json.loads(options.get("driver", "{}"))
        self.run = uuid.uuid4().hex
        files, root = fs.FileSystem.from_uri(self.path)
        if not overwrite and files.get_file_info(posixpath.join(root, LOG)).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds a log; it is replaced in mode overwrite only")
        files.create_dir(posixpath.join(root, f"_{self.run}"), recursive=True)

    def _at(self, *names: str) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, posixpath.join(root, *names)

    def write(self, iterator: Iterator[Row]) -> Part:
        """In a task: its results, one after the other, into a file of its own."""
        name, n = f"{uuid.uuid4().hex}.sarif-external-properties", 0
        files, path = self._at(f"_{self.run}", name)
        with files.open_output_stream(path) as out:
            out.write(b"" if self.single else (json.dumps({"$schema": EXTERNAL, "version": VERSION})[:-1] + ', "results": [').encode())
            for row in iterator:
                out.write((("," if n else "") + row[0]).encode())
                n += 1
            out.write(b"" if self.single else b"]}")
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        """On the driver: the log. Only names and counts have come here."""
        parts = [m for m in messages if m and m.results]
        files, folder = self._at(f"_{self.run}")
        head = json.dumps({"$schema": SCHEMA, "version": VERSION})[:-1] + ', "runs": [' + json.dumps({"tool": {"driver": self.driver}})[:-1]
        with files.open_output_stream(self._at(f"_{self.run}.log")[1]) as out:
            if self.single:
                out.write((head + ', "results": [').encode())
                for i, part in enumerate(parts):
                    out.write(b"," if i else b"")
                    with files.open_input_stream(posixpath.join(folder, part.name)) as held:
                        while block := held.read(_COPIED):
                            out.write(block)
                out.write(b"]}]}")
            else:
                named = [{"location": {"uri": f"results-{self.run}/{p.name}"}, "itemCount": p.results} for p in parts]
                out.write((head + ', "externalPropertyFileReferences": ' + json.dumps({"results": named}) + "}]}").encode())
        if self.single:
            files.delete_dir(folder)
        else:
            wanted = {p.name for p in parts}
            for info in files.get_file_info(fs.FileSelector(folder)):
                if info.base_name not in wanted:
                    files.delete_file(info.path)
            files.move(folder, self._at(f"results-{self.run}")[1])
        files.move(self._at(f"_{self.run}.log")[1], self._at(LOG)[1])  # from here on the log is there
        for info in files.get_file_info(fs.FileSelector(self._at()[1])):
            if info.base_name.startswith("results-") and info.base_name != f"results-{self.run}":
                files.delete_dir(info.path)

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = self._at(f"_{self.run}")
        files.delete_dir(folder)


class SarifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sarif"

    def writer(self, schema, overwrite: bool) -> SarifWriter:
        if [f.dataType.typeName() for f in schema.fields] != ["string"]:
            raise ValueError("a SARIF sink takes one column of JSON strings")
        return SarifWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format "sarif" known to a session."""
    ship_package(spark)
    spark.dataSource.register(SarifSource)


def driver_of(rules: Iterable, tool: str = "leakloom", version: str = "1") -> dict:
    """What a log tells about the tool: its name, version and rules."""
    listed = [{"id": r.id, "name": r.name, "shortDescription": {"text": r.description}} | ({"helpUri": r.references[0]} if r.references else {}) for r in rules]
    return {"name": tool, "version": version, "rules": listed}


def write_log(results: DataFrame, rules: Iterable, folder: str, single: bool = False, **tool: str) -> None:
    """Write rows with column `result` (see report.sarif_result) as a log in a folder that tasks can reach, in the place of one that is there."""
    register(results.sparkSession)
    path = folder if "://" in folder else f"file://{folder}"
    results.select("result").write.format("sarif").mode("overwrite").option("path", path).option("single", str(single)).option("driver", json.dumps(driver_of(rules, **tool))).save()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The results of a log that refers to parts, as rows of JSON: Spark reads the parts."""
    path = folder if "://" in folder else f"file://{folder}"
    log = json.loads(spark.read.text(f"{path}/{LOG}", wholetext=True).first()[0])
    parts = [f"{path}/{p['location']['uri']}" for run in log["runs"] for p in run.get("externalPropertyFileReferences", {}).get("results", [])]
    if not parts:
        return spark.createDataFrame([], "result string")
    return spark.read.text(parts, wholetext=True).selectExpr("explode(from_json(value, 'struct<results:array<string>>').results) AS result")
