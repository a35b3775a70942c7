"""A sink of files, one for each row, that shows all of a write or nothing of it.

df.write.format("wayfold_files").option("path", folder): rows are (path, content). Each task writes its files below a new folder and says
so in a message, with a list of its own of paths, sizes and SHA-256. The commit writes one small record that names the folder; the record of the highest number
is what readers take, so until then they stay with the version before. An abort takes the new folder away.

The folder is reached through pyarrow's file systems (a local or mounted path, hdfs://, s3://, gs://), from the driver and all executors."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wayfold.operators.joins import ancestors

NAME, SCHEMA = "wayfold_files", "path string, content binary"
_VERSIONS, _LISTS = "_versions", "_lists"


class CannotPublish(ValueError):
    """Rows that cannot all be files, or a write that another one overtook."""


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int
    list: str


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], uuid.uuid4().hex)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version: str):
        self.path, self.version = path, version

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.path)
        folder, made, lines, size = posixpath.join(root, self.version), set(), [], 0
        for batch in iterator:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, content = path.as_py(), content.as_py() or b""
                target = posixpath.join(folder, path)
                if (above := posixpath.dirname(target)) not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                with system.open_output_stream(target) as out:
                    out.write(content)
                lines.append(json.dumps({"path": path, "size": len(content), "sha256": hashlib.sha256(content).hexdigest()}))
                size += len(content)
        listed = posixpath.join(_LISTS, f"{uuid.uuid4().hex}.jsonl")
        system.create_dir(posixpath.join(folder, _LISTS), recursive=True)
        with system.open_output_stream(posixpath.join(folder, listed)) as out:
            out.write("".join(x + "\n" for x in lines).encode())
        return Written(len(lines), size, listed)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        done = [m for m in messages if m is not None]
        system.create_dir(posixpath.join(root, _VERSIONS), recursive=True)
        number = _latest(system, root)[0] + 1
        record = {"folder": self.version, "files": sum(m.files for m in done), "size": sum(m.size for m in done), "lists": [m.list for m in done]}
        target, draft = posixpath.join(root, _VERSIONS, f"{number:08d}.json"), posixpath.join(root, self.version, "_record.json")
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(record).encode())
        if system.get_file_info(target).type != fs.FileType.NotFound:
            raise CannotPublish(f"another write became version {number}")
        system.move(draft, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        folder = posixpath.join(root, self.version)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def _latest(system: fs.FileSystem, root: str) -> tuple[int, dict | None]:
    found = system.get_file_info(fs.FileSelector(posixpath.join(root, _VERSIONS), allow_not_found=True))
    records = sorted(f.path for f in found if f.path.endswith(".json"))
    if not records:
        return 0, None
    with system.open_input_stream(records[-1]) as f:
        return int(posixpath.basename(records[-1])[:-5]), json.loads(f.read())


def current(path: str) -> dict | None:
    """The record of what readers see: folder, files, size, lists; None before the first write."""
    return _latest(*_system(path))[1]


def publish(rows: DataFrame, path: str) -> None:
    """Write (path, content) as files of one new version. Raises CannotPublish, and writes nothing, if a path is no relative path below the folder, if two rows
    have one path, or if one path is a directory of another."""
    p = F.col("path")
    bad = rows.where(p.isNull() | (p == "") | p.startswith("/") | p.rlike(r"(^|/)\.{0,2}(/|\z)|\x00") | p.startswith("_"))
    twice = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    above = rows.select(F.explode(ancestors(F.concat(F.lit("/"), p))).alias("a")).distinct()
    nested = rows.join(above, F.concat(F.lit("/"), p) == F.col("a"), "left_semi")
    for what, found in (("no file name", bad), ("several rows", twice), ("a file and a directory", nested)):
        if first := found.select("path").head(1):
            raise CannotPublish(f"{first[0].path!r}: {what}")
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select("path", F.col("content").cast("binary").alias("content")).write.format(NAME).mode("append").option("path", path).save()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files of the current version."""
    record = current(path)
    schema = "path string, size long, sha256 string"
    if record is None or not record["lists"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/{record['folder']}/{x}" for x in record["lists"]])


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of the current version; empty ones, which Spark's reader leaves out, from their lists."""
    record = current(path)
    if record is None:
        return spark.createDataFrame([], SCHEMA)
    empty = listed(spark, path).where("size = 0").select("path", F.lit(b"").alias("content"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{record['folder']}")
    name = F.element_at(F.split("path", f"/{record['folder']}/", 2), 2)
    return files.where(F.col("length") > 0).select(name.alias("path"), "content").where(~F.col("path").startswith("_")).unionByName(empty)


def differing(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the current version whose file is missing, or is not what its list says."""
    there = contents(spark, path).select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    return listed(spark, path).exceptAll(there).select("path").union(there.exceptAll(listed(spark, path)).select("path")).distinct()


def blobs(rows: DataFrame, content: str, sha: str = "sha256") -> DataFrame:
    """(path, content) of binary contents by their hash, equal ones once. Fails on a row whose hash is another."""
    own = F.sha2(content, 256)
    told = F.when(F.col(sha) == own, own).otherwise(F.raise_error(F.concat(F.lit("contents are not "), F.col(sha))))
    return rows.where(F.col(content).isNotNull()).select(F.concat(F.lit("blobs/"), told).alias("path"), F.col(content).cast("binary").alias("content")).dropDuplicates(["path"])
