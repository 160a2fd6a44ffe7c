"""A sink of one file for each row, as a Spark data source: tasks write into a folder beside the target, the commit renames it as a whole.

Rows are (name, content): a path below the target and the file's bytes. A name is written to a
temporary file and renamed, so a task that is run again, or twice at once, leaves the same
file. Nothing is at the target before the commit, and an abort leaves nothing behind. The
target may be any place that Arrow's file systems reach (a path, file://, hdfs://, s3://), and
must be the same place for the driver and the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .contracts import InvalidInput

NAME, SCHEMA = "one_file_each", "name string, content binary"


@dataclass
class _Written(WriterCommitMessage):
    files: int


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    return system, path.rstrip("/")


def _put(system: fs.FileSystem, top: str, name: str, content: bytes) -> None:
    if name.startswith("/") or ".." in name.split("/"):
        raise InvalidInput(f"outside of the target: {name}")
    path = f"{top}/{name}"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        (system, top), files = _place(self.staging), 0
        for batch in iterator:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                _put(system, top, name.as_py(), content.as_py() or b"")
                files += 1
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        """The rows are in the staging folder; publish() does the rest."""

    def abort(self, messages: list[_Written | None]) -> None:
        _remove(self.staging)


class OneFileEach(DataSource):
    """Write-only; the option `staging` names the folder that tasks write into."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["staging"])


def _remove(uri: str) -> None:
    system, path = _place(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def exists(uri: str) -> bool:
    system, path = _place(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def publish(spark: SparkSession, files: DataFrame, target: str, more: dict[str, Callable[[], Iterator[str]]] | None = None, replace: bool = False) -> None:
    """Writes files (name, content) to a new folder at the target, all or nothing.

    `more` are files that the driver writes before the commit, line by line: name and what
    yields its pieces. A name that comes twice is refused. With `replace` an older folder is
    moved away before and removed after the new one is in its place.
    """
    files = files.selectExpr("CAST(name AS STRING) AS name", "CAST(content AS BINARY) AS content")
    if twice := files.groupBy("name").count().where("count > 1 OR name IS NULL").limit(1).collect():
        raise InvalidInput(f"more than one file of a name: {twice[0]['name']}")
    if not replace and exists(target):
        raise InvalidInput(f"exists: {target}")
    mark = uuid.uuid4().hex
    staging, old = f"{target.rstrip('/')}.staging-{mark}", f"{target.rstrip('/')}.old-{mark}"
    (system, top), (_, path), (_, away) = _place(staging), _place(target), _place(old)
    spark.dataSource.register(OneFileEach)
    try:
        system.create_dir(top, recursive=True)
        files.write.format(NAME).option("staging", staging).mode("append").save()
        for name, pieces in (more or {}).items():
            with system.open_output_stream(f"{top}/{name}") as out:
                for piece in pieces():
                    out.write(piece.encode())
        if exists(target):
            system.move(path, away)
        system.move(top, path)
    finally:
        _remove(staging)
        if exists(target):
            _remove(old)
