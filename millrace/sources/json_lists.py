"""Files that each hold one JSON array of rows, as a data source: one partition a file, and writes that commit or leave nothing."""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.sources.scratch import importable_on_workers

CORRUPT = "_corrupt_record"


@dataclass
class JsonFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class JsonLists(DataSource):
    """``json_lists``: options ``path``, a folder's URI, and the reader's schema.

    A file is a JSON array of objects, or one object. Fields that a row lacks are null, others are ignored. A file that is
    no JSON, and an item that is no object, give one row of nulls whose ``_corrupt_record``, if the schema has it, is the
    text; without that column they give none.
    """

    @classmethod
    def name(cls) -> str:
        return "json_lists"

    def reader(self, schema: StructType) -> "JsonListReader":
        return JsonListReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> "JsonListWriter":
        return JsonListWriter(self.options["path"], schema, overwrite)


class JsonListReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()

    def partitions(self) -> list[JsonFile]:
        store, root = arrow_fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [JsonFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith((".", "_"))]

    def read(self, partition: JsonFile) -> Iterator[tuple]:
        if not isinstance(partition, JsonFile):  # what a folder without files gives
            return
        store, _ = arrow_fs.FileSystem.from_uri(self.path)
        text = store.open_input_file(partition.path).readall().decode("utf-8", "replace")
        try:
            items = json.loads(text)
        except ValueError:
            items = [None]
        for item in items if isinstance(items, list) else [items]:
            if isinstance(item, dict):
                yield tuple(item.get(n) for n in self.names)
            elif CORRUPT in self.names:
                yield tuple((text if item is None else json.dumps(item)) if n == CORRUPT else None for n in self.names)


class JsonListWriter(DataSourceWriter):
    """Each task streams its rows to a hidden file; the files get their names when all tasks are done, or are deleted."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.fieldNames(), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        task = TaskContext.get()
        store, root = arrow_fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        path, rows = f"{root}/.part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}.json", 0
        with store.open_output_stream(path) as out:
            for row in iterator:
                item = dict(zip(self.names, (v.asDict(True) if hasattr(v, "asDict") else v for v in row), strict=True))
                out.write(((",\n" if rows else "[\n") + json.dumps(item, ensure_ascii=False, default=str)).encode())
                rows += 1
            out.write(b"\n]\n" if rows else b"[]\n")
        return Written(path, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = arrow_fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for old in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
                if old.is_file and old.base_name.startswith("part-"):
                    store.delete_file(old.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(m.path, f"{root}/{m.path.rsplit('/', 1)[1][1:]}")
            elif m is not None:
                store.delete_file(m.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes the hidden files of this write, those of failed attempts included; committed files stay."""
        store, root = arrow_fs.FileSystem.from_uri(self.path)
        for f in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(".part-") and self.job in f.base_name:
                store.delete_file(f.path)


def _registered(spark: SparkSession) -> None:
    importable_on_workers(spark)
    spark.dataSource.register(JsonLists)


def read_json_lists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all files below ``path``; see :class:`JsonLists`."""
    _registered(spark)
    return spark.read.format("json_lists").schema(schema).option("path", path).load()


def write_json_lists(rows: DataFrame, path: str, mode: str = "append") -> None:
    """One file for each partition of ``rows`` that has any, or none at all if a task fails for good."""
    _registered(rows.sparkSession)
    rows.write.format("json_lists").option("path", path).mode(mode).save()
