"""Arrow IPC files (Feather), with list columns and any names, as a data source: a partition for each file read, a file for each task written."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME, ENDING = "arrow_ipc", ".arrow"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it; a path without a scheme is a local or mounted one."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files of a folder in order, or the one file; those that begin with a point or line are unfinished."""
    store, at = located(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [at]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(ENDING) and x.base_name[0] not in "._")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        return [_File(x) for x in listed(self.path)] or [_File("")]

    def read(self, partition):
        wanted = to_arrow_schema(self.schema)
        if not partition.path:
            return
        store, _ = located(self.path)
        with store.open_input_file(partition.path) as f, pa.ipc.open_file(f) as file:
            for k in range(file.num_record_batches):  # a batch at a time
                batch = file.get_batch(k)
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(wanted.field(n).type) for n in wanted.names], schema=wanted)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator):
        store, at = located(self.path)
        store.create_dir(at, recursive=True)
        path, schema = f"{at}/_{uuid.uuid4().hex}{ENDING}", to_arrow_schema(self.schema)
        with store.open_output_stream(path) as f, pa.ipc.new_file(f, schema) as out:
            for batch in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.columns, schema, strict=True)], schema=schema))
        return _Written(path)

    def commit(self, messages):
        """Only now do the files get the names under which they are read; what a failed task wrote never does."""
        store, _ = located(self.path)
        for k, m in enumerate(messages):
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                store.move(m.path, f"{folder}/part-{k:05d}-{name[1:]}")

    def abort(self, messages):
        store, _ = located(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        path = self.options["path"]
        files = listed(path)
        if not files:
            raise ValueError(f"no {ENDING} file in {path}; state a schema")
        with located(path)[0].open_input_file(files[0]) as f, pa.ipc.open_file(f) as file:
            return from_arrow_schema(file.schema)

    def reader(self, schema):
        return _Reader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        if overwrite:
            store, at = located(self.options["path"])
            if store.get_file_info(at).type == fs.FileType.Directory:
                store.delete_dir_contents(at)
        return _Writer(self.options["path"], schema)


def write_arrow(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format(NAME).mode("append").save(path)


def read_arrow(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format(NAME)
    return (reader.schema(schema) if schema else reader).load(path)
