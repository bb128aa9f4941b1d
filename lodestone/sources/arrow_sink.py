"""Arrow IPC files as a Spark sink: each task writes a file of its own, which counts once all tasks are through.

Tasks write below `_temporary`, in a folder with a mark that the driver makes; commit moves the files of the successful ones into the folder, abort deletes them all, so a failed
job leaves nothing: a task that outlives it finds the mark gone and takes its file back. No rows pass the driver, which sees the names of files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def store(path: str):
    """(file system, path in it) of a path, with or without a scheme."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


_MARK = "_job"


def _there(files, path: str) -> bool:
    from pyarrow.fs import FileType

    return files.get_file_info(path).type != FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.job = uuid.uuid4().hex
        files, folder = store(path)
        files.create_dir(f"{folder}/_temporary/{self.job}", recursive=True)
        with files.open_output_stream(f"{folder}/_temporary/{self.job}/{_MARK}"):
            pass

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        task = TaskContext.get()
        files, folder = store(self.path)
        at = f"{folder}/_temporary/{self.job}"
        name, rows, writer = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.arrow", 0, None
        if not _there(files, f"{at}/{_MARK}"):
            raise FileNotFoundError(f"the job has been given up: {at}")
        with files.open_output_stream(f"{at}/{name}") as out:
            for x in iterator:
                writer = writer or pa.ipc.new_file(out, x.schema)
                writer.write_batch(x)
                rows += x.num_rows
            writer = writer or pa.ipc.new_file(out, to_arrow_schema(self.schema))  # a task without rows leaves the columns
            writer.close()
        if not _there(files, f"{at}/{_MARK}"):
            if _there(files, f"{at}/{name}"):
                files.delete_file(f"{at}/{name}")
            raise FileNotFoundError(f"the job has been given up: {at}")
        return Written(name, rows)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        files, folder = store(self.path)
        if self.overwrite:
            for x in files.get_file_info(FileSelector(folder)):
                if x.base_name.endswith(".arrow"):
                    files.delete_file(x.path)
        for m in messages:
            if m is not None:
                files.move(f"{folder}/_temporary/{self.job}/{m.name}", f"{folder}/{m.name}")
        self._clear(files, folder)
        with files.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self._clear(*store(self.path))

    def _clear(self, files, folder: str) -> None:
        from pyarrow.fs import FileSelector, FileType

        for again in range(9, -1, -1):  # a task may still open its file meanwhile
            if files.get_file_info(f"{folder}/_temporary/{self.job}").type != FileType.Directory:
                break
            try:
                files.delete_dir(f"{folder}/_temporary/{self.job}")
            except OSError:
                if not again:
                    raise
        at = f"{folder}/_temporary"
        if files.get_file_info(at).type == FileType.Directory and not files.get_file_info(FileSelector(at)):
            files.delete_dir(at)


class ArrowSink(DataSource):
    """format("lodestone_arrow"), option path."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_arrow"

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)
