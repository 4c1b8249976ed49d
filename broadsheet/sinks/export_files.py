"""A data source that writes each row as a CSV file of its own."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "file_name"
FORMAT = "broadsheet_files"


@dataclass
class FilesWritten(WriterCommitMessage):
    files: int


def csv_text(columns: list[str], row: Row) -> str:
    """Header and one record; quotes doubled, a missing value is empty."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerow(["" if row[c] is None else row[c] for c in columns])
    return out.getvalue()


class FileWriter(DataSourceWriter):
    """Every task writes its rows' files; nothing passes through the driver but counts.

    A file is written under a passing name and then moved to its own, so a reader never
    sees half of one. Names and contents follow from the row alone: a task that runs twice
    leaves the same files. ``_SUCCESS`` comes when all tasks are done.
    """

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _folder(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, iterator: Iterator[Row]) -> FilesWritten:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        files = 0
        for row in iterator:
            passing = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(passing) as out:
                out.write(csv_text(self.columns, row).encode("utf-8"))
            system.move(passing, f"{folder}/{row[NAME]}")
            files += 1
        return FilesWritten(files)

    def commit(self, messages: list[FilesWritten | None]) -> None:
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())


class ExportFiles(DataSource):
    """``df.write.format("broadsheet_files").save(path)``; ``file_name`` names each row's file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if NAME not in schema.names:
            raise ValueError(f"rows need a column {NAME}")
        return FileWriter(self.options["path"], [c for c in schema.names if c != NAME])
