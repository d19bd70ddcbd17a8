"""A sink of documents at paths of their own, for readers that open a file by its name."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What is being written ends with this and a name of its own until it is whole.
PENDING = ".pending-"


@dataclass
class Written(WriterCommitMessage):
    files: int


def safe(path: str) -> str:
    """The path, if it stays below the sink's folder."""
    if not path or path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"not a path of a document: {path!r}")
    return posixpath.normpath(path)


class DocumentWriter(DataSourceWriter):
    """Rows (path, value) of a task that follow each other with one path are the lines of one file.  A file is written under
    another name and moved when it is whole, so a reader never sees a part, and a task that runs again replaces it."""

    def __init__(self, root: str) -> None:
        self.root, self.job = root, uuid.uuid4().hex

    def _place(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = self._place()
        attempt, open_, at, n = uuid.uuid4().hex, None, None, 0

        def close() -> None:
            if open_ is not None:
                open_.close()
                files.move(f"{base}/{at}{PENDING}{self.job}-{attempt}", f"{base}/{at}")

        for row in iterator:
            path = safe(row["path"])
            if path != at:
                close()
                at, n = path, n + 1
                files.create_dir(posixpath.dirname(f"{base}/{at}"), recursive=True)
                open_ = files.open_output_stream(f"{base}/{at}{PENDING}{self.job}-{attempt}", compression=None)
            open_.write(f"{row['value']}\n".encode())
        close()
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Without what tasks of this job left unfinished."""
        from pyarrow import fs

        files, base = self._place()
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and f"{PENDING}{self.job}" in info.path:
                files.delete_file(info.path)


class Documents(DataSource):
    """format("documents"): a folder of documents; option path: where, as a path or URI that Arrow's file systems know and all
    executors share."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_documents(lines: DataFrame, root: str) -> None:
    """Write lines (path, line, value): each path below root becomes one file of its lines in order.  A document's lines
    stream through one task, which holds one at a time; documents of earlier runs under other paths stay."""
    lines.sparkSession.dataSource.register(Documents)
    rows = lines.repartition("path").sortWithinPartitions("path", "line").select("path", "value")
    rows.write.format("documents").mode("append").option("path", root).save()
