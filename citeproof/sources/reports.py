"""A sink for reports: one file a document, all of them published at once or none."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def file_name(doc_id: str, extension: str) -> str:
    """The last part of a document's path, and a hash of the whole, as names may repeat in other folders."""
    last = re.sub(r"[^\w.\-]+", "_", re.split(r"[/\\]", doc_id.rstrip("/\\"))[-1])[:80]
    return f"{last}-{hashlib.sha256(doc_id.encode()).hexdigest()[:10]}{extension}"


def _files(path: str):
    """The file system of a path, and the path there; the same on the driver and in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^\w+://?", path) else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files (name in the staging folder, name) of a task that is done."""

    files: list[tuple[str, str]]


class ReportWriter(DataSourceWriter):
    """Tasks write below a staging folder of the job's own; the driver moves the files of the tasks that counted."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.extension, self.overwrite = options["path"].rstrip("/"), options.get("extension", ".md"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        # Made here and never by a task, so that one that still runs when the job is aborted can't bring it back.
        system, staging = _files(self.staging)
        system.create_dir(staging, recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        files, (system, staging) = [], _files(self.staging)
        context = TaskContext.get()
        # Attempts of one task never share a file.
        own = f"{staging}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(own, recursive=False)
        for doc_id, text in rows:
            name = file_name(doc_id, self.extension)
            with system.open_output_stream(f"{own}/{name}") as out:
                out.write((text or "").encode())
            files.append((f"{own}/{name}", name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _files(self.path)
        new = [f for m in messages if m for f in m.files]
        names = {name for _, name in new}
        if len(names) < len(new):
            self.abort(messages)
            raise ValueError("a document has several reports")
        if self.overwrite:
            from pyarrow.fs import FileSelector

            # The new files first: a reader finds each report, in its old or its new form, at any time.
            for staged, name in new:
                system.move(staged, f"{path}/{name}")
            for f in system.get_file_info(FileSelector(path)):
                if f.is_file and f.base_name.endswith(self.extension) and f.base_name not in names:
                    system.delete_file(f.path)
        else:
            for staged, name in new:
                system.move(staged, f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of a failed job stays, whichever of its tasks were done."""
        system, staging = _files(self.staging)
        from pyarrow.fs import FileType

        if system.get_file_info(staging).type != FileType.NotFound:
            system.delete_dir(staging)


class Reports(DataSource):
    """format("reports"): rows (doc_id string, text string) to files below path; option extension, .md by default."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "doc_id string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options, overwrite)


def write_reports(texts: DataFrame, path: str, extension: str = ".md", mode: str = "append") -> None:
    """texts (doc_id, text) as one file a document below path; in mode overwrite other reports of this extension go.

    The path must be one that the driver and all executors share. A job that fails publishes nothing and leaves nothing.
    """
    spark = texts.sparkSession
    spark.dataSource.register(Reports)
    texts.selectExpr("cast(doc_id as string) as doc_id", "text").write.format("reports").mode(mode).option("extension", extension).save(path)
