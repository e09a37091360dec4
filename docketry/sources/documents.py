"""A Spark data source that writes one text file for each row: all of a job's files appear when it commits, or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "document_files"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def opened(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class DocumentWriter(DataSourceWriter):
    """Tasks write under a folder of the job; the commit moves the files to their places, an abort takes the folder away.

    A task that is run again writes its files anew; only the files of attempts that Spark commits are moved. What a task writes that is killed
    after the abort stays in the job's folder, whose name readers pass over.
    """

    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    @property
    def staged(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, attempt = [], uuid.uuid4().hex
        for row in iterator:
            system, target = opened(f"{self.staged}/{attempt}/{row['file']}")
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as out:
                out.write((row["text"] or "").encode())
            files.append(f"{attempt}/{row['file']}")
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for message in filter(None, messages):
            for file in message.files:
                system, source = opened(f"{self.staged}/{file}")
                _, target = opened(f"{self.path}/{file.split('/', 1)[1]}")
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                system.move(source, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        system, folder = opened(self.staged)
        if system.get_file_info(folder).type == FileType.Directory:
            system.delete_dir(folder)


class DocumentFiles(DataSource):
    """Format `document_files`, write only: columns `file` (a path below the target) and `text`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if not {"file", "text"} <= set(schema.names):
            raise ValueError("document_files takes the columns file and text")
        return DocumentWriter(self.options["path"])


def write_documents(rows: DataFrame, path: str) -> None:
    """One file a row, in place of files of the same names; rows: file, text. A file name stands in one row only."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(DocumentFiles)
    rows.select("file", "text").write.format(FORMAT).mode("append").save(path)
