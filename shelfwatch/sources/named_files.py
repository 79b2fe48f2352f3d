"""A sink for files of given names: df.write.format("named_files").mode("append").save(folder) for rows (file_name, text).

Spark's writers name files themselves. Here executors write each row to a file in a staging folder below the target, by
the file system that the folder's URI names, and tell the driver names only; its commit renames the files into place, one
after the other, over earlier ones of the same name. A job that fails, or is abandoned, leaves no file: staged ones are
removed, and those of a task that was run again are staged under another name. The folder has to be one that driver and
executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = ".staging-"


def opened(folder: str):
    """(file system, path in it) of a folder given as a path or URI."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


@dataclass
class Staged(WriterCommitMessage):
    """(name, staged path) of what a task has written."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def place(self) -> str:
        return f"{opened(self.folder)[1]}/{STAGING}{self.job}"

    def write(self, iterator: Iterator) -> Staged:
        system, _ = opened(self.folder)
        task, files = f"{self.place()}/{uuid.uuid4().hex}", []
        for row in iterator:
            name, text = row[0], row[1]
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"no file name: {name!r}")
            if not files:
                system.create_dir(task, recursive=True)
            files.append((name, at := f"{task}/{len(files)}"))
            with system.open_output_stream(at) as out:
                out.write((text or "").encode())
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.folder)
        for m in messages:
            for name, at in m.files if m else ():
                system.move(at, f"{root}/{name}")
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        system, _ = opened(self.folder)
        if system.get_file_info(self.place()).type == fs.FileType.Directory:
            system.delete_dir(self.place())


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file_name string, text string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write(files: DataFrame, folder: str) -> None:
    """(file_name, text) as files of just these names in a folder, replacing earlier ones. Of several rows of a name the one of the greatest text is kept, so a run that is repeated leaves the same."""
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    one = files.groupBy("file_name").agg({"text": "max"}).toDF("file_name", "text")
    one.write.format("named_files").mode("append").save(folder)
