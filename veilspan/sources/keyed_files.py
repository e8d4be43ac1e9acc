"""A sink that writes one file for each row, under the row's own name: ``spark.write.format("keyed_files")``.

Rows are ``name string, content string``; a name may hold folders.  A task writes every file beside its place under a name of its own and
moves it there when it is whole, so a reader never sees half a file, and an attempt that runs twice
puts the same file in place again.  Nothing but a count goes to the driver.  Paths are opened with ``pyarrow.fs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "keyed_files"


@dataclass
class Written(WriterCommitMessage):
    files: int


class KeyedFileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = fs.FileSystem.from_uri(self.path)
        made, count = set(), 0
        for row in iterator:
            parts = row.name.split("/")
            if not row.name or row.content is None or {"", ".", ".."} & set(parts):
                raise ValueError(f"no file can be written for {row.name!r}")
            folder = "/".join([base, *parts[:-1]])
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            draft = f"{folder}/_{uuid.uuid4().hex}"
            try:
                with files.open_output_stream(draft) as out:
                    out.write(row.content.encode())
                files.move(draft, f"{folder}/{parts[-1]}")
            except BaseException:
                if files.get_file_info(draft).type != fs.FileType.NotFound:
                    files.delete_file(draft)
                raise
            count += 1
        return Written(count)

    def commit(self, messages) -> None:
        files, base = fs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages) -> None:
        """Files in place are whole; without ``_SUCCESS`` the folder is not."""


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> KeyedFileWriter:
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("columns must be name and content")
        return KeyedFileWriter(self.options["path"])


def write_keyed(df: DataFrame, path: str) -> None:
    """Write ``name, content`` rows; two rows of one name leave one of them."""
    df.sparkSession.dataSource.register(KeyedFiles)
    df.select("name", "content").write.format(FORMAT).mode("append").save(path)
