"""A file per row: notes and pages in folders, as a crawl leaves them."""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class RowFiles(DataSource):
    """Sink ``row_files``: rows (path string, content binary) become files under the folder.

    A file is written beside its place and then moved there, so it is whole or not there,
    and a task that runs again writes the same files again.  Paths must be distinct.
    """

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RowFileWriter(self.options["path"])


class RowFileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows) -> WriterCommitMessage:
        from pyarrow import fs

        # any shared file system: the folder of a local session is written file:/x
        system, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.root))
        folders = set()
        for row in rows:
            path = f"{root}/{row['path']}"
            folder = path.rsplit("/", 1)[0]
            if folder not in folders:
                system.create_dir(folder, recursive=True)
                folders.add(folder)
            draft = f"{path}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(draft) as out:
                out.write(bytes(row["content"] or b""))
            system.move(draft, path)
        return WriterCommitMessage()


def write_row_files(df: DataFrame, root: str) -> None:
    """Write rows (path, content) as files under a folder; a NULL content is an empty file,
    which Spark's file readers pass over."""
    spark = df.sparkSession
    spark.dataSource.register(RowFiles)
    df.selectExpr("cast(path as string) as path", "cast(content as binary) as content").write.format("row_files").mode("append").save(root)


class Notes(DataSource):
    """Source ``row_files_read``: the files under a folder as (path, content, modified).

    The driver lists no files: a task lists the folders and reads the files whose name
    falls to it, so that it holds one note at a time whatever their number.
    """

    @classmethod
    def name(cls) -> str:
        return "row_files_read"

    def schema(self) -> str:
        return "path string, content string, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return NotesReader(self.options["path"], self.options["suffix"], int(self.options["parts"]))


class NotesReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, parts: int):
        self.root, self.suffix, self.parts = root, suffix, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.root))
        folders = [root]
        while folders:
            for info in system.get_file_info(fs.FileSelector(folders.pop())):
                if info.type == fs.FileType.Directory:
                    folders.append(info.path)
                elif info.base_name.endswith(self.suffix) and not info.base_name.startswith(("_", ".")):
                    if info.size and zlib.crc32(info.path.encode()) % self.parts == partition.value:
                        with system.open_input_stream(info.path) as file:
                            yield info.path, file.read().decode("utf-8", "replace"), info.mtime.astimezone(dt.timezone.utc)


def read_row_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, content, modified) of the files under a folder whose names end so, subfolders included; empty files are passed over."""
    spark.dataSource.register(Notes)
    parts = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("row_files_read").options(suffix=suffix, parts=parts).load(root)
