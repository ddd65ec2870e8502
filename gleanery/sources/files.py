"""A data source of whole files: one named file a row on writing, one row a file on reading.

    spark.dataSource.register(NamedFiles)
    df.select("name", "content").write.format("gleanery").mode("append").save(folder)
    spark.read.format("gleanery").option("kinds", "md,json").load(folder)

Tasks write into a folder of the job's own; commit moves all files to their names, abort removes the folder, so a job that fails leaves nothing. Reading deals the files by size and
opens only those of the kinds (extensions) asked for. Folders are opened through pyarrow (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAGING = "_gleanery"


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def kind_of(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FilesReader(DataSourceReader):
    def __init__(self, folder: str, most: int, kinds: set[str]):
        self.folder, self.most, self.kinds = folder, most, kinds

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, base = opened(self.folder)
        found = []
        for i in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            name = posixpath.relpath(i.path, base)
            if i.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in name.split("/")) and (not self.kinds or kind_of(name) in self.kinds):
                found.append((name, i.size))
        parts, size = [Files([])], 0
        for name, n in sorted(found):
            if parts[-1].names and size + n > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append((name, n))
            size += n
        return parts

    def read(self, partition: Files) -> Iterator[tuple]:
        system, base = opened(self.folder)
        for name, size in partition.names:
            with system.open_input_stream(posixpath.join(base, name)) as f:
                yield name, kind_of(name), size, f.read()


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, schema, overwrite: bool):
        self.folder, self.at, self.overwrite, self.job = folder, {c.lower(): i for i, c in enumerate(schema.names)}, overwrite, uuid.uuid4().hex
        if not {"name", "content"} <= set(self.at):
            raise ValueError("the rows need the columns name and content")

    def staging(self, base: str) -> str:
        return posixpath.join(base, STAGING, self.job)

    def write(self, iterator) -> Written:
        system, base = opened(self.folder)
        mine, done = posixpath.join(self.staging(base), uuid.uuid4().hex), []
        for row in iterator:
            name, content = row[self.at["name"]], row[self.at["content"]]
            if not name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
                raise ValueError(f"no name for a file within the folder: {name!r}")
            to = posixpath.join(mine, name)
            system.create_dir(posixpath.dirname(to), recursive=True)
            with system.open_output_stream(to) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            done.append(posixpath.relpath(to, self.staging(base)))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.folder)
        made = [n for m in messages if m is not None for n in m.names]
        finals = [n.split("/", 1)[1] for n in made]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise ValueError("two rows name one file")
        if self.overwrite:
            for i in system.get_file_info(self.selector(base)):
                if posixpath.basename(i.path) != STAGING:
                    (system.delete_dir if i.is_file is False else system.delete_file)(i.path)
        for n, final in zip(made, finals, strict=True):
            to = posixpath.join(base, final)
            system.create_dir(posixpath.dirname(to), recursive=True)
            system.move(posixpath.join(self.staging(base), n), to)
        self.abort(messages)

    def abort(self, messages) -> None:
        system, base = opened(self.folder)
        for folder in (self.staging(base), posixpath.join(base, STAGING)):
            info = system.get_file_info(folder)
            if info.type.name == "Directory" and (folder.endswith(self.job) or not system.get_file_info(self.selector(folder))):
                system.delete_dir(folder)

    @staticmethod
    def selector(folder: str):
        from pyarrow import fs

        return fs.FileSelector(folder, recursive=False, allow_not_found=True)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gleanery"

    def schema(self) -> str:
        return "name string, kind string, size bigint, content binary"

    def reader(self, schema) -> FilesReader:
        kinds = {k.strip().lower() for k in self.options.get("kinds", "").split(",") if k.strip()}
        return FilesReader(self.options["path"], int(self.options.get("maxPartitionBytes", 128 << 20)), kinds)

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], schema, overwrite)
