"""A data source of file digests: a partition is a file, read a block at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file held at a time.
BLOCK = 1 << 20


def opened(folder: str):
    """The file system of a folder and its path there; what has no scheme, or file:, is local."""
    from pyarrow import fs

    local = "://" not in folder and not folder.startswith("file:")
    return (fs.LocalFileSystem(), folder) if local else fs.FileSystem.from_uri(folder)


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DigestReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        system, base = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        return [OneFile(f.path[len(base.rstrip("/")) + 1 :]) for f in found if f.is_file]

    def read(self, partition: OneFile) -> Iterator[tuple[str, int, str]]:
        if partition is None:  # a folder without files
            return
        system, base = opened(self.folder)
        size, digest = 0, hashlib.sha256()
        with system.open_input_stream(f"{base.rstrip('/')}/{partition.path}") as stream:
            while block := stream.read(BLOCK):
                size += len(block)
                digest.update(block)
        yield partition.path, size, digest.hexdigest()


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options["path"].rstrip("/"))
