"""A data source that digests files of any size in pieces: no file is ever in one row or in memory as a whole.

    spark.dataSource.register(FileDigests)
    spark.read.format("file_digests").load(folder)

Files are listed once on the driver (names and sizes only) and dealt to tasks by size. Every task reads its files through Arrow's file systems, which know local folders, HDFS and object
stores by their URI, CHUNK bytes at a time and in order. A file is digested by one task, since a digest is a fold over its bytes.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
#: Files of a task, and bytes after which it takes no more.
MAX_FILES, MAX_BYTES = 1000, 1 << 30


def pieces(stream, size: int = CHUNK) -> Iterator[bytes]:
    while piece := stream.read(size):
        yield piece


def digests(chunks: Iterator[bytes]) -> tuple[str, str, int]:
    """SHA-256 of the bytes; of the same with every kind of line end as \\n if they are valid UTF-8, else again of the bytes; and their number.

    A piece may end within a character, or between the two bytes of a line end.
    """
    raw, text, size = hashlib.sha256(), hashlib.sha256(), 0
    valid: codecs.IncrementalDecoder | None = codecs.getincrementaldecoder("utf-8")()
    open_end = b""
    for chunk in chunks:
        raw.update(chunk)
        size += len(chunk)
        if valid is None:
            continue
        try:
            valid.decode(chunk)
        except UnicodeDecodeError:
            valid = None
            continue
        chunk = open_end + chunk
        open_end = b"\r" if chunk.endswith(b"\r") else b""
        text.update(chunk[: len(chunk) - len(open_end)].replace(b"\r\n", b"\n").replace(b"\r", b"\n"))
    if valid is not None:
        try:
            valid.decode(b"", final=True)
        except UnicodeDecodeError:
            valid = None
    text.update(b"\n" if open_end else b"")
    return raw.hexdigest(), text.hexdigest() if valid is not None else raw.hexdigest(), size


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.chunk = options["path"], int(options.get("chunk", CHUNK))

    def _open(self) -> tuple[fs.FileSystem, str]:
        uri = "file://" + self.uri.removeprefix("file:") if self.uri.startswith("file:/") and not self.uri.startswith("file://") else self.uri
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def partitions(self) -> list[Files]:
        files, top = self._open()
        found = files.get_file_info(top)
        infos = [found] if found.is_file else files.get_file_info(fs.FileSelector(top, recursive=True))
        parts, own, size = [], [], 0
        for info in sorted((i for i in infos if i.is_file), key=lambda i: i.path):
            if own and (len(own) >= MAX_FILES or size + info.size > MAX_BYTES):
                parts.append(Files(own))
                own, size = [], 0
            own.append(info.path)
            size += info.size
        return [*parts, Files(own)] if own else [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, top = self._open()
        for path in partition.paths:
            with files.open_input_stream(path, compression=None) as stream:
                raw, text, size = digests(pieces(stream, self.chunk))
            yield path.removeprefix(top.rstrip("/") + "/"), size, raw, text


class FileDigests(DataSource):
    """path (below the folder; the whole path of a single file), length, sha256 and canonical_sha256. Options: path, chunk (bytes read at a time)."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, length long, sha256 string, canonical_sha256 string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def file_digests(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("chunk", chunk).load(folder)
