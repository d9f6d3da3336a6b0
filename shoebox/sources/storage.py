"""File access: through Hadoop on the driver (small control files), through Arrow inside tasks."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


class ControlFiles:
    """The few small files the driver itself reads and writes."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def is_dir(self, path: str) -> bool:
        target = self._path(path)
        return self._fs.exists(target) and self._fs.getFileStatus(target).isDirectory()

    def is_file(self, path: str) -> bool:
        target = self._path(path)
        return self._fs.exists(target) and self._fs.getFileStatus(target).isFile()

    def names(self, folder: str) -> list[str]:
        if not self.is_dir(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file; fails if it exists, so two writers cannot both win a name."""
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()


def plain(path: str) -> str:
    """The one spelling of a path: local ones absolute and without scheme, others as they are."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if urlparse(path).scheme and "://" in path else os.path.abspath(os.path.expanduser(path))


def locate(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a file name or URI, without decoding special characters."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        path = uri[len("file:"):] if parsed.scheme else uri
        return arrow_fs.LocalFileSystem(), "/" + path.lstrip("/")
    scheme = "s3" if parsed.scheme in ("s3a", "s3n") else parsed.scheme
    system, base = arrow_fs.FileSystem.from_uri(f"{scheme}://{parsed.netloc}/")
    rest = uri.split("://", 1)[1].split("/", 1)[1]
    return system, f"{base.rstrip('/')}/{rest}" if base.strip("/") else rest
