"""Files of a store through Hadoop's file systems, so a store lies wherever Spark can write."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """List, read, move, delete and exclusively create small files of one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, at: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def list(self, at: str) -> list[tuple[str, int, bool]]:
        """(name, bytes, is a folder) of what a folder holds; nothing if it does not exist."""
        path = self._path(at)
        if not self.fs.exists(path):
            return []
        return sorted((s.getPath().getName(), int(s.getLen()), bool(s.isDirectory())) for s in self.fs.listStatus(path))

    def exists(self, at: str) -> bool:
        return bool(self.fs.exists(self._path(at)))

    def read(self, at: str) -> str:
        stream = self.fs.open(self._path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, at: str, text: str) -> None:
        stream = self.fs.create(self._path(at), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def create(self, at: str, text: str) -> bool:
        """Create a file with its whole content, or return False because it exists.

        The content is complete before the name appears.  On local disks the name
        is a hard link, which only one writer can make; elsewhere the file system's
        rename without overwriting decides.
        """
        folder, name = at.rsplit("/", 1)
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.write(draft, text)
        if self.fs.getScheme() == "file":
            plain = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(plain(draft), plain(at))
                return True
            except FileExistsError:
                return False
            finally:
                self.delete(draft)
        if self.exists(at) or not self.fs.rename(self._path(draft), self._path(at)):
            self.delete(draft)
            return False
        return True

    def move(self, a: str, b: str) -> None:
        if not self.fs.rename(self._path(a), self._path(b)):
            raise OSError(f"cannot move {a} to {b}")

    def delete(self, at: str) -> None:
        self.fs.delete(self._path(at), True)

    def make(self, at: str) -> None:
        self.fs.mkdirs(self._path(at))
