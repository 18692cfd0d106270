"""Small files on any file system Spark can reach."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names below ``path`` in order; none if it doesn't exist."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def directories(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, path: str, text: str) -> bool:
        """Write a file that isn't there yet; False if another writer was first."""
        fs, p = self._at(path)
        if fs.getScheme() == "file":  # there, Hadoop looks and creates in two steps
            local = p.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
            except FileExistsError:
                return False
            with os.fdopen(handle, "wb") as out:
                out.write(text.encode())
            return True
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def modified(self, path: str) -> float:
        """When ``path`` was written, in seconds."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def read_bytes(self, path: str) -> bytes:
        return bytes(self.spark.read.format("binaryFile").load(path).select("content").first()[0])
