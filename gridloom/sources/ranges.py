"""Byte ranges of files in any file system that the session knows.

Tasks open what their own process can reach: local and shared folders, and object stores that pyarrow knows by scheme. Everything
else, the driver's JVM reaches through Spark's own file systems; it reads headers and small windows, and for the rest Spark
reads whole files on the executors.
"""

from __future__ import annotations

import os
import re
from typing import Any

from pyspark.sql import SparkSession

#: Schemes that a task opens by itself, and how many bytes of a file the driver reads for one window.
TASK_SCHEMES, WINDOW_BYTES = ("s3", "gs", "gcs", "abfs", "abfss"), 64 << 20
#: Bytes that a header read takes at a time.
HEAD_BYTES = 64 << 10


def scheme(path: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    return m[1].lower() if m and len(m[1]) > 1 else ""


def local_path(path: str) -> str:
    """A path of this machine, or of a folder that all machines mount."""
    return re.sub("^file:/+", "/", path)


def opens_in_tasks(path: str) -> bool:
    return scheme(path) in ("", "file", *TASK_SCHEMES)


class Ranges:
    """A file's byte ranges; ``taken`` counts the bytes read."""

    def __init__(self, path: str):
        self.path, self.taken = path, 0
        if scheme(path) in TASK_SCHEMES:
            from pyarrow import fs

            system, name = fs.FileSystem.from_uri(path.replace("gcs://", "gs://", 1))
            self.file: Any = system.open_input_file(name)
        else:
            self.file = open(local_path(path), "rb")  # noqa: SIM115  closed by close()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.taken += len(data)
        return data

    def close(self) -> None:
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


class SessionRanges(Ranges):
    """Byte ranges by the session's file systems, on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.taken, self.spark = path, 0, spark
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(self.spark._jvm.org.apache.commons.io.input.BoundedInputStream(self.file, n))) if n else b""
        self.taken += len(data)
        return data


class SessionWriter:
    """A new file in the session's file systems, written on the driver from its beginning to its end, and there once it's whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.own = spark, path, scheme(path) in ("", "file")
        if self.own:
            os.makedirs(os.path.dirname(os.path.abspath(local_path(path))), exist_ok=True)
            self.file: Any = open(local_path(path) + ".part", "wb")  # noqa: SIM115  closed by close()
        else:
            self.to, self.part = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
            self.system = self.to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            self.file = self.system.create(self.part, True)

    def write(self, data: bytes) -> None:
        self.file.write(data if self.own else bytearray(data))

    def close(self) -> None:
        self.file.close()
        if self.own:
            os.replace(local_path(self.path) + ".part", local_path(self.path))
        else:
            self.system.delete(self.to, False)
            self.system.rename(self.part, self.to)


def exists(spark: SparkSession, path: str) -> bool:
    if scheme(path) in ("", "file"):
        return os.path.exists(local_path(path))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def open_ranges(path: str, spark: SparkSession | None = None) -> Ranges:
    return Ranges(path) if opens_in_tasks(path) or spark is None else SessionRanges(spark, path)
