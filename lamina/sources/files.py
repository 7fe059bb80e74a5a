"""Small driver-side file operations through Hadoop's file system API, so any store that Spark knows works."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """Files under one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def is_mounted(self) -> bool:
        """Whether the root is a folder of the machines themselves, which plain file operations reach."""
        return self._fs.getScheme() == "file"

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, name: str) -> list[str]:
        """Names of the children of a folder, sorted; none if it does not exist."""
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create_text(self, name: str, text: str) -> None:
        """Publish a new file whole or not at all; of several writers of one name one wins, the others get FileExistsError.

        The text goes to a draft of its own name first. In a local file system, where renaming replaces, a hard
        link claims the name; elsewhere a rename that refuses to replace, which HDFS does in one step. A store
        without such a rename (an object store) needs one writer.
        """
        draft = f".{name}.{uuid.uuid4().hex}.draft"
        self.write_text(draft, text)
        try:
            if self.is_mounted:
                os.link(self._path(draft).toUri().getPath(), self._path(name).toUri().getPath())
            else:
                self._rename(draft, name)
        finally:
            self._fs.delete(self._path(draft), False)

    def _rename(self, old: str, new: str) -> None:
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(old), self._path(new), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise FileExistsError(new) from error
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
