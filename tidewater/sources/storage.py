"""Small files and listings through Hadoop's file systems, so that any path that Spark reads will do."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidewater.functions.paths import join


class Exists(FileExistsError):
    """Another writer has created the file."""


@dataclass(frozen=True)
class Found:
    path: str
    name: str
    size: int
    modified: int


class Storage:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/") or "/"
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        # built from its parts, as a string with % or : would be taken apart
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def full(self, relative: str) -> str:
        return relative if relative.startswith("/") or ":/" in relative else join(self.base, relative)

    def exists(self, relative: str) -> bool:
        return self._fs.exists(self._path(self.full(relative)))

    def list(self, relative: str) -> list[Found]:
        """Files of one directory, by name; none if it is missing."""
        at = self._path(self.full(relative))
        if not self._fs.exists(at):
            return []
        found = [Found(join(self.full(relative), s.getPath().getName()), s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(at) if s.isFile()]
        return sorted(found, key=lambda f: f.name)

    def walk(self, relative: str = "") -> Iterator[Found]:
        """Files of all directories below; paths start with the base as it was given."""
        at = self._path(self.full(relative) if relative else self.base)
        root = at.toUri().getPath().rstrip("/")
        files = self._fs.listFiles(at, True)
        while files.hasNext():
            s = files.next()
            below = s.getPath().toUri().getPath()[len(root) :].lstrip("/")
            yield Found(join(self.full(relative) if relative else self.base, below), below, s.getLen(), s.getModificationTime())

    def read(self, relative: str) -> bytes:
        stream = self._fs.open(self._path(self.full(relative)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def text(self, relative: str) -> str:
        return self.read(relative).decode()

    def write(self, relative: str, data: bytes) -> None:
        """Overwrites, for hints and properties. Readers see the old file or the new one: it is renamed over the old one in one step; where a store can't (object stores), its upload takes one step."""
        path = self.full(relative)
        folder, _, name = path.rpartition("/")
        temporary = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}.tmp")
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        except Exception as e:
            if "UnsupportedFileSystem" not in str(e):
                raise
            self._create(path, [data], True)
            return
        self._create(temporary.toString(), [data], True)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        try:
            context.rename(temporary, self._path(path), how)
        except Exception:
            self._fs.delete(temporary, False)
            raise

    def create(self, relative: str, parts: bytes | Iterable[bytes]) -> str:
        """Creates the file, or raises Exists if there is one. Returns its path."""
        path = self.full(relative)
        if self._fs.exists(self._path(path)):
            raise Exists(path)
        self._create(path, [parts] if isinstance(parts, bytes) else parts, False)
        return path

    def _create(self, path: str, parts: Iterable[bytes], overwrite: bool) -> None:
        try:
            out = self._fs.create(self._path(path), overwrite)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Exists(path) from e
            raise
        done = False
        try:
            for part in parts:
                out.write(bytearray(part))
            done = True
        finally:
            out.close()
            if not done:
                self._fs.delete(self._path(path), False)

    def delete(self, relative: str) -> None:
        self._fs.delete(self._path(self.full(relative)), True)
