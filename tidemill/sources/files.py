"""The Hadoop file system behind a path: local disk, HDFS or an object store alike."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, rel: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def full(self, rel: str) -> str:
        return f"{self.root}/{rel}"

    @property
    def local(self) -> str | None:
        """The root as a path of this machine, if it is one."""
        uri = self.fs.makeQualified(self._path("")).toUri().toString()
        return unquote(urlparse(uri).path) if uri.startswith("file:") else None

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self._path(rel))

    def names(self, rel: str) -> list[str]:
        """Sorted names in a folder; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(rel))) if self.exists(rel) else []

    def tree(self, rel: str = "") -> dict[str, int]:
        """The files below a folder, by path from it, and their bytes."""
        if not self.exists(rel):
            return {}
        top = self.fs.makeQualified(self._path(rel)).toUri().getPath().rstrip("/") + "/"
        out, found = {}, self.fs.listFiles(self._path(rel), True)
        while found.hasNext():
            s = found.next()
            out[s.getPath().toUri().getPath().removeprefix(top)] = s.getLen()
        return out

    def state(self, rel: str = "") -> list[tuple[str, int, int]]:
        """(path, bytes, time of change) of the files below a folder, or of the file, in order."""
        if not self.exists(rel):
            return []
        out, found = [], self.fs.listFiles(self._path(rel), True)
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toUri().getPath(), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def make(self, rel: str) -> None:
        self.fs.mkdirs(self._path(rel))

    def rename(self, old: str, new: str) -> bool:
        """Refuses a target that exists. For data under content names, where whoever comes second brings the same."""
        return not self.exists(new) and bool(self.fs.rename(self._path(old), self._path(new)))

    def publish(self, staged: str, new: str) -> bool:
        """Give a staged file its name, in one step that fails if the name is taken.

        Local disks do this by a hard link, HDFS by a rename that doesn't overwrite. An object store has to
        offer such a rename (or a committer that does) for writers on different machines to be safe.
        """
        if self.local is not None:
            try:
                os.link(f"{self.local}/{staged}", f"{self.local}/{new}")
            except FileExistsError:
                return False
            self.delete(staged)
            return True
        hadoop = self.jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self.jvm.java.lang.Enum.valueOf(kind, "NONE")
        flags = self.jvm.java.lang.reflect.Array.newInstance(kind, 1)
        flags[0] = none
        try:
            context.rename(self._path(staged), self._path(new), flags)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, rel: str) -> None:
        self.fs.delete(self._path(rel), True)

    def copy(self, rel: str, to: Files, new: str) -> None:
        """Copy a file or folder into another tree."""
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(rel), to.fs, to._path(new), False, False, self.conf):
            raise OSError(f"{self.full(rel)}: can't be copied to {to.full(new)}")

    def read(self, rel: str) -> bytes:
        stream = self.fs.open(self._path(rel))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, rel: str, data: bytes) -> None:
        stream = self.fs.create(self._path(rel), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
