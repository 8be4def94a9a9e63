"""Small driver-side files on any file system that Spark can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def stream(self, path: str, parts: Iterable[str]) -> None:
        """Writes a file piece by piece."""
        p, fs = self._at(path)
        out = fs.create(p)
        try:
            for part in parts:
                out.write(bytearray(part.encode()))
        finally:
            out.close()

    def write(self, path: str, text: str) -> None:
        """Replaces the file in one step: readers see the old text or the new."""
        temp = f"{path}.{uuid.uuid4().hex}"
        self.stream(temp, [text])
        p, fs = self._at(temp)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        array[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(fs.makeQualified(p), fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(path)), array)

    def create(self, path: str, text: str) -> bool:
        """Writes a file that isn't there yet, whole or not at all; whether it did.  Of two writers one gets False."""
        temp = f"{path}.{uuid.uuid4().hex}"
        self.write(temp, text)
        (p, fs), (old, _) = self._at(path), self._at(temp)
        try:
            if fs.getScheme() == "file":  # renaming replaces files there; a link does not
                at = lambda x: self.jvm.java.nio.file.Paths.get(x.toUri().getPath(), self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0))
                self.jvm.java.nio.file.Files.createLink(at(p), at(old))
            else:
                none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(fs.makeQualified(old), fs.makeQualified(p), none)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(old, True)

    def newest(self, folder: str) -> int:
        """The greatest n of the files <n>.json in a folder; 0 without any."""
        names = (x.rsplit("/", 1)[1] for x in self.list(folder))
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def delete(self, path: str) -> int:
        """Deletes a folder; its bytes."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return 0
        size = fs.getContentSummary(p).getLength()
        fs.delete(p, True)
        return size

    def list(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
