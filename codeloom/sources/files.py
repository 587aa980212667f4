"""Small files on whatever file system Spark has for their folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SmallFiles:
    """Reads, replaces and creates whole files below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._gateway, self._jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self._conf)

    def path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str):
        return self.path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        p = self.at(name)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        except Exception:
            return None
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file in one step."""
        temporary = self.at(f".{uuid.uuid4().hex}")
        self._put(temporary, text, True)
        how = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(how, 1)
        options[0] = how.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        context.rename(self.fs.makeQualified(temporary), self.fs.makeQualified(self.at(name)), options)

    def create(self, name: str, text: str) -> bool:
        """Writes a file unless there is one; False if so."""
        p = self.at(name)
        self.fs.mkdirs(self.at(""))
        local = self.fs.getUri().getScheme() == "file"
        try:
            if local:
                # Hadoop's local file system looks first and creates then.
                none = self._gateway.new_array(self._jvm.java.nio.file.attribute.FileAttribute, 0)
                self._jvm.java.nio.file.Files.createFile(self._jvm.java.io.File(p.toUri().getPath()).toPath(), none)
            self._put(p, text, local)
        except Exception:
            if self.fs.exists(p):
                return False
            raise
        return True

    def _put(self, p, text: str, overwrite: bool) -> None:
        stream = self.fs.create(p, overwrite)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
