"""Small files through Hadoop's FileSystem, so that manifests live wherever Spark can read and write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class HadoopFs:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self._conf)

    def path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Write a new file whole; False if it exists already.  The rename makes a reader see all of it or nothing."""
        tmp = f"{p}.{self._jvm.java.util.UUID.randomUUID()}.tmp"
        stream = self.fs.create(self.path(tmp), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(p):
            self.fs.delete(self.path(tmp), False)
            return False
        return self.fs.rename(self.path(tmp), self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)
