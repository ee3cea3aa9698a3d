"""Small files through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def make(self, path: str) -> None:
        self.fs.mkdirs(self.path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path)))

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, temporary: str, path: str, text: str) -> bool:
        """Writes text beside its place and moves it there unless something is there
        already; False then. A reader sees the whole file or none."""
        out = self.fs.create(self.path(temporary), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(kinds, 0, options.NONE)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.path(temporary), self.path(path), kinds)
            return True
        except Exception as error:
            if self.exists(path):
                self.delete(temporary)
                return False
            raise error

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)
