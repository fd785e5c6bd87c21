"""Small files and folders in any store that Spark reaches, by its own file systems; run on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """One folder of a store."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none if it is not there."""
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def remove(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def move(self, old: str, new: str) -> None:
        """Rename; an error if the new name is taken."""
        if self.exists(new) or not self.fs.rename(self.path(old), self.path(new)):
            raise FileExistsError(f"{self.root}/{new}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A whole file or none: written under another name, then renamed."""
        out = self.fs.create(self.path(f"{name}.pending"), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        self.move(f"{name}.pending", name)
