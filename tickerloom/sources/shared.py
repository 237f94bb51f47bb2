"""The folder that driver and executors share: intermediate tables, and small files that appear at once or not at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tickerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, whoever reads it and how often. Columns without a type stay null."""
    path = fresh_path(df.sparkSession, label)
    bare = [c for c, kind in df.dtypes if kind == "void"]
    stored = df.drop(*bare)
    stored.write.parquet(path)
    back = df.sparkSession.read.schema(stored.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in bare else F.col(f"`{c}`") for c in df.columns]) if bare else back


class Folder:
    """A folder in whatever store Spark reads, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        """What is in the folder, sorted; a folder that isn't there is empty."""
        at = self._new(f"{self.path}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._new(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect()
        return rows[0][0] if rows else ""

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, whole or not at all; False if another one has the name."""
        draft = self._new(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        final = self._new(f"{self.path}/{name}")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, True)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._new(f"{self.path}/{name}"), True)
