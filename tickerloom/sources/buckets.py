"""Keyed tables in hash buckets, of which a batch rewrites only those that its keys touch; and appends that happen once for each run.

A table's folder holds ``data`` (a folder for each batch, with a folder for each bucket that it wrote) and ``manifests``: a file for each batch
that says, for each bucket that has rows, which batch's folder is the current one. A batch counts once its manifest is there, and the manifest
appears at once or not at all: a batch that fails before leaves files that nothing refers to, and one that comes again finds its manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickerloom.operators.feedback import last_of_key, upsert
from tickerloom.sources import contracts as C
from tickerloom.sources.shared import Folder, written

BUCKET = "__bucket"


class ConcurrentBatch(RuntimeError):
    """Another batch was committed meanwhile; this one may be tried again."""


class BucketedTable:
    """Rows of ``schema``, one for each value of ``keys``, in ``buckets`` buckets by a hash of the keys.

    Choose the number of buckets so that one is a task's work, some 100 MB; it is kept in the manifests, and a table that is there keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.folder = Folder(spark, self.path)
        found = self._manifest()
        self.buckets = found["buckets"] if found else buckets

    def _batches(self) -> list[str]:
        return [n for n in self.folder.names("manifests") if n.endswith(".json")]

    def _manifest(self, name: str | None = None) -> dict | None:
        """A batch's manifest, or the last one."""
        names = [name] if name else self._batches()[-1:]
        return json.loads(self.folder.read(f"manifests/{names[0]}")) if names else None

    def last_batch(self) -> int:
        found = self._manifest()
        return found["batch"] if found else -1

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, current: dict[str, str], only: list[int] | None = None) -> DataFrame:
        """Rows of the buckets, or of some of them, from exactly the folders that the manifest names."""
        wanted = current if only is None else {str(b): current[str(b)] for b in only if str(b) in current}
        if not wanted:
            return C.empty_table(self.spark, self.schema)
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(wanted.items())]
        return C.align_to_schema(self.spark.read.schema(self.schema).parquet(*paths), self.schema)

    def read(self) -> DataFrame:
        found = self._manifest()
        return self._read(found["current"] if found else {})

    def upsert(self, patch: DataFrame, batch: int | None = None, order: str | None = None, overwrite_blanks: bool = False) -> list[int]:
        """Merge ``patch`` (the keys and any of the columns) as batch ``batch``; the buckets that were written anew.

        A batch that is committed already, or one before it, changes nothing: batches are numbered in order. ``order`` tells which of the
        patch's rows of one key is the last.
        """
        known = self._manifest() or {"batch": -1, "current": {}}
        batch = known["batch"] + 1 if batch is None else batch
        if batch <= known["batch"]:
            return []
        columns = [f.name for f in self.schema if f.name in patch.columns]
        one = last_of_key(patch.select(*columns, *([order] if order and order not in columns else [])), self.keys, order)
        one = written(one.select(*columns).withColumn(BUCKET, self._bucket()), "upsert-patch")
        touched = sorted(r[0] for r in one.select(BUCKET).distinct().collect())  # no more than there are buckets
        folder = f"{batch:010d}-{uuid.uuid4().hex[:8]}"
        current = dict(known["current"])
        if touched:
            merged = C.align_to_schema(upsert(self._read(current, touched), one.drop(BUCKET), self.keys, overwrite_blanks=overwrite_blanks), self.schema)
            merged.withColumn(BUCKET, self._bucket()).repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
            current |= {str(b): folder for b in touched}
        text = json.dumps({"batch": batch, "buckets": self.buckets, "current": current})
        if not self.folder.create(f"manifests/{batch:010d}.json", text):
            raise ConcurrentBatch(f"batch {batch} of {self.path}")
        return touched

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the last ``keep`` manifests and the buckets that none of these names; what was removed. Not while a
        batch is being written."""
        names = self._batches()
        kept = [self._manifest(n)["current"] for n in names[-keep:]]
        used = {f"{folder}/{BUCKET}={b}" for current in kept for b, folder in current.items()}
        gone = [f"manifests/{n}" for n in names[:-keep]]
        for folder in self.folder.names("data"):
            inside = [n for n in self.folder.names(f"data/{folder}") if n.startswith(f"{BUCKET}=")]
            unused = [n for n in inside if f"{folder}/{n}" not in used]
            gone += [f"data/{folder}"] if len(unused) == len(inside) else [f"data/{folder}/{n}" for n in unused]
        for name in gone:
            self.folder.delete(name)
        return gone


class RunLog:
    """Rows appended by runs, each run's once: ``data`` has a folder for each attempt, ``runs`` a file for each run that names its own."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.folder = Folder(spark, self.path)

    @staticmethod
    def _name(run: str) -> str:
        return f"{run.encode().hex()}.json"

    def append(self, df: DataFrame, run: str) -> bool:
        """False if the run has appended already: then nothing is written. Of two attempts at a time one counts."""
        if self.folder.exists(f"runs/{self._name(run)}"):
            return False
        attempt = uuid.uuid4().hex
        C.align_to_schema(df, self.schema).write.parquet(f"{self.path}/data/{attempt}")
        return self.folder.create(f"runs/{self._name(run)}", json.dumps({"run": run, "folder": attempt}))

    def read(self) -> DataFrame:
        """The rows of all runs that count. Their markers are read as a table."""
        if not self.folder.names("runs"):
            return C.empty_table(self.spark, self.schema)
        folders = [r[0] for r in self.spark.read.schema("run string, folder string").json(f"{self.path}/runs").select("folder").collect()]  # one for each run
        return C.align_to_schema(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{x}" for x in folders]), self.schema)

    def vacuum(self) -> list[str]:
        """Remove what attempts that don't count have left. Not while a run appends."""
        used = {json.loads(self.folder.read(f"runs/{n}"))["folder"] for n in self.folder.names("runs")}
        gone = [f"data/{n}" for n in self.folder.names("data") if n not in used]
        for name in gone:
            self.folder.delete(name)
        return gone
