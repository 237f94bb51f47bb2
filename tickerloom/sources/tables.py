"""Keyed tables that are replaced whole: numbered versions and a pointer to the current one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tickerloom.sources import contracts as C


class VersionedTable:
    """A keyed table as numbered parquet versions; a pointer file names the current one.

    A batch writes version <batch id> and then moves the pointer, so a repeated batch after a
    failure starts from the version before it and ends in the same state.
    """

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointers(self) -> list[tuple[int, str]]:
        try:
            rows = self.spark.read.schema("batch long, folder string").json(f"{self.path}/pointers").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r["batch"], r["folder"]) for r in rows)

    def read(self, before: int | None = None) -> DataFrame:
        """The current version, or the last one before a batch, in the table's schema: columns that the version
        lacks are null, and others are left out."""
        known = [p for p in self._pointers() if before is None or p[0] < before]
        if not known:
            return C.empty_table(self.spark, self.schema)
        return C.align_to_schema(self.spark.read.parquet(f"{self.path}/{known[-1][1]}"), self.schema)

    def next_batch(self) -> int:
        return max((batch for batch, _ in self._pointers()), default=-1) + 1

    def write(self, df: DataFrame, batch: int | None = None) -> None:
        batch = self.next_batch() if batch is None else batch
        folder = f"v{batch:010d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(batch, folder)], "batch long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/pointers")

    def ensure(self) -> VersionedTable:
        """Create the table empty, or bring its columns in order: nothing is done if it has them already."""
        known = self._pointers()
        if not known:
            self.write(C.empty_table(self.spark, self.schema))
            return self
        try:
            names = self.spark.read.parquet(f"{self.path}/{known[-1][1]}").columns
        except AnalysisException as e:  # the version is gone or holds no readable file
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            self.write(C.empty_table(self.spark, self.schema))
            return self
        if names != self.schema.names:
            self.write(self.read())
        return self


def learning_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, f"{root}/learning", C.LEARNING)


def execution_table(spark: SparkSession, root: str, exec_date: str) -> VersionedTable:
    return VersionedTable(spark, f"{root}/execution/{exec_date or 'unknown'}", C.EXECUTION)
