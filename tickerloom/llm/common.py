"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: the space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own only where none is configured and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tickerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def hash_share(share: float, *columns: str) -> Column:
    """True for about ``share`` of the rows, always the same ones; name columns enough that no value of theirs is frequent."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def few_rows(parts: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, ``n`` at a time: a batch's texts as Python objects, and what is made of them, take much memory."""
    for part in parts:
        for at in range(0, part.num_rows, n):
            yield part.slice(at, n)


def words_of(text: bytes, lower: bool = False) -> list[bytes]:
    """Words of a text: ``bytes.split`` cuts at exactly the separators of ``WORD``, and
    ``bytes.lower`` changes A-Z alone."""
    return (text.lower() if lower else text).split()


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def add_sketches(df: DataFrame, dtype: str = "int64", sum_dtype: str | None = None, finish: Callable[[int, np.ndarray], pa.Table] | None = None, schema: str = "slice int, counts binary") -> DataFrame:
    """Sum equally long count vectors by ``slice``: first within groups of tasks, then over them.

    ``df`` has slice int, part int and counts binary, one row for each slice and task, of numbers of
    ``dtype``; sums are of ``sum_dtype``. ``finish`` makes rows of ``schema`` of a slice and its sums, in the task that has
    them: a further step would need a worker of its own beside this one's.
    """
    sums = sum_dtype or dtype

    def sum_of(table: pa.Table, own: str) -> np.ndarray:
        acc = None
        for x in table.column("counts").to_pylist():
            v = np.frombuffer(x, own).astype(sums)
            acc = v if acc is None else acc + v
        return acc

    def near(key, table):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([sum_of(table, dtype).tobytes()], pa.binary())})

    def total(key, table):
        acc = sum_of(table, sums)
        return finish(key[0].as_py(), acc) if finish else pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([acc.tobytes()], pa.binary())})

    some = df.withColumn("part", (F.col("part") % F.lit(4)).cast("int")).groupBy("slice", "part").applyInArrow(near, "slice int, part int, counts binary")
    return some.groupBy("slice").applyInArrow(total, schema)


def cut_sketch(counts: np.ndarray, slices: int, part: int) -> dict[str, list]:
    """The rows that ``add_sketches`` takes, for one task's counts."""
    return {"slice": list(range(slices)), "part": [part] * slices, "counts": [x.tobytes() for x in np.split(counts, slices)]}
