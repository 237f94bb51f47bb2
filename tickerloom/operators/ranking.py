"""Numbering all rows of a table, or of each day, in order, with no task that sees all of them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.sources.shared import written

#: The lower bits of ``monotonically_increasing_id`` are a row's place in its partition.
IN_PARTITION = (1 << 33) - 1


def down(df: DataFrame, column: str) -> Column:
    """From the greatest on, what is no number last, as is null."""
    kind = df.schema[column].dataType.simpleString()
    value = F.nanvl(F.col(column), F.lit(None)) if kind in ("double", "float") else F.col(column)
    return value.desc_nulls_last()


def same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the left's columns, then the right's other ones."""
    if not keys:
        return left.join(F.broadcast(right), how=how)
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"__right_{k}" for k in keys])


def tie_breaker(df: DataFrame) -> Column:
    """A number from all of a row's values, so that rows that differ have an order of their own."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def number_rows(df: DataFrame, order: list[Column], into: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place from 1 among the rows of its ``by``, in the order of the sort expressions ``order``.

    The input is worked out once and written. Its rows are dealt into ranges of (by, order) and sorted there; a row's
    place is that within its range and the number of rows of its ``by`` in the ranges before. The places are written too, so whoever reads them
    sees the same ones. Rows that tie go by their other values; equal rows are spread over the ranges like others.
    """
    rows = written(df, "numbering-rows")
    tied = rows.withColumns({"__tie": tie_breaker(rows), "__row": F.monotonically_increasing_id()})
    sort = [*[F.col(c) for c in by], *order, F.col("__tie"), F.col("__row")]
    sorted_rows = tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("__tie", "__row")
    placed = sorted_rows.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))})
    placed = written(placed, "numbering-places")
    counts = placed.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", *by, (before - F.col("__first") + 1).alias("__start"))
    met = same(placed, starts, ("__range", *by)) if by else placed.join(F.broadcast(starts), "__range")  # one row for each range
    return met.withColumn(into, F.col("__at") + F.col("__start")).drop("__range", "__at", "__start")


def first_of(df: DataFrame, order: list[Column], n: int, by: tuple[str, ...]) -> DataFrame:
    """The first ``n`` rows of each ``by``: each task keeps no more than that of a group before any row moves."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
