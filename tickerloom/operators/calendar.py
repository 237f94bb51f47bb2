"""Trading days: a calendar is the distinct days of a table, a few thousand rows at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_trade_days(bars: DataFrame, day: str = "trade_date", max_gap_days: int | None = None) -> DataFrame:
    """day, next_trade_date: the following day that has data, if within the gap. Days are dates."""
    days = bars.select(F.col(day)).where(F.col(day).isNotNull()).distinct()
    out = days.withColumn("next_trade_date", F.lead(day).over(W.orderBy(day)))
    if max_gap_days is not None:
        out = out.withColumn("next_trade_date", F.when(F.datediff("next_trade_date", day) <= max_gap_days, F.col("next_trade_date")))
    return out


def latest_days(df: DataFrame, n: int, day: str = "trade_date") -> DataFrame:
    """The last n distinct days."""
    return df.select(day).where(F.col(day).isNotNull()).distinct().orderBy(F.col(day).desc()).limit(n)


def last_days(df: DataFrame, n: int, day: str = "trade_date") -> DataFrame:
    """Rows of the last n distinct days; the days are found first, so rows don't meet in one task."""
    return df.join(F.broadcast(latest_days(df, n, day)), day, "left_semi")
