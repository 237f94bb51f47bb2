"""Forward one-day returns for all days in one plan, with their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators.calendar import next_trade_days


COLUMNS = ("trade_date", "next_trade_date", "ts_code", "close_2", "close_3", "real_premium_ret", "pending", "reason")


def reason_of(there: Column) -> Column:
    """Why a label is pending; ``there``: the code has a bar on the next day."""
    return F.when(F.col("next_trade_date").isNull(), "no_next_day").when(~there, "no_next_bar").when(F.col("close_2").isNull() | F.col("close_3").isNull(), "no_close")


def forward_labels(bars: DataFrame, max_gap_days: int | None = None) -> DataFrame:
    """trade_date, next_trade_date, ts_code, close_2, close_3, real_premium_ret, pending, reason.

    ``bars``: ts_code, trade_date (date), close; one row for a code and day. A label is pending while the next day, or the
    code on that day, has no data.
    """
    days = next_trade_days(bars, "trade_date", max_gap_days)
    then = W.partitionBy("ts_code").orderBy("trade_date")  # a code has one bar for a day
    now = bars.select("ts_code", "trade_date", F.col("close").alias("close_2"), F.lead("trade_date").over(then).alias("__day"), F.lead("close").over(then).alias("__close"))
    there = F.coalesce(F.col("__day") == F.col("next_trade_date"), F.lit(False))
    out = now.join(F.broadcast(days), "trade_date", "left").withColumn("close_3", F.when(there, F.col("__close")))
    return out.withColumn("reason", reason_of(there)).select(
        "trade_date", "next_trade_date", "ts_code", "close_2", "close_3", X.forward_return(F.col("close_3"), F.col("close_2")).alias("real_premium_ret"), F.col("reason").isNotNull().alias("pending"), "reason"
    )


def label_status(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.coalesce("reason", F.lit("ok")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("trade_date").alias("days"))
