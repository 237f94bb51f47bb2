"""Forward labels as a stream: a close waits in state until its code's next trading day is there, or can't come any more.

Closes of a day meet those of the next one in a stream-stream left outer join. Both sides have watermarks, and the next day is at most
``max_gap_days`` away, so a row leaves the state once: when its partner comes, or, without one, when the watermark has passed the last moment
for it. The calendar is known beforehand, as an exchange publishes it: a row for each day, a few thousand at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.functions import scalars as X
from tickerloom.operators.labels import COLUMNS, reason_of
from tickerloom.sources import contracts as C
from tickerloom.sources.shared import Folder

SCHEMA = C.struct("trade_date date, next_trade_date date, ts_code string, close_2 double, close_3 double, real_premium_ret double, pending boolean, reason string")
DAY = 86_400


def midnight(day):
    """The start of a day as an event time, the same in every session's time zone."""
    return F.timestamp_seconds(F.unix_date(day) * DAY)


def daily_closes(ticks: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``ticks`` (ts_code, trade_date, place, price), streaming -> ts_code, trade_date, close, seen (event time): a day's price of the last
    place, once the watermark has passed the day. ``delay``: how much later than others a tick may come."""
    timed = ticks.withColumn("at", midnight(F.col("trade_date"))).withWatermark("at", delay)
    closed = timed.groupBy(F.window("at", "1 day").alias("w"), "ts_code").agg(F.max_by("price", "place").alias("close"))
    day = F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / DAY).cast("int"))
    return closed.select("ts_code", day.alias("trade_date"), "close", F.window_time("w").alias("seen"))


def label_stream(closes: Callable[[], DataFrame], days: DataFrame, max_gap_days: int) -> DataFrame:
    """``closes`` (gives a frame as of ``daily_closes``, a new one for each side of the join) and ``days`` (trade_date, next_trade_date) -> the columns of ``forward_labels``, streaming."""
    now = closes().join(F.broadcast(days.select("trade_date", "next_trade_date")), "trade_date", "left")
    now = now.select("ts_code", "trade_date", "next_trade_date", F.col("close").alias("close_2"), F.col("seen").alias("__seen_2"))
    then = closes().select(F.col("ts_code").alias("__code"), F.col("trade_date").alias("__day"), F.col("close").alias("close_3"), F.col("seen").alias("__seen_3"))
    partner = (F.col("ts_code") == F.col("__code")) & (F.col("next_trade_date") == F.col("__day"))
    soon = (F.col("__seen_3") > F.col("__seen_2")) & (F.col("__seen_3") <= F.col("__seen_2") + F.expr(f"interval {int(max_gap_days)} days"))
    met = now.join(then, partner & soon, "leftOuter")
    reason = reason_of(F.col("__code").isNotNull())
    return met.select(*COLUMNS[:5], X.forward_return(F.col("close_3"), F.col("close_2")).alias("real_premium_ret"), reason.isNotNull().alias("pending"), reason.alias("reason"))


def start_labels(closes: Callable[[], DataFrame], days: DataFrame, max_gap_days: int, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write labels to the folder ``out``; a restart with the same ``checkpoint`` goes on where the last run ended."""
    stream = label_stream(closes, days, max_gap_days).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def read_labels(spark: SparkSession, out: str) -> DataFrame:
    if not Folder(spark, out).exists("_spark_metadata"):  # no batch has ended yet
        return C.empty_table(spark, SCHEMA)
    return spark.read.schema(SCHEMA).parquet(out)


def waiting(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """ts_code, trade_date, next_trade_date, close_2: closes that wait for their partner, from the join's state."""
    state = spark.read.format("statestore").option("operatorId", 0).option("joinSide", "left").load(checkpoint).select("value.*")
    done = read_labels(spark, out).select("ts_code", "trade_date")  # a row whose partner has come stays in the state for a while
    return state.select("ts_code", "trade_date", "next_trade_date", "close_2").join(done, ["ts_code", "trade_date"], "left_anti")


def closing_tick(spark: SparkSession, last_day: str, days_on: int) -> DataFrame:
    """A tick of the empty code, ``days_on`` days behind the last one: it moves the watermark past all that waits. Its own day
    never ends. (Ticks without a code can't meet a partner, so Spark doesn't read them on that side, nor their times.)"""
    return spark.range(1).select(F.lit("").alias("ts_code"), F.date_add(F.lit(last_day).cast("date"), days_on).alias("trade_date"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("double").alias("price"))
