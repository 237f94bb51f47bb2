"""Labels from a stream equal those of the batch plan, however often it is restarted."""

import time

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import calendar, labels
from tickerloom.streaming import label_stream as S

TICKS = [
    ("a", "2024-01-01", 1, 10.0), ("a", "2024-01-01", 2, 11.0), ("b", "2024-01-01", 3, 5.0), ("c", "2024-01-01", 3, 0.0),
    ("a", "2024-01-02", 4, 12.0), ("b", "2024-01-02", 5, None), ("c", "2024-01-02", 5, 3.0),
    ("a", "2024-01-05", 6, 9.0), ("d", "2024-01-05", 7, 1.0),
    ("a", "2024-01-06", 8, 9.5), ("b", "2024-01-06", 9, 6.0), ("d", "2024-01-06", 9, 2.0),
]
KIND = "ts_code string, trade_date date, place long, price double"


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame(TICKS, "ts_code string, day string, place long, price double").select("ts_code", F.col("day").cast("date").alias("trade_date"), "place", "price")


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*labels.COLUMNS).collect()))


def expected(ticks):
    return rows(labels.forward_labels(ticks.groupBy("ts_code", "trade_date").agg(F.max_by("price", "place").alias("close"))))


def start(spark, ticks, root, **options):
    days = calendar.next_trade_days(ticks)
    closes = lambda: S.daily_closes(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    return S.start_labels(closes, days, 3, f"{root}/out", f"{root}/checkpoint", **options)


def put(df, root):
    df.coalesce(1).write.mode("append").parquet(f"{root}/in")
    time.sleep(0.01)


def test_a_restart_behind_each_day_gives_the_same_rows_once(spark, ticks, tmp_path):
    root = str(tmp_path)
    days = sorted({d for _, d, _, _ in TICKS})
    seen = []
    for day in days:
        put(ticks.where(F.col("trade_date") == day), root)
        start(spark, ticks, root).awaitTermination()
        seen.append(S.read_labels(spark, f"{root}/out").count())
        if day == days[2]:  # the closes of the first two days are known; the third day isn't over
            wait = {(r["ts_code"], str(r["trade_date"])) for r in S.waiting(spark, f"{root}/out", f"{root}/checkpoint").collect()}
            assert ("a", "2024-01-02") in wait and ("a", "2024-01-01") not in wait
    assert seen == sorted(seen) and seen[-1] < len({(c, d) for c, d, _, _ in TICKS})
    put(S.closing_tick(spark, days[-1], 5), root)
    start(spark, ticks, root).awaitTermination()
    assert rows(S.read_labels(spark, f"{root}/out")) == expected(ticks)
    start(spark, ticks, root).awaitTermination()  # nothing new
    assert rows(S.read_labels(spark, f"{root}/out")) == expected(ticks)


def test_a_run_that_is_stopped_between_batches_is_gone_on_with(spark, ticks, tmp_path):
    root = str(tmp_path)
    for day in sorted({d for _, d, _, _ in TICKS}):
        put(ticks.where(F.col("trade_date") == day), root)
    put(S.closing_tick(spark, "2024-01-06", 5), root)
    query = start(spark, ticks, root, processingTime="0 seconds")
    for _ in range(600):
        if query.lastProgress and query.lastProgress["batchId"] >= 1:
            break
        time.sleep(0.05)
    query.stop()
    start(spark, ticks, root).awaitTermination()
    assert rows(S.read_labels(spark, f"{root}/out")) == expected(ticks)


def test_no_ticks_no_labels(spark, tmp_path):
    assert S.read_labels(spark, str(tmp_path / "none")).collect() == []
