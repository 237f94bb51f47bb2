"""Ranking quality by day: hit rate and mean return at K, rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators.ranking import down, first_of, number_rows, same, tie_breaker
from tickerloom.sources.shared import written


def evaluate(df: DataFrame, score: str, real: str, key: str = "trade_date", tie: str = "ts_code", k: int = 10) -> DataFrame:
    """key, n, topk, hit_rate_at_k, mean_ret_at_k: a missing return is a miss and not averaged.

    A day's rows are counted where they are, and each task keeps no more than ``k`` of a day: days may be of any size.
    """
    rows = written(df.select(key, tie, score, real), "evaluate-rows")
    top = first_of(rows, [down(rows, score), F.col(tie).asc_nulls_last(), tie_breaker(rows)], k, (key,))
    hit = F.when(F.coalesce(F.col(real), X.double(0)) > 0, X.double(1)).otherwise(X.double(0))
    best = top.groupBy(key).agg(F.count("*").alias("topk"), F.avg(hit).alias("hit_rate_at_k"), F.avg(real).alias("mean_ret_at_k"))
    return same(rows.groupBy(key).agg(F.count("*").alias("n")), best, (key,), "left").select(key, "n", F.coalesce("topk", F.lit(0)).alias("topk"), "hit_rate_at_k", "mean_ret_at_k")


def ranks(df: DataFrame, column: str, into: str, key: str, tie: str, method: str) -> DataFrame:
    """``df`` with each row's rank within its day, nulls lowest; ``average`` gives ties their mean rank."""
    by_tie = [F.col(tie).asc_nulls_last()] if method == "ordinal" else []
    placed = number_rows(df, [F.col(column).asc_nulls_first(), *by_tie], into, (key,))
    if method == "ordinal":
        return placed.withColumn(into, F.col(into).cast("double"))
    placed = written(placed, "ranks-placed")
    mean = placed.groupBy(key, column).agg(((F.min(into) + F.max(into)) / 2).alias("__mean"))
    return same(placed, mean, (key, column)).withColumn(into, F.col("__mean")).drop("__mean")


def rank_ic(df: DataFrame, score: str, real: str, key: str = "trade_date", tie: str = "ts_code", method: str = "ordinal") -> DataFrame:
    """Correlation of ranks by day; null with fewer than 3 rows, no variance or no return at all.

    ``ordinal`` ranks ties by ``tie`` and nulls lowest; ``average`` gives ties their mean rank.
    """
    out = ranks(ranks(df.select(key, tie, score, real), score, "__a", key, tie, method), real, "__b", key, tie, method)
    both = out.groupBy(key).agg(F.count("*").alias("n"), F.count(real).alias("__m"), F.try_divide(F.covar_pop("__a", "__b"), F.stddev_pop("__a") * F.stddev_pop("__b")).alias("ic"))
    return both.select(key, "n", F.when((F.col("n") >= 3) & (F.col("__m") > 0), F.nanvl("ic", F.lit(None).cast("double"))).alias("rank_ic"))
