"""From a prediction snapshot to expected values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X

#: Names the adapter gives, by the source's name.
RENAMED = {"ts_code": "code", "name": "stock_name", "target_trade_date": "verify_date", "Probability": "prob"}


def adapt_snapshot(df: DataFrame) -> DataFrame:
    """Add the columns that later steps use, by which columns exist."""
    for name, source in RENAMED.items():
        if name not in df.columns and source in df.columns:
            df = df.withColumn(name, F.col(source))
    for name in ("target_trade_date", "trade_date"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    for name in ("prob", "StrengthScore", "ThemeBoost", "board"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string" if name == "board" else "double"))
    return df


def existing(df: DataFrame, *names: str):
    """The first of these columns that exists, else null."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("double"))


def score_ev(df: DataFrame, regime: str = "RISK_ON") -> DataFrame:
    """Add p_fill_pred, e_ret_pred, cost_est, risk_penalty and ev_pred."""
    mood = F.lit(regime)
    out = df.withColumn("p_fill_pred", X.fill_probability(existing(df, "open_times"), existing(df, "seal_amount"), existing(df, "turnover_rate")))
    out = out.withColumn("e_ret_pred", X.overnight_return(existing(df, "Probability", "prob", "probability"), existing(df, "StrengthScore", "strength"), existing(df, "ThemeBoost", "theme"), mood))
    out = out.withColumn("cost_est", X.double(X.COST)).withColumn("risk_penalty", X.risk_penalty(mood))
    return out.withColumn("ev_pred", X.expected_value(F.col("p_fill_pred"), F.col("e_ret_pred"), F.col("cost_est"), F.col("risk_penalty")))


def first_rows(df: DataFrame, order: str, topn: int = 10, topk: int = 100) -> DataFrame:
    """The rows that go on, in the file's order."""
    return df.orderBy(F.col(order).asc_nulls_last()).limit(min(max(10, topk), max(10, topk if topk > topn else topn)))


def binary_class_weights(df: DataFrame, label: str) -> DataFrame:
    """n, positive share and balanced class weights n / (2 n_c), in one pass."""
    y = F.col(label)
    one, zero = F.sum((y == 1).cast("long")), F.sum((y == 0).cast("long"))
    return df.agg(F.count(y).alias("n"), F.avg(y.cast("double")).alias("pos_rate"), F.try_divide(F.count(y).cast("double"), 2 * one).alias("w_pos"), F.try_divide(F.count(y).cast("double"), 2 * zero).alias("w_neg"))
