"""Cross-sectional features of each day: rank score, median fill, z-score, risk flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators.quantiles import quantiles


def rank_score(df: DataFrame, rank: str, keys: tuple[str, ...], into: str = "rank_score") -> DataFrame:
    """Min-max of 1/rank within a day; rank 0 is null."""
    inverse = F.try_divide(X.double(1), F.col(rank).cast("double"))
    w = W.partitionBy(*keys)
    return df.withColumn("__inv", inverse).withColumn(into, (F.col("__inv") - F.min("__inv").over(w)) / (F.max("__inv").over(w) - F.min("__inv").over(w) + X.double(1e-12))).drop("__inv")


def median_fill(df: DataFrame, columns: list[str], keys: tuple[str, ...], exact: bool = True) -> DataFrame:
    """Nulls take the day's median, or 0 if a day has none. Days may be of any size.

    ``exact=False`` takes the approximate median, in one pass.
    """
    if exact:
        found = quantiles(df, columns, [0.5], keys)
        stats = found.select(*keys, *[F.col(f"{c}__q0").alias(f"__m_{c}") for c in columns])
    else:
        stats = df.groupBy(*keys).agg(*[F.percentile_approx(F.col(c), 0.5).cast("double").alias(f"__m_{c}") for c in columns])
    out = df.join(stats, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, f"__m_{c}", X.double(0)) for c in columns}).drop(*[f"__m_{c}" for c in columns])


def zscore(df: DataFrame, columns: list[str], keys: tuple[str, ...], prefix: str = "x__") -> DataFrame:
    """(value - mean) / population deviation within a day; 0 where the deviation is under 1e-12."""
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = df.join(stats, list(keys), "left")
    z = {f"{prefix}{c}": F.when(F.col(f"__s_{c}") < 1e-12, X.double(0)).otherwise(F.try_divide(F.col(c) - F.col(f"__a_{c}"), F.col(f"__s_{c}"))) for c in columns}
    return out.withColumns(z).drop(*[f"__{k}_{c}" for c in columns for k in "as"])


def liquidity_flag(df: DataFrame, column: str, keys: tuple[str, ...], q: float = 0.2, least: int = 5, into: str = "risk_liquidity") -> DataFrame:
    """HIGH below the day's q quantile (interpolated), else LOW; null with fewer than ``least`` values."""
    stats = quantiles(df, [column], [q], keys).select(*keys, F.col(f"{column}__q0").alias("__q"), F.col(f"{column}__n").alias("__n"))
    out = df.join(stats, list(keys), "left")
    return out.withColumn(into, F.when(F.col("__n") >= least, X.risk_level(F.col(column) < F.col("__q")))).drop("__q", "__n")


#: Parts of names that are no numbers.
TEXT_NAMES = ("name", "industry", "theme", "concept", "题材", "行业")


def numeric_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, share: how many of its values are numbers, all columns in one pass."""
    one = df.agg(*[F.avg(X.safe_number(F.col(c)).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", "share"))


def auto_numeric(df: DataFrame, known: set[str], least: float = 0.6) -> list[str]:
    """Other columns that mostly hold numbers."""
    candidates = [c for c in df.columns if c not in known and not any(t in c.lower() for t in TEXT_NAMES)]
    return sorted(r["column"] for r in numeric_shares(df, candidates).where(F.col("share") >= least).collect()) if candidates else []


def build_features(df: DataFrame, key: str = "trade_date") -> DataFrame:
    """Features of a decision table (canonical columns) for all its days: meta, x__* and risk_*."""
    numeric = [c for c in ("strength_score", "theme_boost", "probability", "final_score", "regime_weight", "turnover_rate", "amount", "vol") if c in df.columns]
    auto = auto_numeric(df, set(numeric) | {key, "ts_code", "name", "rank", "fill_risk_hint", "industry", "theme"})
    out = df.withColumns({f"auto__{c}": X.safe_number(F.col(c)) for c in auto} | {c: X.safe_number(F.col(c)) for c in numeric})
    out = rank_score(out.withColumn("rank", X.safe_number(F.col("rank"))), "rank", (key,))
    used = [*numeric, *[f"auto__{c}" for c in auto], "rank_score"]
    # a day's amounts if it has any, else its turnover rates
    have = [F.when(F.count(c).over(W.partitionBy(key)) > 0, F.struct(F.col(c).alias("v"))) for c in ("amount", "turnover_rate") if c in numeric]
    liquid = F.coalesce(*have)["v"] if have else F.lit(None).cast("double")
    out = liquidity_flag(out.withColumn("__liquid", liquid), "__liquid", (key,)).drop("__liquid")
    filled = median_fill(out.withColumns({f"__f_{c}": F.col(c) for c in used}), [f"__f_{c}" for c in used], (key,))
    scored = zscore(filled, [f"__f_{c}" for c in used], (key,))
    for c in used:
        scored = scored.withColumnRenamed(f"x____f_{c}", f"x__{c}")
    none = F.lit(None).cast("string")
    return scored.drop(*[f"__f_{c}" for c in used]).withColumns({"risk_volatility": none, "risk_crowding": none, "risk_event": none, "confidence": none})


#: Features by name, and columns that are none.
KNOWN = ("rank_score", "strength_score", "theme_boost", "probability", "final_score", "regime_weight", "turnover_rate", "amount", "vol")
NOT_FEATURES = (
    "trade_date", "next_trade_date", "ts_code", "name", "industry", "theme", "real_premium_ret", "close_2", "close_3",
    "risk_liquidity", "risk_volatility", "risk_crowding", "risk_event", "confidence", "fill_risk_hint",
)


def feature_names(df: DataFrame, prefix: str = "x__") -> list[str]:
    """The columns a model learns from: found ones, then known ones, in their scaled form; if there is neither, all numbers
    that aren't a label or a key."""
    named = [c for c in df.columns if c.startswith(f"{prefix}auto__")] + [f"{prefix}{c}" for c in KNOWN if f"{prefix}{c}" in df.columns]
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return named or [c for c, kind in df.dtypes if c not in NOT_FEATURES and c != "y" and (kind in numeric or kind.startswith("decimal"))]
