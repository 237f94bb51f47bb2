"""Late feedback: patches from fills and returns, and their keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X

KEY = ("exec_date", "ts_code")


def clean_keys(df: DataFrame) -> DataFrame:
    """Dates in one form, codes trimmed; null stays null."""
    out = df.withColumn("ts_code", X.strip(F.col("ts_code")))
    for c in ("exec_date", "exit_date"):
        if c in df.columns:
            out = out.withColumn(c, X.blank_to_null(X.norm_ymd(F.col(c))))
    return out


#: The place of a row among those that came in, where it is known.
PLACE = "__pos"


def _place(df: DataFrame) -> list[str]:
    return [PLACE] if PLACE in df.columns else []


def fill_patch(fills: DataFrame) -> DataFrame:
    rate = X.fill_rate(F.col("target_amount"), F.col("filled_amount"))
    return clean_keys(fills).select("exec_date", "ts_code", rate.alias("fill_rate_real"), (rate > 0).cast("int").alias("filled_flag"), X.number_or(F.col("buy_price"), 0).alias("buy_price"), *_place(fills))


def return_patch(returns: DataFrame) -> DataFrame:
    if "exit_date" not in returns.columns:
        returns = returns.withColumn("exit_date", F.lit(None).cast("string"))
    ret = X.number_or(F.col("ret_exec"), 0)
    return clean_keys(returns).select("exec_date", "ts_code", "exit_date", X.number_or(F.col("sell_price"), 0).alias("sell_price"), ret.alias("ret_exec"), ret.alias("e_ret_real"), *_place(returns))


def last_of_key(df: DataFrame, keys: tuple[str, ...], order: str | None) -> DataFrame:
    """One row of each key: the last by ``order``. Rows without a whole key are rejected.

    Without an order, rows of one key that differ go by their values: the greatest wins, so reruns agree.
    """
    whole = None
    for k in keys:
        good = F.col(k).isNotNull() & (X.strip(F.col(k)) != "")
        whole = good if whole is None else whole & good
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.where(whole).distinct()
    last = F.struct(*([order] if order else []), *[c for c in others if c != order])
    kept = df.where(whole).groupBy(*keys).agg(F.max(last).alias("__last"))  # partial sums before the shuffle
    return kept.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in df.columns])


def upsert(base: DataFrame, patch: DataFrame, keys: tuple[str, ...] = KEY, order: str | None = None, overwrite_blanks: bool = False) -> DataFrame:
    """Full outer join on the key; a patch's value wins where it isn't null (or always).

    The base's columns come out, and patch columns that the base lacks. ``order`` tells which of a patch's rows of
    one key is the last, e.g. when it arrived; ``PLACE`` does so if it is there.
    """
    order = order or next(iter(_place(patch)), None)
    patch = last_of_key(patch, keys, order)
    new = [c for c in patch.columns if c not in keys and c != order]
    there = patch.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in new], F.lit(True).alias("__patch"))
    both = base.join(there, list(keys), "full_outer")
    columns = [c for c in base.columns] + [c for c in new if c not in base.columns]

    def value(c: str):
        if c not in new:
            return F.col(c)
        old = F.col(c) if c in base.columns else F.lit(None)
        return F.when(F.col("__patch"), F.col(f"__p_{c}")).otherwise(old) if overwrite_blanks else F.coalesce(F.col(f"__p_{c}"), old)

    return both.select(*[value(c).alias(c) for c in columns])


def upsert_counts(base: DataFrame, patch: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """updated, inserted."""
    p = last_of_key(patch, keys, None).select(*keys)
    b = base.select(*keys).distinct().withColumn("__base", F.lit(True))
    return p.join(b, list(keys), "left").agg(F.count("__base").alias("updated"), (F.count("*") - F.count("__base")).alias("inserted"))
