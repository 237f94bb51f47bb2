"""Checks of what the pipeline wrote: each table's rules in one aggregate, and what tables say about each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.sources import contracts as C


def first_values(df: DataFrame, column: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first non-null value by ``order``, as ``first_value``, for each key; null if a key has none."""
    return df.groupBy(*keys).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("first_value"))


def first_value(df: DataFrame, column: str, order: str):
    return first_values(df, column, order).first()[0]


@dataclass(frozen=True)
class Rules:
    """What a table must be like: columns that it has, keys whose values are there and occur once, bounds of numbers (both within; a
    bound may be None), and a column that holds one date in all rows. Ranges and dates may be null in a row."""

    columns: list[str]
    keys: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    date: str | None = None


@dataclass
class Found:
    problems: list[str]
    rows: int = 0
    date: str | None = None


def check_table(df: DataFrame | None, rules: Rules, name: str) -> Found:
    """All rules of one table, in one job: rows of a key are added up first, then keys."""
    if df is None:
        return Found([f"{name}: missing"])
    try:
        C.require_columns(df, rules.columns, name)
    except C.ContractError as e:
        return Found([str(e)])
    day = X.blank_to_null(X.norm_ymd(F.col(rules.date).cast("string"))) if rules.date else F.lit(None).cast("string")
    outside = {}
    for c, (low, high) in rules.ranges.items():
        v = X.safe_number(F.col(c).cast("string"))
        wrong = F.lit(False) if low is None else v < low
        outside[c] = F.count_if(wrong if high is None else wrong | (v > high))
    keys = [X.blank_to_null(F.col(k).cast("string")).alias(f"__key{i}") for i, k in enumerate(rules.keys)]
    absent = F.lit(False)
    for i in range(len(keys)):
        absent = absent | F.col(f"__key{i}").isNull()
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(day).alias("low"), F.max(day).alias("high"), *[x.alias(f"out_{c}") for c, x in outside.items()])
    total = by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.sum(F.when(absent, F.col("n"))), F.lit(0)).alias("absent"),
        F.count_if(~absent & (F.col("n") > 1)).alias("repeated"), *[F.coalesce(F.sum(f"out_{c}"), F.lit(0)).alias(f"out_{c}") for c in outside],
    ).first()
    out = []
    if keys and total["absent"]:
        out.append(f"{name}: {total['absent']} rows lack one of {', '.join(rules.keys)}")
    if keys and total["repeated"]:
        out.append(f"{name}: {total['repeated']} values of {', '.join(rules.keys)} occur more than once")
    if total["low"] != total["high"]:
        out.append(f"{name}: {rules.date} has several dates, {total['low']} to {total['high']}")
    if total["low"] is not None and not (len(total["low"]) == 8 and total["low"].isdigit()):
        out.append(f"{name}: {rules.date} is no date: {total['low']}")
    out += [f"{name}: {total[f'out_{c}']} values of {c} outside {rules.ranges[c]}" for c in outside if total[f"out_{c}"]]
    return Found(out, total["n"], total["low"])


#: The artefacts that are tables.
RULES = {
    "candidates": Rules(["ts_code", "name", "signal_date", "exec_date", "p_fill_pred", "e_ret_pred", "cost_est", "risk_penalty", "ev_pred"], ("ts_code",), {"p_fill_pred": (0, 1)}, "signal_date"),
    "weights": Rules(C.WEIGHTS.names, ("ts_code",), {"weight": (0, 1), "target_rank": (1, None), "backup_rank": (1, None)}, "exec_date"),
    "signals": Rules(C.SIGNALS.names, ("jq_code",), {"target_weight": (0, 1), "risk_budget": (0, 1)}, "trade_date"),
    "execution": Rules(C.EXECUTION.names, ("exec_date", "ts_code"), {"filled_flag": (0, 1)}),
    "learning": Rules(C.LEARNING.names, ("exec_date", "ts_code"), {"filled_flag": (0, 1), "fill_rate_real": (0, 1)}),
    "rank": Rules(C.RANK.names, ("trade_date", "ts_code"), {"pred_up_prob": (0, 1), "rank_pred_ev": (1, None)}),
}


def problems(tables: dict[str, DataFrame | None], rules: dict[str, Rules]) -> list[str]:
    """What is wrong, in words; an empty list is a pass. Tables named ``<name>_latest`` and ``<name>_dated`` go by the rules of their name."""
    found = {name: check_table(tables.get(name), own, name) for name, own in rules.items()}
    out = [p for x in found.values() for p in x.problems]
    for latest in (n for n in found if n.endswith("_latest")):
        dated = latest.removesuffix("_latest") + "_dated"
        a, b = found[latest], found.get(dated)
        if b is not None and not a.problems and not b.problems and (a.rows, a.date) != (b.rows, b.date):
            out.append(f"{latest} has {a.rows} rows of {a.date}, {dated} {b.rows} of {b.date}")
    return out


def rules_for(names: list[str]) -> dict[str, Rules]:
    return {n: RULES[n.removesuffix("_latest").removesuffix("_dated")] for n in names}
