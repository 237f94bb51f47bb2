"""Schemas, alias maps, and aligning tables to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "date": T.DateType(), "boolean": T.BooleanType()}


def struct(fields: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


# Column contracts and accepted names, in order of priority.
BARS = struct("ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double")
WEIGHTS = struct("exec_date string, ts_code string, name string, weight double, target_rank int, backup_rank int, ev_pred double")
SIGNALS = struct("trade_date string, target_trade_date string, jq_code string, target_weight double, risk_budget double, regime string, reason string")
EXECUTION = struct("exec_date string, ts_code string, jq_code string, filled_flag int, buy_time string, buy_price double, fail_reason string, buy_slippage_bp double")
FILLS = struct("exec_date string, ts_code string, target_amount double, filled_amount double, buy_price double, buy_time string, fail_reason string")
RETURNS = struct("exec_date string, ts_code string, sell_price double, ret_exec double, exit_date string")
LEARNING = struct(
    "signal_date string, exec_date string, exit_date string, ts_code string, jq_code string, name string, weight_exec double, "
    "filled_flag int, fill_rate_real double, buy_price double, sell_price double, ret_exec double, e_ret_real double, "
    "p_fill_pred double, e_ret_pred double, cost_est double, risk_penalty double, ev_pred double, ev_real double, "
    "regime string, risk_budget double, version int, generated_at_bjt string, commit_sha string"
)
RANK = struct(
    "trade_date string, next_trade_date string, ts_code string, name string, decision_rank int, strength_score double, theme_boost double, "
    "probability double, final_score double, pred_up_prob double, pred_ret_mean double, pred_ev double, rank_pred_ev int, "
    "risk_liquidity string, risk_volatility string, risk_crowding string, risk_event string, fill_risk_hint string, confidence string, "
    "real_premium_ret double, run_id string, commit_sha string, model_version string, data_snapshot string, created_at_utc string"
)
EVAL_HISTORY = struct(
    "trade_date string, next_trade_date string, n int, topk int, hit_rate_at_k double, mean_ret_at_k double, rank_ic double, "
    "model_version string, run_id string, commit_sha string, created_at_utc string"
)
DECISION_REQUIRED = {
    "trade_date": ("trade_date", "date", "dt", "交易日期", "日期"),
    "ts_code": ("ts_code", "code", "symbol", "ticker", "股票代码", "代码"),
}
DECISION_OPTIONAL = {
    "name": ("name", "stock_name", "股票名称", "名称"),
    "rank": ("rank", "rank_no", "排名", "order"),
    "strength_score": ("strengthscore", "strength_score", "强度得分", "strength"),
    "theme_boost": ("themeboost", "theme_boost", "题材加权", "theme"),
    "probability": ("probability", "prob", "_prob", "p", "概率"),
    "final_score": ("finalscore", "final_score", "最终得分", "score"),
    "regime_weight": ("regime_weight", "regime", "情绪权重", "市场状态权重"),
    "industry": ("industry", "行业"),
    "theme": ("theme", "题材", "concept", "concept_name"),
    "turnover_rate": ("turnover_rate", "换手率"),
    "amount": ("amount", "成交额"),
    "vol": ("vol", "volume", "成交量"),
    "fill_risk_hint": ("fill_risk_hint", "fillrisk", "成交风险", "买不到风险"),
}
CLOSE_REQUIRED = {**DECISION_REQUIRED, "close": ("close", "close_price", "收盘价")}
CLOSE_OPTIONAL = {
    "open": ("open", "开盘价"),
    "high": ("high", "最高价"),
    "low": ("low", "最低价"),
    "pre_close": ("pre_close", "昨收", "前收盘"),
    "pct_chg": ("pct_chg", "pct_change", "涨跌幅"),
    "amount": ("amount", "成交额"),
    "vol": ("vol", "volume", "成交量"),
}
#: What a candidate snapshot has beside its own columns, and the value of those that it lacks.
CANDIDATE_DEFAULTS = {
    "signal_date": "", "exec_date": "", "exit_date": "", "p_fill_pred": 0.0, "e_ret_pred": 0.0, "cost_est": 0.0, "risk_penalty": 0.0, "ev_pred": 0.0,
    "weight_exec": "", "regime": "", "risk_budget": "", "version": 1, "name": "",
}


class ContractError(ValueError):
    """A table lacks columns that its contract asks for."""


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "table") -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ContractError(f"{label} lacks columns: {', '.join(lacking)}")
    return df


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def find_alias(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The first alias, by priority, that a column has; case and outer spaces don't count."""
    known: dict[str, str] = {}
    for c in columns:
        known.setdefault(c.strip().lower(), c)
    return next((known[a.strip().lower()] for a in aliases if a.strip().lower() in known), None)


def resolve_aliases(df: DataFrame, required: Mapping[str, Sequence[str]], optional: Mapping[str, Sequence[str]] | None = None, others: bool = False) -> DataFrame:
    """Canonical columns; an absent optional one is null, absent required ones raise together. With ``others``, columns that
    stand for no canonical one come along, under their own names."""
    found = {name: find_alias(df.columns, aliases) for name, aliases in {**required, **(optional or {})}.items()}
    lacking = [name for name in required if found[name] is None]
    if lacking:
        raise ContractError(f"no column for: {', '.join(lacking)}")
    more = [c for c in df.columns if others and c not in found.values() and c.lower() not in found and not c.startswith("__")]
    return df.select(*[(quoted(c) if c is not None else F.lit(None).cast("string")).alias(name) for name, c in found.items()], *map(quoted, more))


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns in order: missing ones null, unknown ones dropped, types cast or null."""
    have = {c: c for c in df.columns}
    return df.select(*[(quoted(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def empty_table(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
