"""Reports for people: a few ranked rows to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators import evaluation


def table_text(df: DataFrame, columns: list[str], order: list, limit: int = 10, titles: list[str] | None = None) -> str:
    """A Markdown table of the first rows."""
    rows = df.orderBy(*order).limit(limit).select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns]).collect()
    lines = [titles or columns, ["---"] * len(columns), *[list(r) for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def decision_report(weights: DataFrame, exec_date: str, regime: str, budget: float) -> str:
    shown = weights.where("weight > 0").withColumn("weight", X.fixed_number(F.col("weight"), 4)).withColumn("ev_pred", X.fixed_number(F.col("ev_pred"), 6))
    body = table_text(shown, ["target_rank", "ts_code", "name", "weight", "ev_pred"], ["target_rank"])
    return f"# Decision {exec_date}\n\n- regime: {regime}\n- risk budget: {budget:g}\n\n{body}\n"


def daily_report(df: DataFrame, title: str, order: str = "rank") -> str:
    """The headers are the reference format's."""
    names = {"rank": "排名", "ts_code": "代码", "name": "名称", "board": "行业", "Probability": "概率", "StrengthScore": "强度得分", "ThemeBoost": "题材加权"}
    use = [c for c in names if c in df.columns]
    return f"# {title}\n\n" + table_text(df, use, [F.col(order).asc_nulls_last()], 10, [names[c] for c in use]) + "\n"


#: Risks of a rank table, and what they are called.
RISKS = {"risk_liquidity": "Liquidity", "risk_volatility": "Volatility", "risk_crowding": "Crowding", "risk_event": "Event"}


def premium_report(ranked: DataFrame, trade_date: str, topk: int = 10) -> str:
    """The first rows, how many rows each kind of risk marks, and, where returns are known, how good the ranking was."""
    shares = {"pred_up_prob": 2, "pred_ret_mean": 2, "pred_ev": 3, "real_premium_ret": 2}
    shown = ranked.withColumns({c: X.percent(F.col(c), n) for c, n in shares.items()})
    table = table_text(shown, ["rank_pred_ev", "ts_code", "name", "pred_up_prob", "pred_ret_mean", "pred_ev", "risk_liquidity", "fill_risk_hint", "real_premium_ret"], ["rank_pred_ev"], topk)
    there = [F.count(c).alias(f"n_{c}") for c in (*RISKS, "fill_risk_hint")]
    one = ranked.agg(F.count("*").alias("n"), F.max("next_trade_date").alias("next"), F.max("model_version").alias("model"), *there, *[F.count_if(F.col(c) == "HIGH").alias(c) for c in RISKS]).first()
    lines = [f"# Premium ranking {trade_date}", "", f"- next trade date: {one['next'] or '-'}", f"- model: {one['model'] or '-'}", "", table, ""]
    lines += [f"{RISKS[c]} risk HIGH: {one[c]} of {one['n']}" for c in RISKS if one[f"n_{c}"] or c == "risk_liquidity"]
    lines += [f"Fill risk: {one['n_fill_risk_hint']} rows have a hint; it doesn't change the order"] if one["n_fill_risk_hint"] else []
    top = ranked.where(F.col("rank_pred_ev") <= topk)
    hit, mean, known = top.agg(F.avg(F.when(F.coalesce("real_premium_ret", X.double(0)) > 0, 1.0).otherwise(0.0)), F.avg("real_premium_ret"), F.count("real_premium_ret")).first()
    if known:
        ic = evaluation.rank_ic(ranked.where("real_premium_ret is not null"), "pred_ev", "real_premium_ret", method="average").first()["rank_ic"]
        lines += ["", f"HitRate@{topk}: {hit:.2%}, MeanRet@{topk}: {mean:.3%}, RankIC: {'-' if ic is None else f'{ic:.4f}'}"]
    else:
        lines += ["", "Realised returns aren't known yet."]
    return "\n".join(lines) + "\n"
