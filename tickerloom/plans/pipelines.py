"""The three dataflows composed of operators: decision, feedback, premium."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators import allocation, evaluation, features, feedback, labels, models, scoring
from tickerloom.operators.calendar import latest_days
from tickerloom.sources import contracts as C
from tickerloom.sources.io import Config
from tickerloom.sources.provenance import RunContext
from tickerloom.sources.shared import written

#: A strategy changes a candidate table; a regime and a guardrail answer from it.
Strategy = Callable[[DataFrame], DataFrame]


def identity_strategy(df: DataFrame) -> DataFrame:
    return df


def constant_regime(df: DataFrame) -> tuple[str, float]:
    return "RISK_ON", 1.0


def no_guardrail(df: DataFrame) -> bool:
    return False


@dataclass
class Decision:
    candidates: DataFrame
    weights: DataFrame
    signals: DataFrame
    regime: str = "RISK_ON"
    risk_budget: float = 1.0
    stopped: bool = False


def decide(snapshot: DataFrame, config: Config = Config(), order: str = "rank", strategy: Strategy = identity_strategy, regime=constant_regime, guardrail=no_guardrail) -> Decision:
    """Snapshot to candidates, weights (targets, then backups) and signals; one lazy plan up to the writers."""
    df = scoring.adapt_snapshot(C.require_columns(snapshot, ["name"], "snapshot"))
    C.require_columns(df, ["ts_code", "name"], "snapshot")
    mood, budget = regime(df)
    df = scoring.first_rows(strategy(df), order, config.topn, config.topk)
    dates = df.withColumns({"signal_date": X.norm_ymd(F.col("trade_date")), "exec_date": X.norm_ymd(X.choose_exec_date(F.col("target_trade_date").cast("string"), F.col("trade_date").cast("string"))), "exit_date": F.lit("")})
    stop = guardrail(df)
    valued = scoring.score_ev(dates, mood)
    if stop:  # a stop keeps cost and penalty and predicts nothing
        valued = valued.withColumns({c: X.double(0) for c in ("p_fill_pred", "e_ret_pred", "ev_pred")})
    scored = allocation.pick_theme(valued).withColumns({"regime": F.lit(mood), "risk_budget": X.double(budget)})
    caps = allocation.Caps(config.topn, config.w_max, config.theme_cap, config.gross_cap)
    ranked = allocation.capped_top_n(scored, caps)
    if stop:
        ranked = ranked.where(F.lit(False))
    weights = C.align_to_schema(ranked, C.WEIGHTS)
    out = allocation.signals(ranked, F.col("signal_date"), F.col("exec_date"), mood, budget)
    return Decision(scored, weights, out, mood, budget, stop)


def candidate_snapshot(candidates: DataFrame, context: RunContext, signal_date: str = "") -> DataFrame:
    """Candidates as they are stored: absent explain and audit columns get their defaults, and if every signal_date is
    blank, all are ``signal_date``."""
    C.require_columns(candidates, ["ts_code"], "candidates")
    lacking = {c: F.lit(v) for c, v in C.CANDIDATE_DEFAULTS.items() if c not in candidates.columns}
    out = context.stamp(candidates.withColumns(lacking), "generated_at_bjt", "commit_sha")
    blank = X.blank_to_null(F.col("signal_date")).isNull()
    if signal_date and out.agg(F.bool_and(blank)).first()[0]:
        out = out.withColumn("signal_date", X.norm_ymd(F.lit(signal_date)))
    return out


def merge_feedback(learning: DataFrame, fills: DataFrame | None, returns: DataFrame | None) -> DataFrame:
    """The learning table with what has come in; of a file's rows of one key the last one counts."""
    out = C.align_to_schema(learning, C.LEARNING)
    placed = lambda df: df.withColumn(feedback.PLACE, F.monotonically_increasing_id())
    if fills is not None:
        out = feedback.upsert(out, feedback.fill_patch(placed(C.require_columns(fills, ["exec_date", "ts_code", "target_amount", "filled_amount"], "fills"))))
    if returns is not None:
        out = feedback.upsert(out, feedback.return_patch(placed(C.require_columns(returns, ["exec_date", "ts_code", "sell_price", "ret_exec"], "returns"))))
    return C.align_to_schema(out, C.LEARNING)


def premium_features(decisions: DataFrame) -> DataFrame:
    df = C.resolve_aliases(decisions, C.DECISION_REQUIRED, C.DECISION_OPTIONAL, others=True)
    df = df.withColumn("ts_code", X.strip(F.col("ts_code")))
    return features.build_features(df.withColumn("trade_date", X.parse_ymd(F.col("trade_date"))).where(F.col("trade_date").isNotNull()))


def dated_labels(bars: DataFrame, config: Config = Config()) -> DataFrame:
    """Labels, pending ones too, with their days as text."""
    lab = labels.forward_labels(bars.withColumn("trade_date", X.ymd_date(F.col("trade_date"))), config.max_gap_days)
    return lab.withColumns({c: F.date_format(c, "yyyyMMdd") for c in ("trade_date", "next_trade_date")})


def realised_returns(bars: DataFrame, config: Config = Config()) -> DataFrame:
    return dated_labels(bars, config).where("real_premium_ret is not null").select("trade_date", "ts_code", "next_trade_date", "real_premium_ret")


def of_day(decisions: DataFrame, day: str | None = None) -> tuple[DataFrame, str | None]:
    """The decisions of a day, or of the latest one; None for a day without any."""
    named = C.resolve_aliases(decisions, {"trade_date": C.DECISION_REQUIRED["trade_date"]})
    column = C.quoted(C.find_alias(decisions.columns, C.DECISION_REQUIRED["trade_date"]))
    days = named.select(X.parse_ymd(F.col("trade_date")).alias("d"))
    found = (days.where(F.col("d") == X.parse_ymd(F.lit(day))) if day else days).agg(F.max("d")).first()[0]
    return decisions.where(X.parse_ymd(column) == F.lit(found)), found


def observed_samples(built: DataFrame, lab: DataFrame) -> tuple[DataFrame, Observation]:
    """Features with their labels, and the days by what became of them, gathered while the rows go by: no pass of its own. The sets
    hold days, of which there are a few thousand at most."""
    joined = built.join(lab.select("trade_date", "ts_code", "next_trade_date", "real_premium_ret", F.col("reason").alias("__reason"), F.lit(True).alias("__bar")), ["trade_date", "ts_code"], "left")
    days = lambda when: F.collect_set(F.when(when, F.col("trade_date")))
    seen = Observation()
    labelled, bar = F.col("real_premium_ret").isNotNull(), F.coalesce("__bar", F.lit(False))
    out = joined.observe(seen, days(labelled).alias("ok"), days(bar).alias("bars"), F.collect_set("trade_date").alias("days"), F.count_if(labelled).alias("rows"))
    return out.where(labelled).drop("__reason", "__bar"), seen


def day_counts(seen: Observation, skipped: int = 0) -> dict[str, int]:
    """ok (with labels), pending (bars, but no label yet), failed (no bars) and skipped (no date), once the samples have been read."""
    got = seen.get
    ok, bars, days = (set(got[c]) for c in ("ok", "bars", "days"))
    return {"ok": len(ok), "pending": len(bars - ok), "failed": len(days - bars), "skipped": skipped}


def premium_train(decisions: DataFrame, bars: DataFrame, config: Config = Config(), context: RunContext | None = None, counts: dict | None = None):
    """(classifier, regressor, evaluation of the last day) or None with too few days. ``counts`` gets the numbers of days by status, and of
    files without a date."""
    no_date = X.parse_ymd(C.quoted(C.find_alias(decisions.columns, C.DECISION_REQUIRED["trade_date"]) or "trade_date")).isNull()
    built = premium_features(decisions)
    samples, seen = observed_samples(built, dated_labels(bars, config))
    rows = samples.join(F.broadcast(latest_days(built, config.train_window_days)), "trade_date", "left_semi")
    rows = written(rows.withColumn("y", X.binarise(F.col("real_premium_ret"))), "training-rows")
    days, last = rows.agg(F.countDistinct("trade_date"), F.max("trade_date")).first()
    if counts is not None:
        file = F.col("__file") if "__file" in decisions.columns else F.lit("")
        counts |= day_counts(seen, decisions.where(no_date).agg(F.countDistinct(file)).first()[0])
    if days < config.min_train_days:
        return None
    names = features.feature_names(rows)
    up = models.fit_logistic(rows, names, "y")
    ret = models.fit_boosted(rows, names, "real_premium_ret", config.boosting_rounds, max(30, 5 * config.min_train_days))
    scored = models.predict(rows.where(F.col("trade_date") == last), up, ret)
    both = evaluation.evaluate(scored, "pred_ev", "real_premium_ret", k=config.eval_k).join(evaluation.rank_ic(scored, "pred_ev", "real_premium_ret").drop("n"), "trade_date")
    if context is not None:
        both = context.stamp(both, "run_id", "commit_sha", "created_at_utc", "model_version")
    return up, ret, C.align_to_schema(both, C.EVAL_HISTORY)


def premium_predict(decisions: DataFrame, up=None, ret=None, real: DataFrame | None = None, context: RunContext | None = None) -> DataFrame:
    """Ranked predictions of every day in ``decisions``, in the rank contract."""
    scored = models.predict(premium_features(decisions), up, ret)
    if real is not None:
        scored = scored.join(real.select("trade_date", "ts_code", "next_trade_date", "real_premium_ret"), ["trade_date", "ts_code"], "left")
    ranked = allocation.rank_desc(scored, "pred_ev", "ts_code", ("trade_date",), "rank_pred_ev").withColumnRenamed("rank", "decision_rank")
    if context is not None:
        ranked = context.stamp(ranked, "run_id", "commit_sha", "created_at_utc", "model_version", "data_snapshot")
    return C.align_to_schema(ranked, C.RANK)
