"""The premium dataflow from decision files and bars to ranks, evaluation and report."""

import random
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import features
from tickerloom.plans import pipelines, reports
from tickerloom.sources import contracts as C
from tickerloom.sources.io import Config
from tickerloom.sources.provenance import RunContext

DAYS = [(date(2026, 1, 1) + timedelta(days=k)).strftime("%Y%m%d") for k in range(24)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows, bars = [], []
    for i, day in enumerate(DAYS):
        for k in range(12):
            good = rng.random()
            rows.append((day, f"c{k:02d}", f"n{k}", str(k + 1), f"{good:.4f}", f"{100 + k * 10 + i}" if k else "", f"{rng.random():.3f}", "text"))
            bars.append((f"c{k:02d}", day, 10.0 + k, good))
    # tomorrow's close follows today's probability
    last, closes = {}, []
    for code, day, base, good in bars:
        close = last.get(code, (base, 0.5))[0] * (1 + 0.1 * (last.get(code, (0, 0.5))[1] - 0.5))
        closes.append((code, day, close))
        last[code] = (close, good)
    decisions = spark.createDataFrame(rows, "Date string, `代码` string, name string, rank_no string, prob string, amount string, heat string, theme string")
    return decisions, spark.createDataFrame(closes, "ts_code string, trade_date string, close double")


def test_features_of_a_day_equal_numpy(tables):
    decisions, _ = tables
    built = pipelines.premium_features(decisions)
    names = features.feature_names(built)
    assert names == ["x__auto__heat", "x__rank_score", *(f"x__{c}" for c in features.KNOWN[1:])]  # words and files' dates are no features
    assert {r["x__vol"] for r in built.select("x__vol").collect()} == {0.0}
    rows = [r for r in built.where(F.col("trade_date") == DAYS[3]).orderBy("ts_code").collect()]
    amount = np.array([np.nan if r["ts_code"] == "c00" else 100 + int(r["ts_code"][1:]) * 10 + 3 for r in rows])
    filled = np.where(np.isnan(amount), np.nanmedian(amount), amount)
    assert np.allclose([r["x__amount"] for r in rows], (filled - filled.mean()) / filled.std())
    inverse = 1 / np.arange(1, 13)
    assert np.allclose([r["rank_score"] for r in rows], (inverse - inverse.min()) / (np.ptp(inverse) + 1e-12))
    known = amount[~np.isnan(amount)]
    assert [r["risk_liquidity"] for r in rows] == ["LOW" if a >= np.quantile(known, 0.2) else "HIGH" if a == a else None for a in amount]


def test_train_and_predict(spark, tables):
    decisions, bars = tables
    run = RunContext.here({"GITHUB_SHA": "a" * 40}, now=datetime(2026, 2, 1, tzinfo=timezone.utc), model_version="m1")
    counts: dict = {}
    undated = decisions.limit(1).withColumn("Date", F.lit("soon"))
    assert pipelines.premium_train(decisions.unionByName(undated), bars.where(F.col("trade_date") != DAYS[4]), Config(min_train_days=60), counts=counts) is None
    assert counts == {"ok": 22, "pending": 1, "failed": 1, "skipped": 1}
    up, ret, history = pipelines.premium_train(decisions, bars, Config(boosting_rounds=3, min_train_days=20, eval_k=3), run)
    assert up.fitted is not None and ret.fitted is not None and "x__auto__heat" in up.features
    r = history.first()
    assert history.count() == 1 and history.columns == C.EVAL_HISTORY.names
    assert (r["trade_date"], r["n"], r["topk"], r["commit_sha"], r["model_version"]) == (DAYS[-2], 12, 3, "a" * 12, "m1") and r["rank_ic"] > 0.5
    ranked = pipelines.premium_predict(decisions, up, ret, context=run).where(F.col("trade_date") == DAYS[-1]).orderBy("rank_pred_ev").collect()
    assert [x["rank_pred_ev"] for x in ranked] == list(range(1, 13)) and ranked[0].asDict().keys() == set(C.RANK.names)
    assert ranked == sorted(ranked, key=lambda x: (-x["pred_ev"], x["ts_code"])) and {x["created_at_utc"] for x in ranked} == {"2026-02-01T00:00:00Z"}
    assert all(abs(x["pred_ev"] - x["pred_up_prob"] * x["pred_ret_mean"]) < 1e-12 for x in ranked)
    by_prob = sorted(ranked, key=lambda x: -x["probability"]) if ranked[0]["probability"] is not None else ranked
    assert np.corrcoef([x["pred_up_prob"] for x in by_prob], range(12))[0, 1] < -0.8


def test_without_models_ranks_go_by_code(tables):
    decisions, _ = tables
    ranked = pipelines.premium_predict(decisions).where(F.col("trade_date") == DAYS[0]).orderBy("rank_pred_ev").collect()
    assert [x["ts_code"] for x in ranked] == [f"c{k:02d}" for k in range(12)] and {x["pred_up_prob"] for x in ranked} == {0.5}


def test_report_has_the_top_rows_and_the_risk(tables):
    decisions, _ = tables
    text = reports.premium_report(pipelines.premium_predict(decisions).where(F.col("trade_date") == DAYS[0]), DAYS[0], 5)
    assert text.count("| c0") == 5 and "50.00%" in text and "Liquidity risk HIGH: " in text
    assert "aren't known yet" in text


def test_realised_returns_reach_the_report(tables):
    decisions, bars = tables
    today, day = pipelines.of_day(decisions, DAYS[5])
    assert day == DAYS[5] and today.count() == 12 and pipelines.of_day(decisions)[1] == DAYS[-1] and pipelines.of_day(decisions, "20300101")[1] is None
    ranked = pipelines.premium_predict(today, real=pipelines.realised_returns(bars))
    assert {r["next_trade_date"] for r in ranked.collect()} == {DAYS[6]} and ranked.where("real_premium_ret is null").count() == 0
    text = reports.premium_report(ranked, day, 5)
    assert "RankIC: -" in text and f"next trade date: {DAYS[6]}" in text  # constant predictions have no correlation
    text = reports.premium_report(ranked.withColumn("pred_ev", F.col("real_premium_ret")), day, 5)
    assert "RankIC: 1.0000" in text


def test_counts_take_no_pass_of_their_own(tables):
    decisions, bars = tables
    samples, seen = pipelines.observed_samples(pipelines.premium_features(decisions), pipelines.dated_labels(bars))
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 1
    n = samples.count()
    assert seen.get["rows"] == n and pipelines.day_counts(seen) == {"ok": 23, "pending": 1, "failed": 0, "skipped": 0}
