"""Files in and out, versioned tables, provenance, and the command line on small files."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators import allocation, features, feedback, models
from tickerloom.plans import cli, pipelines, validate
from tickerloom.sources import contracts as C
from tickerloom.sources import io, tables
from tickerloom.sources.provenance import RunContext


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_files_with_other_columns_are_matched_by_name(spark, tmp_path):
    put(tmp_path / "a_20260227.csv", "trade_date,ts_code,prob\n20260227,AAA,0.5\n")
    put(tmp_path / "b_20260226.csv", "﻿trade_date,name,ts_code,prob\n20260226,Bee,BBB,0.7\n20260225,,CCC,\n")
    put(tmp_path / "c_20260101.csv", "ts_code,prob\nDDD,0.1\n")
    put(tmp_path / "empty_20260101.csv", "")
    got = {r["ts_code"]: r for r in io.read_decision_inputs(spark, str(tmp_path / "*.csv")).collect()}
    assert {k: (r["name"], r["prob"], r["__file_date"], r["__file_no"]) for k, r in got.items()} == {
        "AAA": (None, "0.5", "20260227", 2), "BBB": ("Bee", "0.7", "20260226", 1), "CCC": (None, None, "20260226", 1), "DDD": (None, "0.1", None, 3),
    }


def test_encoding_is_that_of_the_whole_file(spark, tmp_path):
    rows = [f"2026022{i % 8},c{i},plain" for i in range(20000)] + ["20260227,last,银行,地产".replace(",地产", "")]
    late = put(tmp_path / "late_20260227.csv", "trade_date,ts_code,名称\n" + "\n".join(rows) + "\n", "gbk")
    put(tmp_path / "utf_20260227.csv", 'trade_date,ts_code,名称\n20260227,u,"证券, 一"\n')
    got = io.read_csv_text(spark, late)
    assert got.count() == len(rows) and got.where("ts_code = 'last'").first()["名称"] == "银行"
    both = {r["ts_code"]: r["名称"] for r in io.read_csv_files(spark, str(tmp_path / "*.csv")).where("ts_code in ('u', 'last', 'c1')").collect()}
    assert both == {"u": "证券, 一", "last": "银行", "c1": "plain"}
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_candidates_take_the_date_of_their_file(spark, tmp_path):
    put(tmp_path / "decision_candidates_20260227.csv", "ts_code,signal_date,exec_date\na,,\nb,20260101,20260102\n")
    got = {r["ts_code"]: (r["signal_date"], r["exec_date"], r["name"]) for r in io.read_candidates(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"a": ("20260227", "20260227", ""), "b": ("20260101", "20260102", "")}


def test_closes_have_their_optional_columns(spark, tmp_path):
    put(tmp_path / "x.csv", "日期,代码,收盘价,昨收\n2026-02-27, a ,2.5,2.4\n")
    r = io.read_closes(spark, str(tmp_path / "x.csv")).first()
    assert (r["trade_date"], r["ts_code"], r["close"], r["pre_close"], r["vol"]) == ("20260227", "a", 2.5, 2.4, None)


def test_exports_never_cut(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    io.export_csv(spark.range(5), path)
    with pytest.raises(C.ContractError, match="more than 3"):
        io.export_csv(spark.range(5), path, most=3)
    assert open(path).read().split() == ["id", "0", "1", "2", "3", "4"]
    assert spark.read.option("header", True).csv(io.write_csv(spark.range(5), str(tmp_path / "folder"))).count() == 5


def test_missing_files_and_json(spark, tmp_path):
    assert io.read_table_text(spark, str(tmp_path / "no.csv"), C.FILLS).count() == io.read_table_text(spark, None, C.FILLS).count() == 0
    assert io.read_snapshot(spark, str(tmp_path / "no.csv")).count() == 0
    good, bad = put(tmp_path / "g.json", '{"exec_date": "1",\n "picked": 3}'), put(tmp_path / "b.json", "not json")
    assert io.json_problems(spark, good, ["exec_date", "picked"]) == [] and len(io.json_problems(spark, good, ["paths"])) == 1
    assert "no JSON" in io.json_problems(spark, bad, [])[0] and "missing" in io.json_problems(spark, str(tmp_path / "none.json"), [])[0]


def test_a_day_that_cannot_be_read_is_stored_anew(spark, tmp_path):
    bars = spark.createDataFrame([("a", "20260227", 1.0)], "ts_code string, trade_date string, close double")
    asked = []
    store = io.MarketStore(spark, str(tmp_path / "m"), fetch=lambda day: asked.append(day) or bars)
    assert store.load("20260227").count() == 1 and store.load("20260227").count() == 1 and asked == ["20260227"]
    for f in (tmp_path / "m" / "trade_date=20260227").glob("*.parquet"):
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert store.load("20260227").first()["close"] == 1.0 and len(asked) == 2
    with pytest.raises(C.ContractError):
        io.MarketStore(spark, str(tmp_path / "m"), mode="cache_only").load("20260101")
    put(tmp_path / "mirror" / "20260302.csv", "ts_code,trade_date,close\na,20260302,3\n")
    mirrored = io.MarketStore(spark, str(tmp_path / "m"), mirrors=(str(tmp_path / "no/{day}.csv"), str(tmp_path / "mirror/{day}.csv")))
    assert mirrored.load("20260302").first()["close"] == 3.0


def test_learning_table_is_made_and_brought_in_order(spark, tmp_path):
    table = tables.learning_table(spark, str(tmp_path)).ensure()
    assert table.read().columns == C.LEARNING.names and table.read().count() == 0
    table.write(spark.createDataFrame([("20260302", "a", "x")], "exec_date string, ts_code string, wild string"))
    table.ensure()
    assert table.read().columns == C.LEARNING.names and [r["ts_code"] for r in table.read().collect()] == ["a"] and table.next_batch() == 3
    table.ensure()
    assert table.next_batch() == 3


def test_provenance(spark):
    run = RunContext.here({"GITHUB_SHA": "0123456789abcdef", "GITHUB_RUN_ID": "7"}, now=datetime(2026, 2, 27, 20, tzinfo=timezone.utc))
    assert (run.run_id, run.commit_sha, run.created_at_utc, run.generated_at_bjt) == ("gh_7", "0123456789ab", "2026-02-27T20:00:00Z", "2026-02-28 04:00:00+0800")
    assert RunContext.here({}, "/", datetime(2026, 2, 27, tzinfo=timezone.utc)).commit_sha == "unknown"
    got = pipelines.candidate_snapshot(spark.createDataFrame([("a", "")], "ts_code string, signal_date string"), run, "2026-02-27").first()
    assert (got["commit_sha"], got["version"], got["p_fill_pred"], got["name"], got["signal_date"]) == ("0123456789ab", 1, 0.0, "", "2026-02-27")
    kept = pipelines.candidate_snapshot(spark.createDataFrame([("a", ""), ("b", "20260101")], "ts_code string, signal_date string"), run, "20260227")
    assert sorted(r["signal_date"] for r in kept.collect()) == ["", "20260101"]


def test_stop_predicts_nothing(spark):
    rows = [(f"c{i}", f"n{i}", "20260227", "20260302", 0.5, i) for i in range(3)]
    snapshot = spark.createDataFrame(rows, "ts_code string, name string, trade_date string, target_trade_date string, prob double, __pos long")
    got = pipelines.decide(snapshot, order="__pos", guardrail=lambda df: True)
    assert got.stopped and got.weights.count() == got.signals.count() == 0
    assert {(r["p_fill_pred"], r["e_ret_pred"], r["ev_pred"], r["cost_est"]) for r in got.candidates.collect()} == {(0.0, 0.0, 0.0, 0.0008)}


def test_no_sensible_number_of_targets_is_the_default():
    assert allocation.Caps(topn=0) == allocation.Caps(topn=-3) == allocation.Caps()


def test_the_last_row_of_a_key_wins(spark):
    base = spark.createDataFrame([("d", "a", 1.0)], "exec_date string, ts_code string, buy_price double")
    patch = spark.createDataFrame([("d", "a", 9.0, 1), ("d", "a", 2.0, 2), ("d", "b", 5.0, 1), ("d", "b", 3.0, 1)], "exec_date string, ts_code string, buy_price double, at int")
    assert sorted(map(tuple, feedback.upsert(base, patch, order="at").collect())) == [("d", "a", 2.0), ("d", "b", 5.0)]
    fills = spark.createDataFrame([("d", "a", 10.0, 10.0, 9.0), ("d", "a", 10.0, 5.0, 2.0)], "exec_date string, ts_code string, target_amount double, filled_amount double, buy_price double").coalesce(1)
    got = pipelines.merge_feedback(C.empty_table(spark, C.LEARNING), fills, None).collect()
    assert [(r["fill_rate_real"], r["buy_price"]) for r in got] == [(0.5, 2.0)]


def test_features_are_found_known_or_all_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4)], "x__amount double, x__auto__z double, x__other double, close_2 int")
    assert features.feature_names(df) == ["x__auto__z", "x__amount"]
    assert features.feature_names(df.select(F.lit(1.0).alias("a"), "close_2", F.lit("t").alias("t"))) == ["a"]


def test_numbers_are_cut_towards_zero_and_white_space_goes(spark):
    df = spark.createDataFrame([("-1.5",), ("\t20260227.0　",), ("1.9",), ("1e400",)], "v string")
    assert [r[0] for r in df.select(X.norm_ymd(F.col("v"))).collect()] == ["-1", "20260227", "1", "1e400"]


def test_logistic_equals_a_newton_solve(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + rng.normal(size=120) > 0.4).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int")
    got = [r["p"] for r in models.fit_logistic(df, ["a", "b"], "y").apply(df, "p").select("p").collect()]
    n, pos = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    z, w = np.hstack([x, np.ones((n, 1))]), np.zeros(3)
    for _ in range(50):  # minimise sum(weight * loss) + |w|^2 / 2, intercept free
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (weight * (p - y)) + np.array([w[0], w[1], 0])
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 0])
        w = w - np.linalg.solve(curve, slope)
    assert np.abs(np.array(got) - 1 / (1 + np.exp(-z @ w))).max() < 1e-3


def test_boosting_comes_close_to_trees_grown_by_hand(spark):
    """One feature, two levels: the fitted value of each level is its mean, up to what 300 steps of 0.05 leave."""
    df = spark.createDataFrame([(float(i % 2), float(3 * (i % 2) + 1)) for i in range(120)], "x double, r double")
    got = {r["x"]: r["p"] for r in models.fit_boosted(df, ["x"], "r").apply(df, "p").collect()}
    assert abs(got[0.0] - 1) < 0.01 and abs(got[1.0] - 4) < 0.01


def test_command_line_decides_merges_twice_and_checks(spark, tmp_path, monkeypatch):
    rows = "".join(f"20260227,20260302,c{i:02d}.SZ,n{i},{0.3 + i / 100:.2f},{i}\n" for i in range(30))
    put(tmp_path / "snap.csv", "trade_date,target_trade_date,ts_code,name,prob,StrengthScore\n" + rows)
    out = str(tmp_path / "out")
    monkeypatch.setenv("TICKERLOOM_ROOT", str(tmp_path))
    monkeypatch.setattr(spark, "stop", lambda: None)
    assert cli.main(["decide", "--snapshot", "snap.csv", "--out", out]) == 0
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.csv")) == ["decision_candidates_20260227.csv", "top10_20260227.csv", "top10_latest.csv", "weights_20260302.csv", "weights_latest.csv"]
    fills = put(tmp_path / "f1.csv", "exec_date,ts_code,target_amount,filled_amount,buy_price\n20260302,c01.SZ,100,50,2\n")
    more = put(tmp_path / "f2.csv", "exec_date,ts_code,target_amount,filled_amount,buy_price\n20260302,c02.SZ,100,100,3\n")
    returns = put(tmp_path / "r.csv", "exec_date,ts_code,sell_price,ret_exec\n20260302,c01.SZ,2.2,0.1\n")
    assert cli.main(["merge", "--fills", fills, "--out", out]) == cli.main(["merge", "--fills", more, "--returns", returns, "--out", out]) == 0
    got = {r["ts_code"]: (r["fill_rate_real"], r["ret_exec"]) for r in tables.learning_table(spark, out).read().collect()}
    assert got == {"c01.SZ": (0.5, 0.1), "c02.SZ": (1.0, None)}
    assert cli.main(["validate", "--out", out]) == 0
    assert cli.main(["merge", "--fills", str(tmp_path / "not there.csv"), "--out", out]) == 0
    assert {r["ts_code"] for r in tables.learning_table(spark, out).read().collect()} == {"c01.SZ", "c02.SZ"}
    assert cli.validate_output(spark, out) == []
    # planted defects, each named
    weights = tmp_path / "out/weights/weights_latest.csv"
    whole = weights.read_text("utf-8-sig")
    weights.write_text(whole + whole.splitlines()[1] + "\n", "utf-8")
    found = cli.validate_output(spark, out)
    assert len(found) == 1 and "weights_latest" in found[0] and "more than once" in found[0]
    weights.write_text(whole, "utf-8-sig")
    (tmp_path / "out/eval_20260302.json").write_text('{"exec_date": "20260303", "paths": 1}')
    assert len(cli.validate_output(spark, out)) == 2
    (tmp_path / "out/decision_report_20260302.md").unlink()
    (tmp_path / "out/signals/top10_20260227.csv").unlink()
    found = cli.validate_output(spark, out)
    assert len(found) == 4 and "signals_dated: missing" in found and "decision_report_20260302.md: missing" in found


def test_rules_of_a_table_are_checked_in_one_job(spark):
    rules = validate.Rules(["d", "k", "p"], ("k",), {"p": (0, 1)}, "d")
    check = lambda rows: validate.check_table(spark.createDataFrame(rows, "d string, k string, p string"), rules, "t")
    good = check([("2026-02-27", "a", "0.5"), (None, "b", None)])
    assert (good.problems, good.rows) == (["t: d is no date: 2026-02-27"], 2)
    assert check([("20260227", "a", "0.5"), ("20260227.0", "b", "1")]).problems == []
    assert check([]).problems == []
    bad = check([("20260227", "a", "1.5"), ("20260228", "a", "-1"), ("20260228", " ", "x")]).problems
    assert bad == ["t: 1 rows lack one of k", "t: 1 values of k occur more than once", "t: d has several dates, 20260227 to 20260228", "t: 2 values of p outside (0, 1)"]
    assert validate.check_table(None, rules, "t").problems == ["t: missing"]
    assert "lacks columns: k, p" in validate.check_table(spark.createDataFrame([("x",)], "d string"), rules, "t").problems[0]
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("one check", "")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check([("20260227", "a", "0.5"), ("20260227", "b", "0.5")])
        assert len(tracker.getJobIdsForGroup("one check")) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        context.setJobGroup("", "")


def test_command_line_predicts_the_latest_or_a_given_day(spark, tmp_path, monkeypatch, capsys):
    days, folder = ["20260225", "20260226", "20260227"], tmp_path / "data/decision"
    folder.mkdir(parents=True)
    for day in days:
        put(folder / f"decision_candidates_{day}.csv", "trade_date,ts_code,name,rank,prob\n" + "".join(f"{day},c{i:02d}.SZ,n{i},{i + 1},0.{i}\n" for i in range(8)))
    bars = [(f"c{i:02d}.SZ", day, 10.0 + i + k) for k, day in enumerate(days) for i in range(8)]
    monkeypatch.setenv("TICKERLOOM_ROOT", str(tmp_path))
    monkeypatch.setattr(spark, "stop", lambda: None)
    out = str(tmp_path / "out")
    assert cli.main(["predict", "--out", out]) == 0  # no bars yet
    spark.createDataFrame(bars, "ts_code string, trade_date string, close double").write.parquet(str(tmp_path / "data/market/daily"))
    assert cli.main(["predict", "--trade_date", days[0], "--out", out]) == 0
    assert cli.main(["predict", "--trade_date", "20300101", "--out", out]) == 1
    ranked = spark.read.parquet(f"{out}/rank").collect()
    assert {str(r["trade_date"]) for r in ranked} == {days[0], days[2]} and len(ranked) == 16
    assert {(r["next_trade_date"], r["real_premium_ret"] is None) for r in ranked if str(r["trade_date"]) == days[0]} == {(days[1], False)}
    assert "aren't known yet" in (tmp_path / f"out/rank_report_{days[2]}.md").read_text() and "HitRate@10: 100.00%" in (tmp_path / f"out/rank_report_{days[0]}.md").read_text()
    assert cli.main(["train", "--out", out]) == 0
    assert "2 ok, 1 pending, 0 failed, 0 skipped" in capsys.readouterr().out
