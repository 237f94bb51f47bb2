"""Units and properties of the decision pipeline's operators."""

import random

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators import allocation, evaluation, features, feedback, labels, models, ranking, scoring
from tickerloom.plans import pipelines
from tickerloom.sources import contracts as C
from tickerloom.sources import io


def greedy(rows, caps):
    """The selection row by row: (target ids, backup ids)."""
    picked, used, gross = [], {}, 0.0
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for code, _, theme in order:
        if len(picked) >= caps.topn:
            break
        blank = theme is None or not theme.strip()
        if not blank and used.get(theme, 0.0) + caps.weight > caps.theme_cap:
            continue
        if gross + caps.weight > caps.gross_cap + 1e-9:
            break
        picked.append(code)
        gross += caps.weight
        if not blank:
            used[theme] = used.get(theme, 0.0) + caps.weight
    return picked, [r[0] for r in order if r[0] not in picked]


def test_capped_top_n_equals_greedy(spark):
    rng = random.Random(7)
    for _ in range(6):
        caps = allocation.Caps(rng.randint(1, 20), rng.choice([0.05, 0.12]), rng.choice([0.04, 0.25, 0.35]), rng.choice([0.5, 1.0]))
        rows = [(f"c{i:02d}", rng.choice([None, 0.1, 0.2, 0.3]), rng.choice([None, "", "a", "b", "c"])) for i in range(rng.randint(1, 30))]
        got = allocation.capped_top_n(spark.createDataFrame(rows, "ts_code string, ev_pred double, theme string"), caps).collect()
        targets = [r["ts_code"] for r in sorted((r for r in got if r["target_rank"]), key=lambda r: r["target_rank"])]
        backups = [r["ts_code"] for r in sorted((r for r in got if r["backup_rank"]), key=lambda r: r["backup_rank"])]
        assert (targets, backups) == greedy(rows, caps)
        dated = spark.createDataFrame(rows, "ts_code string, ev_pred double, theme string").withColumn("day", F.lit("d"))
        by_day = allocation.capped_top_n(dated, caps, keys=("day",)).drop("day")
        assert sorted(map(repr, by_day.select(*sorted(by_day.columns)).collect())) == sorted(repr(r) for r in allocation.capped_top_n(dated.drop("day"), caps).select(*sorted(by_day.columns)).collect())


def ordered(rows):
    value = lambda v: (1, 0) if v is None or v != v else (0, -v)
    return sorted(rows, key=lambda r: (value(r[0]), r[1] is None, r[1] or "", r[2]))


def test_rows_are_numbered_by_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 1.0, 1.0, rng.random(), float("nan")]), rng.choice([None, "a", f"c{k}"]), k, rng.choice([None, "x", "x", "x", "y"])) for k in range(500)]
    df = spark.createDataFrame(rows, "v double, t string, k long, day string").withColumn("nothing", F.lit(None)).repartition(5)
    order = [ranking.down(df, "v"), F.col("t").asc_nulls_last(), F.col("k")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        whole = ranking.number_rows(df, order, "n")
        assert whole.columns == [*df.columns, "n"]
        got = {r["k"]: r["n"] for r in whole.collect()}
        assert [got[r[2]] for r in ordered(rows)] == list(range(1, 501))
        by_day = {r["k"]: r["n"] for r in ranking.number_rows(df, order, "n", ("day",)).collect()}
        for day in (None, "x", "y"):
            own = [r for r in ordered(rows) if r[3] == day]
            assert [by_day[r[2]] for r in own] == list(range(1, len(own) + 1))
        equal = spark.range(300).select(F.lit(1.0).alias("v"), F.lit("a").alias("t"))
        placed = ranking.number_rows(equal, order[:2], "n")
        assert sorted(r["n"] for r in placed.collect()) == list(range(1, 301))
        assert ranking.number_rows(df.limit(0), [F.col("k")], "n").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_tied_rows_keep_one_place_however_often_they_are_read(spark):
    """All rows tie on value and code, their themes differ, and the input deals them out anew each time it is worked out: no theme may go
    beyond its room, and every number occurs once."""
    rows = spark.range(400).select(F.lit(0.5).alias("ev_pred"), F.lit("same").alias("ts_code"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("theme"))
    dealt = rows.repartition(7, F.rand())
    for keys in ((), ("day",)):
        got = allocation.capped_top_n(dealt.withColumn("day", F.lit("d")), allocation.Caps(), keys=keys)
        for _ in range(2):
            seen = got.collect()
            chosen = [r for r in seen if r["target_rank"]]
            assert sorted(r["target_rank"] for r in chosen) == list(range(1, 10)) and {sum(r["theme"] == t for r in chosen) for t in ("t0", "t1", "t2")} == {3}
            assert sorted(r["backup_rank"] for r in seen if r["backup_rank"]) == list(range(1, 392))
    first = sorted(map(repr, got.collect()))
    assert sorted(map(repr, got.collect())) == first


def test_targets_equal_the_capped_ones_and_number_nothing(spark):
    rng = random.Random(5)
    rows = [(f"c{i:03d}", rng.choice([None, float("nan"), rng.random()]), rng.choice([None, " ", "a", "b", "c", "d"])) for i in range(300)]
    df = spark.createDataFrame(rows, "ts_code string, ev_pred double, theme string")
    want = [tuple(r) for r in allocation.capped_top_n(df).where("target_rank is not null").select("ts_code", "target_rank", "weight").orderBy("target_rank").collect()]
    few = allocation.targets(df)
    assert [tuple(r) for r in few.select("ts_code", "target_rank", "weight").orderBy("target_rank").collect()] == want
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "rangepartitioning" not in plan


def brute_ranks(values, method):
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    out = [0.0] * len(values)
    for place, i in enumerate(order, 1):
        out[i] = float(place)
    if method == "average":
        for v in set(values):
            own = [i for i, x in enumerate(values) if x == v]
            mean = sum(out[i] for i in own) / len(own)
            for i in own:
                out[i] = mean
    return out


@pytest.mark.parametrize("method", ["ordinal", "average"])
def test_ranks_of_one_hot_day(spark, method):
    """Nearly all rows are of one day; no plan has a window over days."""
    import numpy as np

    rng = random.Random(6)
    rows = [("hot" if i % 50 else f"d{i % 3}", f"c{i:04d}", rng.choice([None, 0.0, round(rng.random(), 2)]), rng.choice([None, round(rng.random(), 2)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, p double, y double").repartition(6)
    got = evaluation.rank_ic(df, "p", "y", method=method)
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "windowspecdefinition" in x]
    assert all("__range" in x for x in windows)  # over a day's ranges, never over its rows
    for r in got.collect():
        own = [x for x in rows if x[0] == r["trade_date"]]
        a, b = (brute_ranks([x[k] for x in own], method) for k in (2, 3))
        assert r["n"] == len(own) and abs(r["rank_ic"] - np.corrcoef(a, b)[0, 1]) < 1e-9
    for r in evaluation.evaluate(df, "p", "y").collect():
        own = sorted((x for x in rows if x[0] == r["trade_date"]), key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))[:10]
        known = [x[3] for x in own if x[3] is not None]
        assert r["topk"] == len(own) and abs(r["hit_rate_at_k"] - sum((x[3] or 0) > 0 for x in own) / len(own)) < 1e-12
        assert (r["mean_ret_at_k"] is None) == (not known) and (not known or abs(r["mean_ret_at_k"] - sum(known) / len(known)) < 1e-12)


def test_what_is_not_known_adds_nothing(spark):
    df = spark.createDataFrame([(None, None, None), ("2", None, "x"), (None, 3e8, "30")], "a string, b double, c string")
    got = [r["p"] for r in df.select(X.fill_probability(F.col("a"), F.col("b"), F.col("c")).alias("p")).collect()]
    assert [round(p, 9) for p in got] == [0.35, 0.47, 0.3]
    bare = scoring.score_ev(scoring.adapt_snapshot(spark.createDataFrame([("a", "n", 0.5)], "ts_code string, name string, prob double"))).first()
    assert round(bare["p_fill_pred"], 9) == 0.35 and round(bare["e_ret_pred"], 9) == 0.009
    none = scoring.score_ev(scoring.adapt_snapshot(spark.createDataFrame([("a", "n")], "ts_code string, name string"))).first()
    assert round(none["e_ret_pred"], 9) == 0.003  # a probability that isn't known counts as 0.3


def test_theme_room_adds_as_a_running_sum():
    assert allocation.Caps(topn=20).theme_room() == 7


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("20260227.0",), ("2026-02-27",), (None,), ("3d",), ("nan",), (" 1e3 ",)], "v string")
    got = df.select(X.parse_ymd(F.col("v")).alias("d"), X.safe_number(F.col("v")).alias("n")).collect()
    assert [r["d"] for r in got][:2] == ["20260227", "20260227"]
    assert [r["n"] for r in got][3:] == [None, None, 1000.0]


def test_upsert_is_idempotent_and_keeps_old_values(spark):
    base = spark.createDataFrame([("d1", "a", 1.0, "x"), ("d1", "b", 2.0, None)], "exec_date string, ts_code string, buy_price double, exit_date string")
    patch = spark.createDataFrame([("d1", "a", None), ("d1", "c", 3.0), ("d1", "c", 3.0), ("d1", "", 9.0), (None, "q", 9.0)], "exec_date string, ts_code string, buy_price double")
    once = feedback.upsert(base, patch)
    twice = feedback.upsert(once, patch)
    want = [("d1", "a", 1.0, "x"), ("d1", "b", 2.0, None), ("d1", "c", 3.0, None)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_labels_zero_price_and_missing_day(spark):
    rows = [("a", "2024-01-01", 0.0), ("a", "2024-01-02", 2.0), ("b", "2024-01-01", 1.0)]
    bars = spark.createDataFrame(rows, "ts_code string, d string, close double").select("ts_code", F.col("d").cast("date").alias("trade_date"), "close")
    got = {(r["ts_code"], str(r["trade_date"])): (r["real_premium_ret"], r["reason"]) for r in labels.forward_labels(bars).collect()}
    assert got[("a", "2024-01-01")] == (None, None)
    assert got[("b", "2024-01-01")] == (None, "no_next_bar")
    assert got[("a", "2024-01-02")] == (None, "no_next_day")


def test_zscore_of_constant_is_zero(spark):
    df = spark.createDataFrame([("d", 5.0), ("d", 5.0), ("e", None)], "trade_date string, v double")
    out = features.zscore(features.median_fill(df, ["v"], ("trade_date",)), ["v"], ("trade_date",))
    assert {r["x__v"] for r in out.collect()} == {0.0}


def test_rank_ic_needs_three_rows(spark):
    df = spark.createDataFrame([("d", "a", 1.0, 1.0), ("d", "b", 2.0, 2.0)], "trade_date string, ts_code string, p double, y double")
    assert evaluation.rank_ic(df, "p", "y").first()["rank_ic"] is None


def test_model_fallbacks(spark):
    one_class = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    assert models.fit_logistic(one_class, ["x"], "y").constant == 1.0
    assert models.fit_boosted(one_class.withColumn("r", F.lit(0.5)), ["x"], "r", least=10).constant == 0.5


def test_boosting_goes_on_for_300_rounds(spark):
    rows = [(float(i % 20), float(i % 20 >= 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, r double")
    model = models.fit_boosted(df, ["x"], "r")
    assert len(model.fitted.trees) == 300 == io.Config().boosting_rounds
    loss = model.apply(df, "p").selectExpr("avg((p - r) * (p - r)) l").first()["l"]
    assert loss < 1e-3  # 0.25 for the mean; five rounds at step 0.05 leave it far from r


def test_alias_errors_list_all(spark):
    with pytest.raises(C.ContractError, match="trade_date, ts_code"):
        C.resolve_aliases(spark.createDataFrame([(1,)], "x int"), C.DECISION_REQUIRED)


def test_decide_and_export(spark, tmp_path):
    rows = [(i, f"{i:06d}.SZ", f"n{i}", "b", 0.3 + i / 100, 5.0, 1.0, "20260227", "20260302") for i in range(12)]
    df = spark.createDataFrame(rows, "rank int, ts_code string, name string, board string, prob double, StrengthScore double, ThemeBoost double, trade_date string, verify_date string")
    got = pipelines.decide(df)
    assert got.weights.where("weight > 0").count() == 3 and got.weights.count() == 12
    assert {r["jq_code"][-5:] for r in got.signals.collect()} == {".XSHE"}
    paths = io.export_dated(got.weights, str(tmp_path), "weights", "20260302", bom=True)
    assert [open(p, "rb").read(3) for p in paths] == [b"\xef\xbb\xbf"] * 2
    back = io.read_csv_text(spark, paths[0])
    assert back.columns == C.WEIGHTS.names and back.count() == 12


def test_streamed_upserts(spark, tmp_path):
    from tickerloom.streaming.feedback_stream import VersionedTable, start_upserts

    schema = C.struct("exec_date string, ts_code string, fill_rate_real double, filled_flag int, buy_price double")
    source = str(tmp_path / "in")
    spark.createDataFrame([("20260302", "a", 10.0, 5.0, 2.0)], "exec_date string, ts_code string, target_amount double, filled_amount double, buy_price double").write.json(source)
    table = VersionedTable(spark, str(tmp_path / "t"), schema)
    changes = spark.readStream.schema("exec_date string, ts_code string, target_amount double, filled_amount double, buy_price double").json(source)
    start_upserts(changes, table, feedback.fill_patch, str(tmp_path / "c")).awaitTermination()
    assert [tuple(r) for r in table.read().collect()] == [("20260302", "a", 0.5, 1, 2.0)]
