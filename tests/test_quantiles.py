"""Exact quantiles of groups of any size against DuckDB and against sorting."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import features
from tickerloom.operators.quantiles import quantiles

SHAPES = {
    "spread": lambda rng: rng.gauss(0, 1),
    "heavy": lambda rng: rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300),
    "ties": lambda rng: float(rng.choice([1, 1, 1, 2])),
    "two": lambda rng: rng.choice([0.0, 1.0]),
    "one": lambda rng: 7.0,
    "tied and spread": lambda rng: rng.choice([0.0, 0.0, 5.0, 5.0, rng.uniform(0, 5)]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_one_hot_day(spark, shape):
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 30 + ["a", None]), SHAPES[shape](rng) if rng.random() > 0.1 else None) for _ in range(3001)]
    rows += [("nothing", None)]
    df = spark.createDataFrame(rows, "day string, v double").repartition(4)
    fractions = [0.5, 0.2, 0.0, 1.0]
    got = {r["day"]: tuple(r)[1:] for r in quantiles(df, ["v"], fractions, ("day",), most=40, grid=8, accuracy=50).collect()}
    table = df.toPandas()
    sql = "SELECT day, count(v), " + ", ".join(f"quantile_cont(v, {f})" for f in fractions) + " FROM table GROUP BY day"
    con = duckdb.connect()
    con.register("t", table)
    want = {r[0]: r[1:] for r in con.execute(sql.replace("FROM table", "FROM t")).fetchall()}
    assert got.keys() == want.keys()
    for day, (n, *values) in want.items():
        assert got[day][0] == n
        for a, b in zip(got[day][1:], values):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12, abs=1e-300))


def test_medians_and_flags_of_a_large_day(spark):
    """A day beyond the limit and one within it, in two columns of which one is large."""
    df = spark.range(30_001).select((F.col("id") % 5 == 0).cast("string").alias("day"), F.when(F.col("id") % 3 != 0, F.hash("id").cast("double")).alias("v"), F.when(F.col("id") % 40 == 0, F.col("id").cast("double")).alias("w"))
    con = duckdb.connect()
    con.register("t", df.toPandas())
    want = {r[0]: r[1:] for r in con.execute("SELECT day, median(v), median(w) FROM t GROUP BY day").fetchall()}
    filled = features.median_fill(df.withColumn("hole", F.col("v").isNull()), ["v"], ("day",)).where("hole").groupBy("day").agg(F.min("v"), F.max("v"))
    assert {r[0]: (r[1], r[2]) for r in filled.collect()} == {k: pytest.approx((v[0], v[0])) for k, v in want.items()}
    medians = {r["day"]: (r["v__q0"], r["w__q0"]) for r in quantiles(df, ["v", "w"], [0.5], ("day",)).collect()}
    assert medians == {k: pytest.approx(v) for k, v in want.items()}
    flags = features.liquidity_flag(df, "v", ("day",)).groupBy("day").agg(F.count_if(F.col("risk_liquidity") == "HIGH").alias("n")).collect()
    low = dict(con.execute("SELECT t.day, count(*) FROM t JOIN (SELECT day, quantile_cont(v, 0.2) q FROM t GROUP BY day) x ON t.day = x.day WHERE v < q GROUP BY t.day").fetchall())
    assert {r["day"]: r["n"] for r in flags} == low


def test_no_rows_and_no_keys(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,)], "v double")
    assert [tuple(r) for r in quantiles(df, ["v"], [0.5], ()).collect()] == [(2, 2.5)]
    assert quantiles(df.withColumn("k", F.lit(1)).limit(0), ["v"], [0.5], ("k",)).collect() == []
