"""Registered queries of the decision pipeline's operators over stand-in tables, and their SQL.

Stand-ins: daily bars are the events of a user and day; the snapshot is ``part`` with sums of
``lineitem``; feedback is ``orders``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickerloom.functions import scalars as X
from tickerloom.operators import allocation, calendar, evaluation, features, feedback, labels, models, scoring
from tickerloom.plans import validate
from tickerloom.sources import contracts as C
from tickerloom.sources.buckets import BucketedTable
from tickerloom.sources.shared import fresh_path, written
from tickerloom.streaming import label_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: Columns that both sides give as text: engines hand dates over in different types.
DATES = ("trade_date", "next_trade_date")


def query(sql: str | None = None):
    """Register a query under its name; its dates come out as YYYYMMDD, on both sides."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({c: F.date_format(c, "yyyyMMdd") for c, t in df.dtypes if c in DATES and t == "date"})

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"SELECT * EXCLUDE ({', '.join(DATED[f.__name__])}), {{dates}} FROM ({sql})" if f.__name__ in DATED else sql
            ORACLE_SQL[f.__name__] = ORACLE_SQL[f.__name__].replace("{dates}", ", ".join(f"strftime({c}, '%Y%m%d') AS {c}" for c in DATED.get(f.__name__, ())))
        return run

    return add


_ONE, _TWO = DATES[:1], DATES
DATED = {
    "q_next_trade_day": _TWO, "q_next_day_probe10": _TWO, "q_forward_return_label": _TWO, "q_streamed_labels": _TWO, "q_last_n_days": _ONE, "q_rank_score": _ONE, "q_median_impute": _ONE, "q_zscore": _ONE,
    "q_liquidity_flag": _ONE, "q_hit_rate_mean_ret_at_k": _ONE, "q_rank_ic": _ONE, "q_binarize": _ONE, "q_premium_rank_constant": _ONE,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    """Rounded as DuckDB does: scaled in doubles, halves away from zero."""
    x, scale = (F.col(c) if isinstance(c, str) else c).cast("double"), X.double(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + X.double(0.5)) / scale


# ---------------------------------------------------------------- stand-ins


def snapshot(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").cast("double").alias("open_times"), (X.double(100) * F.round(F.sum("l_extendedprice"), 2)).alias("seal_amount"), F.avg("l_quantity").alias("turnover_rate"))
    part = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("ts_code"), F.col("p_name").alias("name"), F.col("p_type").alias("board"), F.col("p_brand").alias("brand"), ((F.col("p_retailprice") - 900) / 100).alias("prob"),
        F.col("p_size").cast("double").alias("StrengthScore"), (F.col("p_size") / X.double(25)).alias("ThemeBoost"), F.col("p_partkey"),
    )
    return part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").drop("l_partkey")


SNAPSHOT = """
l AS (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS open_times, 100 * round(sum(l_extendedprice), 2) AS seal_amount, avg(l_quantity) AS turnover_rate FROM lineitem GROUP BY 1),
snap AS (SELECT CAST(p_partkey AS VARCHAR) AS ts_code, p_name AS name, p_type AS board, p_brand AS brand, (p_retailprice - 900) / 100 AS prob,
  CAST(p_size AS DOUBLE) AS s, p_size / 25.0 AS t, p_partkey, open_times, seal_amount, turnover_rate FROM part LEFT JOIN l ON p_partkey = l_partkey),
ev0 AS (SELECT *, least(0.98, greatest(0.02, 0.35 + CASE WHEN open_times IS NULL THEN 0 ELSE 0.06 * least(5.0, greatest(0.0, open_times)) END - CASE WHEN seal_amount IS NULL THEN 0 ELSE 0.05 * least(5.0, seal_amount / 1e8) END
      + CASE WHEN turnover_rate IS NULL THEN 0 ELSE 0.005 * least(20.0, greatest(0.0, turnover_rate)) END)) AS p_fill_pred,
  least(0.08, greatest(-0.05, (least(1.0, greatest(0.0, prob)) - 0.2) * 0.03 + least(10.0, greatest(-2.0, s)) * 0.001 + least(3.0, greatest(-1.0, t)) * 0.003)) AS e_ret_pred FROM snap),
ev AS (SELECT *, round(CAST(p_fill_pred * e_ret_pred - 0.0008 AS DOUBLE), 9) AS ev_pred FROM ev0)"""


def scored(spark, d) -> DataFrame:
    return scoring.score_ev(scoring.adapt_snapshot(snapshot(spark, d))).withColumn("ev_pred", r("ev_pred", 9))


def bars(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("ts_code"), F.col("ts").cast("date").alias("trade_date"), "event_id", "value")
    return e.groupBy("ts_code", "trade_date").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("vol"), F.round(F.sum("value"), 2).alias("amount"))


BARS = """bars AS (SELECT CAST(user_id AS VARCHAR) AS ts_code, CAST(ts AS DATE) AS trade_date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS vol, round(sum(value), 2) AS amount FROM events GROUP BY 1, 2)"""
NEXT = "nxt AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS next_trade_date FROM (SELECT DISTINCT trade_date FROM bars))"
LABELS = """lab AS (SELECT b.trade_date, n.next_trade_date, b.ts_code, b.close AS close_2, c.close AS close_3, CASE WHEN b.close <> 0 THEN c.close / b.close - 1 END AS real_premium_ret,
  CASE WHEN n.next_trade_date IS NULL THEN 'no_next_day' WHEN c.ts_code IS NULL THEN 'no_next_bar' WHEN b.close IS NULL OR c.close IS NULL THEN 'no_close' END AS reason
  FROM bars b LEFT JOIN nxt n ON b.trade_date = n.trade_date LEFT JOIN bars c ON c.ts_code = b.ts_code AND c.trade_date = n.next_trade_date)"""

# ---------------------------------------------------------------- scoring and allocation


@query(f"WITH {SNAPSHOT[1:]} SELECT ts_code, name, round(CAST(p_fill_pred AS DOUBLE), 8) AS p_fill_pred, round(CAST(e_ret_pred AS DOUBLE), 8) AS e_ret_pred, CAST(0.0008 AS DOUBLE) AS cost_est, CAST(0 AS DOUBLE) AS risk_penalty, round(ev_pred, 8) AS ev_pred FROM ev")
def q_ev_score(spark, d):
    return scored(spark, d).select("ts_code", "name", r("p_fill_pred", 8).alias("p_fill_pred"), r("e_ret_pred", 8).alias("e_ret_pred"), "cost_est", "risk_penalty", r("ev_pred", 8).alias("ev_pred"))


@query(f"WITH {SNAPSHOT[1:]} SELECT ts_code, round(greatest(-0.05, least(0.08, e_ret_pred - 0.006)), 8) AS e_ret_pred, CAST(0.02 AS DOUBLE) AS risk_penalty FROM (SELECT ts_code, CAST((least(1.0, greatest(0.0, prob)) - 0.2) * 0.03 + least(10.0, greatest(-2.0, s)) * 0.001 + least(3.0, greatest(-1.0, t)) * 0.003 AS DOUBLE) AS e_ret_pred FROM snap)")
def q_ev_risk_off(spark, d):
    return scoring.score_ev(scoring.adapt_snapshot(snapshot(spark, d)), " risk_off ").select("ts_code", r("e_ret_pred", 8).alias("e_ret_pred"), "risk_penalty")


def _weights(spark, d, caps, theme="board"):
    out = allocation.capped_top_n(scored(spark, d), caps, theme=theme)
    return out.select("ts_code", theme, "ev_pred", "weight", F.col("target_rank").cast("long").alias("target_rank"), F.col("backup_rank").cast("long").alias("backup_rank"))


def _weights_sql(theme: str, room: int, topn: int, weight: float, source: str = "ev") -> str:
    return f"""WITH {SNAPSHOT[1:]},
a AS (SELECT ts_code, {theme}, ev_pred, {theme} IS NULL OR trim({theme}) = '' OR row_number() OVER (PARTITION BY {theme} ORDER BY ev_pred DESC, ts_code) <= {room} AS fits FROM {source}),
b AS (SELECT *, fits AND row_number() OVER (PARTITION BY fits ORDER BY ev_pred DESC, ts_code) <= {topn} AS target FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ev_pred DESC, ts_code) AS k FROM b)
SELECT ts_code, {theme}, ev_pred, CAST(CASE WHEN target THEN {weight} ELSE 0 END AS DOUBLE) AS weight, CASE WHEN target THEN k END AS target_rank, CASE WHEN NOT target THEN k END AS backup_rank FROM c"""


@query(_weights_sql("board", 3, 10, 0.1))
def q_capped_topn_weights(spark, d):
    return _weights(spark, d, allocation.Caps())


@query(_weights_sql("board", 2, 10, 0.1))
def q_capped_topn_tight(spark, d):
    return _weights(spark, d, allocation.Caps(theme_cap=0.25))


@query(_weights_sql("board", 2, 10, 0.1, "(SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '' ELSE board END AS board) FROM ev)"))
def q_capped_topn_themeless(spark, d):
    theme = F.when(F.col("p_partkey") % 3 == 0, None).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("board"))
    out = allocation.capped_top_n(scored(spark, d).withColumn("board", theme), allocation.Caps(theme_cap=0.25), theme="board")
    return out.select("ts_code", "board", "ev_pred", "weight", F.col("target_rank").cast("long").alias("target_rank"), F.col("backup_rank").cast("long").alias("backup_rank"))


@query(f"""WITH m AS (SELECT c_mktsegment, c_custkey, CAST(c_custkey AS VARCHAR) AS ts_code, c_acctbal AS ev_pred FROM customer),
a AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ev_pred DESC, ts_code) <= 2 AS fits FROM m),
b AS (SELECT *, fits AND row_number() OVER (PARTITION BY fits ORDER BY ev_pred DESC, ts_code) <= 10 AS target FROM a)
SELECT ts_code, CASE WHEN target THEN 'target' ELSE 'backup' END AS kind, CAST(row_number() OVER (PARTITION BY target ORDER BY ev_pred DESC, ts_code) AS BIGINT) AS place FROM b""")
def q_union_targets_backups(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ts_code"), F.col("c_acctbal").alias("ev_pred"), F.col("c_mktsegment").alias("theme"))
    w = allocation.capped_top_n(c, allocation.Caps(theme_cap=0.25))
    targets = w.where("weight > 0").select("ts_code", F.lit("target").alias("kind"), F.col("target_rank").cast("long").alias("place"))
    return targets.unionByName(w.where("weight = 0").select("ts_code", F.lit("backup").alias("kind"), F.col("backup_rank").cast("long").alias("place")))


@query(f"""WITH {SNAPSHOT[1:]},
k AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY ev_pred DESC, ts_code) <= 3 AS fits FROM ev),
p AS (SELECT * FROM k WHERE fits ORDER BY ev_pred DESC, ts_code LIMIT 10)
SELECT '20260227' AS trade_date, '20260302' AS target_trade_date, CASE WHEN p_partkey % 2 = 0 THEN ts_code || '.XSHE' ELSE ts_code || '.XSHG' END AS jq_code,
CAST(0.1 AS DOUBLE) AS target_weight, CAST(1 AS DOUBLE) AS risk_budget, 'RISK_ON' AS regime, 'P0_EV_weight' AS reason FROM p""")
def q_signals(spark, d):
    w = allocation.targets(scored(spark, d), theme="board")
    coded = w.withColumn("ts_code", F.concat("ts_code", F.when(F.col("p_partkey") % 2 == 0, ".SZ").otherwise(".SH")))
    return allocation.signals(coded, F.lit("20260227"), F.lit("20260302"))


@query("SELECT s_suppkey, CAST(0.9 AS DOUBLE) / count(*) OVER (PARTITION BY s_nationkey) AS target_weight FROM supplier")
def q_equal_weight(spark, d):
    return allocation.equal_weight(table(spark, d, "supplier"), 0.9, ("s_nationkey",)).select("s_suppkey", "target_weight")


@query("SELECT CAST(p_partkey AS VARCHAR) AS ts_code, CAST(0.1 AS DOUBLE) AS weight FROM part ORDER BY p_partkey LIMIT 10")
def q_equal_weight_p0(spark, d):
    return allocation.equal_weight_signals(snapshot(spark, d).select("ts_code", "p_partkey"), "p_partkey").select("ts_code", "weight")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def q_topk_file_order(spark, d):
    return scoring.first_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_brand END), ''), nullif(trim(p_type), '')) AS theme FROM part")
def q_theme_pick(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(F.col("p_brand")).alias("theme"), F.col("p_type").alias("board"))
    return allocation.pick_theme(df).select("p_partkey", "theme")


@query(f"WITH {SNAPSHOT[1:]} SELECT board, ts_code, ev_pred, CAST(row_number() OVER (PARTITION BY board ORDER BY ev_pred DESC, ts_code) AS BIGINT) AS rank_pred_ev FROM ev")
def q_rank_pred_ev(spark, d):
    out = allocation.rank_desc(scored(spark, d), "ev_pred", "ts_code", ("board",), "rank_pred_ev")
    return out.select("board", "ts_code", "ev_pred", F.col("rank_pred_ev").cast("long").alias("rank_pred_ev"))


# ---------------------------------------------------------------- scalars and contracts

#: Texts made of every event's day, and of its numbers, in several forms; the same on both sides.
def _dates():
    day, iso = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "yyyy-MM-dd")
    forms = (F.concat(F.lit(" \t"), day, F.lit(" ")), F.concat(day, F.lit(".0")), iso, F.concat(F.substring(day, 1, 1), F.lit("."), F.substring(day, 2, 7), F.lit("e7")), F.concat(day, F.lit(".75")), F.lit(""), F.concat(F.lit("bad"), day))
    return F.element_at(F.array(*forms), (F.col("event_id") % 7 + 1).cast("int"))


def _numbers():
    n = F.concat(F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 100).cast("string"))
    forms = (n, F.concat(F.lit(" "), n, F.lit("\t")), F.concat(n, F.lit("e2")), F.concat(n, F.lit("d")), F.concat(F.lit("-."), F.col("user_id").cast("string")), F.lit(""), F.concat(F.lit("1,"), n), F.lit("nan"))
    return F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))


_NUMBER_SQL = "'[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?'"
_STRIP_SQL = "trim({0}, ' ' || chr(9))"
_DATES_SQL = "[' ' || chr(9) || d || ' ', d || '.0', i, d[1] || '.' || d[2:] || 'e7', d || '.75', '', 'bad' || d][event_id % 7 + 1]"
_NORM_SQL = f"""(SELECT event_id, v, regexp_replace({_STRIP_SQL.format('v')}, '\\.0$', '') AS t FROM (SELECT event_id, {_DATES_SQL} AS v
  FROM (SELECT event_id, strftime(ts, '%Y%m%d') AS d, strftime(ts, '%Y-%m-%d') AS i FROM events)))"""


@query(f"SELECT event_id, CASE WHEN regexp_full_match(t, '\\d{{8}}') THEN t WHEN regexp_full_match(t, {_NUMBER_SQL}) THEN CAST(CAST(trunc(CAST(t AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE t END AS ymd FROM {_NORM_SQL}".replace("CAST(t AS DOUBLE)", "TRY_CAST(t AS DOUBLE)"))
def q_norm_ymd(spark, d):
    return table(spark, d, "events").select("event_id", X.norm_ymd(_dates()).alias("ymd"))


@query(f"SELECT event_id, CASE WHEN regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN replace(s, '-', '') ELSE s END AS ymd, coalesce(nullif(s, ''), '20260101') AS exec_date FROM (SELECT event_id, {_STRIP_SQL.format('v')} AS s FROM {_NORM_SQL})")
def q_to_ymd(spark, d):
    return table(spark, d, "events").select("event_id", X.to_ymd(_dates()).alias("ymd"), X.choose_exec_date(_dates(), F.lit("20260101")).alias("exec_date"))


@query(f"""WITH v AS (SELECT event_id, user_id || '.' || event_id % 100 AS n, CAST(user_id AS VARCHAR) AS u FROM events),
t AS (SELECT event_id, {_STRIP_SQL.format("[n, ' ' || n || chr(9), n || 'e2', n || 'd', '-.' || u, '', '1,' || n, 'nan'][event_id % 8 + 1]")} AS t FROM v),
x AS (SELECT event_id, CASE WHEN regexp_full_match(t, {_NUMBER_SQL}) THEN TRY_CAST(t AS DOUBLE) END AS number FROM t)
SELECT event_id, number, coalesce(number, 0) AS number_or_0 FROM x""")
def q_safe_number(spark, d):
    return table(spark, d, "events").select("event_id", X.safe_number(_numbers()).alias("number"), X.number_or(_numbers(), 0).alias("number_or_0"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 10, '%Y%m%d') AS later, strftime(o_orderdate, '%Y') AS year FROM orders")
def q_date_add(spark, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, d, "orders").select("o_orderkey", X.add_days(day, 10).alias("later"), F.substring(day, 1, 4).alias("year"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(printf('%.2f', CAST(p_retailprice AS DOUBLE)), '0+$', ''), '\\.$', '') AS price, printf('%.2f', CAST(p_size AS DOUBLE) * 100) || '%' AS share FROM part")
def q_format_number(spark, d):
    return table(spark, d, "part").select("p_partkey", X.fixed_number(F.col("p_retailprice").cast("double"), 2).alias("price"), X.percent(F.col("p_size").cast("double")).alias("share"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS ts_code, CAST(NULL AS VARCHAR) AS name, CAST(p_size AS INTEGER) AS target_rank, CAST(NULL AS DOUBLE) AS weight FROM part")
def q_schema_align(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_size").alias("target_rank"), F.lit("x").alias("unknown"))
    return C.align_to_schema(df, C.struct("ts_code string, name string, target_rank int, weight double"))


@query("SELECT '20260227' AS trade_date, CAST(p_partkey AS VARCHAR) AS ts_code, p_name AS name, CAST(p_size AS VARCHAR) AS rank, CAST(p_retailprice AS VARCHAR) AS probability FROM part")
def q_alias_resolve(spark, d):
    df = table(spark, d, "part").select(F.lit("20260227").alias(" Date "), F.col("p_partkey").cast("string").alias("代码"), F.col("p_name").alias("Stock_Name"), F.col("p_size").cast("string").alias("rank_no"), F.col("p_retailprice").cast("string").alias("PROB"))
    return C.resolve_aliases(df, C.DECISION_REQUIRED, C.DECISION_OPTIONAL).select("trade_date", "ts_code", "name", "rank", "probability")


@query("SELECT p_type, arg_min(p_name, p_partkey) FILTER (WHERE p_size > 10) AS first_value FROM part GROUP BY p_type")
def q_first_value(spark, d):
    named = table(spark, d, "part").withColumn("n", F.when(F.col("p_size") > 10, F.col("p_name")))
    return validate.first_values(named, "n", "p_partkey", ("p_type",))


# ---------------------------------------------------------------- bars, calendar, labels


@query(f"WITH {BARS} SELECT ts_code, strftime(trade_date, '%Y%m%d') AS trade_date, open, high, low, close, vol, amount FROM bars")
def q_daily_bars(spark, d):
    from tickerloom.sources.io import normalise_bars

    raw = bars(spark, d).withColumnRenamed("close", "CLOSE").withColumn("trade_date", F.col("trade_date").cast("string"))
    return normalise_bars(raw)


@query(f"WITH {BARS}, {NEXT} SELECT trade_date, next_trade_date FROM nxt")
def q_next_trade_day(spark, d):
    return calendar.next_trade_days(bars(spark, d))


@query("""WITH days AS (SELECT DISTINCT make_date(year(o_orderdate), month(o_orderdate), CASE WHEN day(o_orderdate) <= 10 THEN 1 ELSE 11 END) AS trade_date FROM orders)
SELECT a.trade_date, min(b.trade_date) AS next_trade_date FROM days a LEFT JOIN days b ON b.trade_date > a.trade_date AND b.trade_date <= a.trade_date + 10 GROUP BY 1""")
def q_next_day_probe10(spark, d):
    """A sparse calendar of all orders: the 1st and the 11th of each month, so every other gap is within ten days."""
    day = F.when(F.dayofmonth("o_orderdate") <= 10, 1).otherwise(11)
    sparse = table(spark, d, "orders").select(F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), day).alias("trade_date"))
    return calendar.next_trade_days(sparse, max_gap_days=10)


@query(f"WITH {BARS}, {NEXT}, {LABELS} SELECT trade_date, next_trade_date, ts_code, close_2, close_3, round(real_premium_ret, 8) AS real_premium_ret, reason IS NOT NULL AS pending, reason FROM lab")
def q_forward_return_label(spark, d):
    return labels.forward_labels(bars(spark, d)).withColumn("real_premium_ret", r("real_premium_ret", 8))


@query(f"WITH {BARS}, {NEXT}, {LABELS} SELECT trade_date, next_trade_date, ts_code, close_2, close_3, round(real_premium_ret, 8) AS real_premium_ret, reason IS NOT NULL AS pending, reason FROM lab")
def q_streamed_labels(spark, d):
    """The same labels from a stream of all events; a second run of it, from the checkpoint of the first, gets the tick that closes the calendar."""
    events, root = table(spark, d, "events"), fresh_path(spark, "label-stream")
    days = calendar.next_trade_days(events.select(F.col("ts").cast("date").alias("trade_date")))
    last, gap = days.agg(F.max("trade_date").cast("string"), F.coalesce(F.max(F.datediff("next_trade_date", "trade_date")), F.lit(1))).first()
    columns = (F.col("user_id").cast("string").alias("ts_code"), F.col("ts").cast("date").alias("trade_date"), F.col("event_id").alias("place"), F.col("value").alias("price"))
    closing = label_stream.closing_tick(spark, last, gap + 2)
    closing.limit(0).write.parquet(f"{root}/closing")

    def closes():
        ticks = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select(*columns)
        return label_stream.daily_closes(ticks.unionByName(spark.readStream.schema(closing.schema).parquet(f"{root}/closing")))

    for run in range(2):
        if run:
            closing.write.mode("append").parquet(f"{root}/closing")
        label_stream.start_labels(closes, days, gap, f"{root}/labels", f"{root}/checkpoint").awaitTermination()
    return label_stream.read_labels(spark, f"{root}/labels").withColumn("real_premium_ret", r("real_premium_ret", 8))


@query(f"WITH {BARS}, {NEXT}, {LABELS} SELECT coalesce(reason, 'ok') AS status, count(*) AS n, count(DISTINCT trade_date) AS days FROM lab GROUP BY 1")
def q_label_status(spark, d):
    return labels.label_status(labels.forward_labels(bars(spark, d)))


@query(f"WITH {BARS} SELECT ts_code, trade_date, close FROM bars WHERE trade_date IN (SELECT DISTINCT trade_date FROM bars ORDER BY 1 DESC LIMIT 7)")
def q_last_n_days(spark, d):
    return calendar.last_days(bars(spark, d), 7).select("ts_code", "trade_date", "close")


# ---------------------------------------------------------------- features


@query(f"""WITH {BARS}, v AS (SELECT *, CASE WHEN vol - 1 <> 0 THEN 1.0 / (vol - 1) END AS inv FROM bars)
SELECT ts_code, trade_date, round((inv - min(inv) OVER w) / (max(inv) OVER w - min(inv) OVER w + 1e-12), 6) AS rank_score FROM v WINDOW w AS (PARTITION BY trade_date)""")
def q_rank_score(spark, d):
    b = bars(spark, d).withColumn("rank", F.col("vol") - 1)
    return features.rank_score(b, "rank", ("trade_date",)).select("ts_code", "trade_date", r("rank_score").alias("rank_score"))


def _holes():
    return F.when(F.pmod(F.col("ts_code").cast("int"), F.lit(4)) != 0, F.col("close"))
_HOLES_SQL = "h AS (SELECT *, CASE WHEN CAST(ts_code AS INTEGER) % 4 <> 0 THEN close END AS c FROM bars)"


@query(f"WITH {BARS}, {_HOLES_SQL} SELECT ts_code, trade_date, round(coalesce(c, median(c) OVER (PARTITION BY trade_date), 0), 6) AS c FROM h")
def q_median_impute(spark, d):
    out = features.median_fill(bars(spark, d).withColumn("c", _holes()), ["c"], ("trade_date",))
    return out.select("ts_code", "trade_date", r("c").alias("c"))


@query(f"""WITH {BARS}, {_HOLES_SQL}, f AS (SELECT ts_code, trade_date, coalesce(c, median(c) OVER (PARTITION BY trade_date), 0) AS c FROM h)
SELECT ts_code, trade_date, round(CASE WHEN stddev_pop(c) OVER w < 1e-12 THEN 0 ELSE (c - avg(c) OVER w) / stddev_pop(c) OVER w END, 6) AS x__c FROM f WINDOW w AS (PARTITION BY trade_date)""")
def q_zscore(spark, d):
    filled = features.median_fill(bars(spark, d).withColumn("c", _holes()), ["c"], ("trade_date",))
    return features.zscore(filled, ["c"], ("trade_date",)).select("ts_code", "trade_date", r("x__c").alias("x__c"))


@query(f"""WITH {BARS}, q AS (SELECT trade_date, quantile_cont(amount, 0.2) AS q, count(amount) AS n FROM bars GROUP BY 1)
SELECT ts_code, b.trade_date, CASE WHEN n >= 5 THEN CASE WHEN amount < q THEN 'HIGH' ELSE 'LOW' END END AS risk_liquidity FROM bars b JOIN q ON b.trade_date = q.trade_date""")
def q_liquidity_flag(spark, d):
    return features.liquidity_flag(bars(spark, d), "amount", ("trade_date",)).select("ts_code", "trade_date", "risk_liquidity")


_SHARE_SQL = "SELECT '{0}' AS \"column\", round(avg(CASE WHEN regexp_full_match(trim(CAST({0} AS VARCHAR)), {1}) THEN 1.0 ELSE 0.0 END), 6) AS share FROM e"


@query("WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS half FROM events) " + " UNION ALL ".join(_SHARE_SQL.format(c, _NUMBER_SQL) for c in ("value", "event_type", "props", "half")))
def q_auto_numeric_ratio(spark, d):
    e = table(spark, d, "events").withColumn("half", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x"))
    return features.numeric_shares(e, ["value", "event_type", "props", "half"]).select("column", r("share").alias("share"))


# ---------------------------------------------------------------- evaluation


def _ranked(spark, d):
    lab = labels.forward_labels(bars(spark, d)).where("next_trade_date is not null")
    return lab.withColumn("pred", r(F.col("close_2") % 7, 6))


_RANKED = f"{BARS}, {NEXT}, {LABELS}, e AS (SELECT *, round(close_2 % 7, 6) AS pred, row_number() OVER (PARTITION BY trade_date ORDER BY round(close_2 % 7, 6) DESC, ts_code) AS k FROM lab WHERE next_trade_date IS NOT NULL)"


@query(f"""WITH {_RANKED} SELECT trade_date, count(*) AS n, count(*) FILTER (WHERE k <= 10) AS topk, round(avg(CASE WHEN coalesce(real_premium_ret, 0) > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE k <= 10), 8) AS hit_rate_at_k,
round(avg(real_premium_ret) FILTER (WHERE k <= 10), 8) AS mean_ret_at_k FROM e GROUP BY 1""")
def q_hit_rate_mean_ret_at_k(spark, d):
    out = evaluation.evaluate(_ranked(spark, d), "pred", "real_premium_ret")
    return out.select("trade_date", "n", "topk", r("hit_rate_at_k", 8).alias("hit_rate_at_k"), r("mean_ret_at_k", 8).alias("mean_ret_at_k"))


@query(f"""WITH {_RANKED}, o AS (SELECT trade_date, real_premium_ret, row_number() OVER (PARTITION BY trade_date ORDER BY pred NULLS FIRST, ts_code) AS a,
row_number() OVER (PARTITION BY trade_date ORDER BY real_premium_ret NULLS FIRST, ts_code) AS b FROM e)
SELECT trade_date, count(*) AS n, CASE WHEN count(*) >= 3 AND count(real_premium_ret) > 0 THEN round(corr(a, b), 6) END AS rank_ic FROM o GROUP BY 1""")
def q_rank_ic(spark, d):
    return evaluation.rank_ic(_ranked(spark, d), "pred", "real_premium_ret").withColumn("rank_ic", r("rank_ic"))


@query(f"WITH {BARS}, {NEXT}, {LABELS} SELECT trade_date, ts_code, CASE WHEN real_premium_ret > 0 THEN 1 ELSE 0 END AS y FROM lab")
def q_binarize(spark, d):
    return labels.forward_labels(bars(spark, d)).select("trade_date", "ts_code", X.binarise(F.col("real_premium_ret")).alias("y"))


@query(f"WITH {BARS}, {NEXT}, {LABELS}, y AS (SELECT CASE WHEN real_premium_ret > 0 THEN 1 ELSE 0 END AS y FROM lab) SELECT count(*) AS n, round(avg(y), 8) AS pos_rate, round(count(*) / (2.0 * sum(y)), 8) AS w_pos, round(count(*) / (2.0 * (count(*) - sum(y))), 8) AS w_neg FROM y")
def q_class_weights(spark, d):
    y = labels.forward_labels(bars(spark, d)).select(X.binarise(F.col("real_premium_ret")).alias("y"))
    return scoring.binary_class_weights(y, "y").select("n", r("pos_rate", 8).alias("pos_rate"), r("w_pos", 8).alias("w_pos"), r("w_neg", 8).alias("w_neg"))


# ---------------------------------------------------------------- feedback


def _fills(spark, d):
    return table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("exec_date"), F.col("o_orderkey").cast("string").alias("ts_code"), F.when(F.col("o_orderkey") % 11 == 0, X.double(0)).otherwise(X.double(1000)).alias("target_amount"),
        (F.col("o_orderkey") % 1500).cast("double").alias("filled_amount"), F.col("o_totalprice").alias("buy_price"), F.col("o_orderkey"),
    )


_FILLS = """f AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS ts_code, strftime(o_orderdate, '%Y-%m-%d') AS exec_date,
CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE least(1.0, (o_orderkey % 1500) / 1000.0) END::DOUBLE AS fill_rate_real, o_totalprice AS buy_price FROM orders)"""


@query(f"WITH {_FILLS} SELECT exec_date, ts_code, fill_rate_real, CASE WHEN fill_rate_real > 0 THEN 1 ELSE 0 END AS filled_flag, buy_price FROM f")
def q_fill_patch(spark, d):
    return feedback.fill_patch(_fills(spark, d))


#: The learning table is made of all parts, the patch of all customers; every other number up to a point is a key of both.
def _base(spark, d):
    return table(spark, d, "part").select(F.lit("2026-02-27").alias("exec_date"), F.col("p_partkey").cast("string").alias("ts_code"), F.col("p_name").alias("name"), X.double(-1).alias("buy_price"), X.double(0).alias("ev_pred"))


def _patch(spark, d):
    c = table(spark, d, "customer")
    return feedback.fill_patch(
        c.select(F.lit("2026-02-27 ").alias("exec_date"), (2 * F.col("c_custkey")).cast("string").alias("ts_code"), F.when(F.col("c_custkey") % 11 == 0, 0).otherwise(1000).cast("double").alias("target_amount"), (F.col("c_custkey") % 1500).cast("double").alias("filled_amount"), F.col("c_acctbal").alias("buy_price"))
    )


_PATCH = """p AS (SELECT CAST(2 * c_custkey AS VARCHAR) AS ts_code, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE least(1.0, (c_custkey % 1500) / 1000.0) END::DOUBLE AS fill_rate_real, CAST(c_acctbal AS DOUBLE) AS buy_price FROM customer),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS ts_code, p_name AS name FROM part)"""


@query(f"""WITH {_PATCH} SELECT '2026-02-27' AS exec_date, coalesce(b.ts_code, p.ts_code) AS ts_code, b.name, coalesce(p.buy_price, -1)::DOUBLE AS buy_price, CASE WHEN b.ts_code IS NOT NULL THEN 0.0 END::DOUBLE AS ev_pred,
p.fill_rate_real, CASE WHEN p.fill_rate_real > 0 THEN 1 WHEN p.fill_rate_real = 0 THEN 0 END AS filled_flag FROM b FULL JOIN p ON b.ts_code = p.ts_code""")
def q_upsert_learning(spark, d):
    return feedback.upsert(_base(spark, d), _patch(spark, d))


@query(f"WITH {_PATCH} SELECT count(b.ts_code) AS updated, count(*) - count(b.ts_code) AS inserted FROM p LEFT JOIN b ON b.ts_code = p.ts_code")
def q_upsert_counts(spark, d):
    return feedback.upsert_counts(_base(spark, d), _patch(spark, d))


#: Of an order's lines that share a number the one of the greatest values is the last.
_LATE = """p AS (SELECT l_orderkey, m.f AS last_flag, m.q AS last_quantity FROM (SELECT l_orderkey, max({'n': l_linenumber, 'f': l_returnflag, 'q': l_quantity}) AS m FROM lineitem GROUP BY 1))"""


@query(f"""WITH {_LATE}, b AS (SELECT * FROM orders), s AS (SELECT 2 * s_suppkey AS k, s_acctbal FROM supplier)
SELECT coalesce(b.o_orderkey, p.l_orderkey, s.k)::BIGINT AS orderkey, coalesce(s.s_acctbal, b.o_totalprice)::DOUBLE AS price, b.o_orderstatus AS status, p.last_flag, p.last_quantity::DOUBLE AS last_quantity
FROM b FULL JOIN p ON b.o_orderkey = p.l_orderkey FULL JOIN s ON s.k = coalesce(b.o_orderkey, p.l_orderkey)""")
def q_bucketed_upsert(spark, d):
    """All orders as a bucketed table, then all their lines as late feedback, then one batch for few keys (of twice a supplier's number),
    which comes twice."""
    kept = BucketedTable(spark, fresh_path(spark, "orders-table"), C.struct("orderkey long, price double, status string, last_flag string, last_quantity double"), ("orderkey",), 32)
    kept.upsert(table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status")), 0)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_returnflag").alias("last_flag"), F.col("l_quantity").cast("double").alias("last_quantity"), "l_linenumber")
    kept.upsert(lines, 1, order="l_linenumber")
    few = table(spark, d, "supplier").select((2 * F.col("s_suppkey")).cast("long").alias("orderkey"), F.col("s_acctbal").cast("double").alias("price"))
    for _ in range(2):
        kept.upsert(few, 2)
    return kept.read()


# ---------------------------------------------------------------- models


@query(f"WITH {BARS} SELECT ts_code, trade_date, CAST(0.5 AS DOUBLE) AS pred_up_prob, CAST(0 AS DOUBLE) AS pred_ret_mean, CAST(0 AS DOUBLE) AS pred_ev, row_number() OVER (PARTITION BY trade_date ORDER BY ts_code) AS rank_pred_ev FROM bars")
def q_premium_rank_constant(spark, d):
    ranked = allocation.rank_desc(models.predict(bars(spark, d), None, None), "pred_ev", "ts_code", ("trade_date",), "rank_pred_ev")
    return ranked.select("ts_code", "trade_date", "pred_up_prob", "pred_ret_mean", "pred_ev", F.col("rank_pred_ev").cast("long").alias("rank_pred_ev"))


def _training(spark, d):
    daily = written(bars(spark, d), "bars")
    b = daily.withColumn("rank", F.row_number().over(W.partitionBy("trade_date").orderBy(F.col("amount").desc(), "ts_code")))
    x = features.zscore(features.median_fill(b, ["close", "amount", "vol"], ("trade_date",)), ["close", "amount", "vol"], ("trade_date",))
    lab = labels.forward_labels(daily).select("trade_date", "ts_code", "real_premium_ret")
    return x.join(lab, ["trade_date", "ts_code"]).where("real_premium_ret is not null").withColumn("y", X.binarise(F.col("real_premium_ret")))


@query()
def q_lr_scores(spark, d):
    rows = _training(spark, d)
    model = models.fit_logistic(rows, ["x__close", "x__amount", "x__vol"], "y")
    return model.apply(rows, "pred_up_prob").select("trade_date", "ts_code", r("pred_up_prob").alias("pred_up_prob"))


@query()
def q_gbt_scores(spark, d):
    used = ["x__close", "x__amount", "x__vol"]
    rows = written(_training(spark, d).select("trade_date", "ts_code", *used, "real_premium_ret"), "training-rows")
    model = models.fit_boosted(rows, used, "real_premium_ret")
    return model.apply(rows, "pred_ret_mean").select("trade_date", "ts_code", r("pred_ret_mean").alias("pred_ret_mean"))
