"""Command line: decide, merge feedback, train or predict premiums, check what was written."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import scalars as X
from tickerloom.plans import pipelines, reports, validate
from tickerloom.sources import contracts as C
from tickerloom.sources import io, tables
from tickerloom.sources.io import Config
from tickerloom.sources.provenance import RunContext
from tickerloom.sources.shared import Folder
from tickerloom.operators.models import load_model


def decide(spark: SparkSession, config: Config, context: RunContext, snapshot: str, out: str) -> None:
    """Candidates and signals go by signal date, weights and the execution table by execution date."""
    got = pipelines.decide(io.read_snapshot(spark, config.path(snapshot)), config, order="__pos")
    signal_date, exec_date = got.candidates.agg(F.max("signal_date"), F.max("exec_date")).first()
    stored = pipelines.candidate_snapshot(got.candidates.drop("__pos"), context, signal_date or "")
    io.export_dated(stored, f"{out}/candidates", "decision_candidates", signal_date or "unknown", latest=False, bom=True, refuse_empty=True)
    io.export_dated(got.weights, f"{out}/weights", "weights", exec_date or "unknown", order=["target_rank", "backup_rank"], bom=True)
    if not got.stopped:
        C.require_columns(got.signals, ["jq_code", "target_weight", "trade_date", "target_trade_date"], "signals")
        io.export_dated(got.signals, f"{out}/signals", "top10", signal_date, refuse_empty=True)
    tables.execution_table(spark, out, exec_date or "").ensure()
    tables.learning_table(spark, out).ensure()
    counts = got.weights.agg(F.count("*").alias("rows"), F.count_if(F.col("weight") > 0).alias("targets"), F.sum("weight").alias("gross")).first().asDict()
    paths = {"candidates": f"candidates/decision_candidates_{signal_date}.csv", "weights": f"weights/weights_{exec_date}.csv", "signals": f"signals/top10_{signal_date}.csv", "report": f"decision_report_{exec_date}.md"}
    evaluated = {"exec_date": exec_date or "", "signal_date": signal_date or "", "regime": got.regime, "risk_budget": got.risk_budget, "run_id": context.run_id, "commit_sha": context.commit_sha, **counts, "paths": paths}
    io.write_json(f"{out}/eval_{exec_date or 'unknown'}.json", evaluated)
    text = reports.decision_report(got.weights, exec_date or "", got.regime, got.risk_budget)
    io.write_text(f"{out}/decision_report_{exec_date or 'unknown'}.md", text)


def merge(spark: SparkSession, out: str, fills: str | None, returns: str | None) -> None:
    """What has come in goes into the learning table, as its next version."""
    table = tables.learning_table(spark, out).ensure()
    table.write(pipelines.merge_feedback(table.read(), arrived(spark, fills, C.FILLS), arrived(spark, returns, C.RETURNS)))


def arrived(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame | None:
    """A feedback file as it is; one that isn't there is empty."""
    try:
        return io.read_csv_text(spark, path) if path else None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return C.empty_table(spark, schema)


def evaluation_problems(spark: SparkSession, path: str, exec_date: str) -> list[str]:
    """What is wrong with the evaluation's JSON: it has the execution date, and its paths are an object."""
    if wrong := io.json_problems(spark, path, ["exec_date", "paths"]):
        return wrong
    df = spark.read.option("multiLine", True).json(path)
    found = df.select(X.norm_ymd(F.col("exec_date").cast("string"))).first()[0]
    wrong = [] if found == exec_date else [f"{path}: exec_date is {found}, the weights' is {exec_date}"]
    return wrong if isinstance(df.schema["paths"].dataType, T.StructType) else [*wrong, f"{path}: paths is no object"]


def validate_output(spark: SparkSession, out: str) -> list[str]:
    """What is wrong with the nine artefacts of ``decide``; an empty list is a pass. Dated ones go by the latest ones' dates."""

    def read(path: str):
        try:
            return io.read_csv_text(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    found = {"signals_latest": read(f"{out}/signals/top10_latest.csv"), "weights_latest": read(f"{out}/weights/weights_latest.csv")}
    day = lambda name, c: (validate.first_value(found[name].withColumn("__n", F.monotonically_increasing_id()), c, "__n") if found[name] is not None and c in found[name].columns else None) or "unknown"
    signal_date, exec_date = day("signals_latest", "trade_date"), day("weights_latest", "exec_date")
    found |= {
        "signals_dated": read(f"{out}/signals/top10_{signal_date}.csv"), "weights_dated": read(f"{out}/weights/weights_{exec_date}.csv"),
        "candidates": read(f"{out}/candidates/decision_candidates_{signal_date}.csv"), "execution": tables.execution_table(spark, out, exec_date).read(), "learning": tables.learning_table(spark, out).read(),
    }
    wrong = validate.problems(found, validate.rules_for(list(found)))
    wrong += evaluation_problems(spark, f"{out}/eval_{exec_date}.json", exec_date)
    report = f"decision_report_{exec_date}.md"
    return wrong if Folder(spark, out).exists(report) else [*wrong, f"{report}: missing"]


def realised(spark: SparkSession, config: Config):
    """Labels of all days that have bars, as predictions take them along; none without bars."""
    try:
        bars = spark.read.parquet(config.path(config.market_dir))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return pipelines.realised_returns(bars, config)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["decide", "train", "predict", "all", "merge", "validate"])
    parser.add_argument("--snapshot", default="data/pred/pred_source_latest.csv")
    parser.add_argument("--fills")
    parser.add_argument("--returns")
    parser.add_argument("--trade_date", help="the day to predict; the latest one if it isn't given")
    parser.add_argument("--out", default="out")
    args = parser.parse_args(argv)
    config = Config.from_env()
    spark, context = SparkSession.builder.appName("tickerloom").getOrCreate(), RunContext.here(root=config.root)
    if args.command == "decide":
        decide(spark, config, context, args.snapshot, args.out)
        return 0
    if args.command == "merge":
        merge(spark, args.out, args.fills, args.returns)
        return 0
    if args.command == "validate":
        found = validate_output(spark, args.out)
        print("\n".join(found) or "ok")
        return 1 if found else 0
    decisions = io.read_decision_inputs(spark, config.path(config.candidates_glob))
    if args.command in ("train", "all"):
        bars = spark.read.parquet(config.path(config.market_dir))
        counts: dict = {}
        fitted = pipelines.premium_train(decisions, bars, config, context, counts)
        print("days: " + ", ".join(f"{n} {status}" for status, n in counts.items()))
        if fitted is None:
            print("too few days to train")  # not an error: the job runs daily from day one
        else:
            fitted[0].save(f"{args.out}/model_up", spark)
            fitted[1].save(f"{args.out}/model_ret", spark)
            io.append_history(fitted[2], f"{args.out}/eval_history", context.run_id)
    if args.command in ("predict", "all"):
        today, day = pipelines.of_day(decisions, args.trade_date)
        if day is None:
            print("no decisions of that day")
            return 1
        models = [load_model(f"{args.out}/model_{x}", spark) for x in ("up", "ret")]
        ranked = pipelines.premium_predict(today, *models, real=realised(spark, config), context=context)
        io.write_partitioned(ranked, f"{args.out}/rank", "trade_date")
        stored = spark.read.parquet(f"{args.out}/rank").where(F.col("trade_date").cast("string") == day)
        io.write_text(f"{args.out}/rank_report_{day}.md", reports.premium_report(stored, day, config.eval_k))
    return 0


if __name__ == "__main__":
    sys.exit(main())
