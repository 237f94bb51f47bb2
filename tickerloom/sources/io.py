"""Reading and writing the pipeline's tables: CSV in several encodings, partitioned tables, single-file exports."""

from __future__ import annotations

import csv
import functools
import json
import os
import re
import shutil
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, fields

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import scalars as X
from tickerloom.sources import contracts as C
from tickerloom.sources.buckets import RunLog


@dataclass(frozen=True)
class Config:
    """Settings; each can be set by an environment variable TICKERLOOM_<NAME>."""

    topn: int = 10
    topk: int = 100
    w_max: float = 0.12
    theme_cap: float = 0.35
    gross_cap: float = 1.0
    train_window_days: int = 60
    min_train_days: int = 20
    eval_k: int = 10
    max_gap_days: int = 10
    boosting_rounds: int = 300
    root: str = "."
    candidates_glob: str = "data/decision/decision_candidates_*.csv"
    market_dir: str = "data/market/daily"

    @classmethod
    def from_env(cls, env=os.environ) -> Config:
        found = {}
        for f in fields(cls):
            try:
                found[f.name] = type(f.default)(env[f"TICKERLOOM_{f.name.upper()}"])
            except (KeyError, ValueError):
                continue
        return cls(**found)

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)


def _csv_files(spark: SparkSession, pattern: str | list[str]) -> list:
    """file, head (its first line, as bytes) and utf8 (whether all of its lines are UTF-8), from one pass over the files."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(pattern)
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("utf8"), at.alias("at"))
    return rows.groupBy("file").agg(F.min_by("line", "at").alias("head"), F.bool_and("utf8").alias("utf8")).orderBy("file").collect()


def _decoded(spark: SparkSession, files: list[str], head: bytes, encoding: str) -> DataFrame:
    """Files with one header in an encoding that Spark doesn't read: lines are decoded in batches, then parsed by Spark."""
    names = next(csv.reader([head.decode(encoding)]))

    def decode(parts):
        for part in parts:
            lines = [x.decode(encoding, "replace") for x in part.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("file"), pa.array(lines, pa.string())], names=["file", "line"])

    rows = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    lines = rows.where((F.col("line") != F.lit(head)) & (F.length("line") > 0)).mapInArrow(decode, "file string, line string")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = lines.select("file", F.from_csv("line", schema).alias("row"))
    return parsed.select(*[F.nullif(F.col(f"row.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)], F.col("file").alias("__file"))


def read_csv_files(spark: SparkSession, pattern: str | list[str], encoding: str | None = None) -> DataFrame:
    """All files, as text, with ``__file``: columns are matched by name, and those that a file lacks are null.

    Files with the same header are read together. A file that isn't UTF-8 from end to end is GBK, unless
    ``encoding`` says what all of them are. Blanks are null. GBK files can't have line ends within quotes.
    """
    groups: dict[tuple[bytes, str], list[str]] = {}
    for r in _csv_files(spark, pattern):
        groups.setdefault((bytes(r["head"]), encoding or ("UTF-8" if r["utf8"] else "gb18030")), []).append(r["file"])
    parts = []
    for (head, code), files in groups.items():
        if code.upper() in ("UTF-8", "UTF8"):
            df = spark.read.option("header", True).option("ignoreCorruptFiles", True).csv(files)
            parts.append(df.withColumn("__file", F.col("_metadata.file_path")))
        else:
            parts.append(_decoded(spark, files, head, code))
    if not parts:
        return C.empty_table(spark, C.struct("__file string"))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_text(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """One table of text columns; blanks are null."""
    return read_csv_files(spark, path, encoding).drop("__file")


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def read_table_text(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """A feedback file in its contract's columns; empty if there is no such file."""
    try:
        return C.align_to_schema(read_csv_text(spark, path), schema) if path else C.empty_table(spark, schema)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return C.empty_table(spark, schema)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A snapshot with its row order as ``__pos``; a missing file gives an empty table."""
    try:
        df = read_csv_text(spark, path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return C.empty_table(spark, schema or C.struct("ts_code string, name string")).withColumn("__pos", F.lit(0).cast("long"))
    return (C.align_to_schema(df, schema) if schema else df).withColumn("__pos", F.monotonically_increasing_id())


def read_decision_inputs(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a glob with ``__file``, its in-file trade date ``__file_date`` and its place by that date, undated
    ones last by name, ``__file_no``; unreadable files are skipped."""
    df = read_csv_files(spark, pattern)
    found = [c for c in df.columns if c.strip().lower() in C.DECISION_REQUIRED["trade_date"]]  # files may name it differently
    names = sorted(found, key=lambda c: C.DECISION_REQUIRED["trade_date"].index(c.strip().lower()))
    day = F.coalesce(*[X.parse_ymd(C.quoted(c)) for c in names], F.lit(None).cast("string"))
    dates = df.groupBy("__file").agg(F.max(day).alias("__file_date"))
    # a row for each file
    numbered = dates.withColumn("__file_no", F.row_number().over(W.orderBy(F.col("__file_date").asc_nulls_last(), "__file")))
    return df.join(F.broadcast(numbered), "__file", "left")


def read_candidates(spark: SparkSession, pattern: str) -> DataFrame:
    """Candidate files; a blank signal_date is the date in the file's name, a blank exec_date the signal_date, a null name blank."""
    df = read_csv_files(spark, pattern)
    have = lambda c: X.blank_to_null(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    dated = df.withColumn("signal_date", F.coalesce(have("signal_date"), file_date(F.col("__file")), F.lit("")))
    return dated.withColumns({"exec_date": F.coalesce(have("exec_date"), "signal_date"), "name": F.coalesce(have("name"), F.lit(""))})


def json_problems(spark: SparkSession, path: str, keys: list[str]) -> list[str]:
    """What is wrong with a JSON document, in words: it is missing, no JSON object, or lacks keys."""
    try:
        found = spark.read.option("multiLine", True).json(path).columns
    except AnalysisException as e:
        if not _missing(e):
            raise
        return [f"{path}: missing"]
    if not found or found == ["_corrupt_record"]:
        return [f"{path}: no JSON object"]
    return [f"{path}: lacks {k}" for k in keys if k not in found]


def read_closes(spark: SparkSession, pattern: str) -> DataFrame:
    """The close contract of all files: 3 required and 7 optional columns; codes and dates trimmed."""
    df = C.resolve_aliases(read_csv_files(spark, pattern), C.CLOSE_REQUIRED, C.CLOSE_OPTIONAL)
    numbers = {c: X.safe_number(F.col(c)) for c in ("close", *C.CLOSE_OPTIONAL)}
    return df.withColumns({"trade_date": X.parse_ymd(F.col("trade_date")), "ts_code": X.blank_to_null(F.col("ts_code")), **numbers})


def file_date(column=None):
    """The date that a file's name ends in."""
    return F.nullif(F.regexp_extract(column if column is not None else F.input_file_name(), r"_(\d{8})\.csv", 1), F.lit(""))


def latest_name(names: list[str], pattern: str = r"^pred_top10_(\d{8})\.csv$") -> str | None:
    """The listed name with the greatest date."""
    found = [(m[1], n) for n in names if (m := re.match(pattern, n))]
    return max(found)[1] if found else None


def sync_snapshot(target: str, url: str | None = None, local: str | None = None, fetch: Callable[[str], bytes] | None = None) -> str:
    """Land a snapshot from a URL, or else from a local path."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    if url:
        data = fetch(url) if fetch else urllib.request.urlopen(url, timeout=60).read()
        with open(target, "wb") as f:
            f.write(data)
    elif local and os.path.exists(local):
        shutil.copyfile(local, target)
    else:
        raise FileNotFoundError("neither a URL nor a local snapshot")
    return target


def sync_latest(listing: Callable[[], list[str]], fetch: Callable[[str], bytes], folder: str, latest: str) -> str | None:
    """Fetch the newest listed snapshot and copy it to the name ``latest``."""
    name = latest_name(listing())
    if name is None:
        return None
    path = sync_snapshot(os.path.join(folder, name), url=name, fetch=fetch)
    shutil.copyfile(path, os.path.join(folder, latest))
    return path


def normalise_bars(df: DataFrame, day: str | None = None) -> DataFrame:
    """The bar contract: lower-case names, dates as text, numbers safe, rows with code and close."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    C.require_columns(df, ["ts_code", "trade_date", "close"], "bars")
    out = df.select(X.strip(F.col("ts_code")).alias("ts_code"), X.trade_date_text(F.col("trade_date")).alias("trade_date"), *[(X.safe_number(F.col(c)) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in ("open", "high", "low", "close", "vol", "amount")])
    if day is not None:
        out = out.where(F.col("trade_date") == day)
    return out.dropna(subset=["ts_code", "close"])


class MarketStore:
    """Bars in a table partitioned by day: read what is there, fetch and store what isn't."""

    def __init__(self, spark: SparkSession, path: str, mirrors: tuple[str, ...] = (), fetch: Callable[[str], DataFrame | None] | None = None, mode: str = "cache_first") -> None:
        self.spark, self.path, self.mirrors, self.fetch, self.mode = spark, path, mirrors, fetch, mode

    def _day(self, day: str) -> DataFrame | None:
        """The stored day, or None if it isn't there or can't be read (then it is stored anew)."""
        df = self.spark.read.schema(C.BARS)
        try:
            found = df.parquet(self.path).where(F.col("trade_date") == day)
            return found if found.agg(F.count("close")).first()[0] else None
        except (PySparkException, Py4JJavaError) as e:
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "FAILED_READ_FILE", "CANNOT_READ_FILE")):
                raise
            return None

    def ensure(self, day: str) -> DataFrame | None:
        found = self._day(day)
        if found is not None or self.mode == "cache_only":
            return found
        for mirror in self.mirrors:
            try:
                bars = read_csv_text(self.spark, mirror.format(day=day, year=day[:4]))
            except AnalysisException as e:
                if not _missing(e):
                    raise
                continue
            return self._store(normalise_bars(bars, day), day)
        raw = self.fetch(day) if self.fetch else None
        return None if raw is None else self._store(normalise_bars(raw, day), day)

    def load(self, day: str) -> DataFrame:
        """The day's bars; an error if there are none to be had."""
        found = self.ensure(day)
        if found is None:
            raise C.ContractError(f"no bars for {day}")
        return found

    def _store(self, bars: DataFrame, day: str) -> DataFrame | None:
        if bars.isEmpty():
            return None
        write_partitioned(bars, self.path, "trade_date")
        return self._day(day)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_history(df: DataFrame, path: str, run: str) -> bool:
    """Add a run's evaluation once: False, and nothing written, if the run has added one already."""
    return RunLog(df.sparkSession, path, C.EVAL_HISTORY).append(df, run)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return RunLog(spark, path, C.EVAL_HISTORY).read()


def export_csv(df: DataFrame, path: str, order: list[str] | None = None, bom: bool = False, refuse_empty: bool = False, most: int = 1_000_000) -> str:
    """One CSV file for people and brokers, written row by row on the driver. More than ``most`` rows are an error:
    use ``write_csv`` for tables."""
    n, part = 0, path + ".part"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(part, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for n, r in enumerate((df.orderBy(*order) if order else df).limit(most + 1).toLocalIterator(), 1):
            out.writerow(["" if v is None else v for v in r])
    if n > most or (refuse_empty and not n):
        os.remove(part)
        raise C.ContractError(f"no rows for {path}" if not n else f"more than {most} rows for {path}")
    os.replace(part, path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A table of any size as a folder of CSV files, each with a header, written by the tasks."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_dated(df: DataFrame, folder: str, stem: str, date: str | None, latest: bool = True, **options) -> list[str]:
    """``stem_latest.csv`` and, if there is a date, ``stem_<date>.csv``."""
    names = [f"{stem}_latest.csv"] * latest + ([f"{stem}_{date}.csv"] if date else [])
    first = export_csv(df, os.path.join(folder, names[0]), **options)
    for name in names[1:]:
        shutil.copyfile(first, os.path.join(folder, name))
    return [os.path.join(folder, n) for n in names]


def write_json(path: str, payload: dict) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)
    return path


def write_text(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
