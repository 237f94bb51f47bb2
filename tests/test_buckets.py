"""Bucketed upserts, and appends that happen once."""

import json
import os
import random

import pytest

from tickerloom.operators import feedback
from tickerloom.sources import contracts as C
from tickerloom.sources import io
from tickerloom.sources.buckets import BucketedTable, ConcurrentBatch, RunLog
from tickerloom.streaming.feedback_stream import start_upserts

SCHEMA = C.struct("exec_date string, ts_code string, buy_price double, note string")


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upserts_equal_those_of_a_whole_table(spark, tmp_path):
    rng = random.Random(1)
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, feedback.KEY, 8)
    assert rows(table) == []
    whole = frame(spark, [])
    for _ in range(4):
        some = [(rng.choice(["d1", "d2", None]), rng.choice(["", "a", "b", *[f"c{k}" for k in range(30)]]), rng.choice([None, rng.random()]), rng.choice([None, "x", "y"])) for _ in range(25)]
        patch = frame(spark, some)
        table.upsert(patch)
        whole = frame(spark, [tuple(r) for r in feedback.upsert(whole, patch).collect()])
        assert rows(table) == sorted(map(tuple, whole.collect()), key=repr)


def test_only_touched_buckets_are_written_and_a_repeated_batch_is_idle(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, SCHEMA, feedback.KEY, 16)
    table.upsert(frame(spark, [("d", f"c{k}", 1.0, None) for k in range(200)]), 0)
    before = files(f"{path}/data")
    touched = table.upsert(frame(spark, [("d", "c7", 2.0, "new")]), 1)
    assert len(touched) == 1
    with open(f"{path}/manifests/0000000000.json") as f, open(f"{path}/manifests/0000000001.json") as g:
        old, new = json.load(f)["current"], json.load(g)["current"]
    assert {b for b in new if new[b] != old.get(b)} == {str(touched[0])}
    after = files(f"{path}/data")
    assert before.items() <= after.items() and {p for p in after if f"__bucket={touched[0]}/" in p} > set(after) - set(before)
    want = rows(table)
    assert ("d", "c7", 2.0, "new") in want and len(want) == 200
    assert table.upsert(frame(spark, [("d", "c7", 3.0, "again")]), 1) == [] == table.upsert(frame(spark, [("d", "c7", 3.0, "older")]), 0)
    assert rows(table) == want == rows(BucketedTable(spark, path, SCHEMA, feedback.KEY, 3))  # the table keeps its own number of buckets
    read = table.read()._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().size()
    assert read == len(new)


def test_a_crash_before_the_manifest_changes_nothing_and_vacuum_clears_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, SCHEMA, feedback.KEY, 4)
    table.upsert(frame(spark, [("d", f"c{k}", 1.0, None) for k in range(40)]), 0)
    want = rows(table)
    with monkeypatch.context() as m:
        m.setattr(table.folder, "create", lambda *a: False)
        with pytest.raises(ConcurrentBatch):
            table.upsert(frame(spark, [("d", "c1", 9.0, None)]), 1)
    assert rows(table) == want and len(os.listdir(f"{path}/data")) == 2
    assert len(table.vacuum()) == 1 and rows(table) == want and len(os.listdir(f"{path}/data")) == 1
    table.upsert(frame(spark, [("d", f"c{k}", 2.0, None) for k in range(40)]), 1)
    table.vacuum()
    assert os.listdir(f"{path}/manifests") and len([n for n in os.listdir(f"{path}/data")]) == 1 and {r[2] for r in rows(table)} == {2.0}
    assert table.upsert(frame(spark, []), 2) == [] and table.last_batch() == 2


def test_a_stream_of_patches(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "exec_date string, ts_code string, buy_price double, note string"
    for price in (1.0, 2.0):
        spark.createDataFrame([("d", "a", price, None), ("d", f"b{price}", price, None)], schema).coalesce(1).write.mode("append").json(source)
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, feedback.KEY, 4)
    changes = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    start_upserts(changes(), table, lambda df: df, str(tmp_path / "c")).awaitTermination()
    assert len(rows(table)) == 3
    start_upserts(changes(), table, lambda df: df, str(tmp_path / "other")).awaitTermination()  # the same batches again
    assert len(rows(table)) == 3


def test_a_run_appends_once(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "log"), C.struct("run_id string, v double")
    log = RunLog(spark, path, schema)
    one = spark.createDataFrame([("r/1", 1.0)], schema)
    assert log.read().collect() == []
    assert log.append(one, "r/1") and not log.append(one, "r/1")
    with monkeypatch.context() as m:  # data but no marker
        m.setattr(log.folder, "create", lambda *a: False)
        assert not log.append(one.withColumn("v", one.v + 1), "r2")
    assert [tuple(r) for r in log.read().collect()] == [("r/1", 1.0)]
    assert len(log.vacuum()) == 1 and log.append(one, "r2") and log.read().count() == 2


def test_history_of_evaluations(spark, tmp_path):
    df = spark.createDataFrame([("20260227",)], "trade_date string")
    assert io.append_history(df, str(tmp_path / "h"), "run") and not io.append_history(df, str(tmp_path / "h"), "run")
    assert io.read_history(spark, str(tmp_path / "h")).columns == C.EVAL_HISTORY.names and io.read_history(spark, str(tmp_path / "h")).count() == 1
