import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from roadsky.operators import ols
from roadsky.plans.subsets import plan_models
from roadsky.schemas import INCIDENT, MODEL_LOG_FULL, MODEL_LOG_SHORT, MODEL_RESULT
from roadsky.session import scratch_path, shared_folder
from roadsky.operators.ranking import numeric_log
from roadsky.sources import modellog, quoted_csv, tables


def test_incident_csv(spark, tmp_path):
    names = [field.name for field in INCIDENT]
    cells = {name: "" for name in names} | {"ID": "C-1", "Severity": "2", "Description": 'say ""go"", now', "City": "N/A"}
    quoted = [f'"{cells[n]}"' if n == "Description" else cells[n] for n in names]
    path = tmp_path / "incidents.csv"
    path.write_text(",".join(names) + "\n" + ",".join(quoted) + "\n")
    row = tables.read_incident_csv(spark, str(path)).first()
    assert row.ID == "C-1" and row.Description == 'say "go", now' and row.City == "N/A" and row.State is None
    typed = tables.read_typed_csv(spark, str(path), INCIDENT, ["Severity", "Distance(mi)"]).first()
    assert typed.Severity == 2.0 and typed.City is None and typed["Distance(mi)"] is None
    two = tmp_path / "lines.csv"
    two.write_text('a,b\n"one\ntwo",3\n')
    lines = tables.read_incident_csv(spark, str(two), schema="a string, b string", multi_line=True)
    assert [tuple(r) for r in lines.collect()] == [("one\ntwo", "3")]


def test_headerless_logs(spark, tmp_path):
    full = tmp_path / "full.csv"
    full.write_text("y,\"['a', 'b']\",0.5,0.1,0.1,3,y ~ (a + b)\n")
    row = numeric_log(tables.read_headerless_csv(spark, str(full), MODEL_LOG_FULL)).first()
    assert row.predictors == ["a", "b"] and row.r2 == 0.1 and row.significant_vars == 3
    short = tmp_path / "short.csv"
    short.write_text("y,['a'],0.1,1,y ~ (a)\n")
    assert numeric_log(tables.read_headerless_csv(spark, str(short), MODEL_LOG_SHORT)).first().formula == "y ~ (a)"
    wide = tables.read_headerless_csv(spark, str(short), MODEL_LOG_FULL).first()
    assert wide.formula is None and wide.target == "y"


def test_missing_table_reads_as_empty(spark, tmp_path):
    empty = tables.read_if_exists(spark, str(tmp_path / "none"), MODEL_RESULT)
    assert empty.count() == 0 and empty.schema == MODEL_RESULT


def test_resume_equals_one_run(spark, tmp_path):
    rows = [(float(i), float(i * i % 17), float((i * 7) % 13), float((i * 5) % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    sweep = ols.prepare(df, ["a", "b", "c"], ["y"], log_label=True)
    plan = plan_models(spark, ["y"], ["a", "b", "c"], 3)
    runs = []

    def run(todo):
        runs.append(todo.count())
        return ols.run_sweep(sweep, todo)

    log = str(tmp_path / "log")
    modellog.resume_sweep(spark, log, plan.filter(F.size("predictors") < 3), run)
    resumed = modellog.resume_sweep(spark, log, plan, run)
    again = modellog.resume_sweep(spark, log, plan, run)
    assert runs == [6, 1]  # with nothing left to do nothing runs
    once = {row.formula: round(row.r2, 12) for row in ols.run_sweep(sweep, plan).collect()}
    assert {row.formula: round(row.r2, 12) for row in resumed.collect()} == once
    assert again.count() == 7


@pytest.mark.parametrize("size", ["7b", "23b", "100b", "1000b", "10m"])
def test_quoted_lines_in_splits_of_any_size(spark, tmp_path, size):
    r = random.Random(5)
    bits = ["a", "é", "日", ",", '"', "\n", "\r\n", " ", "x" * 30, '""', "\n\n"]
    written = []
    for name in ("one", "two"):
        rows = [[str(i), "".join(r.choice(bits) for _ in range(r.randint(0, 12))) + "|"] for i in range(60)]
        rows.append(["60", "long " + "\n" * 90 + "|"])
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows([["id", "t"], *rows])
        written += [(int(i), t) for i, t in rows]
    with open(tmp_path / "empty.csv", "w") as out:
        out.write("")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = quoted_csv._lines(spark, str(tmp_path / "*.csv"))
        splits = lines.select("file", "start").distinct().count()
        found = quoted_csv.read_quoted_csv(spark, str(tmp_path / "*.csv"), "id int, t string")
        assert sorted(map(tuple, found.collect())) == sorted(written)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert splits > 20 if size == "100b" else splits >= 2


def test_quoted_lines_with_windows_ends_and_without_header(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes(b'1,"a\r\nb"\r\n2,plain\r\n\r\n3,"say ""so"""\r\n')
    found = quoted_csv.read_quoted_csv(spark, str(path), "id int, `t (x)` string", header=False)
    assert sorted(map(tuple, found.collect())) == [(1, "a\r\nb"), (2, "plain"), (3, 'say "so"')]


def small_sweep(spark):
    rows = [(float(i), float(i * i % 17), float((i * 7) % 13), float((i * 5) % 11)) for i in range(80)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    return ols.prepare(df, ["a", "b", "c"], ["y"], log_label=True), plan_models(spark, ["y"], ["a", "b", "c"], 3)


def test_a_lost_run_keeps_its_finished_batches(spark, tmp_path):
    sweep, plan = small_sweep(spark)
    log, calls = str(tmp_path / "log"), []

    def run(todo):
        calls.append({row.formula for row in todo.collect()})
        if len(calls) == 3:
            raise RuntimeError("the executor is gone")
        return ols.run_sweep(sweep, todo)

    with pytest.raises(RuntimeError):
        modellog.resume_sweep(spark, log, plan, run, batch_models=2)
    kept = {row.formula for row in modellog.finished_models(spark, log).collect()}
    assert kept == calls[0] | calls[1] and modellog.manifest(spark, log).count() == 2
    # a batch that was written but not listed does not count
    ols.run_sweep(sweep, plan).write.parquet(str(tmp_path / "log" / "batches" / "halfway"))
    assert {row.formula for row in modellog.finished_models(spark, log).collect()} == kept
    whole = modellog.resume_sweep(spark, log, plan, run, batch_models=2)
    found = [row.formula for row in whole.collect()]
    assert len(found) == 7 and set(found) == {row.formula for row in plan.collect()}
    assert not (calls[0] | calls[1]) & set().union(*calls[3:])
    before = len(calls)
    assert modellog.resume_sweep(spark, log, plan, run, batch_models=2).count() == 7 and len(calls) == before


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    sweep, plan = small_sweep(spark)
    log = str(tmp_path / "log")
    models = ols.run_sweep(sweep, plan)
    for _ in range(2):
        modellog.commit_batch(spark, log, "one", models)
    assert modellog.finished_models(spark, log).count() == 7
    # listed twice, by two runs at a time
    twice = spark.read.schema(modellog.MANIFEST).parquet(f"{log}/manifest").withColumn("folder", F.lit("other"))
    models.write.parquet(f"{log}/batches/other")
    tables.append_parquet(twice, f"{log}/manifest")
    assert modellog.finished_models(spark, log).count() == 7


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x y(1)", "a;b", 1.5), ("z", None, 2.0)], "target string, t string, v double")
    tables.write_csv_by(df, str(tmp_path / "by"), "target")
    back = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "by"))
    assert {(r.target, r.t) for r in back.collect()} == {("x y(1)", "a;b"), ("z", None)}
    tables.write_parquet(df, str(tmp_path / "p"), sort_by=["v"])
    tables.append_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p")).count() == 4
    assert tables.describe_schema(df)[2] == ("v", "double", True)
    assert tables.preview(df, 1).count() == 1 and tables.present_text(df, "t").count() == 1


def test_shared_folder(spark):
    folder = shared_folder(spark)
    assert shared_folder(spark) == folder or spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
