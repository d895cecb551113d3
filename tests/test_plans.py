"""What the physical plans must and must not hold."""

import re

import pytest

from roadsky.operators import impact, ols
from roadsky.plans import studies
from roadsky.schemas import INCIDENT


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "incidents")
    row = {field.name: "1" for field in INCIDENT} | {
        "StartTime": "2020-01-01T00:00:00.000-05:00",
        "EndTime": "2020-01-01T01:00:00.000-05:00",
        "Weather_Conditions": "Fair",
        "Congestion_Speed": "Fast",
    }
    rows = [tuple(row[field.name] for field in INCIDENT)] * 3
    spark.createDataFrame(rows, INCIDENT).write.parquet(path)
    return spark.read.parquet(path)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    scans = re.findall(r"FileScan parquet \[(.*?)\] Batched", physical(df))
    assert scans
    return [set(re.findall(r"([^,#]+)#\d+", scan)) for scan in scans]


def test_impact_reads_four_columns(raw):
    for df in studies.impact_tables(raw):
        used = {"Weather_Conditions", "Congestion_Speed", impact.DELAY_TYPICAL, impact.DELAY_FREE_FLOW}
        assert all(columns <= used for columns in read_columns(df))


def test_model_frame_is_one_pruned_scan_without_python_or_exchange(raw):
    sweep, _ = studies.log_study(raw)
    plan = physical(sweep.frame)
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
    columns = read_columns(sweep.frame)[0]
    assert "Description" not in columns and "City" not in columns and len(columns) == 13


def test_not_null_filters_reach_the_scan(raw):
    plan = physical(studies.placed_incidents(raw))  # what the fill writes before it reads it twice
    assert re.search(r"PushedFilters: \[.*IsNotNull\(State\)", plan)


def test_studies_have_the_expected_sizes(raw):
    sizes = {
        "log": studies.log_study(raw),
        "reversed": studies.reversed_log_study(raw),
        "standardised": studies.standardised_study(raw),
        "interactions": studies.interaction_study(raw),
        "hc3": studies.hc3_study(raw),
    }
    found = {name: plan.count() for name, (_, plan) in sizes.items()}
    assert found == {"log": 645, "reversed": 105, "standardised": 330, "interactions": 1050, "hc3": 35}


def test_staged_sweep_gives_the_same_models(raw, tmp_path):
    sweep, plan = studies.reversed_log_study(raw)
    copy = ols.staged(sweep, str(tmp_path / "frame"))
    assert copy.columns == sweep.columns and copy.frame.count() == sweep.frame.count()
    results = [ols.run_sweep(each, plan).orderBy("model_id").collect() for each in (sweep, copy)]
    assert results[0] == results[1] and len(results[0]) == 105


def test_profile_tables(raw):
    missing, top = studies.profile_tables(raw.select("State", "City"), top_n=2)
    assert {tuple(row) for row in missing.collect()} == {("State", 0.0), ("City", 0.0)}
    assert {tuple(row) for row in top.collect()} == {("State", "1", 3, 100.0, 1), ("City", "1", 3, 100.0, 1)}
