"""Sums that do not depend on order, plans of any width, passes without the driver."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsky.operators import moments as M
from roadsky.operators import ols, residuals, robust
from roadsky.plans.subsets import plan_models


def numbers(seed=1, n=500, width=3):
    """Numbers of very different sizes, with signs."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width, n)) * 10.0 ** rng.integers(-9, 9, (width, n))


def exact(block):
    """(rows, means, products about the means) in fractions."""
    rows = [[Fraction(float(v)) for v in row] for row in block]
    n = len(rows[0])
    means = [sum(row) / n for row in rows]
    return n, means, [[sum(a * b for a, b in zip(x, y, strict=True)) - n * mx * my for y, my in zip(rows, means, strict=True)] for x, mx in zip(rows, means, strict=True)]


@pytest.mark.parametrize("block", [numbers(), numbers(2) + 1e12, np.array([[5e-324, 1e-300, 0.0], [1e150, -1e150, 3.0]]), np.zeros((2, 4))])
def test_sums_are_exact(block):
    z = np.vstack([np.ones(block.shape[1]), block])
    whole = M.products(*M.cut(z))
    n, means, table = M.about_means(whole, len(z))
    rows, expected_means, expected = exact(block)
    assert n == rows
    assert means.tolist() == [float(x) for x in expected_means]
    assert table.tolist() == [[float(x) for x in row] for row in expected]


def test_parts_in_any_order_add_up_to_the_same_limbs():
    block = numbers(3)
    z = np.vstack([np.ones(block.shape[1]), block])
    results = set()
    for seed in range(5):
        rng = np.random.default_rng(seed)
        parts = np.array_split(rng.permutation(z.shape[1]), rng.integers(1, 40))
        total = None
        for part in parts:
            found = M.products(*M.cut(z[:, part]))
            total = found if total is None else total.plus(found)
        results.add(tuple(x << (M.PIECE * (total.low + 100)) if total.low + 100 >= 0 else None for x in total.whole()))
    assert len(results) == 1


def frame_of(spark, table, names):
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in table]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))


def gaps(n, names, seed=7, share=0.1):
    rng = np.random.default_rng(seed)
    table = rng.normal(size=(n, len(names))) * rng.uniform(0.1, 100, len(names)) + rng.normal(size=len(names)) * 50
    table[:, -1] += table[:, 0] - 0.3 * table[:, 1]
    table[rng.random(table.shape) < share] = np.nan
    return table


def test_results_are_equal_to_the_last_bit_for_any_partitions(spark):
    names = ["a", "b", "c", "y"]
    df = frame_of(spark, gaps(700, names), names)
    plan = plan_models(spark, ["y"], names[:3], 2)
    found = []
    for parts in (1, 6, 40, 6):
        sweep = ols.prepare(df.repartition(parts, F.rand(parts)), names[:3], ["y"], log_label=False, missing="per_model", interactions=True)
        rows = ols.run_sweep(sweep, plan).orderBy("model_id")
        found.append([(r.n, r.r2, r.rmse, r.intercept, tuple(r.coefficients), tuple(r.pvalues)) for r in rows.collect()])
    assert found[0] == found[1] == found[2] == found[3]


@pytest.mark.parametrize("width", [66, 200])
def test_more_predictors_than_bits_in_a_word(spark, width):
    names = [f"x{i}" for i in range(width)]
    table = gaps(60, [*names, "y"], share=0.02)
    df = frame_of(spark, table, [*names, "y"]).repartition(3)
    sweep = ols.prepare(df, names, ["y"], log_label=False, missing="per_model")
    plan = plan_models(spark, ["y"], names, 1)
    rows = {r.predictors[0]: r for r in ols.run_sweep(sweep, plan).collect()}
    assert len(rows) == width
    for i in range(0, width, 5):
        x, y = table[:, i], table[:, -1]
        there = ~np.isnan(x) & ~np.isnan(y)
        slope, intercept = np.polyfit(x[there], y[there], 1)
        row = rows[names[i]]
        assert row.n == there.sum()
        assert row.coefficients[0] == pytest.approx(slope, rel=1e-8) and row.intercept == pytest.approx(intercept, rel=1e-8)


def test_overflow_is_told_and_others_are_not_touched(spark):
    rows = [(1e200 * (i + 1), float(i), float(i * i % 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    sweep = ols.prepare(df, ["a", "b"], ["y"], log_label=False, interactions=True)
    found = {tuple(r.predictors): r.status for r in ols.run_sweep(sweep, plan_models(spark, ["y"], ["a", "b"], 2)).collect()}
    assert found[("b",)] == "OK" and found[("a",)] == "OVERFLOW" and found[("a", "b")] == "OVERFLOW"


def test_ids_of_large_plans_count_up(spark):
    for width, most in ((7, 6), (9, 9)):
        names = [f"x{i}" for i in range(width)]
        rows = plan_models(spark, ["y", "z"], names, most).orderBy("model_id").collect()
        assert [r.model_id for r in rows] == list(range(len(rows))) and len(rows) == 2 * sum(
            len([c for c in range(1 << width) if c.bit_count() == k]) for k in range(1, most + 1)
        )
        keys = [(r.target, len(r.predictors), [int(p[1:]) for p in r.predictors]) for r in rows]
        assert keys == sorted(keys)
    wide = plan_models(spark, ["y"], [f"x{i}" for i in range(1200)], 1)
    assert wide.agg(F.min("model_id"), F.max("model_id"), F.count_distinct("model_id")).first() == (0, 1199, 1200)


def test_passes_do_without_the_driver(spark, monkeypatch):
    names = ["a", "b", "c", "y"]
    df = frame_of(spark, gaps(200, names), names).repartition(3)
    sweep = ols.prepare(df, names[:3], ["y"], log_label=False, missing="per_model")
    plan = plan_models(spark, ["y"], names[:3], 2)

    def refused(*_, **__):
        raise AssertionError("rows went to the driver")

    for name in ("collect", "toLocalIterator", "toPandas", "first", "head", "take"):
        monkeypatch.setattr(DataFrame, name, refused)
    found = [robust.run_robust_sweep(sweep, plan), residuals.residual_summary(sweep, plan), ols.run_sweep(sweep, plan)]
    monkeypatch.undo()
    assert [f.count() for f in found] == [6, 6, 6]


def test_residuals_of_a_plan(spark):
    names = ["a", "b", "y", "z"]
    table = gaps(3000, names, share=0.05)
    table[:50, 0] = 5.0
    df = frame_of(spark, table, names).repartition(4)
    sweep = ols.prepare(df, ["a", "b"], ["y", "z"], log_label=False, missing="per_model", interactions=True)
    plan = plan_models(spark, ["y", "z"], ["a", "b"], 2)
    models = {r.model_id: r for r in ols.run_sweep(sweep, plan).collect()}
    found = residuals.residual_summary(sweep, plan, (0.0, 0.1, 0.5, 0.9, 1.0)).collect()
    assert len(found) == 6
    at = {n: i for i, n in enumerate(names)}
    for row in found:
        model = models[row.model_id]
        used = table[:, [at[model.target], *[at[p] for p in model.predictors]]]
        used = used[~np.isnan(used).any(1)]
        x = used[:, 1:]
        if x.shape[1] == 2:
            x = np.column_stack([x, x[:, 0] * x[:, 1]])
        e = used[:, 0] - model.intercept - x @ np.array(model.coefficients)
        assert row.n == len(e)
        assert row.mean == pytest.approx(0, abs=1e-8) and row.mean_size == pytest.approx(np.abs(e).mean())
        assert row.rmse == pytest.approx(model.rmse) and row.least == pytest.approx(e.min()) and row.most == pytest.approx(e.max())
        ordered = np.sort(e)
        for share, value in zip((0.1, 0.5, 0.9, 1.0), row.quantiles[1:], strict=True):
            assert value == pytest.approx(ordered[int(np.ceil(share * len(e))) - 1], rel=0.0101)


def test_buckets_rise_with_the_number():
    values = np.array([-1e300, -5.0, -1.0, -1e-300, -5e-324, 0.0, 5e-324, 1e-10, 1.0, 1.5, 1e308])
    found = residuals.buckets_of(values)
    assert found.tolist() == sorted(found.tolist()) and found[5] == 0 and len(set(found.tolist())) == len(values)


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, y double")
    sweep = ols.prepare(df, ["a"], ["y"], log_label=False)
    plan = plan_models(spark, ["y"], ["a"], 1)
    assert residuals.residual_summary(sweep, plan).count() == 0
    assert robust.run_robust_sweep(sweep, plan).first().status == "INSUFFICIENT"


def test_whole_numbers_have_one_piece():
    whole = np.arange(-50.0, 50.0).reshape(4, 25)
    z = np.vstack([np.ones(25), whole, numbers(4, 25, 1)])
    first, pieces, size = M.cut(z)
    held = np.zeros_like(z)
    for down, (at, piece) in enumerate(pieces):
        held[at] += np.ldexp(piece, M.PIECE * (first - down))
    assert size == len(z) and np.array_equal(held, z)
    assert len(pieces) > 1 and sum(len(at) for at, _ in pieces) <= len(z) - 1 + len(pieces)


def test_wide_projections_are_no_method_that_the_jvm_only_interprets(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    df = frame_of(spark, [[1.0, 2.0]], ["x", "y"])
    held = spark.conf.get(name)
    try:
        for before, after in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(name, before)
            ols.prepare(df, ["x"], ["y"], log_label=False)
            assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, held)
