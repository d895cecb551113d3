import itertools

import numpy as np
import pytest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from roadsky.functions import tails
from roadsky.operators import moments as M
from roadsky.operators import ols, ranking, robust
from roadsky.operators.vectors import assemble, standardise
from roadsky.plans.subsets import (
    check_models,
    count_experiments,
    pending_models,
    plan_models,
    with_valid_predictors,
)
from roadsky.schemas import TRAFFIC_TARGETS, WEATHER_PREDICTORS

X = ["a", "b (x)", "c", "d"]
Y = ["y", "z"]


def raw_rows(n=400, holes=0.0, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 3] + [0, 30, 2, -4]
    y = 3 + x @ [0.5, -0.2, 2.0, 0.0] + rng.normal(size=n) * (1 + np.abs(x[:, 0]))
    z = np.abs(x[:, 1]) + rng.normal(size=n)
    table = np.column_stack([x, y, z])
    table[rng.random(table.shape) < holes] = np.nan
    return table


def frame_of(spark, table, names=(*X, *Y)):
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in table]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(3)


def design(table, names, predictors, interactions):
    at = {name: i for i, name in enumerate(names)}
    columns = [table[:, at[p]] for p in predictors]
    if interactions:
        columns += [a * b for a, b in itertools.combinations(columns, 2)]
    return np.column_stack([np.ones(len(table)), *columns])


def dense(table, names, target, predictors, interactions=False):
    """Straightforward dense fit with test and HC3, over the rows complete for the model."""
    at = {name: i for i, name in enumerate(names)}
    used = table[:, [at[n] for n in (target, *predictors)]]
    part = table[~np.isnan(used).any(axis=1)]
    x, y = design(part, names, predictors, interactions), part[:, at[target]]
    n, width = x.shape
    rank = np.linalg.matrix_rank(x)
    inverse = np.linalg.pinv(x, rcond=1e-12) @ np.linalg.pinv(x, rcond=1e-12).T
    beta = np.linalg.pinv(x, rcond=1e-12) @ y
    e = y - x @ beta
    sse, sst = e @ e, ((y - y.mean()) ** 2).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        p = tails.t_two_sided(beta / np.sqrt(np.diag(inverse) * sse / (n - rank)), n - rank)
        h = np.einsum("ij,jk,ik->i", x, inverse, x)
        meat = x.T @ (x * ((e / (1 - h)) ** 2)[:, None])
        hc3 = tails.normal_two_sided(beta / np.sqrt(np.diag(inverse @ meat @ inverse)))
    gamma = np.linalg.pinv(x, rcond=1e-12) @ e**2
    fit = x @ gamma
    lm = n * (1 - ((e**2 - fit) ** 2).sum() / ((e**2 - (e**2).mean()) ** 2).sum())
    return {
        "n": n, "beta": beta, "r2": 1 - sse / sst, "adj_r2": 1 - (sse / (n - rank)) / (sst / (n - 1)),
        "rmse": np.sqrt(sse / n), "p": p, "hc3": hc3, "lm": lm, "bp": tails.chi2_tail(lm, width - 1),
    }


def floats(values):
    return np.array([np.nan if v is None else v for v in values], float)


def check(row, expected):
    assert row.n == expected["n"]
    assert row.r2 == pytest.approx(expected["r2"], abs=1e-9)
    assert row.adj_r2 == pytest.approx(expected["adj_r2"], abs=1e-9)
    assert row.rmse == pytest.approx(expected["rmse"], rel=1e-9)
    np.testing.assert_allclose([row.intercept, *row.coefficients], expected["beta"], rtol=1e-6, atol=1e-9)


# ---- plans -----------------------------------------------------------------


def test_plan_counts_and_order(spark):
    plan = plan_models(spark, TRAFFIC_TARGETS, WEATHER_PREDICTORS, 3)
    rows = plan.orderBy("model_id").collect()
    assert len(rows) == 645 and len({row.model_id for row in rows}) == 645
    expected = [
        (t, list(c)) for t in TRAFFIC_TARGETS for k in (1, 2, 3) for c in itertools.combinations(WEATHER_PREDICTORS, k)
    ]
    assert [(row.target, row.predictors) for row in rows] == expected
    assert rows[0].formula == "Distance(mi) ~ (Temperature(F))"
    assert plan_models(spark, TRAFFIC_TARGETS, WEATHER_PREDICTORS[:6], 2).count() == 105
    counts = {(r.target, r.n_predictors): r.n_models for r in count_experiments(plan).collect()}
    assert counts[("Severity", 3)] == 84


def test_always_included_predictor(spark):
    plan = plan_models(spark, ["y", "d"], ["a", "c"], 2, always_include=["d"])
    found = {(row.target, tuple(row.predictors), row.formula) for row in plan.collect()}
    assert ("y", ("a", "c", "d"), "y ~ a + c + d") in found and ("d", ("a", "c"), "d ~ a + c") in found
    assert len(found) == 6


def test_pending_and_check(spark):
    plan = plan_models(spark, ["y"], ["a", "b", "c"], 2)
    done = plan.filter(F.size("predictors") == 1)
    assert pending_models(plan, done.unionByName(done)).count() == 3
    odd = spark.createDataFrame([(1, "y", ["a", "q"], "y ~ (a + q)")], plan.schema)
    doubled = done.unionByName(done.filter(F.array_contains("predictors", "a"))).unionByName(odd)
    assert tuple(check_models(doubled, plan).first()) == ("y", 5, 1, 1, 3)


def test_valid_predictors(spark):
    models = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["a", "q"],), (["b"],)], "predictors array<string>")
    found = [row.valid_predictors for row in with_valid_predictors(models, ["a", "b", "c"]).collect()]
    assert found == [True, False, False, True]


def test_vectors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, 8.0)], "a double, b double")
    rows = standardise(assemble(df, ["a", "b"], invalid="skip")).collect()
    assert [round(row.scaled_features[0], 6) for row in rows] == [-0.707107, 0.707107]
    with pytest.raises(Exception, match="(?i)null"):
        assemble(df, ["a", "b"]).collect()


# ---- ordinary least squares ------------------------------------------------


def test_sweep_matches_the_library(spark):
    df = frame_of(spark, raw_rows())
    sweep = ols.prepare(df, X, Y, log_label=False)
    for row in ols.run_sweep(sweep, plan_models(spark, Y, X, 3)).collect():
        assembled = VectorAssembler(inputCols=row.predictors, outputCol="features").transform(df)
        summary = LinearRegression(featuresCol="features", labelCol=row.target, solver="normal").fit(assembled).summary
        assert row.status == "OK" and row.r2 == pytest.approx(summary.r2, abs=1e-10)
        assert row.adj_r2 == pytest.approx(summary.r2adj, abs=1e-10)
        assert row.rmse == pytest.approx(summary.rootMeanSquaredError, rel=1e-9)
        np.testing.assert_allclose(row.pvalues, summary.pValues, atol=1e-9)
        assert row.n_sig_with_intercept == sum(p < 0.05 for p in summary.pValues)
        assert row.n_sig_predictors == sum(p < 0.05 for p in summary.pValues[:-1])
        assert row.n_nonzero == len(row.predictors)


def test_standardised_sweep_matches_the_library(spark):
    df = frame_of(spark, raw_rows(holes=0.05))
    sweep = ols.prepare(df, X, Y, log_label=False, missing="per_model", standardised=True)
    for row in ols.run_sweep(sweep, plan_models(spark, ["y"], X, 2)).collect():
        assembled = VectorAssembler(inputCols=row.predictors, outputCol="v", handleInvalid="skip").transform(
            df.na.drop(subset=[*row.predictors, "y"])
        )
        scaler = StandardScaler(inputCol="v", outputCol="features", withMean=True, withStd=True)
        model = LinearRegression(labelCol="y", standardization=False).fit(scaler.fit(assembled).transform(assembled))
        np.testing.assert_allclose(row.coefficients, model.coefficients, rtol=1e-6)
        assert row.intercept == pytest.approx(model.intercept) and row.r2 == pytest.approx(model.summary.r2, abs=1e-9)
        np.testing.assert_allclose(row.pvalues, model.summary.pValues, atol=1e-8)


def test_per_model_deletion(spark):
    table = raw_rows(holes=0.1)
    sweep = ols.prepare(frame_of(spark, table), X, Y, log_label=False, missing="per_model")
    rows = ols.run_sweep(sweep, plan_models(spark, Y, X, 3)).collect()
    assert len(rows) == 28
    for row in rows:
        check(row, dense(table, (*X, *Y), row.target, row.predictors))


def test_twenty_columns_with_gaps(spark):
    rng = np.random.default_rng(11)
    names = [f"x{i}" for i in range(20)]
    x = rng.normal(size=(300, 20))
    y = x[:, 0] - 2 * x[:, 19] + rng.normal(size=300)
    x[rng.random(x.shape) < 0.15] = np.nan  # nearly every row lacks columns of its own
    table = np.column_stack([x, y])
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in table]
    df = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in [*names, "y"])).repartition(5)
    sweep = ols.prepare(df, names, ["y"], log_label=False, missing="per_model")
    found = ols.run_sweep(sweep, plan_models(spark, ["y"], names, 2)).collect()
    assert len(found) == 210
    for row in found[::15]:
        check(row, dense(table, (*names, "y"), "y", row.predictors))


def test_constant_column_does_not_repeat_the_pass(spark):
    df = spark.range(50).selectExpr("double(id) AS a", "12345678.9D AS b", "double(id * 3 + id % 7) AS y")
    gathered = M.moments_of(df, ["a", "b", "y"])
    assert gathered.column_means()[1] is False


def test_global_deletion_and_partition_invariance(spark):
    table = raw_rows(holes=0.05)
    whole = table[~np.isnan(table).any(axis=1)]
    plan = plan_models(spark, Y, X, 2)
    results = []
    for parts in (1, 6):
        df = frame_of(spark, table).repartition(parts)
        rows = ols.run_sweep(ols.prepare(df, X, Y, log_label=False), plan).orderBy("model_id").collect()
        results.append([row.r2 for row in rows])
        for row in rows:
            check(row, dense(whole, (*X, *Y), row.target, row.predictors))
    np.testing.assert_allclose(results[0], results[1], rtol=1e-12)


def test_predictor_order_does_not_matter(spark):
    df = frame_of(spark, raw_rows())
    forth = ols.run_sweep(ols.prepare(df, X, ["y"], log_label=True), plan_models(spark, ["y"], X, 2))
    back = ols.run_sweep(ols.prepare(df, X[::-1], ["y"], log_label=True), plan_models(spark, ["y"], X[::-1], 2))
    r2 = [{frozenset(row.predictors): round(row.r2, 10) for row in m.collect()} for m in (forth, back)]
    assert r2[0] == r2[1] and len(r2[0]) == 10


def test_log_label_drops_values_without_log(spark):
    table = raw_rows()
    table[:40, 4] = -1.0
    df = frame_of(spark, table)
    row = ols.run_sweep(ols.prepare(df, ["a"], ["y"], log_label=True), plan_models(spark, ["y"], ["a"], 1)).first()
    assert row.n == int((table[:, 4] > -1).sum()) < 400


def test_far_means_keep_their_digits(spark):
    table = raw_rows()
    table[:, :2] += 1e7
    df = frame_of(spark, table)
    sweep = ols.prepare(df, X, ["y"], log_label=False)
    near = dense(raw_rows(), (*X, *Y), "y", ["a", "b (x)"])
    row = ols.run_sweep(sweep, plan_models(spark, ["y"], X[:2], 2)).filter(F.size("predictors") == 2).first()
    assert row.r2 == pytest.approx(near["r2"], abs=1e-7)
    np.testing.assert_allclose(row.coefficients, near["beta"][1:], rtol=1e-6)


def test_models_that_cannot_be_fitted_are_reported(spark):
    table = raw_rows(n=30)
    table[:, 2] = 7.0
    table[:, 3] = 2 * table[:, 0] - 1
    table[:, 5] = 4.0
    df = frame_of(spark, table)
    models = ols.run_sweep(ols.prepare(df, X, Y, log_label=False), plan_models(spark, Y, X, 2))
    status = {(row.target, tuple(row.predictors)): row for row in models.collect()}
    assert len(status) == 20
    assert status[("y", ("c",))].status == "SINGULAR" and status[("y", ("c",))].r2 is None
    assert status[("y", ("a", "d"))].status == "SINGULAR" and status[("y", ("a", "d"))].estimation is None
    assert status[("y", ("a", "b (x)"))].status == "OK" and status[("z", ("a",))].status == "CONSTANT_TARGET"
    few = ols.run_sweep(ols.prepare(df.limit(3), X, ["y"], log_label=False), plan_models(spark, ["y"], X, 2))
    assert {row.status for row in few.filter(F.size("predictors") == 2).collect()} == {"INSUFFICIENT"}
    none = ols.run_sweep(ols.prepare(df.limit(0), X, ["y"], log_label=False), plan_models(spark, ["y"], X, 1))
    assert {(row.status, row.n) for row in none.collect()} == {("INSUFFICIENT", 0)}
    with pytest.raises(ValueError, match="not numeric"):
        ols.prepare(df.withColumn("t", F.lit("x")), X, ["t"], log_label=False)


def test_residuals(spark):
    table = raw_rows()
    df = frame_of(spark, table)
    model = ols.run_sweep(ols.prepare(df, ["c"], ["y"], log_label=False), plan_models(spark, ["y"], ["c"], 1)).first()
    rows = ols.with_residuals(df, "y", ["c"], model).select("c", "y", "residual").collect()
    beta = dense(table, (*X, *Y), "y", ["c"])["beta"]
    assert all(row.residual == pytest.approx(row.y - beta[0] - beta[1] * row.c, abs=1e-9) for row in rows)


# ---- heteroskedasticity ----------------------------------------------------


def with_dummies(table, seed=3):
    """Adds three exclusive 0/1 columns, so products of two of them are all zero."""
    kind = np.random.default_rng(seed).integers(0, 4, len(table))
    return np.column_stack([table, *[(kind == k).astype(float) for k in range(3)]])


@pytest.mark.parametrize("estimation", ["tested", "hc3"])
def test_robust_sweep_matches_dense_formulas(spark, estimation):
    names = (*X, *Y, "k0", "k1", "k2")
    table = with_dummies(raw_rows(n=600, holes=0.03))
    df = frame_of(spark, table, names)
    predictors = ["a", "b (x)", "k0", "k1", "k2"]
    sweep = ols.prepare(
        df, predictors, Y, log_label=False, missing="per_model", interactions=True, collinear="shortest"
    )
    plan = plan_models(spark, Y, predictors, 3, interactions=True)
    rows = robust.run_robust_sweep(sweep, plan, estimation).collect()
    assert len(rows) == 50 and {row.status for row in rows} == {"OK", "RANK_DEFICIENT"}
    kinds = set()
    for row in rows:
        expected = dense(table, names, row.target, row.predictors, interactions=True)
        check(row, expected)
        assert row.bp_stat == pytest.approx(expected["lm"], rel=1e-6)
        assert row.bp_pvalue == pytest.approx(expected["bp"], rel=1e-6, abs=1e-12)
        use = "HC3" if estimation == "hc3" or expected["bp"] < 0.05 else "OLS"
        assert row.estimation == use
        kinds.add(use)
        p = expected["hc3"] if use == "HC3" else expected["p"]
        there = np.abs(expected["beta"]) > 1e-9
        mine = floats([row.pvalues[-1], *row.pvalues[:-1]])
        np.testing.assert_allclose(mine[there], p[there], rtol=1e-5, atol=1e-9)
        assert np.isnan(mine[~there]).all()
        assert row.n_sig_with_intercept == int((p[there] < 0.05).sum())
    assert kinds == ({"HC3"} if estimation == "hc3" else {"HC3", "OLS"})


def test_robust_summary_counts_both_kinds(spark):
    sweep = ols.prepare(frame_of(spark, raw_rows()), X, ["y"], log_label=False)
    summary = ranking.robust_summary(robust.run_robust_sweep(sweep, plan_models(spark, ["y"], X, 2))).first()
    assert summary.total_models == 10 and summary.hc3_models + summary.ols_models == 10


# ---- ranking ---------------------------------------------------------------

# R² of a published sweep with six predictors and at most two per
# model, in log order; and how often its ten best models use each predictor.
PUBLISHED_PREDICTORS = [
    "Visibility(mi)", "WindSpeed(mph)", "Humidity(%)", "Pressure(in)", "WindChill(F)", "Temperature(F)",
]
PUBLISHED_R2 = """\
SpeedNumeric 0.0229 0.0005 0.0096 0.0124 0.0065 0.0053 0.0229 0.0234 0.0332 0.0232 0.0230 0.0104 0.0128 0.0066 0.0055 0.0229 0.0116 0.0109 0.0180 0.0169 0.0111
TrafficJamDuration(mins) 0.0113 0.0029 0.0072 0.0014 0.0455 0.0432 0.0131 0.0125 0.0133 0.0458 0.0437 0.0107 0.0044 0.0457 0.0439 0.0083 0.0455 0.0432 0.0479 0.0456 0.0470
DelayFromTypicalTraffic(mins) 0.0108 0.0002 0.0145 0.0140 0.0007 0.0004 0.0114 0.0169 0.0232 0.0112 0.0115 0.0145 0.0143 0.0010 0.0006 0.0296 0.0151 0.0156 0.0143 0.0141 0.0045
Severity 0.0019 0.0000 0.0025 0.0051 0.0013 0.0010 0.0020 0.0030 0.0066 0.0023 0.0021 0.0025 0.0051 0.0015 0.0011 0.0079 0.0029 0.0027 0.0061 0.0059 0.0028
Distance(mi) 0.0382 0.0027 0.0149 0.0106 0.0213 0.0188 0.0391 0.0388 0.0463 0.0429 0.0419 0.0184 0.0130 0.0218 0.0199 0.0266 0.0261 0.0240 0.0303 0.0279 0.0266
"""
PUBLISHED_INFLUENCE = {
    "SpeedNumeric": (6, 2, 2, 5, 2, 2),
    "TrafficJamDuration(mins)": (2, 2, 1, 2, 6, 5),
    "DelayFromTypicalTraffic(mins)": (2, 2, 6, 5, 2, 2),
    "Severity": (2, 1, 4, 6, 3, 3),
    "Distance(mi)": (6, 1, 2, 4, 3, 3),
}
PUBLISHED_TOTAL = (18, 8, 15, 22, 16, 15)


def test_ranking_reproduces_published_counts(spark):
    targets = list(PUBLISHED_INFLUENCE)
    plan = plan_models(spark, targets, PUBLISHED_PREDICTORS, 2)
    ids = [row.model_id for row in plan.orderBy("model_id").collect()]
    r2 = [float(v) for line in PUBLISHED_R2.splitlines() for v in line.split()[1:]]
    assert len(ids) == len(r2) == 105
    models = plan.join(spark.createDataFrame(list(zip(ids, r2)), "model_id long, r2 double"), "model_id")
    ranked = ranking.top_and_bottom(models)
    assert ranked.filter("section = 'top'").count() == 50 and ranked.filter("section = 'bottom'").count() == 25
    influence = ranking.predictor_influence(ranked.filter("section = 'top'"))
    found = {(row.target, row.predictor): row.frequency for row in influence.collect()}
    for target, counts in PUBLISHED_INFLUENCE.items():
        assert tuple(found[(target, name)] for name in PUBLISHED_PREDICTORS) == counts
    total = {row.predictor: row.frequency for row in ranking.influence_over_targets(influence).collect()}
    assert tuple(total[name] for name in PUBLISHED_PREDICTORS) == PUBLISHED_TOTAL
    best = ranked.filter("section = 'top' AND place = 1 AND target = 'Distance(mi)'").first()
    assert best.predictors == ["Visibility(mi)", "Pressure(in)"] and best.r2 == 0.0463
