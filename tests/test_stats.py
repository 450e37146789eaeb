"""Count models, CV, densities, smoother and the gamma-family functions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galecast.functions import special
from galecast.sources.tables import order_model_rows
from galecast.stats import cv, glm, kde, smooth
from tests.conftest import SF_SMALL


def test_special_functions(spark):
    xs = [0.3, 1.0, 2.5, 7.0, 40.0, 1234.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    x = F.col("x")
    rows = df.select(special.lgamma(x).alias("lg"), special.digamma(x).alias("dg"),
                     special.trigamma(x).alias("tg")).collect()
    for x, r in zip(xs, rows):
        assert abs(r.lg - math.lgamma(x)) < 1e-10 * max(1.0, abs(math.lgamma(x)))
        h = 1e-5
        num_dg = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        assert abs(r.dg - num_dg) < 1e-5
        assert abs(r.dg - special.digamma_py(x)) < 1e-12
        assert abs(r.tg - special.trigamma_py(x)) < 1e-12
        num_tg = (special.digamma_py(x + h) - special.digamma_py(x - h)) / (2 * h)
        assert abs(r.tg - num_tg) < 1e-5 * max(1.0, r.tg)


@pytest.fixture(scope="module")
def orders(spark):
    return order_model_rows(spark, SF_SMALL).where(F.col("region").isNotNull()).cache()


def test_poisson_matches_mllib(spark, orders):
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression
    fit = glm.glm(orders, "y ~ year + region + totalprice", family="poisson")
    rf = RFormula(formula="y ~ year + region + totalprice", stringIndexerOrderType="alphabetDesc")
    m = rf.fit(orders).transform(orders)
    ref = GeneralizedLinearRegression(family="poisson", link="log", tol=1e-12, maxIter=100).fit(m)
    attrs = m.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"].replace("region_", "region") for kind in attrs.values() for a in kind}
    ours = dict(zip(fit.names, fit.beta))
    assert abs(ours["(Intercept)"] - ref.intercept) < 1e-6 * abs(ref.intercept)
    for i, c in enumerate(ref.coefficients):
        assert abs(ours[names[i]] - c) <= 1e-6 * abs(c) + 1e-12
    assert abs(fit.aic - ref.summary.aic) < 1e-6 * ref.summary.aic


def test_negbin_score_equations(spark, orders):
    fit = glm.glm(orders, "y ~ year + region + totalprice", family="negbin")
    assert fit.converged and 0 < fit.theta < 1e5
    pdf = orders.select("y", "year", "region", "totalprice").toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.year,
                         *(pdf.region == lv for lv in ["northeast", "southeast", "west"]), pdf.totalprice])
    mu = np.exp(X @ fit.beta)
    y = pdf.y.to_numpy(float)
    th = fit.theta
    score_b = X.T @ ((y - mu) / (1 + mu / th))
    scale = np.abs(X).T @ y
    assert np.all(np.abs(score_b) / scale < 1e-6)
    score_t = sum(special.digamma_py(th + v) for v in y) - len(y) * special.digamma_py(th) \
        + np.sum(np.log(th) + 1 - np.log(th + mu) - (y + th) / (mu + th))
    assert abs(score_t) < 1e-4 * len(y) / th
    ll = sum(math.lgamma(th + v) - math.lgamma(th) - math.lgamma(v + 1) for v in y) + \
        np.sum(th * np.log(th) + y * np.log(mu) - (th + y) * np.log(th + mu))
    assert abs(ll - fit.loglik) < 1e-6 * abs(ll)


def test_by_group_closed_form(spark, orders):
    pdf = orders.select("y", "region").toPandas()
    means = pdf.groupby("region").y.mean()
    for family in ("poisson", "negbin"):
        fit = glm.glm(orders, "y ~ region", family=family)
        b = dict(zip(fit.names, fit.beta))
        assert abs(b["(Intercept)"] - math.log(means["midwest"])) < 1e-8
        for lv in ("northeast", "southeast", "west"):
            assert abs(b["region" + lv] - math.log(means[lv] / means["midwest"])) < 1e-8


def test_poisson_underdispersed_negbin_falls_back(spark, orders):
    pois = glm.glm(orders, "n_lines ~ region", family="poisson")
    nb = glm.glm(orders, "n_lines ~ region", family="negbin")
    assert math.isinf(nb.theta) and abs(nb.aic - pois.aic - 2) < 1e-9


def test_cv_splits_stable_and_exact(spark):
    df = spark.createDataFrame([(r, y) for r in "abcd" for y in range(10)], "region string, year int")
    a = cv.split_sizes(df, ["region", "year"], n_splits=20, seed=7, exact=True).collect()
    assert all(r.n_test == 8 and r.n_train == 32 for r in a)
    s1 = cv.with_splits(df, ["region", "year"], 5, seed=3).where("is_test").collect()
    s2 = cv.with_splits(df, ["region", "year"], 5, seed=3).where("is_test").collect()
    assert sorted(map(tuple, s1)) == sorted(map(tuple, s2))


def test_cv_errors_shapes(spark):
    rng = np.random.default_rng(0)
    rows = [(reg, yr, float(rng.poisson(20 + 3 * i))) for i, reg in enumerate(["a", "b", "c"]) for yr in range(2000, 2020)]
    df = spark.createDataFrame(rows, "region string, year int, y double")
    out = cv.cv_errors(df, "y ~ year + region", ["region", "year"], n_splits=10,
                       seed=1, exact=True).collect()
    assert len(out) == 20 and all(r.rmse >= 0 for r in out)
    assert {r.model_order for r in out if r.model == "poisson"} == {1}
    leaky = cv.cv_errors(df, "y ~ year + region", ["region", "year"], n_splits=10,
                         seed=1, exact=True, leaky=True, scale="link").collect()
    assert all(r.rmse > 5 for r in leaky)       # counts vs log-scale predictions (D3)


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(0, 1, 3000)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 1500 + ["b"] * 1500, "x": vals}))
    out = kde.density(df, "x", by=["g"]).toPandas()
    for g, part in out.groupby("g"):
        part = part.sort_values("x")
        assert len(part) == 512
        area = np.trapezoid(part.density, part.x)
        assert 0.9 < area < 1.0
        # Close to the exact Gaussian KDE on the grid.
        x = vals[:1500] if g == "a" else vals[1500:]
        sd, iqr = np.std(x, ddof=1), np.subtract(*np.percentile(x, [75, 25]))
        bw = 0.9 * min(sd, iqr / 1.34) * len(x) ** -0.2
        g0 = part.x.to_numpy()[256]
        exact = np.mean(np.exp(-0.5 * ((g0 - x) / bw) ** 2)) / (bw * math.sqrt(2 * math.pi))
        assert abs(part.density.to_numpy()[256] - exact) < 1e-3


def test_smoother_recovers_known_curve(spark):
    rng = np.random.default_rng(2)
    xs = np.tile(np.arange(1953, 2019), 4)
    grp = np.repeat(["a", "b", "c", "d"], 66)
    f = np.sin((xs - 1953) / 10.0) * 3 + 50
    ys = f + rng.normal(0, 0.3, len(xs))
    df = spark.createDataFrame(pd.DataFrame({"g": grp, "year": xs.astype(int), "v": ys}))
    out = smooth.trend_smooth(df, "year", "v", ["g"]).toPandas()
    assert len(out) == 4 * 80
    truth = np.sin((out.x - 1953) / 10.0) * 3 + 50
    assert np.max(np.abs(out.fitted - truth)) < 0.5


def test_exact_quantiles_match_type7(spark):
    from galecast.stats.quantile import exact_quantiles
    rng = np.random.default_rng(7)
    # A hot group holding most rows, continuous values with clusters and
    # repeats, a small integer group and a one-row group.
    hot = np.concatenate([rng.lognormal(0, 3, 4000), np.full(300, 2.5), 1e-9 * rng.random(200)])
    small = rng.integers(0, 5, 37).astype(float)
    rows = [("hot", float(v)) for v in hot] + [("small", float(v)) for v in small] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    freq = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["g"]: r for r in exact_quantiles(freq, ["g"], probs, value="v", count="c", bins=16).collect()}
    for g, vals in (("hot", hot), ("small", small), ("one", np.array([4.0]))):
        want = np.quantile(vals, probs)  # numpy's default is type 7
        for i, w in enumerate(want):
            assert got[g][f"q{i}"] == pytest.approx(w, rel=1e-12, abs=0.0), (g, probs[i])


def test_density_far_from_zero_and_missing_groups(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 10, 500), 3)
    mass = []
    for shift in (0.0, 1e9):
        df = spark.createDataFrame([(None, float(v) + shift) for v in x] + [(None, None)], "g string, x double")
        out = kde.density(df, "x", by=["g"]).toPandas().sort_values("x")
        assert len(out) == 512 and out.g.isna().all()
        mass.append(np.trapezoid(out.density, out.x))
    assert 0.9 < mass[0] < 1 and abs(mass[0] - mass[1]) < 1e-4


def test_density_plan_has_no_exchange_of_values_by_group(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).selectExpr("CAST(id * id % 977 AS DOUBLE) AS x")
        kde.density(df, "x").explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Every exchange by the key comes after a partial aggregate to grid points.
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_attach_groups_salted_equals_broadcast(spark):
    from galecast.functions.joins import attach_groups
    big = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("b", 2), ("c", 3)], "g string, v int")
    small = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", 3.0)], "g string, m double")
    one = attach_groups(big, small, ["g"], ["v"]).collect()
    two = attach_groups(big, small, ["g"], ["v"], broadcast_rows=0).collect()
    assert len(one) == 52 and sorted(map(repr, one)) == sorted(map(repr, two))


def test_theta_without_overdispersion_is_infinite(spark):
    rng = np.random.default_rng(4)
    y = rng.poisson(6, 4000)
    fit = glm.glm(spark.createDataFrame([(int(v), float(i % 7)) for i, v in enumerate(y)], "y int, x double"), "y ~ x", family="both")
    assert fit["poisson"].converged
    nb = fit["negbin"]
    assert math.isinf(nb.theta) and nb.loglik == fit["poisson"].loglik or nb.theta < 1e5


def test_frequency_weights_equal_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.negative_binomial(3, 0.3)), str(i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "y int, g string")
    one = glm.glm(df, "y ~ g", family="negbin")
    design = glm.build_design(df, glm.as_formula("y ~ g"))
    two = glm.fit_groups(glm.prepare_rows(df, design), design, "negbin", groups=[0])[0]
    assert np.allclose(one.beta, two.beta) and abs(one.theta - two.theta) < 1e-6 and one.n == two.n == 900


def test_score_check_is_zero_at_the_fit(spark, orders):
    out = glm.score_check(orders, "y ~ year + region + totalprice", "negbin").collect()
    assert {r.term for r in out} >= {"(Intercept)", "year", "theta"} and all(r.score < 1e-6 for r in out)


def test_loess_follows_a_quadratic(spark):
    rows = [(None, x, 3.0 + 2 * x - 0.1 * x * x) for x in range(30)] * 2 + [("b", 5, 1.0), ("b", 5, 3.0)]
    out = smooth.trend_loess(spark.createDataFrame(rows, "g string, x int, y double"), "x", "y", ["g"], n_grid=20).toPandas()
    a, b = out[out.g.isna()], out[out.g == "b"]
    assert len(a) == 20 and np.allclose(a.fitted, 3 + 2 * a.x - 0.1 * a.x ** 2)
    assert np.allclose(b.fitted, 2.0)
