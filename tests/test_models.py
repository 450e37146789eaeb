"""Formulas, rank, guarded fits, exact splits, level order, grouping sets, the REML spline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galecast.operators import hazards, levels
from galecast.stats import cv, design, glm, smooth


@pytest.mark.parametrize(("text", "terms", "intercept", "offsets"), [
    ("y ~ a + b", [("a",), ("b",)], True, []),
    ("y ~ a*b - 1", [("a",), ("b",), ("a", "b")], False, []),
    ("y ~ a:b + a + 0", [("a",), ("a", "b")], False, []),
    ("y ~ a*b*c - a:b:c", [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")], True, []),
    ("y ~ I(x^2) + log(x + 1) + offset(log(n))", [("I(x^2)",), ("I(log(x + 1))",)], True, ["offset(log(n))"]),
    ("`my y` ~ `a b` + a + a", [("a b",), ("a",)], True, []),
    ("y ~ 1", [], True, []),
])
def test_formula(text, terms, intercept, offsets):
    f = design.parse_formula(text)
    assert (list(f.terms), f.intercept, list(f.offsets)) == (terms, intercept, offsets)


@pytest.mark.parametrize("text", ["y", "~ a", "y ~ a +", "y ~ (a", "y ~ a b", "y ~ a - offset(log(b))"])
def test_bad_formula(text):
    with pytest.raises(ValueError):
        design.parse_formula(text)


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g, h = "abc"[i % 3], ["u", "v"][(i // 3) % 2]
        x, e = float(rng.normal()), float(rng.integers(1, 9))
        rows.append((int(rng.poisson(e * math.exp(0.3 + 0.4 * x + 0.5 * (g == "b") - 0.7 * (h == "v")))), g, h, x, e))
    return spark.createDataFrame(rows, "y int, g string, h string, x double, e double").cache()


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark)


def matrix(pdf, names):
    def column(name):
        out = np.ones(len(pdf))
        for part in name.split(":"):
            if part in ("x", "e", "y"):
                out = out * pdf[part]
            elif part != "(Intercept)":
                out = out * (pdf[part[0]] == part[1:])
        return out
    return np.column_stack([column(n) for n in names]).astype(float)


def irls(X, y, offset=0.0):
    eta = np.log(y + 0.1)
    for _ in range(60):
        mu = np.exp(eta)
        beta = np.linalg.lstsq(X * np.sqrt(mu)[:, None], (eta - offset + (y - mu) / mu) * np.sqrt(mu), rcond=None)[0]
        eta = X @ beta + offset
    return beta


@pytest.mark.parametrize(("formula", "names"), [
    ("y ~ g * x", ["(Intercept)", "gb", "gc", "x", "gb:x", "gc:x"]),
    ("y ~ g - 1", ["ga", "gb", "gc"]),
    ("y ~ g + h - 1", ["ga", "gb", "gc", "hv"]),
    ("y ~ g:h - 1", ["ga:hu", "gb:hu", "gc:hu", "ga:hv", "gb:hv", "gc:hv"]),
    ("y ~ g:x", ["(Intercept)", "ga:x", "gb:x", "gc:x"]),
    ("y ~ g * h", ["(Intercept)", "gb", "gc", "hv", "gb:hv", "gc:hv"]),
    ("y ~ x - 1", ["x"]),
])
def test_design_and_fit_equal_plain_regression(rows, formula, names):
    fit = glm.glm(rows, formula)
    assert fit.names == names and fit.converged and not fit.aliased.any()
    pdf = rows.toPandas()
    assert np.allclose(fit.beta, irls(matrix(pdf, names), pdf.y.to_numpy(float)), atol=1e-6)


def test_offset_and_powers(rows):
    pdf = rows.toPandas()
    fit = glm.glm(rows, "y ~ x + I(x^2) + offset(log(e))")
    X = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.x ** 2])
    assert fit.names == ["(Intercept)", "x", "I(x^2)"]
    assert np.allclose(fit.beta, irls(X, pdf.y.to_numpy(float), np.log(pdf.e.to_numpy())), atol=1e-6)


@pytest.mark.parametrize("family", ["poisson", "negbin"])
def test_aliased_terms_are_left_out(rows, family):
    more = rows.withColumn("x2", 2 * F.col("x") + 1).withColumn("is_b", (F.col("g") == "b").cast("int")).withColumn("five", F.lit(5.0))
    fit, plain = glm.glm(more, "y ~ five + x + x2 + g + is_b", family), glm.glm(rows, "y ~ x + g", family)
    assert dict(zip(fit.names, fit.aliased, strict=True)) == {
        "(Intercept)": False, "five": True, "x": False, "x2": True, "gb": False, "gc": False, "is_b": True}
    kept = ~fit.aliased
    assert fit.rank == plain.rank == 4 and fit.converged
    assert np.allclose(fit.beta[kept], plain.beta, atol=1e-8) and abs(fit.aic - plain.aic) < 1e-6
    assert np.allclose(np.diag(fit.cov)[kept], np.diag(plain.cov), rtol=1e-6)
    tidy = {r[0]: r[1:6] for r in fit.tidy_rows()}
    assert tidy["x2"] == tidy["five"] == tidy["is_b"] == (None,) * 5


def test_nearly_collinear_column_is_kept(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.poisson(5)), float(x), float(x + 1e-5 * z), float(2 * x + 1)) for x, z in rng.normal(size=(500, 2))]
    fit = glm.glm(spark.createDataFrame(rows, "y double, x double, near double, same double"), "y ~ x + near + same")
    assert list(fit.aliased) == [False, False, False, True]


def test_level_that_a_group_lacks_is_aliased_there(rows):
    formula = design.parse_formula("y ~ g + x")
    d = design.build_design(design.complete_rows(rows, formula), formula)
    group = F.when(F.col("h") == "u", 0).otherwise(1)
    own = rows.where((F.col("h") == "u") | (F.col("g") != "c"))
    fits = glm.fit_groups(glm.prepare_rows(own, d, group), d)
    assert list(fits[0].aliased) == [False] * 4 and list(fits[1].aliased) == [False, False, True, False]


def diverging(spark):
    """A far outlier in x beside counts that fall with x: the first step puts its mean beyond a double."""
    rows = [(c, float(x)) for x, c in [(0, 1000), (1, 400), (2, 150), (3, 60), (4, 20)] for _ in range(5)]
    return spark.createDataFrame([*rows, *[(0, 400.0)] * 3, (1, -60.0)], "y int, x double")


def test_steps_that_go_too_far_are_halved(spark):
    df = diverging(spark)
    pdf = df.toPandas()
    y, X = pdf.y.to_numpy(float), np.column_stack([np.ones(len(pdf)), pdf.x])

    def deviance(beta):
        with np.errstate(over="ignore", invalid="ignore"):
            mu = np.exp(X @ beta)
        return 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))

    eta = np.log(y + 0.1)
    mu = np.exp(eta)
    W = X * mu[:, None]
    first = np.linalg.solve(X.T @ W, W.T @ (eta + (y - mu) / mu))
    null = np.array([math.log(y.mean()), 0.0])
    assert not deviance(first) <= deviance(null)  # a plain first step does harm
    fit = glm.glm(df, "y ~ x")
    assert fit.converged and fit.deviance <= deviance(null)
    score = X.T @ (y - np.exp(X @ fit.beta))
    assert np.all(np.abs(score) < 1e-5 * (np.abs(X).T @ y))


def test_all_zero_counts_and_no_rows(spark):
    fit = glm.glm(spark.createDataFrame([(0, 1.0), (0, 2.0)], "y int, x double"), "y ~ 1")
    assert fit.beta[0] < -15
    with pytest.raises(ValueError, match="no complete rows"):
        glm.glm(spark.createDataFrame([(None, 1.0)], "y int, x double"), "y ~ x")


def test_theta_from_counts_equals_theta_from_rows(rows, monkeypatch):
    one = glm.glm(rows, "y ~ g + x", "negbin")
    monkeypatch.setattr(glm, "HISTOGRAM_ROWS", 1)
    two = glm.glm(rows, "y ~ g + x", "negbin")
    assert abs(one.theta - two.theta) < 1e-8 * one.theta and abs(one.loglik - two.loglik) < 1e-8 * abs(one.loglik)
    assert np.allclose(one.beta, two.beta, atol=1e-9)


@pytest.mark.parametrize("n", [1, 7, 500, 3001])
def test_exact_splits(spark, n):
    df = spark.range(n).withColumn("k", F.col("id") % 50)
    for keys in (["id"], ["k"]):  # with repeated keys the row number decides
        got = cv.split_sizes(df, keys, n_splits=7, seed=5, exact=True).collect()
        k = max(n // 5, 1)
        assert sorted((r.split_id, r.n_train, r.n_test) for r in got) == [(s, n - k, k) for s in range(7)]
    flags = cv.with_splits(df, ["id"], 3, seed=5, exact=True).withColumn("h", cv._hash(["id"], 5)).collect()
    for s in range(3):
        own = sorted((r.h, r.is_test) for r in flags if r.split_id == s)
        assert [f for _, f in own] == [True] * max(n // 5, 1) + [False] * (n - max(n // 5, 1))


def test_cross_validation_fits_equal_single_fits(rows):
    keyed = rows.withColumn("id", F.monotonically_increasing_id()).cache()
    out = cv.cv_errors(keyed, "y ~ g + x", ["id"], n_splits=3, seed=2, exact=True).collect()
    for s in range(3):
        flagged = cv.with_splits(keyed, ["id"], 3, seed=2, exact=True).where(F.col("split_id") == s)
        both = glm.glm(flagged.where("NOT is_test"), "y ~ g + x", "both")
        pdf = flagged.where("is_test").toPandas()
        X = matrix(pdf, ["(Intercept)", "gb", "gc", "x"])
        for name, fit in (("poisson", both["poisson"]), ("negative_binomial", both["negbin"])):
            want = math.sqrt(np.mean((pdf.y - np.exp(X @ fit.beta)) ** 2))
            got = [r.rmse for r in out if (r.split_id, r.model) == (s, name)]
            assert got == [pytest.approx(want, rel=1e-6)]
    assert {(r.model, r.model_order) for r in out} == {("poisson", 1), ("negative_binomial", 2)}


def test_levels_in_order_of_first_appearance(spark, tmp_path):
    for k, text in enumerate(["x\nb\na\nb\n", "x\nc\na\nd\n"]):
        (tmp_path / f"{k}.csv").write_text(text)
    df = levels.read_order(spark.read.option("header", "true").schema("x string").csv(str(tmp_path)))
    got = {r.x: r.position for r in levels.first_appearance(df, "x", ["read_at"]).collect()}
    assert got == {"b": 1, "a": 2, "c": 3, "d": 4}
    out = levels.with_first_order(df, "x", "n", ["read_at"]).collect()
    assert sorted((r.x, r.n) for r in out) == [("a", 2), ("a", 2), ("b", 1), ("b", 1), ("c", 3), ("d", 4)]


def test_totals_by_grouping_sets_equal_windows(spark):
    rows = [(s, y, d, n) for s, y, d, n in [("a", 1, "x", 2), ("a", 1, "y", 3), ("b", 1, "x", 4), (None, 1, "x", 5), (None, 1, None, 6),
                                            ("a", None, "x", 7), ("a", 2, None, 8), (None, None, None, 9)]]
    df = spark.createDataFrame(rows, "state string, year int, disaster string, n long")
    one, two = (sorted(map(tuple, hazards.with_totals(df, "state", bounded=b).select(
        "state", "year", "disaster", "n_disaster_state", "n_state", "n_total", "n_type").collect()), key=str) for b in (True, False))
    assert one == two and len(one) == len(rows)


def curve(spark, n=2000, noise=0.1, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(g, float(x), float((math.sin(6 * x) if g == "wave" else 2 * x) + noise * rng.normal()))
            for g in ("wave", "line") for x in rng.uniform(0, 1, n)]
    return spark.createDataFrame(rows, "g string, x double, y double")


def test_spline_recovers_curves_and_its_score_is_zero(spark):
    df = curve(spark)
    out = smooth.trend_smooth(df, "x", "y", ["g"]).toPandas()
    wave, line = out[out.g == "wave"], out[out.g == "line"]
    assert len(wave) == len(line) == 80
    assert np.max(np.abs(wave.fitted - np.sin(6 * wave.x))) < 0.05 and np.max(np.abs(line.fitted - 2 * line.x)) < 0.05
    assert 10 > wave.edf.iloc[0] > line.edf.iloc[0] > 1
    assert all(abs(r.score) < 1e-6 for r in smooth.spline_fits(df, "x", "y", ["g"]).collect())


def test_spline_equals_a_plain_solution(spark):
    df = curve(spark, n=300)
    fits = {r.g: r for r in smooth.spline_fits(df, "x", "y", ["g"]).collect()}
    for g, pdf in df.toPandas().groupby("g"):
        x, y, r = pdf.x.to_numpy(), pdf.y.to_numpy(), fits[g]
        knots = np.quantile(np.unique(x), np.linspace(0, 1, smooth.KNOTS))
        t, k = (x - knots[0]) / (knots[-1] - knots[0]), (knots - knots[0]) / (knots[-1] - knots[0])
        assert np.allclose(r._knots, k)
        second, S = smooth.spline_matrices(k)
        j = np.clip(np.searchsorted(k, t, "right") - 1, 0, len(k) - 2)
        h = k[j + 1] - k[j]
        a, b = k[j + 1] - t, t - k[j]
        X = (((a ** 3 / h - h * a) / 6)[:, None] * second[j] + ((b ** 3 / h - h * b) / 6)[:, None] * second[j + 1])
        X[np.arange(len(t)), j] += a / h
        X[np.arange(len(t)), j + 1] += b / h
        Xc = X - X.mean(axis=0)
        # The sum-to-zero curve with the least penalised squares at the reported weight.
        A = np.vstack([np.hstack([X.T @ X + r["lambda"] * smooth.shrunk(S, k), X.sum(axis=0)[:, None]]), np.append(X.sum(axis=0), 0.0)])
        beta = np.linalg.solve(A, np.append(X.T @ (y - y.mean()), 0.0))[:-1]
        assert np.allclose(np.array(r._value), beta + y.mean(), atol=1e-6) and Xc.shape[1] == smooth.KNOTS


def test_spline_of_few_values(spark):
    rows = [("one", 1.0, 2.0), ("one", 1.0, 4.0), ("two", 0.0, 1.0), ("two", 1.0, 3.0), ("two", 1.0, 5.0), ("flat", 0.0, 1.0), ("flat", 1.0, 1.0),
            ("gone", None, 1.0), (None, 0.0, 1.0), (None, 5.0, 2.0), (None, 9.0, 3.0)]
    out = smooth.trend_smooth(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"], n_grid=3).toPandas()
    assert set(out.g.map(str)) == {"one", "two", "flat", "None"} and out.fitted.notna().all()
    assert np.allclose(out[out.g == "one"].fitted, 3) and np.allclose(out[out.g == "flat"].fitted, 1)


def test_spline_without_a_best_weight_above_zero(spark):
    """Equal y at each of seven x: the curve goes through all, and the least weight is the best one."""
    y = [3.0, 9.0, 1.0, 7.0, 2.0, 8.0, 4.0]
    df = spark.createDataFrame([("g", float(x), v) for x, v in enumerate(y) for _ in range(6)], "g string, x double, y double")
    fit = smooth.spline_fits(df, "x", "y", ["g"]).first()
    assert fit.score == 0 and abs(fit.edf - 7) < 1e-3
    out = smooth.trend_smooth(df, "x", "y", ["g"], n_grid=7).toPandas().sort_values("x")
    assert np.allclose(out.fitted, y, atol=1e-4)


def test_dense_loess_equals_the_plain_one(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0, 100, 3000), rng.normal(20, 0.01, 800), [1e3], np.full(200, 50.0)])
    rows = [("a", float(v), float(math.sin(v / 9) + rng.normal())) for v in x]
    rows += [(None, float(v), float(v)) for v in range(5)] + [("same", 2.0, 1.0), ("same", 2.0, 3.0), ("gone", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    one, two = (f(df, "x", "y", ["g"], n_grid=40).toPandas() for f in (smooth.trend_loess, smooth.trend_loess_dense))
    one, two = (o.assign(g=o.g.map(str)).sort_values(["g", "x"], ignore_index=True) for o in (one, two))
    assert len(one) == len(two) == 120 and (one.g == two.g).all() and np.allclose(one.x, two.x)
    assert np.allclose(one.fitted, two.fitted, atol=1e-6)


def test_dense_loess_without_groups_reads_few_points(spark, monkeypatch):
    df = spark.range(20000).selectExpr("CAST(id AS DOUBLE) / 7 AS x", "SIN(id / 3000) AS y")
    read = []
    points = smooth._points_of
    monkeypatch.setattr(smooth, "_points_of", lambda *a: read.append(points(*a)) or read[-1])
    out = smooth.trend_loess_dense(df, "x", "y", n_grid=40).toPandas()
    assert len(out) == 40 and list(out.columns) == ["x", "fitted"]
    assert sum(r.count() for r in read) < 0.05 * 40 * 20000
