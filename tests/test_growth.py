import re

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from galecast.operators import climate
from galecast.sources import tables
from galecast.stats import cv, glm
from galecast.stats.design import as_formula, build_design
from .conftest import SF_SMALL


def test_customer_lines_meet_their_orders_once(spark):
    years = tables.DRIVER_YEARS
    out = climate.climate_state_year(tables.customer_series(spark, SF_SMALL, years), tables.customer_places(spark, SF_SMALL), years)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 1


def test_series_of_one_table_keep_missing_values_apart(spark):
    years = (2000, 2001)
    one = spark.createDataFrame([("a", "200001", 5.0), ("b", "200001", 1.0), (None, "200005", 2.0)], "location string, date string, value double")
    rows = [("a", "200002", 1.0, None, 3.0), ("a", "200003", 2.0, 7.0, 1.0), (None, "200001", 1.0, 2.0, 3.0), ("c", "200001", 1.0, 1.0, 1.0),
            ("b", "200101", 1.0, 1.0, 1.0)]
    three = spark.createDataFrame(rows, "location string, date string, pcp double, tmax double, tmin double")
    places = spark.createDataFrame([("a", "A")], "location string, state_code string")
    apart = {"tavg": one} | {c: three.select("location", "date", F.col(c).alias("value")) for c in ("pcp", "tmax", "tmin")}
    want = {("A", "a", 2000, 5.0, 3.0, None, 1.0), (None, None, 2000, 2.0, 1.0, 2.0, 3.0)}
    for series in (apart, {"tavg": one, ("pcp", "tmax", "tmin"): three}):
        assert {tuple(r) for r in climate.climate_state_year(series, places, years).collect()} == want


@pytest.fixture(scope="module")
def split_rows(spark):
    rng = np.random.default_rng(3)
    rows = [Row(key=None if i % 50 == 0 else i, y=float(rng.negative_binomial(3, 0.1) if i % 9 else 0), x=float(rng.normal()), kind="abc"[i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:20]).repartition(3)
    df = glm.stage_table(df.withColumn("_out", cv._test_splits(["key"], 7, 0.3, 5)), "test-rows")
    design = build_design(df, as_formula("y ~ x + kind"))
    return df, design, glm.SplitRows(glm.prepare_rows(df, design, others=["_out"]), 7)


def test_sums_of_all_splits_equal_those_of_exploded_rows(split_rows, monkeypatch):
    df, design, rows = split_rows
    plain, p = rows.exploded(), design.p
    assert sorted((r["split_id"], r["n_train"]) for r in cv.split_sizes(df.drop("_out"), ["key"], 7, 0.3, 5).collect()) == sorted(
        (r["_g"], r["count"]) for r in plain.groupBy("_g").count().collect())
    betas = {g: np.linspace(0.1, 0.4, p) + g / 10 for g in (0, 2, 3, 6)}
    for kind, thetas in (("poisson", None), ("negbin", {g: 1.5 + g for g in betas})):
        got, want = glm._pass(rows, betas, p, kind, thetas), glm._pass(plain, betas, p, kind, thetas)
        assert got.keys() == want.keys() == betas.keys()
        for g in betas:
            assert got[g].keys() == want[g].keys()
            for name in got[g]:
                np.testing.assert_allclose(got[g][name], want[g][name], rtol=1e-10, err_msg=name)
    one, two = glm._counts(rows), glm._counts(plain)
    assert one.keys() == two.keys()
    for g in one:
        assert dict(zip(one[g].y, one[g].c, strict=True)) == dict(zip(two[g].y, two[g].c, strict=True))
    monkeypatch.setattr(glm, "HISTOGRAM_ROWS", 3)
    assert glm._counts(rows)[0].n == one[0].n


def test_cross_validation_makes_no_row_per_split(split_rows, monkeypatch):
    df, _, rows = split_rows
    monkeypatch.setattr(glm.SplitRows, "exploded", lambda self: pytest.fail("rows x splits"))
    out = cv.cv_errors(df.drop("_out"), "y ~ x + kind", ["key"], n_splits=7, test=0.3, seed=5).collect()
    assert len(out) == 14
    exact = cv.cv_errors(df.drop("_out"), "y ~ x + kind", ["key"], n_splits=7, test=0.3, seed=5, exact=True).collect()
    assert len(exact) == 14 and all(r["rmse"] > 0 for r in exact)
