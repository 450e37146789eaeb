"""One test per missing-value / text rule of SURVEY §1.5."""

from pyspark.sql import functions as F

from galecast.functions.nulls import drop_any_null, na_max, na_mean, na_min, na_sum, not_na_text, null_safe_on
from galecast.functions.text import clean_names, num_text, paste, r_round, snake_name, str_c
from galecast.plans.products import num_label


def test_null_propagating_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    out = {r.k: r for r in df.groupBy("k").agg(na_mean("x").alias("m"), na_sum("x").alias("s"),
                                                na_max("x").alias("mx"), na_min("x").alias("mn")).collect()}
    assert out["a"].m is None and out["a"].s is None and out["a"].mx is None and out["a"].mn is None
    assert out["b"].m == 3.0 and out["b"].s == 6.0 and out["b"].mx == 4.0 and out["b"].mn == 2.0


def test_null_safe_join_matches_null(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    rows = a.join(b, null_safe_on(a, b, [("k", "k")]), "full").collect()
    assert len(rows) == 2


def test_not_na_text_drops_null_and_literal(spark):
    df = spark.createDataFrame([("NA",), (None,), ("west",)], "r string")
    assert [r.r for r in df.where(not_na_text("r")).collect()] == ["west"]


def test_drop_any_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "x int, y string")
    assert drop_any_null(df).count() == 1


def test_str_c_null_and_paste_na(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    r = df.select(str_c(F.col("x"), "-", F.col("y")).alias("c"),
                  paste(F.col("x"), F.col("y"), sep="-").alias("p")).first()
    assert r.c is None
    assert r.p == "a-NA"


def test_unpivot_keeps_nulls(spark):
    df = spark.createDataFrame([("t", 1, None)], "d string, a long, b long")
    rows = df.unpivot(["d"], ["a", "b"], "region", "n").collect()
    assert len(rows) == 2 and any(r.n is None for r in rows)


def test_desc_nulls_last(spark):
    df = spark.createDataFrame([(None,), (3,), (5,)], "n int")
    assert [r.n for r in df.orderBy(F.desc_nulls_last("n")).collect()] == [5, 3, None]


def test_half_even_rounding_and_number_text(spark):
    df = spark.createDataFrame([(0.25, 53.0, 45.23)], "a double, b double, c double")
    r = df.select(r_round("a", 1).alias("a"), num_text("b").alias("b"),
                  num_label("b").alias("bl"), num_label("c").alias("cl"),
                  num_label(F.lit(0.1) + F.lit(0.2)).alias("dl")).first()
    assert r.a == 0.2
    assert r.b == "53" and r.bl == "53"
    assert r.cl == "45.23"
    assert r.dl == "0.3"   # 15 significant digits, like the reference's text


def test_clean_names():
    assert snake_name("FY Declared") == "fy_declared"
    assert snake_name("incidentType") == "incident_type"
    assert snake_name("<b>VALUE</b>") == "b_value_b"
    assert snake_name("% change") == "percent_change"
    assert snake_name("2019 count") == "x2019_count"
    assert clean_names(["Value", "value", "VALUE"]) == ["value", "value_2", "value_3"]


def test_num_label_keeps_exponents(spark):
    values = [1.23e20, 1.5e-10, 1e22, 100.0, 0.5, -2.50, 1e15]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(num_label("v").alias("t")).collect()]
    assert got == ["1.23e+20", "1.5e-10", "1e+22", "100", "0.5", "-2.5", "1e+15"]
