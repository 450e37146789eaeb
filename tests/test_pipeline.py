"""The relational pipeline on the hand-made fixture (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from galecast.operators import climate as C
from galecast.operators import facts, hazards, rollups
from galecast.plans import products
from tests.fixtures import YEARS, fixture_frames


@pytest.fixture(scope="module")
def built(spark):
    climate_raw, decl, places = fixture_frames(spark)
    clim = C.climate_state_year(climate_raw, places, YEARS)
    counts = hazards.declaration_counts(decl, YEARS)
    fact_a = facts.fact_joined_then_counted(clim, counts, places).cache()
    fact_b = facts.fact_counted_then_joined(clim, hazards.declaration_totals(counts)).cache()
    return dict(clim=clim, counts=counts, fact_a=fact_a, fact_b=fact_b, places=places, raw=climate_raw)


def _by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_annual_measures_and_nulls(built):
    c = _by(built["clim"], "location", "year")
    assert len(c) == 7                              # out-of-range and bad dates dropped
    al = c[("Alabama", 1990)]
    assert (al.state_code, al.mean_temp, al.total_precip, al.max_temp, al.min_temp) == ("AL", 52.0, 104.0, 54.0, 50.0)
    tx = c[("Texas", 1990)]
    assert tx.mean_temp is None and tx.total_precip is None and tx.max_temp is None
    at = c[("Atlantis", 1990)]
    assert at.state_code is None and at.mean_temp == 10.0


def test_single_series_equals_window_distinct(spark, built):
    """The reference's grouped mutate + distinct equals the group-by."""
    from pyspark.sql import Window
    raw = C.with_year(built["raw"], YEARS)
    w = Window.partitionBy("location", "year")
    ref = raw.withColumn("m", F.when(F.count(F.lit(1)).over(w) == F.count("value").over(w),
                                     F.avg("value").over(w))).select("location", "year", "m").distinct()
    ours = C.annual_series(built["raw"], built["places"], "m", "mean", YEARS).drop("state_code")
    assert sorted(map(tuple, ref.collect()), key=str) == sorted(map(tuple, ours.collect()), key=str)


def test_tagged_series_inner_join_semantics(spark, built):
    raw = built["raw"]
    series = {"tavg": raw, "pcp": raw, "tmax": raw,
              "tmin": raw.where(F.col("location") != "Ohio")}   # Ohio missing from one series
    out = _by(C.climate_state_year(series, built["places"], YEARS), "location")
    assert ("Ohio",) not in out and out[("Alabama",)].total_precip == 104.0


def test_counts(built):
    n = _by(built["counts"], "state", "disaster")
    assert n[("AL", "Flood")].n == 3 and n[("PR", "Hurricane")].n == 2
    assert built["counts"].count() == 9


def test_fact_a(built):
    fa = built["fact_a"]
    assert fa.count() == 11
    rows = fa.collect()
    assert all(r.n_total == 16 for r in rows)
    pooled = [r for r in rows if r.location is None]
    assert {r.state_code for r in pooled} == {"PR", "AK"}
    assert all(r.n_state == 3 and r.region is None for r in pooled)   # territory + Alaska pooled
    me = [r for r in rows if r.location == "Maine"][0]
    assert me.n_disaster_state == 0 and me.disaster is None and me.region == "northeast"
    flood = {r.n_type for r in rows if r.disaster == "Flood"}
    assert flood == {11}
    at = [r for r in rows if r.location == "Atlantis"][0]
    assert at.state_code is None and at.region is None and at.n_state == 0


def test_type_totals_sum_to_year_total(built):
    fa = built["fact_a"]
    per_type = fa.select("disaster", "n_type").distinct().agg(F.sum("n_type")).first()[0]
    assert per_type == 16


def test_fact_b(built):
    rows = built["fact_b"].collect()
    me = [r for r in rows if r.location == "Maine"][0]
    assert me.n_disaster_state is None and me.n_state is None
    pr = [r for r in rows if r.state_code == "PR"][0]
    assert pr.n_state == 2 and pr.location is None
    assert "region" not in built["fact_b"].columns


def test_regional_rollup_published_and_dedupe(built):
    pub = _by(rollups.regional_rollup(built["fact_a"]), "region")
    assert set(pub) == {("southeast",), ("northeast",), ("midwest",)}
    assert pub[("midwest",)].sum_precip == 164.0          # fan-out doubles (D1)
    assert pub[("midwest",)].ave_temp == 41.0 and pub[("midwest",)].count_region == 3
    assert pub[("northeast",)].ave_temp == 26.0 and pub[("northeast",)].count_region == 2
    assert pub[("southeast",)].ave_temp is None and pub[("southeast",)].count_region == 8
    ded = _by(rollups.regional_rollup(built["fact_a"], dedupe=True), "region")
    assert ded[("midwest",)].sum_precip == 82.0 and ded[("midwest",)].count_region == 3


def test_regional_type_rollup(built):
    rt = _by(rollups.regional_type_rollup(built["fact_a"]), "disaster", "region")
    assert rt[("Flood", "southeast")].count_region == 6
    assert ("Hurricane", None) not in rt


def test_type_by_region_pivot_and_left_chain(built):
    full = built["fact_a"]
    corrected = rollups.type_by_region(full).collect()
    published = rollups.type_by_region(full, published=True).collect()
    assert len(corrected) == 12 and len(published) == 4
    assert {r.disaster for r in published} == {"Flood"}       # drought lost (D7)
    assert "Drought" in {r.disaster for r in corrected}
    assert (corrected[0].disaster, corrected[0].region, corrected[0].n_disaster) == ("Flood", "southeast", 6)
    assert corrected[-1].n_disaster is None                     # nulls last


def test_bars_distinct_merges_equal_counts(built):
    bars = products.region_year_bars(built["fact_a"]).where(F.col("region") == "southeast").collect()
    assert len(bars) == 2                                       # AL and GA floods merged (D6)
    lab = [r.text_label for r in bars if r.disaster == "Fire"][0]
    assert lab == "total disasters: 1\nsoutheast"
    totals = _by(products.region_year_totals(built["fact_a"]), "region")
    assert totals[("southeast",)].n_disasters == 7


def test_precip_points_hidden_key(built):
    pub = products.precip_points(built["fact_a"]).where(F.col("region") == "southeast").collect()
    fixed = products.precip_points(built["fact_a"], published=False).where(F.col("region") == "southeast").collect()
    assert len(pub) == 3 and len(fixed) == 2                   # one point per type when published (D5)
    assert {r.text_label for r in fixed} == {"1990\nTotal Precip(in.):104", "1990\nTotal Precip(in.):122"}


def test_map_long_and_slice(spark, built):
    ml = products.map_long(built["fact_b"])
    labels = {r.variable_type for r in ml.select("variable_type").distinct().collect()}
    assert "Yearly Total of All Disasters" in labels and "Yearly Mean Temperature (degrees F)" in labels
    sl = products.map_slice(ml, built["places"], "Yearly Total of All Disasters", 1990).collect()
    texts = {r.state_code: r.text_label for r in sl}
    assert texts["PR"] == "Yearly Total of All Disasters-NA"    # unknown code prints NA
    assert texts["AL"] == "Yearly Total of All Disasters-Alabama"


def test_dashboard_slices(built):
    dash = facts.dashboard_fact(built["fact_a"])
    trend = products.place_type_trend(dash, "Alabama", "Flood", (1953, 2018)).collect()
    assert [r.n_disaster_state for r in trend] == [3]
    cvm = products.count_vs_measure(dash, "Alabama", "Flood").collect()
    assert cvm[0].text_label == "Number of Disaster Events: 4\nAverage Temperature: 52 F"
    pub = products.measure_series(dash, "Alabama", (1953, 2018)).collect()
    fixed = products.measure_series(dash, "Alabama", (1953, 2018), published=False).collect()
    assert len(pub) == 2 and len(fixed) == 1
    opts = products.option_lists(dash).collect()
    assert ("state", "Atlantis") in {(r.list_name, r.value) for r in opts}


def test_precounted_declarations_equal_record_counts(spark):
    from galecast.sources import tables
    from tests.conftest import SF_SMALL
    years = tables.DRIVER_YEARS
    plain = hazards.declaration_counts(tables.declarations_raw(spark, SF_SMALL, years), years)
    pre = hazards.declaration_counts(tables.declarations_raw(spark, SF_SMALL, years, weighted=True), years)
    a = sorted(tuple(r) for r in plain.collect())
    b = sorted(tuple(r) for r in pre.collect())
    assert a == b and len(a) > 0


def test_stage_table_round_trip(spark):
    from galecast.session import stage_table
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    staged = stage_table(df.groupBy("k").agg(F.sum("v").alias("s")), "test")
    assert staged.schema == df.groupBy("k").agg(F.sum("v").alias("s")).schema
    assert sorted(tuple(r) for r in staged.collect()) == \
        sorted(tuple(r) for r in df.groupBy("k").agg(F.sum("v").alias("s")).collect())
    # The staged plan reads files, not the aggregate it was written from.
    assert "Aggregate" not in staged._jdf.queryExecution().optimizedPlan().toString()


def test_left_chain_loses_the_last_region_without_the_third(spark):
    rows = [("x", p, 1990, 1.0, 1.0, 1.0, 1.0, d, n, n, n, n, r)
            for d, r, p, n in [("Fire", "northeast", "Maine", 3), ("Fire", "west", "Utah", 7),
                               ("Flood", "northeast", "Maine", 2), ("Flood", "midwest", "Ohio", 4), ("Flood", "west", "Utah", 5),
                               ("Snow", "west", "Utah", 9)]]
    from galecast.operators.facts import FACT_A_COLS
    from galecast.operators.rollups import type_by_region
    fact = spark.createDataFrame(rows, ", ".join(
        f"{c} {t}" for c, t in zip(FACT_A_COLS, ["string", "string", "int", *["double"] * 4, "string", *["long"] * 4, "string"])))
    wide = lambda published: {(r.disaster, r.region): r.n_disaster
                              for r in type_by_region(fact, published=published).collect()}
    assert wide(False)["Fire", "west"] == 7 and wide(False)["Snow", "west"] == 9
    assert wide(True)["Fire", "west"] is None and wide(True)["Flood", "west"] == 5 and ("Snow", "west") not in wide(True)


def test_totals_by_join_equal_windows(spark, built):
    from galecast.operators.hazards import with_totals
    rows = spark.createDataFrame([("a", 1990, "F", 1), ("a", 1990, "G", 2), (None, 1990, "F", 4), (None, None, None, 8)],
                                 "state string, year int, disaster string, n long")
    one, two = (with_totals(rows, "state", bounded=b) for b in (True, False))
    assert sorted(map(repr, one.select(*sorted(one.columns)).collect())) == sorted(map(repr, two.select(*sorted(one.columns)).collect()))


def test_staged_tables_go_when_dropped(spark):
    import os
    from galecast.session import drop_staged, stage_table
    staged = stage_table(spark.range(3), "gone")
    path = staged.inputFiles()[0].replace("file://", "")
    assert os.path.exists(path)
    drop_staged(staged)
    assert not os.path.exists(path)
    drop_staged(staged)
    drop_staged(spark.range(1))
