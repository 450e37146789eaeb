"""CSV ingest (S1-S3) and table sinks."""

import os
import tempfile

import pytest

from galecast.operators import climate as C
from galecast.sources import csv as csvsrc
from galecast.sources.dims import us_places
from galecast.sources.sinks import pull, round_doubles, scalar, write_table
from tests.fixtures import YEARS, climate_rows


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def _series_file(path, rows):
    lines = ["Statewide Average Temperature", "Units: Degrees Fahrenheit", "Base Period: 1901-2000",
             "Location,Date,Value,Anomaly"]
    for loc, date, val in rows:
        lines.append(f'{loc},{date},{"NA" if val is None else val},0.1')
    _write(path, "\n".join(lines) + "\n")


def test_climate_csv_with_preamble(spark):
    d = tempfile.mkdtemp(prefix="galecast-csv-")
    _series_file(f"{d}/tavg.csv", climate_rows())
    raw = csvsrc.read_climate_csv(spark, f"{d}/tavg.csv")
    assert raw.count() == len(climate_rows()) - 1          # the bad date text is dropped here too
    out = {r.location: r for r in C.annual_series(raw, us_places(spark), "mean_temp", "mean", YEARS).collect()}
    assert out["Alabama"].mean_temp == 52.0 and out["Texas"].mean_temp is None


def test_tagged_series_from_files(spark):
    d = tempfile.mkdtemp(prefix="galecast-csv-")
    paths = {}
    for name in ("tavg", "pcp", "tmax", "tmin"):
        paths[name] = f"{d}/110-{name}.csv"
        _series_file(paths[name], climate_rows())
    raw = csvsrc.read_climate_csv(spark, paths)
    assert {r.series for r in raw.select("series").distinct().collect()} == set(paths)
    series = {name: raw.where(raw.series == name).drop("series") for name in paths}
    clim = {r.location: r for r in C.climate_state_year(series, us_places(spark), YEARS).collect()}
    assert clim["Alabama"].total_precip == 104.0 and clim["Alabama"].min_temp == 50.0


def test_declarations_csv_clean_names(spark):
    d = tempfile.mkdtemp(prefix="galecast-csv-")
    _write(f"{d}/decl.csv",
           'femaDeclarationString,State,Incident Type,FY Declared,"Title, long"\n'
           'DR-1,AL,Flood,1990,"A, b"\n'
           'DR-2,AL,Flood,19x0,"c"\n'
           'DR-3,PR,Hurricane,1990,"d ""quoted"""\n')
    df = csvsrc.read_declarations_csv(spark, f"{d}/decl.csv")
    rows = sorted(df.collect(), key=lambda r: (r.state, r.fy_declared or 0))
    assert [tuple(r) for r in rows] == [("AL", "Flood", None), ("AL", "Flood", 1990), ("PR", "Hurricane", 1990)]


def test_quoted_numbers_and_html_names(spark):
    d = tempfile.mkdtemp(prefix="galecast-csv-")
    _write(f"{d}/cows.csv", '"Year","<b>VALUE</b>","CV (%)"\n"1977","36,300,000",""\n"1978","35,100,000","1.2"\n')
    raw = spark.read.option("header", "true").option("nullValue", "").csv(f"{d}/cows.csv")
    df = csvsrc.with_clean_names(raw)
    assert df.columns == ["year", "b_value_b", "cv_percent"]
    vals = df.selectExpr("try_cast(replace(b_value_b, ',', '') AS BIGINT) AS v").collect()
    assert [r.v for r in vals] == [36300000, 35100000]


def test_sinks(spark):
    df = spark.createDataFrame([("a", 1.23456, 1), ("b", 2.5, 2)], "k string, x double, n int")
    r = round_doubles(df, 3).orderBy("k").collect()
    assert r[0].x == 1.235 and r[1].n == 2
    out = tempfile.mkdtemp(prefix="galecast-out-")
    write_table(df, os.path.join(out, "t"), partition_by=["k"])
    back = spark.read.parquet(os.path.join(out, "t"))
    assert back.where("k = 'a'").count() == 1
    assert sorted(r.k for r in pull(df, "k").collect()) == ["a", "b"]
    assert scalar(df.where("k = 'b'"), "n") == 2


def test_publish_and_pruned_slice(spark, capsys):
    from galecast.plans.driver import DriverPipeline
    from galecast.plans.products import map_slice
    from galecast.plans.publish import publish_tables, read_published
    from tests.conftest import SF_SMALL
    p = DriverPipeline(spark, SF_SMALL)
    paths = publish_tables(p, tempfile.mkdtemp(prefix="galecast-pub-"))
    mt = read_published(spark, paths, "map")
    sl = map_slice(mt, p.places, "Yearly Total of All Disasters", 1998)
    capsys.readouterr()
    sl.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(variable_type" in plan
    direct = map_slice(p.map_table, p.places, "Yearly Total of All Disasters", 1998)
    assert sorted(map(tuple, sl.collect())) == sorted(map(tuple, direct.collect()))


def test_rounding_of_large_and_odd_values(spark):
    rows = [(1e13,), (5e14 + 0.25,), (float("inf"),), (float("-inf"),), (float("nan"),), (-1.23456,), (2.5e300,), (None,), (0.0,)]
    got = [r.x for r in round_doubles(spark.createDataFrame(rows, "x double"), 3).collect()]
    assert got[:4] == [1e13, 5e14 + 0.25, float("inf"), float("-inf")] and got[4] != got[4]
    assert got[5:] == [-1.235, 2.5e300, None, 0.0]
    assert [r.x for r in round_doubles(spark.createDataFrame(rows[5:6], "x double"), 3, {"x": 1}).collect()] == [-1.2]


def test_climate_columns_by_header_name(spark):
    d = tempfile.mkdtemp(prefix="galecast-csv-")
    rows = [("Alabama", "199001", 50.0), ("Alabama", "199002", 54.0)]
    lines = ["Title", "Units", "Period", "Date,Anomaly,Location,Value"] + [f"{t},0.5,{p},{v}" for p, t, v in rows]
    _write(f"{d}/swapped.csv", "\n".join(lines) + "\n")
    assert sorted(map(tuple, csvsrc.read_climate_csv(spark, f"{d}/swapped.csv").collect())) == rows
    _write(f"{d}/nameless.csv", "Alabama,199001,50.0\nAlabama,199002,54.0\n")
    with pytest.raises(ValueError, match="no header"):  # read by position only if told so
        csvsrc.read_climate_csv(spark, [f"{d}/nameless.csv", f"{d}/swapped.csv"])
    assert sorted(map(tuple, csvsrc.read_climate_csv(spark, f"{d}/nameless.csv", csvsrc.CLIMATE_COLUMNS).collect())) == sorted(rows)
    _write(f"{d}/long.csv", "\n".join(["a note, of the date", *["line"] * 3000, *lines[3:]]) + "\n")
    assert sorted(map(tuple, csvsrc.read_climate_csv(spark, [f"{d}/long.csv", f"{d}/swapped.csv"]).collect())) == sorted(rows * 2)
    _write(f"{d}/other.csv", "Place,Date,Value\nAlabama,199001,1\n")
    try:
        csvsrc.read_climate_csv(spark, f"{d}/other.csv")
    except ValueError as e:
        assert "location" in str(e)
    else:
        raise AssertionError("a file without a location column was read")


def test_series_tags_with_equal_file_names_folders_and_globs(spark):
    d = tempfile.mkdtemp(prefix="galecast-csv-")
    for name, value in (("tavg", 1.0), ("tmax", 2.0)):
        os.makedirs(f"{d}/{name}")
        _series_file(f"{d}/{name}/data.csv", [("Ohio", "199001", value)])
    os.makedirs(f"{d}/pcp")
    for k in range(3):
        _series_file(f"{d}/pcp/part-{k}.csv", [("Ohio", f"19900{k + 1}", 3.0)])
    raw = csvsrc.read_climate_csv(spark, {"tavg": f"{d}/tavg/data.csv", "tmax": f"{d}/tmax/data.csv", "pcp": f"{d}/pcp",
                                          "tmin": f"{d}/pcp/part-[01].csv"})
    got = sorted((r.series, r.value) for r in raw.collect())
    assert got == [("pcp", 3.0)] * 3 + [("tavg", 1.0), ("tmax", 2.0)] + [("tmin", 3.0)] * 2
