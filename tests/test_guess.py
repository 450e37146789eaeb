"""Guessed kinds and problem cells."""

import datetime as dt

import pytest

from galecast.sources import guess


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lattice(spark):
    cells = {"a": ["T", "FALSE", None], "b": ["1", "-2", "NA"], "c": ["1", "2.5", "1e3"], "d": ["2020-01-31", "2020-02-29", ""],
             "e": ["2020-02-30", "2020-01-01", "x"], "f": [None, "", "NA"], "g": ["1", "T", "2020-01-01"], "h": ["1", "99999999999999999999", "3"],
             "i": [" 7", "8 ", "9"]}
    df = spark.createDataFrame(list(zip(*cells.values())), ", ".join(f"{c} string" for c in cells))
    got = {r["column"]: (r["kind"], r["cells"], r["missing"]) for r in guess.guess_kinds(df).collect()}
    assert got == {"a": ("logical", 2, 1), "b": ("integer", 2, 1), "c": ("double", 3, 0), "d": ("date", 2, 1), "e": ("text", 3, 0),
                   "f": ("logical", 0, 3), "g": ("text", 3, 0), "h": ("double", 3, 0), "i": ("integer", 3, 0)}


def test_no_rows_guess_logical(spark):
    assert [tuple(r) for r in guess.guess_kinds(spark.createDataFrame([], "x string")).collect()] == [("x", "logical", 0, 0)]


def test_mixed_files(spark, tmp_path):
    one = write(tmp_path / "one.csv", 'State Code,Fy Declared,Cost (USD),Day,Open\n"a,b",1999,1.5,2001-02-03,T\nCO,2000,NA,2001-02-04,F\n')
    two = write(tmp_path / "two.csv", "State Code,Fy Declared,Cost (USD),Day,Open\nNY,2001,7,2001-02-05,TRUE\n")
    rows, problems = guess.read_csv(spark, [one, two])
    assert {f.name: f.dataType.simpleString() for f in rows.schema.fields} == {
        "state_code": "string", "fy_declared": "bigint", "cost_usd": "double", "day": "date", "open": "boolean"}
    assert sorted(map(tuple, rows.collect())) == [
        ("CO", 2000, None, dt.date(2001, 2, 4), False), ("NY", 2001, 7.0, dt.date(2001, 2, 5), True), ("a,b", 1999, 1.5, dt.date(2001, 2, 3), True)]
    assert problems.collect() == []


def test_problems_name_file_and_row(spark, tmp_path):
    n = 3000
    lines = [f"{i},{i / 2}" for i in range(1, n + 1)]
    lines[1233] = "x,3"
    lines[2999] = "5,oops"
    lines[99] = "7"
    one = write(tmp_path / "one.csv", "id,value\n" + "\n".join(lines) + "\n")
    two = write(tmp_path / "two.csv", "id,value\n1,2\nq,r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several blocks a file
        rows, problems = guess.read_csv(spark, [one, two], {"id": "integer", "value": "double"})
        got = sorted((r["file"].rsplit("/", 1)[1], r["row"], r["column"] or "", r["expected"], r["actual"]) for r in problems.collect())
        assert rows.count() == n + 2 and rows.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("one.csv", 100, "", "2 columns", "7"), ("one.csv", 1234, "id", "integer", "x"), ("one.csv", 3000, "value", "double", "oops"),
                   ("two.csv", 2, "id", "integer", "q"), ("two.csv", 2, "value", "double", "r")]


def test_unknown_kind_or_column(spark, tmp_path):
    path = write(tmp_path / "x.csv", "a\n1\n")
    with pytest.raises(ValueError, match="no such column or kind"):
        guess.read_csv(spark, path, {"b": "integer"})
    with pytest.raises(ValueError, match="no such column or kind"):
        guess.read_csv(spark, path, {"a": "number"})
