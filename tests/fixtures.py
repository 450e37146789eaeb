"""Hand-made inputs for the behaviours listed in FIXTURES.md §3."""

from pyspark.sql import types as T

from galecast.sources.dims import us_places

CLIMATE = T.StructType([T.StructField("location", T.StringType()),
                        T.StructField("date", T.StringType()),
                        T.StructField("value", T.DoubleType())])
DECL = T.StructType([T.StructField("state", T.StringType()),
                     T.StructField("incident_type", T.StringType()),
                     T.StructField("fy_declared", T.IntegerType())])

YEARS = (1953, 2018)


def climate_rows():
    rows = []
    rows += [("Alabama", "199001", 50.0), ("Alabama", "199002", 54.0)]
    rows += [("Georgia", "199001", 60.0), ("Georgia", "199002", 62.0)]
    # Texas has one missing month: its 1990 measures are missing.
    rows += [("Texas", "199001", 70.0), ("Texas", "199002", None)]
    # Maine is quiet: climate but no declaration.
    rows += [("Maine", "199001", 30.0), ("Maine", "199002", 32.0)]
    rows += [("Vermont", "199001", 20.0), ("Vermont", "199002", 22.0)]
    rows += [("Ohio", "199001", 40.0), ("Ohio", "199002", 42.0)]
    # Unknown place name: null code, but still joined.
    rows += [("Atlantis", "199001", 10.0)]
    # Years outside the range and bad date text are dropped.
    rows += [("Alabama", "195201", 1.0), ("Alabama", "201901", 1.0), ("Alabama", "19x001", 1.0)]
    return rows


def declaration_rows():
    rows = []
    # Alabama: two types in one state-year (fan-out).
    rows += [("AL", "Flood", 1990)] * 3 + [("AL", "Fire", 1990)]
    # Georgia: same type and count as Alabama, same region.
    rows += [("GA", "Flood", 1990)] * 3
    rows += [("TX", "Severe Storm(s)", 1990)]
    # Ohio: a drought, a type never seen in the northeast.
    rows += [("OH", "Flood", 1990)] * 2 + [("OH", "Drought", 1990)]
    rows += [("VT", "Flood", 1990)] * 2
    # Territory: no climate row.
    rows += [("PR", "Hurricane", 1990)] * 2
    # Alaska: on a region list but without climate data.
    rows += [("AK", "Flood", 1990)]
    # Out of range.
    rows += [("AL", "Flood", 2019), ("AL", "Flood", 1952)]
    return rows


def fixture_frames(spark):
    climate = spark.createDataFrame(climate_rows(), CLIMATE)
    decl = spark.createDataFrame(declaration_rows(), DECL)
    return climate, decl, us_places(spark)
