"""Small dimensions: places (name, code, region) and the year range.

A *places* dimension has the columns ``location, state_code, region``.  It
serves two lookups of the reference: name → code on the climate series and
name → region label on the fact table.  Both are joins against a table whose
size is fixed by the list below (50 rows) or by the ``nation`` dimension, so
it is broadcast; the fact side is never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference's data for right results.
# US state names and two-letter codes (R's built-in state.name / state.abb).
# ---------------------------------------------------------------------------
US_STATES = [
    ("Alabama", "AL"), ("Alaska", "AK"), ("Arizona", "AZ"), ("Arkansas", "AR"),
    ("California", "CA"), ("Colorado", "CO"), ("Connecticut", "CT"), ("Delaware", "DE"),
    ("Florida", "FL"), ("Georgia", "GA"), ("Hawaii", "HI"), ("Idaho", "ID"),
    ("Illinois", "IL"), ("Indiana", "IN"), ("Iowa", "IA"), ("Kansas", "KS"),
    ("Kentucky", "KY"), ("Louisiana", "LA"), ("Maine", "ME"), ("Maryland", "MD"),
    ("Massachusetts", "MA"), ("Michigan", "MI"), ("Minnesota", "MN"), ("Mississippi", "MS"),
    ("Missouri", "MO"), ("Montana", "MT"), ("Nebraska", "NE"), ("Nevada", "NV"),
    ("New Hampshire", "NH"), ("New Jersey", "NJ"), ("New Mexico", "NM"), ("New York", "NY"),
    ("North Carolina", "NC"), ("North Dakota", "ND"), ("Ohio", "OH"), ("Oklahoma", "OK"),
    ("Oregon", "OR"), ("Pennsylvania", "PA"), ("Rhode Island", "RI"), ("South Carolina", "SC"),
    ("South Dakota", "SD"), ("Tennessee", "TN"), ("Texas", "TX"), ("Utah", "UT"),
    ("Vermont", "VT"), ("Virginia", "VA"), ("Washington", "WA"), ("West Virginia", "WV"),
    ("Wisconsin", "WI"), ("Wyoming", "WY"),
]

# The reference's region membership lists, in its order.
# A name on no list gets no region (there is no default branch).
US_REGIONS = {
    "southeast": ["Alabama", "Arkansas", "Delaware", "Florida", "Georgia",
                  "Kentucky", "Louisiana", "Maryland", "Mississippi",
                  "Oklahoma", "North Carolina", "South Carolina",
                  "Tennessee", "Texas", "Virginia", "West Virginia"],
    "northeast": ["Connecticut", "Maine", "New Hampshire", "Massachusetts",
                  "New Jersey", "New York", "Pennsylvania", "Rhode Island", "Vermont"],
    "west": ["Alaska", "Arizona", "California", "Colorado", "Hawaii", "Idaho",
             "Montana", "Nevada", "New Mexico", "Oregon", "Utah", "Washington", "Wyoming"],
    "midwest": ["Illinois", "Indiana", "Iowa", "Kansas", "Michigan", "Missouri",
                "Minnesota", "Nebraska", "North Dakota", "Ohio", "South Dakota", "Wisconsin"],
}

# The years the reference keeps.
US_YEARS = (1953, 2018)

# Region labels in the order the reference lays out its wide table.
REGION_ORDER = ["northeast", "southeast", "midwest", "west"]

PLACES_SCHEMA = T.StructType([
    T.StructField("location", T.StringType(), False),
    T.StructField("state_code", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
])


def region_of(location: str, regions: dict[str, list[str]] = US_REGIONS) -> str | None:
    """First list that holds the name wins (the lists are disjoint)."""
    for label, names in regions.items():
        if location in names:
            return label
    return None


def us_places(spark: SparkSession) -> DataFrame:
    """The 50-state places dimension (fixed size, safe to broadcast)."""
    rows = [(name, code, region_of(name)) for name, code in US_STATES]
    return spark.createDataFrame(rows, PLACES_SCHEMA)


def years_dim(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """Generated dimension of years ``lo..hi`` (inclusive)."""
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("year"))
