"""Independent SQL statements of the registered queries, for DuckDB.

These restate each query from the driver tables up, in plain SQL, so the
driver can run them beside the Spark plans and compare results.  They share
no code with the Spark side; the only shared facts are the fixed values of
the mapping (year range, region by region key, labels).
Rules used throughout: ``IS NOT DISTINCT FROM`` for null-matching joins,
``CASE WHEN count(*) = count(x)`` for null-propagating aggregates,
``UNPIVOT INCLUDE NULLS`` for the wide → long steps, and doubles rounded
half-up at 6 decimals as ``floor(x * 1e6 + 0.5) / 1e6`` on both sides.
"""

from __future__ import annotations

from ..sources.tables import DRIVER_YEARS, PANEL_TYPES

LO, HI = DRIVER_YEARS


def r4(expr: str) -> str:
    """Half-up rounding of published doubles (6 decimals, see catalog)."""
    return f"floor(({expr}) * 1000000.0 + 0.5) / 1000000.0"


def r3(expr: str) -> str:
    """The same at 3 decimals, for sums."""
    return f"floor(({expr}) * 1000.0 + 0.5) / 1000.0"


def rounded(c: str) -> str:
    return f"{r3(c) if c == 'total_precip' else r4(c)} AS {c}"


def num_label(expr: str) -> str:
    return f"printf('%.15g', CAST({expr} AS DOUBLE))"


BASE = f"""
places AS (
  SELECT n_name AS location,
         'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_code,
         CASE n_regionkey WHEN 0 THEN 'southeast' WHEN 1 THEN 'northeast'
                          WHEN 2 THEN 'west' WHEN 3 THEN 'midwest' END AS region
  FROM nation),
climate_raw AS (
  SELECT n.n_name AS location, strftime(o.o_orderdate, '%Y%m') AS date, o.o_totalprice AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                JOIN nation n ON c.c_nationkey = n.n_nationkey),
climate_years AS (
  SELECT location, TRY_CAST(substr(date, 1, 4) AS INTEGER) AS year, value FROM climate_raw),
annual AS (
  SELECT location, year,
         CASE WHEN count(*) = count(value) THEN avg(value) END AS mean_temp,
         CASE WHEN count(*) = count(value) THEN sum(value) END AS total_precip,
         CASE WHEN count(*) = count(value) THEN max(value) END AS max_temp,
         CASE WHEN count(*) = count(value) THEN min(value) END AS min_temp
  FROM climate_years WHERE year BETWEEN {LO} AND {HI}
  GROUP BY location, year),
climate AS (
  SELECT p.state_code, a.location, a.year, a.mean_temp, a.total_precip, a.max_temp, a.min_temp
  FROM annual a LEFT JOIN places p ON a.location = p.location),
decl_raw AS (
  SELECT 'N' || lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') AS state,
         l.l_returnflag || l.l_linestatus AS incident_type,
         CAST(year(l.l_shipdate) AS INTEGER) AS fy_declared
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
counts AS (
  SELECT state, fy_declared AS year, incident_type AS disaster, CAST(count(*) AS BIGINT) AS n
  FROM decl_raw WHERE fy_declared BETWEEN {LO} AND {HI}
  GROUP BY state, fy_declared, incident_type),
totals AS (
  SELECT state, year, disaster, n AS n_disaster_state,
         CAST(sum(n) OVER (PARTITION BY year, state) AS BIGINT) AS n_state,
         CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS n_total,
         CAST(sum(n) OVER (PARTITION BY year, disaster) AS BIGINT) AS n_type
  FROM counts),
joined_a AS (
  SELECT coalesce(c.state_code, d.state) AS state_code, c.location,
         coalesce(c.year, d.year) AS year,
         c.mean_temp, c.total_precip, c.max_temp, c.min_temp, d.disaster,
         coalesce(d.n, 0) AS n
  FROM climate c FULL OUTER JOIN counts d
    ON c.year IS NOT DISTINCT FROM d.year AND c.state_code IS NOT DISTINCT FROM d.state),
fact_a AS (
  SELECT j.state_code, j.location, j.year, j.mean_temp, j.total_precip, j.max_temp, j.min_temp,
         j.disaster, j.n AS n_disaster_state,
         CAST(sum(j.n) OVER (PARTITION BY j.year, j.location) AS BIGINT) AS n_state,
         CAST(sum(j.n) OVER (PARTITION BY j.year) AS BIGINT) AS n_total,
         CAST(sum(j.n) OVER (PARTITION BY j.year, j.disaster) AS BIGINT) AS n_type,
         p.region
  FROM joined_a j LEFT JOIN places p ON j.location = p.location),
fact_b AS (
  SELECT coalesce(c.state_code, d.state) AS state_code, c.location,
         coalesce(c.year, d.year) AS year,
         c.mean_temp, c.total_precip, c.max_temp, c.min_temp, d.disaster,
         d.n_disaster_state, d.n_state, d.n_total, d.n_type
  FROM climate c FULL OUTER JOIN totals d
    ON c.year IS NOT DISTINCT FROM d.year AND c.state_code IS NOT DISTINCT FROM d.state),
dash AS (
  SELECT state_code, location AS state, year, mean_temp, total_precip, max_temp, min_temp,
         disaster, n_disaster_state, n_state, n_total, n_type, region FROM fact_a),
complete_a AS (
  SELECT * FROM fact_a
  WHERE state_code IS NOT NULL AND location IS NOT NULL AND year IS NOT NULL
    AND mean_temp IS NOT NULL AND total_precip IS NOT NULL AND max_temp IS NOT NULL
    AND min_temp IS NOT NULL AND disaster IS NOT NULL AND n_disaster_state IS NOT NULL
    AND n_state IS NOT NULL AND n_total IS NOT NULL AND n_type IS NOT NULL
    AND region IS NOT NULL),
regional AS (
  SELECT region, year,
         CASE WHEN count(*) = count(mean_temp) THEN avg(mean_temp) END AS ave_temp,
         CASE WHEN count(*) = count(total_precip) THEN sum(total_precip) END AS sum_precip,
         CAST(CASE WHEN count(*) = count(n_disaster_state) THEN sum(n_disaster_state) END AS BIGINT) AS count_region
  FROM fact_a WHERE region IS NOT NULL AND region <> 'NA'
  GROUP BY region, year),
regional_type AS (
  SELECT disaster, region, year,
         CASE WHEN count(*) = count(mean_temp) THEN avg(mean_temp) END AS ave_temp,
         CASE WHEN count(*) = count(total_precip) THEN sum(total_precip) END AS sum_precip,
         CAST(CASE WHEN count(*) = count(n_disaster_state) THEN sum(n_disaster_state) END AS BIGINT) AS count_region
  FROM fact_a
  WHERE region IS NOT NULL AND region <> 'NA' AND disaster IS NOT NULL AND disaster <> 'NA'
  GROUP BY disaster, region, year),
type_wide AS (
  SELECT disaster,
         CAST(sum(CASE WHEN region = 'northeast' THEN n_disaster_state END) AS BIGINT) AS northeast,
         CAST(sum(CASE WHEN region = 'southeast' THEN n_disaster_state END) AS BIGINT) AS southeast,
         CAST(sum(CASE WHEN region = 'midwest' THEN n_disaster_state END) AS BIGINT) AS midwest,
         CAST(sum(CASE WHEN region = 'west' THEN n_disaster_state END) AS BIGINT) AS west
  FROM complete_a WHERE region IN ('northeast', 'southeast', 'midwest', 'west')
  GROUP BY disaster),
map_wide AS (
  SELECT state_code, year, CAST(mean_temp AS DOUBLE) AS mean_temp, CAST(max_temp AS DOUBLE) AS max_temp,
         CAST(min_temp AS DOUBLE) AS min_temp, CAST(total_precip AS DOUBLE) AS mtotal_precip,
         CAST(n_state AS DOUBLE) AS mn_state
  FROM fact_b),
map_long AS (
  SELECT state_code, year,
         CASE variable_type
           WHEN 'mean_temp' THEN 'Yearly Mean Temperature (degrees F)'
           WHEN 'max_temp' THEN 'Yearly Maximum Temperature (degrees F)'
           WHEN 'min_temp' THEN 'Yearly Minimum Temperature (degrees F)'
           WHEN 'mtotal_precip' THEN 'Yearly Total Precipitation (inches)'
           WHEN 'mn_state' THEN 'Yearly Total of All Disasters'
           ELSE variable_type END AS variable_type,
         statistic
  FROM (UNPIVOT map_wide ON mean_temp, max_temp, min_temp, mtotal_precip, mn_state
        INTO NAME variable_type VALUE statistic)
  WHERE state_code IS NOT NULL AND year IS NOT NULL AND statistic IS NOT NULL),
order_rows AS (
  SELECT l.y, CAST(year(o.o_orderdate) AS INTEGER) AS year, p.region, o.o_totalprice AS totalprice
  FROM (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS y FROM lineitem GROUP BY l_orderkey) l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN places p ON p.state_code = 'N' || lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0'))
"""


# Customers as places: four separate series, and declarations by ship year.
CUSTOMER_BASE = f"""
places AS (
  SELECT c.c_name AS location, 'C' || CAST(c.c_custkey AS VARCHAR) AS state_code,
         CASE n.n_regionkey WHEN 0 THEN 'southeast' WHEN 1 THEN 'northeast'
                            WHEN 2 THEN 'west' WHEN 3 THEN 'midwest' END AS region
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
lines AS (
  SELECT c.c_name AS location, 'C' || CAST(c.c_custkey AS VARCHAR) AS state, CAST(year(l.l_shipdate) AS INTEGER) AS year,
         l.l_extendedprice, l.l_quantity, l.l_discount, l.l_returnflag || l.l_linestatus AS disaster
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE year(l.l_shipdate) BETWEEN {LO} AND {HI}),
tavg AS (
  SELECT c.c_name AS location, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CASE WHEN count(*) = count(o.o_totalprice) THEN avg(o.o_totalprice) END AS mean_temp
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE year(o.o_orderdate) BETWEEN {LO} AND {HI} GROUP BY ALL),
pcp AS (SELECT location, year, CASE WHEN count(*) = count(l_extendedprice) THEN sum(l_extendedprice) END AS total_precip
        FROM lines GROUP BY location, year),
tmax AS (SELECT location, year, CASE WHEN count(*) = count(l_quantity) THEN max(l_quantity) END AS max_temp
         FROM lines GROUP BY location, year),
tmin AS (SELECT location, year, CASE WHEN count(*) = count(l_discount) THEN min(l_discount) END AS min_temp
         FROM lines GROUP BY location, year),
climate AS (
  SELECT p.state_code, tavg.location, tavg.year, mean_temp, total_precip, max_temp, min_temp
  FROM tavg JOIN pcp USING (location, year) JOIN tmax USING (location, year) JOIN tmin USING (location, year)
  LEFT JOIN places p ON tavg.location = p.location),
counts AS (SELECT state, year, disaster, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY state, year, disaster),
"""
CUSTOMER_BASE += BASE[BASE.index("totals AS ("):BASE.index("dash AS (")].rstrip().rstrip(",")


def with_base(select: str) -> str:
    return f"WITH {BASE.strip()}\n{select.strip()}"


MEAS = ("mean_temp", "total_precip", "max_temp", "min_temp")
FACT_COLS = ("state_code, location, year, {m}, disaster, n_disaster_state, n_state, n_total, n_type")


def _fact_select(table: str, region: bool) -> str:
    m = ", ".join(map(rounded, MEAS))
    cols = FACT_COLS.format(m=m) + (", region" if region else "")
    return f"SELECT {cols} FROM {table}"


def _annual(measure: str, how: str) -> str:
    agg = {"mean": "avg", "sum": "sum", "max": "max", "min": "min"}[how]
    return with_base(f"""
SELECT p.state_code, a.location, a.year, {r3('a.v') if how == 'sum' else r4('a.v')} AS {measure}
FROM (SELECT location, year, CASE WHEN count(*) = count(value) THEN {agg}(value) END AS v
      FROM climate_years WHERE year BETWEEN {LO} AND {HI} GROUP BY location, year) a
LEFT JOIN places p ON a.location = p.location""")


TEMP_LABEL = ("'Average Temperature: ' || {m} || ' F' || chr(10) || 'Minimum Temperature: ' || {mi}"
              " || ' F' || chr(10) || 'Maximum Temperature: ' || {ma} || ' F'")


def _temp_label() -> str:
    return TEMP_LABEL.format(m=num_label("round_even(mean_temp, 1)"),
                             mi=num_label("round_even(min_temp, 1)"),
                             ma=num_label("round_even(max_temp, 1)"))


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["annual_mean"] = _annual("mean_temp", "mean")
    q["annual_sum"] = _annual("total_precip", "sum")
    q["annual_max"] = _annual("max_temp", "max")
    q["annual_min"] = _annual("min_temp", "min")
    q["climate_state_year"] = with_base(
        "SELECT state_code, location, year, " + ", ".join(map(rounded, MEAS)) + " FROM climate")
    q["declaration_counts"] = with_base("SELECT state, year, disaster, n FROM counts")
    q["declaration_totals"] = with_base(
        "SELECT state, year, disaster, n_disaster_state, n_state, n_total, n_type FROM totals")
    q["fact_joined_then_counted"] = with_base(_fact_select("fact_a", True))
    q["fact_counted_then_joined"] = with_base(_fact_select("fact_b", False))
    q["regional_rollup"] = with_base(
        f"SELECT region, year, {r4('ave_temp')} AS ave_temp, {r3('sum_precip')} AS sum_precip, count_region FROM regional")
    q["regional_rollup_dedup"] = with_base(f"""
SELECT region, year, {r4('ave_temp')} AS ave_temp, {r3('sum_precip')} AS sum_precip, count_region FROM (
  SELECT region, year,
         CASE WHEN count(*) = count(mean_temp) THEN avg(mean_temp) END AS ave_temp,
         CASE WHEN count(*) = count(total_precip) THEN sum(total_precip) END AS sum_precip,
         CAST(CASE WHEN count(*) = count(n) THEN sum(n) END AS BIGINT) AS count_region
  FROM (SELECT region, year, location,
               CASE WHEN count(*) = count(mean_temp) THEN max(mean_temp) END AS mean_temp,
               CASE WHEN count(*) = count(total_precip) THEN max(total_precip) END AS total_precip,
               CASE WHEN count(*) = count(n_disaster_state) THEN sum(n_disaster_state) END AS n
        FROM fact_a WHERE region IS NOT NULL AND region <> 'NA'
        GROUP BY region, year, location) s
  GROUP BY region, year) t""")
    q["regional_type_rollup"] = with_base(
        f"SELECT disaster, region, year, {r4('ave_temp')} AS ave_temp, {r3('sum_precip')} AS sum_precip, "
        "count_region FROM regional_type")
    q["type_by_region"] = with_base("""
SELECT disaster, region, n_disaster
FROM type_wide UNPIVOT INCLUDE NULLS (n_disaster FOR region IN (northeast, southeast, midwest, west))""")
    # The published form: left joins anchored on the northeast totals.
    q["type_by_region_left_chain"] = with_base("""
, per_region AS (
  SELECT disaster, region, CAST(sum(n_disaster_state) AS BIGINT) AS total
  FROM complete_a GROUP BY disaster, region),
ne AS (SELECT disaster, total AS total_ne FROM per_region WHERE region = 'northeast'),
se AS (SELECT disaster, total AS total_se FROM per_region WHERE region = 'southeast'),
mw AS (SELECT disaster, total AS total_mw FROM per_region WHERE region = 'midwest'),
w AS (SELECT disaster, total AS total_w FROM per_region WHERE region = 'west'),
us AS (
  SELECT ne.disaster, ne.total_ne AS northeast, se.total_se AS southeast,
         mw_w.total_mw AS midwest, mw_w.total_w AS west
  FROM ne LEFT JOIN se ON ne.disaster = se.disaster
          LEFT JOIN (SELECT mw.disaster, mw.total_mw, w.total_w
                     FROM mw LEFT JOIN w ON mw.disaster = w.disaster) mw_w
            ON ne.disaster = mw_w.disaster)
SELECT disaster, region, n_disaster FROM (
  SELECT disaster, 'northeast' AS region, northeast AS n_disaster FROM us UNION ALL
  SELECT disaster, 'southeast', southeast FROM us UNION ALL
  SELECT disaster, 'midwest', midwest FROM us UNION ALL
  SELECT disaster, 'west', west FROM us)""")
    q["precip_points"] = with_base(f"""
SELECT disaster, region, year, {r3('total_precip')} AS total_precip,
       {num_label('year')} || chr(10) || 'Total Precip(in.):' || {num_label('total_precip')} AS text_label
FROM (SELECT DISTINCT disaster, region, year, total_precip FROM complete_a) t""")
    q["precip_points_corrected"] = with_base(f"""
SELECT region, year, {r3('total_precip')} AS total_precip,
       {num_label('year')} || chr(10) || 'Total Precip(in.):' || {num_label('total_precip')} AS text_label
FROM (SELECT DISTINCT region, year, total_precip FROM complete_a) t""")
    q["region_year_bars"] = with_base(f"""
SELECT disaster, n_disaster_state, region, year,
       'total disasters: ' || {num_label('n_disaster_state')} || chr(10) || region AS text_label
FROM (SELECT DISTINCT disaster, n_disaster_state, region, year FROM complete_a) t""")
    q["region_year_totals"] = with_base("""
SELECT region, year, CAST(sum(n_disaster_state) AS BIGINT) AS n_disasters
FROM complete_a GROUP BY region, year""")
    types = ", ".join(f"'{t}'" for t in PANEL_TYPES)
    q["type_panel"] = with_base(f"""
SELECT region, disaster, year, count_region AS total FROM regional_type
WHERE region IS NOT NULL AND disaster IS NOT NULL AND year IS NOT NULL AND count_region IS NOT NULL
  AND disaster IN ({types})""")
    q["map_long"] = with_base(f"SELECT state_code, year, variable_type, {r4('statistic')} AS statistic FROM map_long")
    q["map_slice"] = with_base(f"""
SELECT m.state_code, m.year, m.variable_type, {r4('m.statistic')} AS statistic,
       m.variable_type || '-' || coalesce(p.location, 'NA') AS text_label
FROM map_long m LEFT JOIN places p ON m.state_code = p.state_code
WHERE m.variable_type = 'Yearly Mean Temperature (degrees F)' AND m.year = 1998""")
    q["place_type_trend"] = with_base("""
SELECT state, year, disaster, n_disaster_state FROM dash
WHERE state = 'NATION_7' AND disaster = 'NF' AND year BETWEEN 1997 AND 2000""")
    q["count_vs_measure"] = with_base(f"""
SELECT state, year, n_state, {r4('mean_temp')} AS mean_temp,
       'Number of Disaster Events: ' || {num_label('n_state')} || chr(10) || 'Average Temperature: '
         || {num_label('round_even(mean_temp, 1)')} || ' F' AS text_label
FROM dash WHERE state = 'NATION_7' AND disaster = 'NF'
  AND n_state IS NOT NULL AND mean_temp IS NOT NULL""")
    q["count_vs_measure_years"] = q["count_vs_measure"] + " AND year BETWEEN 1996 AND 2000"
    q["measure_series_corrected"] = with_base(f"""
SELECT state, year, {r4('mean_temp')} AS mean_temp, {r4('min_temp')} AS min_temp,
       {r4('max_temp')} AS max_temp, {_temp_label()} AS text_label
FROM (SELECT DISTINCT state, year, mean_temp, min_temp, max_temp FROM dash
      WHERE state = 'NATION_7' AND year BETWEEN 1996 AND 1999) t""")
    q["regional_rollup_window"] = q["regional_rollup"].replace(f"BETWEEN {LO} AND {HI}", "BETWEEN 1996 AND 2000")
    customer = lambda select: f"WITH {CUSTOMER_BASE.strip()}\n{select}"
    q["climate_four_series"] = customer(
        "SELECT state_code, location, year, " + ", ".join(map(rounded, MEAS)) + " FROM climate")
    q["fact_by_customer"] = customer(_fact_select("fact_a", True))
    q["fact_by_customer_counted_first"] = customer(_fact_select("fact_b", False))
    q["measure_series"] = with_base(f"""
SELECT state, year, {r4('mean_temp')} AS mean_temp, {r4('min_temp')} AS min_temp,
       {r4('max_temp')} AS max_temp, disaster, {_temp_label()} AS text_label
FROM (SELECT DISTINCT * FROM dash WHERE state = 'NATION_7' AND year BETWEEN 1996 AND 1999) t""")
    q["option_lists"] = with_base("""
SELECT DISTINCT list_name, value FROM (
  SELECT 'state' AS list_name, state AS value FROM dash WHERE state IS NOT NULL AND state <> 'NA'
  UNION ALL SELECT 'disaster', disaster FROM dash WHERE disaster IS NOT NULL AND disaster <> 'NA'
  UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM dash WHERE year IS NOT NULL
  UNION ALL SELECT 'variable_type', variable_type FROM map_long
  UNION ALL SELECT 'year_from', '""" + str(LO) + """' UNION ALL SELECT 'year_to', '""" + str(HI) + """') t""")
    q.update(_model_queries())
    return q


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0 + 0.5) / 1000000.0"


INV_SQRT_2PI = 0.3989422804014327


def _density(values_cte: str, group: str | None) -> str:
    """Binned Gaussian density on 512 points over each group's range."""
    g = group or "0"
    return with_base(f"""
, vals AS (SELECT {g} AS g, v FROM ({values_cte}) raw),
st0 AS (
  SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd,
         quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, min(abs(v)) AS fa
  FROM vals GROUP BY g),
st AS (
  SELECT g, n, lo,
         CASE WHEN hi > lo THEN (hi - lo) / 511 ELSE 0.0 END AS delta,
         0.9 * (CASE WHEN least(coalesce(sd, 0.0), iqr / 1.34) > 0 THEN least(coalesce(sd, 0.0), iqr / 1.34)
                     WHEN coalesce(sd, 0.0) > 0 THEN sd WHEN fa > 0 THEN fa ELSE 1.0 END)
             * pow(CAST(n AS DOUBLE), -0.2) AS bw
  FROM st0),
freq AS (SELECT g, v, count(*) AS c FROM vals GROUP BY g, v),
pos AS (
  SELECT f.g, f.c, s.n, CASE WHEN s.delta > 0 THEN (f.v - s.lo) / s.delta ELSE 0.0 END AS pos
  FROM freq f JOIN st s ON f.g IS NOT DISTINCT FROM s.g),
parts AS (
  SELECT g, CAST(floor(pos) AS BIGINT) AS j, (c / n) * (1.0 - (pos - floor(pos))) AS m FROM pos
  UNION ALL
  SELECT g, CAST(floor(pos) AS BIGINT) + 1 AS j, (c / n) * (pos - floor(pos)) AS m FROM pos),
bins AS (SELECT g, least(j, 511) AS j, sum(m) AS mass FROM parts WHERE m > 0 GROUP BY g, least(j, 511)),
dens AS (
  SELECT b.g, u.range AS u, s.lo, s.delta,
         sum(b.mass * exp(-0.5 * (((u.range - b.j) * s.delta) / s.bw) * (((u.range - b.j) * s.delta) / s.bw))
             * {INV_SQRT_2PI} / s.bw) AS density
  FROM bins b JOIN st s ON b.g IS NOT DISTINCT FROM s.g, range(512) u
  GROUP BY b.g, u.range, s.lo, s.delta)
SELECT {"g AS " + group + ", " if group else ""}{r6("lo + u * delta")} AS x, {r6("density")} AS density FROM dens""")


def _model_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    # One categorical regressor: the fitted means are the group means, so the
    # coefficients are log ratios of group means (Poisson and negative
    # binomial alike) and the Poisson standard errors are sqrt(1/S_g + 1/S_ref).
    means = """
, m AS (SELECT region, avg(CAST(y AS DOUBLE)) AS mu, sum(CAST(y AS DOUBLE)) AS s
        FROM order_rows WHERE region IS NOT NULL AND y IS NOT NULL GROUP BY region),
ref AS (SELECT * FROM m ORDER BY region LIMIT 1)"""
    q["poisson_by_group"] = with_base(means + f"""
SELECT '(Intercept)' AS term, {r6('ln(ref.mu)')} AS estimate, {r6('1 / sqrt(ref.s)')} AS std_error,
       {r6('ref.mu')} AS exp_estimate FROM ref
UNION ALL
SELECT 'region' || m.region, {r6('ln(m.mu) - ln(ref.mu)')}, {r6('sqrt(1 / m.s + 1 / ref.s)')},
       {r6('m.mu / ref.mu')}
FROM m, ref WHERE m.region <> ref.region""")
    q["negbin_by_group"] = with_base(means + f"""
SELECT '(Intercept)' AS term, {r6('ln(ref.mu)')} AS estimate, {r6('ref.mu')} AS exp_estimate FROM ref
UNION ALL
SELECT 'region' || m.region, {r6('ln(m.mu) - ln(ref.mu)')}, {r6('m.mu / ref.mu')}
FROM m, ref WHERE m.region <> ref.region""")
    # At the maximum of the likelihood its derivative is zero for every term.
    for name, rows, numeric in (("regional", "regional", "ave_temp sum_precip"), ("orders", "order_rows", "totalprice")):
        terms = " UNION ALL ".join(f"SELECT '{t}'" for t in ["(Intercept)", "year", *numeric.split()])
        select = f"""
SELECT term, 0.0::DOUBLE AS score FROM (
  {terms}
  UNION ALL SELECT 'region' || region FROM (SELECT DISTINCT region FROM {rows} WHERE region IS NOT NULL) r
  WHERE region > (SELECT min(region) FROM {rows})) t(term)"""
        q[f"poisson_{name}_scores"] = with_base(select)
        q[f"negbin_{name}_scores"] = with_base(select + " UNION ALL SELECT 'theta', 0.0::DOUBLE")
    q["aic_by_group"] = with_base(means + """
, ll AS (SELECT count(*) AS n, sum(CASE WHEN o.y > 0 THEN o.y * ln(m.mu) ELSE 0 END - m.mu - lgamma(o.y + 1.0)) AS v
         FROM order_rows o JOIN m ON o.region = m.region WHERE o.y IS NOT NULL)
SELECT 'poisson' AS model, CAST(n AS BIGINT) AS n, floor(v * 1000.0 + 0.5) / 1000.0 AS loglik,
       floor((-2 * v + 2 * (SELECT count(*) FROM m)) * 1000.0 + 0.5) / 1000.0 AS aic FROM ll""")
    for name, rows in (("cv_splits", "regional"), ("cv_splits_orders", "order_rows")):
        q[name] = with_base(f"""
, k AS (SELECT count(*) AS n, greatest(CAST(floor(count(*) * 0.2) AS BIGINT), 1) AS t FROM {rows})
SELECT CAST(s.range AS INTEGER) AS split_id, CAST(n - t AS BIGINT) AS n_train, CAST(t AS BIGINT) AS n_test FROM k, range(100) s""")
    # A column that the factor decides changes nothing and has no coefficient.
    q["poisson_aliased"] = with_base(means + f"""
SELECT term, estimate, std_error, (SELECT CAST(count(*) AS INTEGER) FROM m) AS rank FROM (
  SELECT '(Intercept)' AS term, {r6('ln(ref.mu)')} AS estimate, {r6('1 / sqrt(ref.s)')} AS std_error FROM ref
  UNION ALL
  SELECT 'region' || m.region, {r6('ln(m.mu) - ln(ref.mu)')}, {r6('sqrt(1 / m.s + 1 / ref.s)')}
  FROM m, ref WHERE m.region <> ref.region
  UNION ALL SELECT 'region_size', NULL, NULL) t""")
    # Two factors and their products: the fitted cells are the cells' means.
    cell = {"a": "b.region = m.region AND b.size = m.size", "r": "b.region = f.region AND b.size = m.size",
            "s": "b.region = m.region AND b.size = f.size", "o": "b.region = f.region AND b.size = f.size"}
    log = {k: f"(SELECT ln(b.mu) FROM cells b WHERE {on})" for k, on in cell.items()}
    q["poisson_interaction"] = with_base(f"""
, cells AS (SELECT region, CASE WHEN totalprice > 150000 THEN 'large' ELSE 'small' END AS size, avg(CAST(y AS DOUBLE)) AS mu
            FROM order_rows WHERE region IS NOT NULL AND y IS NOT NULL AND totalprice IS NOT NULL GROUP BY ALL),
f AS (SELECT min(region) AS region, min(size) AS size FROM cells),
terms AS (
  SELECT CASE WHEN m.region = f.region AND m.size = f.size THEN '(Intercept)'
              WHEN m.size = f.size THEN 'region' || m.region WHEN m.region = f.region THEN 'size' || m.size
              ELSE 'region' || m.region || ':size' || m.size END AS term,
         CASE WHEN m.region = f.region AND m.size = f.size THEN {log['a']}
              WHEN m.size = f.size THEN {log['a']} - {log['r']} WHEN m.region = f.region THEN {log['a']} - {log['s']}
              ELSE {log['a']} - {log['r']} - {log['s']} + {log['o']} END AS e
  FROM cells m, f)
SELECT term, {r6('e')} AS estimate, {r6('exp(e)')} AS exp_estimate FROM terms""")
    shapes = {"logical": "^(T|F|TRUE|FALSE|True|False|true|false)$", "integer": "^[+-]?[0-9]+$",
              "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}
    cells = {"order_key": "o_orderkey::VARCHAR", "total_price": "o_totalprice::VARCHAR", "order_day": "strftime(o_orderdate, '%Y-%m-%d')",
             "finished": "CASE o_orderstatus WHEN 'F' THEN 'T' WHEN 'O' THEN 'F' END", "o_orderpriority": "o_orderpriority"}
    kind = " ".join(f"WHEN coalesce(bool_and(regexp_matches(v, '{shape}')), true) THEN '{k}'" for k, shape in shapes.items())
    q["order_kinds"] = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"column\", CASE {kind} ELSE 'text' END AS kind, count(v) AS cells, count(*) - count(v) AS missing "
        f"FROM (SELECT nullif(nullif(trim({cell}), ''), 'NA') AS v FROM orders) t" for name, cell in cells.items())
    q["priority_levels"] = """
SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS position
FROM (SELECT o_orderpriority, min(struct_pack(d := o_orderdate, k := o_orderkey)) AS first
      FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority) t"""
    q["trend_points"] = with_base(f"SELECT DISTINCT region, year, {r4('mean_temp')} AS mean_temp FROM complete_a")
    # Both trends: one on years, one on a continuous column (region may be null there).
    for name, points in (("trend_loess", "SELECT region, CAST(year AS DOUBLE) AS x, count(*) AS c, avg(mean_temp) AS y FROM complete_a GROUP BY region, year"),
                         ("trend_loess_price", "SELECT region, totalprice / 1000 AS x, count(*) AS c, avg(CAST(y AS DOUBLE)) AS y FROM order_rows GROUP BY ALL")):
        q[name] = with_base(f"""
, p AS ({points}),
g AS (SELECT region, min(x) AS lo, max(x) AS hi, sum(c) AS n FROM p GROUP BY region),
r AS (SELECT p.*, g.n, u.range AS u, g.lo + u.range / 79.0 * (g.hi - g.lo) AS x0 FROM p JOIN g ON p.region IS NOT DISTINCT FROM g.region, range(80) u),
d AS (SELECT *, abs(x - x0) AS d FROM r),
c AS (SELECT *, sum(c) OVER (PARTITION BY region, u ORDER BY d RANGE UNBOUNDED PRECEDING) AS held FROM d),
h AS (SELECT *, min(CASE WHEN held >= greatest(floor(n * 0.75 + 1e-5), 1) THEN d END) OVER (PARTITION BY region, u) AS h FROM c),
w AS (SELECT *, c * pow(greatest(1 - pow(d / h, 3), 0), 3) AS w, (x - x0) / h AS t FROM h),
s AS (SELECT region, u, x0, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(w * t * t * t) AS s3,
             sum(w * t * t * t * t) AS s4, sum(w * y) AS t0, sum(w * t * y) AS t1, sum(w * t * t * y) AS t2
      FROM w GROUP BY region, u, x0),
f AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det,
             t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2) AS top FROM s)
SELECT region, floor(x0 * 10000.0 + 0.5) / 10000.0 AS x,
       floor((CASE WHEN det > 1e-9 * s0 * s0 * s0 THEN top / det ELSE t0 / s0 END) * 10000.0 + 0.5) / 10000.0 AS fitted FROM f""")
    q["trend_smooth_scores"] = with_base("SELECT DISTINCT region, 0.0::DOUBLE AS score FROM complete_a")
    q["density_totalprice"] = _density("SELECT o_totalprice / 1000 AS v FROM orders WHERE o_totalprice IS NOT NULL", None)
    q["density"] = _density(
        "SELECT CAST(count_region AS DOUBLE) AS v FROM (SELECT DISTINCT year, count_region FROM regional) d "
        "WHERE count_region IS NOT NULL", None)
    q["density_by_group"] = _density(
        "SELECT region, CAST(y AS DOUBLE) AS v FROM order_rows WHERE y IS NOT NULL",
        "region")
    return q
