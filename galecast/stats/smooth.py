"""Smoothed trend per group (M13): a cubic regression spline by REML, and local regression.

``trend_smooth`` is what the reference's plots draw for large samples: a cubic
regression spline in the values at ``knots`` knots, placed at quantiles of the group's
distinct x, with the integrated squared second derivative as its penalty.  The penalty's
null space is shrunk a little (straight lines a tenth of the least curved direction), the
curve is centred beside an intercept, and the penalty's weight is that of restricted maximum
likelihood (REML).  Between two knots the spline is a product of four functions
of x, so one ``groupBy(group, interval)`` of their products is all the fit needs: ten
sums and four with y for an interval, whatever the number of rows.  Each group is
solved on the executors; nothing passes through the driver.

``trend_loess`` is the local form: at each grid point a quadratic is fitted by
least squares to the nearest ``span`` of the observations, with tricube weights
that fall to 0 at the farthest of them.  It works on one row per group and x
value (mean and count), so it suits x values from a short list, such as years.

``trend_loess_dense`` gives the same curve for continuous x.  The points of a group are summed up in
``BINS`` bins by the moments of x and y around the bin's middle.  To one side of a
grid point the tricube weight is a polynomial of degree 9, so a bin that lies wholly in reach
and on one side adds its share to the sums of a quadratic fit from its moments up to
degree 13, exactly.  Only the bins that hold the grid point or a border of its
reach are read point by point, three of them, and some four to find how far it
reaches: a grid point reads about seven bins of points where the local form reads all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import BROADCAST_ROWS, attach_groups
from ..session import stage_table
from .quantile import exact_quantiles, settled

KNOTS = 10
#: Range of the logarithm of the penalty's weight, in units where data and penalty are of one size.
_LOG_WEIGHTS = (-20.0, 20.0)
_LOCAL = ("a0", "a1", "c0", "c1")
_PRODUCTS = [(i, j) for i in range(4) for j in range(i, 4)]


def spline_matrices(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(second, penalty)``: second derivatives at the knots from the values there, and the penalty in the values."""
    k, h = len(knots), np.diff(knots)
    D, B = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        D[i, i:i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        B[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < k - 2:
            B[i, i + 1] = B[i + 1, i] = h[i + 1] / 6
    inner = np.linalg.solve(B, D)
    second = np.vstack([np.zeros(k), inner, np.zeros(k)])
    return second, D.T @ inner


def shrunk(penalty: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The penalty with its null space weighted slightly: straight lines a tenth, constants a hundredth of the least curved direction."""
    least = np.linalg.eigvalsh(penalty)[2]
    line, level = knots - knots.mean(), np.ones(len(knots))
    return penalty + least * (0.1 * np.outer(line, line) / (line @ line) + 0.01 * np.outer(level, level) / len(knots))


def reml_weight(G: np.ndarray, b: np.ndarray, yy: float, n: int, S: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """``(log weight, coefficients, edf, score)``: where the REML criterion's derivative (the score) is zero.

    ``G, b, yy`` are the sums of products of centred columns and y; ``S`` penalises all of them.
    The least value within ``_LOG_WEIGHTS`` may be at an end of it: a curve through all means of a few x, with equal y at each, has
    no best weight above 0.  The score is then the derivative's part that leads back into the range, zero at a least value.
    """
    r = len(b)

    def at(rho: float) -> tuple[float, float, np.ndarray, np.ndarray]:
        P = math.exp(rho) * S
        A = G + P
        beta, AP = np.linalg.solve(A, b), np.linalg.solve(A, P)
        left = max(yy - b @ beta, 1e-12 * yy + 1e-300)
        value = (n - 1) / 2 * math.log(left) + np.linalg.slogdet(A)[1] / 2 - r * rho / 2
        return value, (n - 1) / 2 * float(beta @ P @ beta) / left + np.trace(AP) / 2 - r / 2, beta, AP

    grid = np.linspace(*_LOG_WEIGHTS, 81)
    best = int(np.argmin([at(x)[0] for x in grid]))
    lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, 80)]
    if at(lo)[1] < 0 < at(hi)[1]:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if at(mid)[1] < 0 else (lo, mid)
        rho = (lo + hi) / 2
    else:
        rho = grid[best]
    _, score, beta, AP = at(rho)
    if rho == grid[0]:
        score = min(score, 0.0)
    elif rho == grid[-1]:
        score = max(score, 0.0)
    return rho, beta, r - float(np.trace(AP)) + 1, score


_FIT = T.StructType([
    T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType()), T.StructField("_knots", T.ArrayType(T.DoubleType())),
    T.StructField("_value", T.ArrayType(T.DoubleType())), T.StructField("_second", T.ArrayType(T.DoubleType())),
    T.StructField("lambda", T.DoubleType()), T.StructField("edf", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _solve_group(by: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group's intervals (one row each) that returns its fit as one row."""
    def run(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        knots, n, mean = np.array(first["_knots"], float), sum(rows.column("n").to_pylist()), first["_m"]
        k, span = len(knots), knots[-1] - knots[0]
        value, second, weight, edf, score = np.zeros(k), np.zeros(k), None, 1.0, 0.0
        t = (knots - knots[0]) / span if span > 0 else np.zeros(k)
        yy = sum(rows.column("yy").to_pylist())
        if np.all(np.diff(t) > 0) and n > 2 and yy > 0:
            F_, S = spline_matrices(t)
            G, b = np.zeros((k, k)), np.zeros(k)
            for row in rows.to_pylist():
                j = row["_j"]
                L = np.zeros((4, k))
                L[0, j] = L[1, j + 1] = 1.0
                L[2], L[3] = F_[j], F_[j + 1]
                M = np.zeros((4, 4))
                for a, c in _PRODUCTS:
                    M[a, c] = M[c, a] = row[f"p{a}{c}"]
                G += L.T @ M @ L
                b += L.T @ np.array([row[f"y{a}"] for a in range(4)])
            # The curve sums to zero over the data: the complement of the columns' sums.
            Z = np.linalg.qr((G @ np.ones(k))[:, None], mode="complete")[0][:, 1:]
            Gz, Sz = Z.T @ G @ Z, Z.T @ shrunk(S, t) @ Z
            size = np.trace(Gz) / np.trace(Sz)
            rho, beta, edf, score = reml_weight(Gz, Z.T @ b, yy, n, size * Sz)
            value, weight = Z @ beta, math.exp(rho) * size
            second = F_ @ value
        fit = [knots[0], knots[-1], t.tolist(), (value + mean).tolist(), second.tolist(), weight, edf, score]
        kinds = [pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.float64()] * 3]
        return pa.table([*[rows.column(c).slice(0, 1).combine_chunks() for c in by], *[pa.array([v], kind) for v, kind in zip(fit, kinds, strict=True)]],
                        names=[*by, *_FIT.names])
    return run


def spline_fits(df: DataFrame, x: str, y: str, by: Sequence[str], knots: int = KNOTS) -> DataFrame:
    """One row per group: its range, knots, values and second derivatives there, ``lambda``, ``edf`` and ``score``,
    the derivative of the REML criterion, which is zero at its optimum (at an end of the weights' range: its part that leads back)."""
    by = list(by)
    data = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
             .dropna(how="any", subset=["_x", "_y"])
    counts = stage_table(data.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"), F.avg("_y").alias("_y"),
                                                     F.sum(F.col("_y") * F.col("_y")).alias("_yy")), "smooth-values")
    places = exact_quantiles(counts.select(*by, F.col("_x").alias("_v"), F.lit(1).alias("_c")), by, [i / (knots - 1) for i in range(knots)])
    means = counts.groupBy(*by).agg((F.sum(F.col("_y") * F.col("_c")) / F.sum("_c")).alias("_m"))
    groups = stage_table(places.select(*by, F.array(*[f"q{i}" for i in range(knots)]).alias("_knots")), "smooth-knots", small=True)
    groups = stage_table(attach_groups(groups, stage_table(means, "smooth-means", small=True), by, by), "smooth-groups", small=True)
    rows = attach_groups(counts, groups, by, ["_x"])
    lo, span = F.col("_knots")[0], F.col("_knots")[knots - 1] - F.col("_knots")[0]
    rows = rows.withColumn("_j", sum((F.when(F.col("_x") >= F.col("_knots")[i], 1).otherwise(0) for i in range(1, knots - 1)), F.lit(0)))
    unit = lambda v: F.when(span > 0, (v - lo) / F.nullif(span, F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.select(*by, "_knots", "_m", "_c", "_j", unit(F.col("_x")).alias("_t"), (F.col("_y") - F.col("_m")).alias("_d"),
                       unit(F.get("_knots", F.col("_j"))).alias("_k0"), unit(F.get("_knots", F.col("_j") + 1)).alias("_k1"),
                       (F.col("_yy") - 2 * F.col("_m") * F.col("_y") * F.col("_c") + F.col("_c") * F.col("_m") * F.col("_m")).alias("_dd"))
    h, left, right = F.col("_k1") - F.col("_k0"), F.col("_k1") - F.col("_t"), F.col("_t") - F.col("_k0")
    safe = F.nullif(h, F.lit(0.0))
    local = [left / safe, right / safe, (left * left * left / safe - h * left) / 6, (right * right * right / safe - h * right) / 6]
    rows = rows.select(*by, "_knots", "_m", "_c", "_j", "_d", "_dd", *[F.coalesce(v, F.lit(0.0)).alias(name) for v, name in zip(local, _LOCAL, strict=True)])
    aggs = [F.sum(F.col("_c") * F.col(_LOCAL[a]) * F.col(_LOCAL[c])).alias(f"p{a}{c}") for a, c in _PRODUCTS]
    aggs += [F.sum(F.col("_c") * F.col(_LOCAL[a]) * F.col("_d")).alias(f"y{a}") for a in range(4)]
    sums = rows.groupBy(*by, "_j").agg(*aggs, F.sum("_dd").alias("yy"), F.sum("_c").alias("n"), F.first("_m").alias("_m"),
                                       F.first("_knots").alias("_knots"))
    schema = T.StructType([*[df.schema[c] for c in by], *_FIT.fields])
    # At most knots - 1 rows a group.
    return sums.groupBy(*by).applyInArrow(_solve_group(by), schema)


def trend_smooth(df: DataFrame, x: str, y: str, by: Sequence[str], n_grid: int = 80, knots: int = KNOTS) -> DataFrame:
    """``by..., x, fitted, lambda, edf`` on ``n_grid`` points over each group's x range."""
    at = F.col("_u").cast("double") / F.lit(float(n_grid - 1))
    grid = spline_fits(df, x, y, by, knots).withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1)))).withColumn("_t", at)
    j = sum((F.when(F.col("_t") >= F.col("_knots")[i], 1).otherwise(0) for i in range(1, knots - 1)), F.lit(0))
    grid = grid.withColumn("_j", j).select("*", *[F.get(c, F.col("_j") + s).alias(f"{c}{s}") for c in ("_knots", "_value", "_second") for s in (0, 1)])
    h = F.col("_knots1") - F.col("_knots0")
    left, right, safe = F.col("_knots1") - F.col("_t"), F.col("_t") - F.col("_knots0"), F.nullif(h, F.lit(0.0))
    fitted = (left / safe * F.col("_value0") + right / safe * F.col("_value1")
              + (left * left * left / safe - h * left) / 6 * F.col("_second0") + (right * right * right / safe - h * right) / 6 * F.col("_second1"))
    return grid.select(*by, (F.col("_lo") + F.col("_t") * (F.col("_hi") - F.col("_lo"))).alias("x"),
                       F.coalesce(fitted, F.col("_value0")).alias("fitted"), "lambda", "edf")


def trend_loess(df: DataFrame, x: str, y: str, by: Sequence[str], span: float = 0.75, n_grid: int = 80) -> DataFrame:
    """``by..., x, fitted`` on ``n_grid`` points over each group's x range, by local quadratic regression."""
    by = list(by)
    data = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
             .dropna(how="any", subset=["_x", "_y"])
    points = data.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"), F.avg("_y").alias("_y"))
    groups = points.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_c").alias("_n"))
    at = F.col("_lo") + F.col("_u").cast("double") / F.lit(float(n_grid - 1)) * (F.col("_hi") - F.col("_lo"))
    rows = (attach_groups(points, stage_table(groups, "loess-groups"), by, ["_x"])
            .withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1)))).withColumn("_at", at)
            .withColumn("_d", F.abs(F.col("_x") - F.col("_at"))))
    # The distance within which the nearest ``span`` of the observations lie.
    near = Window.partitionBy(*by, "_u")
    rows = rows.withColumn("_held", F.sum("_c").over(near.orderBy("_d")))
    enough = F.col("_held") >= F.greatest(F.floor(F.col("_n") * F.lit(span) + F.lit(1e-5)), F.lit(1))
    rows = rows.withColumn("_h", F.min(F.when(enough, F.col("_d"))).over(near))
    scaled = F.when(F.col("_h") > 0, F.col("_d") / F.col("_h")).otherwise(F.when(F.col("_d") > 0, 1.0).otherwise(0.0))
    cube = F.greatest(F.lit(1.0) - scaled * scaled * scaled, F.lit(0.0))
    weight = F.col("_c") * cube * cube * cube
    t = F.when(F.col("_h") > 0, (F.col("_x") - F.col("_at")) / F.col("_h")).otherwise(F.lit(0.0))
    rows = rows.select(*by, "_u", "_at", "_y", weight.alias("_w"), t.alias("_t"))
    power, sums = F.lit(1.0), []
    for k in range(5):
        sums.append(F.sum(F.col("_w") * power).alias(f"s{k}"))
        if k < 3:
            sums.append(F.sum(F.col("_w") * power * F.col("_y")).alias(f"t{k}"))
        power = power * F.col("_t")
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    top = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    # Fewer than three x values within reach: their weighted mean.
    fitted = F.when(det > F.lit(1e-9) * s0 * s0 * s0, top / det).otherwise(t0 / s0)
    return rows.groupBy(*by, "_u", "_at").agg(*sums).select(*by, F.col("_at").alias("x"), fitted.alias("fitted"))


BINS = 512
_DEGREE = 13
_SUMS = ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")


def _bin_edges(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Begins and ends of the bins, a little wider than they are, as rounding may put a point past them; and their width."""
    width = (hi - lo) / BINS
    begins = lo + width * np.arange(BINS)
    return begins - 1e-9 * width, begins + width * (1 + 1e-9), width


def _reach(by: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each grid point of a group, the bins that may hold the farthest point in reach, and its rank among theirs."""
    def run(bins: pa.Table, grid: pa.Table) -> pa.Table:
        held = np.zeros(BINS, np.int64)
        held[bins.column("_bin").to_numpy()] = bins.column("m0").to_numpy().round().astype(np.int64)
        lo, hi, k = (grid.column(c)[0].as_py() for c in ("_lo", "_hi", "_k"))
        a, b, _ = _bin_edges(lo, hi)
        out: list[tuple] = []
        for u, x0 in zip(grid.column("_u").to_pylist(), grid.column("_at").to_pylist(), strict=True):
            near, far = np.maximum(np.maximum(a - x0, x0 - b), 0.0), np.maximum(x0 - a, b - x0)
            order = np.argsort(near, kind="stable")
            least = near[order][np.searchsorted(np.cumsum(held[order]), k)]
            order = np.argsort(far, kind="stable")
            most = far[order][np.searchsorted(np.cumsum(held[order]), k)]
            rank = k - 1 - int(held[far < least].sum())
            out += [(u, int(j), rank, 0.0, most) for j in np.flatnonzero((near <= most) & (far >= least) & (held > 0))]
        cols = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([*[pa.array([grid.column(c)[0].as_py()] * len(out), grid.schema.field(c).type) for c in by],
                         *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*by, "_u", "_bin", "_r", "_a", "_b"])
    return run


def _powers(a: np.ndarray, s: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Sums of ``(a + s z)**m`` for each degree m from sums of ``z**j``."""
    top = moments.shape[0]
    scaled = np.array([s ** j * moments[j] for j in range(top)])
    return np.array([sum(math.comb(m, j) * a ** (m - j) * scaled[j] for j in range(m + 1)) for m in range(top)])


def _inside(by: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each grid point its sums over the bins wholly in reach (``_bin`` null), and the bins to be read point by point."""
    def run(bins: pa.Table, grid: pa.Table) -> pa.Table:
        M, Q = np.zeros((_DEGREE + 1, BINS)), np.zeros((_DEGREE - 1, BINS))
        at = bins.column("_bin").to_numpy()
        for j in range(_DEGREE + 1):
            M[j, at] = bins.column(f"m{j}").to_numpy()
        for j in range(_DEGREE - 1):
            Q[j, at] = bins.column(f"q{j}").to_numpy()
        lo, hi = grid.column("_lo")[0].as_py(), grid.column("_hi")[0].as_py()
        a, b, width = _bin_edges(lo, hi)
        middle, out = lo + width * (np.arange(BINS) + 0.5), []
        for u, x0, h in zip(*[grid.column(c).to_pylist() for c in ("_u", "_at", "_h")], strict=True):
            touched = (a <= x0 + h) & (b >= x0 - h) & (M[0] > 0)
            whole = touched & (a > x0 - h) & (b < x0 + h) & ((a > x0) | (b < x0))
            total = np.zeros(8)
            if whole.any():
                side = np.where(a[whole] > x0, 1.0, -1.0)
                E = _powers((middle[whole] - x0) / h, np.full(whole.sum(), width / 2 / h), M[:, whole])
                Y = _powers((middle[whole] - x0) / h, np.full(whole.sum(), width / 2 / h), Q[:, whole])
                tricube = lambda P, k: (P[k] - 3 * side * P[k + 3] + 3 * P[k + 6] - side * P[k + 9]).sum()  # noqa: E731, B023
                total = np.array([*[tricube(E, k) for k in range(5)], *[tricube(Y, k) for k in range(3)]])
            out.append((u, None, x0, h, *total))
            out += [(u, int(j), x0, h, *[0.0] * 8) for j in np.flatnonzero(touched & ~whole)]
        cols = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.int32(), *[pa.float64()] * 10)
        return pa.table([*[pa.array([grid.column(c)[0].as_py()] * len(out), grid.schema.field(c).type) for c in by],
                         *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*by, "_u", "_bin", "_at", "_h", *_SUMS])
    return run


def _points_of(points: DataFrame, bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """The points of each listed bin, once for every grid point that lists it."""
    keys = [*by, "_bin"]
    listed = bins.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[c for c in bins.columns if c not in keys])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    few = bins.count() <= BROADCAST_ROWS
    return points.join(F.broadcast(listed) if few else listed, on).drop(*[f"_k_{c}" for c in keys])


def quadratic_at(s0, s1, s2, s3, s4, t0, t1, t2) -> Column:
    """The value at t = 0 of a weighted quadratic fit, from its sums; the mean where three x values are not in reach."""
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    top = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    return F.when(det > F.lit(1e-9) * s0 * s0 * s0, top / det).otherwise(t0 / s0)


def trend_loess_dense(df: DataFrame, x: str, y: str, by: Sequence[str] = (), span: float = 0.75, n_grid: int = 80) -> DataFrame:
    """``by..., x, fitted`` as ``trend_loess`` gives them, for x with about as many values as rows."""
    keyless = not by
    by = list(by) or ["_all"]
    if keyless:
        df = df.withColumn("_all", F.lit(0))
    data = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
             .dropna(how="any", subset=["_x", "_y"])
    points = stage_table(data.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"), F.avg("_y").alias("_y")), "loess-points")
    groups = stage_table(points.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_c").alias("_n")),
                         "loess-groups", small=True)
    span_x = F.col("_hi") - F.col("_lo")
    place = F.when(span_x > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(span_x, F.lit(0.0)) * BINS), F.lit(BINS - 1))).otherwise(0)
    points = attach_groups(points, groups, by, ["_x"]).withColumn("_bin", place.cast("int"))
    half = span_x / (2 * BINS)
    z = F.when(half > 0, (F.col("_x") - (F.col("_lo") + (F.col("_bin") * 2 + 1) * half)) / F.nullif(half, F.lit(0.0))).otherwise(F.lit(0.0))
    sums, power = [], F.lit(1.0)
    for j in range(_DEGREE + 1):
        sums.append(F.sum(F.col("_c") * power).alias(f"m{j}"))
        if j < _DEGREE - 1:
            sums.append(F.sum(F.col("_c") * power * F.col("_y")).alias(f"q{j}"))
        power = power * F.col("_z")
    bins = stage_table(points.withColumn("_z", z).groupBy(*by, "_bin").agg(*sums), "loess-bins", small=True)
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("_u")).withColumn(
        "_at", F.col("_lo") + F.col("_u").cast("double") / F.lit(float(n_grid - 1)) * span_x)
    grid = grid.withColumn("_k", F.greatest(F.floor(F.col("_n") * F.lit(span) + F.lit(1e-5)), F.lit(1)).cast("long"))
    keys = [df.schema[c] for c in by]
    long, double, integer = T.LongType(), T.DoubleType(), T.IntegerType()

    # BINS and n_grid rows a group at most on either side of both cogroups.
    open_bins = stage_table(bins.groupBy(*by).cogroup(grid.groupBy(*by)).applyInArrow(_reach(by), T.StructType(
        [*keys, T.StructField("_u", integer), T.StructField("_bin", integer), T.StructField("_r", long),
         T.StructField("_a", double), T.StructField("_b", double)])), "loess-open", small=True)
    at = grid.select(*by, "_u", "_at")
    near = _points_of(points.select(*by, "_bin", "_x", "_c"), attach_groups(open_bins, stage_table(at, "loess-grid", small=True), [*by, "_u"], ["_bin"]), by)
    near = stage_table(near.select(*by, "_u", F.abs(F.col("_x") - F.col("_at")).alias("_v"), "_c"), "loess-near")
    targets = open_bins.select(*by, "_u", F.lit(0).alias("_t"), F.lit(1.0).alias("_w"), "_r", "_a", "_b").distinct()
    targets = targets.withColumn("_done", F.col("_a") == F.col("_b"))
    farthest = settled(near, targets, [*by, "_u"], bins=256).select(*by, "_u", F.col("_b").alias("_h"))
    reach = attach_groups(grid, stage_table(farthest, "loess-reach", small=True), [*by, "_u"], ["_u"])
    parts = stage_table(bins.groupBy(*by).cogroup(reach.groupBy(*by)).applyInArrow(_inside(by), T.StructType(
        [*keys, T.StructField("_u", integer), T.StructField("_bin", integer), T.StructField("_at", double), T.StructField("_h", double),
         *[T.StructField(c, double) for c in _SUMS]])), "loess-parts", small=True)
    rows = _points_of(points.select(*by, "_bin", "_x", "_c", "_y"), parts.where("_bin IS NOT NULL").select(*by, "_bin", "_u", "_at", "_h"), by)
    weight, t = _tricube(F.abs(F.col("_x") - F.col("_at")), F.col("_x") - F.col("_at"), F.col("_h"), F.col("_c"))
    each = rows.select(*by, "_u", "_at", *_local_sums(weight, t, F.col("_y")))
    each = each.unionByName(parts.where("_bin IS NULL").select(*by, "_u", "_at", *_SUMS))
    total = each.groupBy(*by, "_u", "_at").agg(*[F.sum(c).alias(c) for c in _SUMS])
    out = total.select(*by, F.col("_at").alias("x"), quadratic_at(*[F.col(c) for c in _SUMS]).alias("fitted"))
    return out.drop("_all") if keyless else out


def _tricube(distance: Column, gap: Column, h: Column, count: Column) -> tuple[Column, Column]:
    """The weight of a point and its place in units of the reach."""
    scaled = F.when(h > 0, distance / F.nullif(h, F.lit(0.0))).otherwise(F.when(distance > 0, 1.0).otherwise(0.0))
    cube = F.greatest(F.lit(1.0) - scaled * scaled * scaled, F.lit(0.0))
    return count * cube * cube * cube, F.when(h > 0, gap / F.nullif(h, F.lit(0.0))).otherwise(F.lit(0.0))


def _local_sums(weight: Column, t: Column, y: Column) -> list[Column]:
    powers = [F.lit(1.0), t, t * t, t * t * t, t * t * t * t]
    return [*[(weight * p).alias(f"s{k}") for k, p in enumerate(powers)], *[(weight * p * y).alias(f"t{k}") for k, p in enumerate(powers[:3])]]
