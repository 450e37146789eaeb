"""Poisson and negative-binomial regression with a log link (M2, M3, M5, M7, M8).

Each pass over the rows is one aggregate job: the current coefficients (and
theta) of every active group sit in a small table that is broadcast to the rows
(one row per group, so its size is the number of groups, a parameter), every row
computes its weight and working response as Column expressions, and one
``groupBy(group).agg`` returns the weighted Gram matrix, the right side and the
deviance or log-likelihood.  The driver receives about ``p(p+1)/2 + 2p`` numbers
per group and solves a ``p × p`` system.  Groups that have converged drop
out of the broadcast table, so later passes skip their rows in the join.  A model
with factors only is fitted on its distinct rows with their counts.

* **Rank.**  Columns that depend on earlier ones are found by a Cholesky
  elimination of the first Gram matrix in column order.  A Gram matrix squares a
  column's norm and can't tell 1e-7 of it from rounding, so a column that
  comes out small is confirmed by a pass that sums its residual row by row;
  below ``RANK_TOL`` of its norm it is aliased: it is left out, published as
  null, and not counted in rank and AIC.
* **Poisson.**  Newton's method from ``mu = y + 0.1``.  A step after which the
  deviance is not finite or has risen is halved towards the last good
  coefficients (at first: an intercept alone), so a first step that shoots
  too far does no harm.
* **Negative binomial.**  Joint Newton steps for the coefficients and log theta from
  the Poisson fit and its moment estimate of theta, guarded in the same way by the
  log-likelihood.  The gamma functions of the likelihood depend on a row by its ``y``
  alone: the driver holds how many rows have each ``y`` (``HISTOGRAM_ROWS`` at most;
  beyond that the rows compute them), and the passes sum logarithms and quotients.

Groups that are one table without some of its rows each (the splits of a
cross-validation) are not made into rows x groups: ``SplitRows`` holds every row
once with the groups it is not in, and a pass takes, in numpy, the sums of all
groups over a bounded number of rows at a time, the weights of all groups as one matrix.

A fit ends when the next step would gain less than ``tol`` of the criterion;
that step is still taken.  Ungrouped fits are the one-group case (group key 0).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import digamma, gamma_np, lgamma, norm_sf2, trigamma
from ..session import drop_staged, stage_table
from .design import Design, Formula, as_formula, build_design, complete_rows, factors_of

#: Past these the likelihood of an under-dispersed group still rises with theta: its limit, the Poisson model, is reported.
THETA_MAX = 1e8
THETA_POISSON = 1e5
#: Groups whose coefficients one fit may hold on the driver, each a p × p system.
MAX_GROUPS = 100_000
#: Distinct (group, y) whose counts the driver may hold.
HISTOGRAM_ROWS = 200_000
#: A column whose part outside the earlier ones is below this share of its norm is aliased.
RANK_TOL = 1e-7
#: Squared shares below this are measured by a pass of their own.
_DOUBTFUL = 1e-9
MAX_HALVINGS = 40


@dataclass
class Fit:
    family: str
    names: list[str]
    beta: np.ndarray          # original units; 0 where aliased
    cov: np.ndarray           # original units; nan where aliased
    beta_scaled: np.ndarray
    aliased: np.ndarray
    loglik: float
    deviance: float
    n: int
    theta: float | None
    iterations: int
    converged: bool

    @property
    def rank(self) -> int:
        """Coefficients that were estimated."""
        return int((~self.aliased).sum())

    @property
    def aic(self) -> float:
        extra = 1 if self.family == "negbin" else 0
        return -2.0 * self.loglik + 2.0 * (self.rank + extra)

    def tidy_rows(self) -> list[tuple]:
        rows = []
        for k, name in enumerate(self.names):
            if self.aliased[k]:
                rows.append((name, None, None, None, None, None, bool(self.converged)))
                continue
            b, s = self.beta[k], math.sqrt(max(self.cov[k, k], 0.0))
            z = b / s if s > 0 else float("nan")
            rows.append((name, float(b), float(s), float(z), float(norm_sf2(z)), _exp(b), bool(self.converged)))
        return rows


def _exp(x: float) -> float:
    return math.exp(x) if x < 709 else math.inf


TIDY_SCHEMA = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()),
    T.StructField("statistic", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("exp_estimate", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
])


def _pair_index(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def linear_predictor(p: int) -> Column:
    """``_off`` plus the design columns times ``_beta``."""
    e = F.col("_off")
    for k in range(p):
        e = e + F.col("_beta")[k] * F.col(f"_x{k}")
    return e


def _mean(eta: Column) -> Column:
    """``exp(eta)``, kept off zero as R's inverse link does."""
    return F.greatest(F.exp(eta), F.lit(2.220446049250313e-16))


def _gram(p: int, w: Column, z: Column) -> list[Column]:
    c = F.col("_c")
    out = [F.sum(c * w * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"g{i}_{j}") for i, j in _pair_index(p)]
    return out + [F.sum(c * w * F.col(f"_x{i}") * z).alias(f"b{i}") for i in range(p)]


@lru_cache(maxsize=64)
def _pass_exprs(p: int, kind: str) -> tuple[list[list[Column]], list[Column]]:
    """Per-row columns (in steps) and aggregates of a pass.

    They depend only on the model size and the kind of pass (the coefficients come in
    through the joined ``_beta`` / ``_theta`` columns), so they are built
    once and reused by every pass and every fit of that shape.  ``b`` holds ``X'r`` for the gradient's
    ``r``, so a Newton step is ``G⁻¹ b``; in the first pass it is ``X'Wz``.
    """
    y, c, th = F.col("_y"), F.col("_c"), F.col("_theta")
    eta, mu = F.col("_eta"), F.col("_mu")

    def total(x: Column, name: str) -> Column:
        return F.sum(c * x).alias(name)

    if kind == "start":
        # The reference's Poisson start: mu = y + 0.1.
        first = [F.log(y + F.lit(0.1)).alias("_eta"), (y + F.lit(0.1)).alias("_mu")]
        return [first], _gram(p, mu, eta - F.col("_off") + (y - mu) / mu)
    steps = [[linear_predictor(p).alias("_eta")], [_mean(eta).alias("_mu")]]
    if kind == "poisson":
        ylogy = F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0))
        return steps, [*_gram(p, mu, (y - mu) / mu),
                       total(F.lit(2.0) * (ylogy - (y - mu)), "dev"), total(y * eta - mu, "loglik"),
                       total(F.pow(y / mu - F.lit(1.0), 2), "moment"), total(F.pow(y - mu, 2) - y, "overdisp")]
    sure = mu / (F.lit(1.0) + mu / th)
    if kind == "expected":
        return steps, _gram(p, sure, (y - mu) / mu)[:len(_pair_index(p))]
    both = th + mu
    seen = th * mu * (th + y) / (both * both)
    aggs = [*_gram(p, seen, F.lit(0.0))[:len(_pair_index(p))],
            *[total(F.col(f"_x{i}") * (y - mu) * th / both, f"b{i}") for i in range(p)],
            *[total(F.col(f"_x{i}") * (y - mu) * mu / (both * both), f"t{i}") for i in range(p)],
            total(y * eta - (y + th) * F.log(both), "loglik"),
            total(F.lit(1.0) - F.log(both) - (y + th) / both, "score"),
            total(F.lit(-2.0) / both + (y + th) / (both * both), "second"),
            total(F.lit(2.0) * (F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0))
                                - (y + th) * F.log((y + th) / both)), "dev")]
    if kind == "negbin_gamma":
        aggs += [total(lgamma(th + y) - lgamma(th), "h0"), total(digamma(th + y) - digamma(th), "h1"),
                 total(trigamma(th + y) - trigamma(th), "h2")]
    return steps, aggs


@dataclass
class SplitRows:
    """Rows of groups ``0 .. n - 1``, each group a table's rows but for those that name it in ``_out`` (see ``prepare_rows``)."""

    rows: DataFrame
    n: int

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802  as a DataFrame's
        return self.rows.sparkSession

    def exploded(self) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(self.n - 1))
        out = self.rows.select(F.explode(F.array_except(every, F.col("_out"))).alias("_g"),
                               *[c for c in self.rows.columns if c not in ("_g", "_out")])
        return out.withColumn("_g", F.col("_g").cast("long"))


#: Rows x groups that a pass over ``SplitRows`` holds at once.
CELLS = 1 << 17
_EPS = 2.220446049250313e-16


def _plain(rows: DataFrame | SplitRows) -> DataFrame:
    return rows.exploded() if isinstance(rows, SplitRows) else rows


def _numbers(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, ...]:
    """``y, off, c, x`` and the rows and groups of ``_out``."""
    y, off, c, *x = (batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("_y", "_off", "_c", *[f"_x{k}" for k in range(p)]))
    out = batch.column("_out")
    return y, off, c, np.stack(x, 1), np.repeat(np.arange(len(y)), out.value_lengths().to_numpy()), out.flatten().to_numpy()


def _log_times(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0)), 0.0)


def _pass_sums(y, off, c, x, inside, beta, theta, kind: str) -> dict[str, np.ndarray]:
    """The sums of ``_pass_exprs`` for every group: ``inside`` (rows x groups) tells who has which row."""
    pairs = _pair_index(x.shape[1])
    z = np.stack([x[:, i] * x[:, j] for i, j in pairs], 1)
    eta = np.where(inside, off[:, None] + x @ beta.T, 0.0)
    mu = np.maximum(np.exp(eta), _EPS)
    c, y = inside * c[:, None], y[:, None]
    gap = y - mu
    # y log(y / mu), the part of y apart.
    quotient = _log_times(y) - y * np.maximum(eta, math.log(_EPS))

    def total(v: np.ndarray) -> np.ndarray:
        return (c * v).sum(axis=0)

    if kind == "poisson":
        gram, b, t = z.T @ (c * mu), x.T @ (c * gap), None
        out = {"dev": total(2.0 * (quotient - gap)), "loglik": total(y * eta - mu),
               "moment": total((y / mu - 1.0) ** 2), "overdisp": total(gap * gap - y)}
    else:
        both, sure = theta + mu, theta + y
        logs, share = np.log(both), sure / both
        gram, b, t = z.T @ (c * (theta * mu * share / both)), x.T @ (c * (gap * theta / both)), x.T @ (c * (gap * mu / (both * both)))
        out = {"loglik": total(y * eta - sure * logs), "score": total(1.0 - logs - share), "second": total((share - 2.0) / both),
               "dev": total(2.0 * (quotient - sure * (np.log(sure) - logs)))}
    out |= {f"g{i}_{j}": gram[k] for k, (i, j) in enumerate(pairs)} | {f"b{k}": v for k, v in enumerate(b)}
    return out | ({f"t{k}": v for k, v in enumerate(t)} if t is not None else {})


def _split_pass(groups: np.ndarray, n: int, beta: np.ndarray, theta: np.ndarray, kind: str,
                names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per group and task: the sums ``names`` over the task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict.fromkeys(names, 0.0)
        step = max(1, CELLS // n)
        with np.errstate(all="ignore"):
            for whole in batches:
                for lo in range(0, len(whole), step):
                    y, off, c, x, row, out = _numbers(whole.slice(lo, step), beta.shape[1])
                    inside = np.ones((len(y), n), bool)
                    inside[row, out] = False
                    sums = _pass_sums(y, off, c, x, inside[:, groups], beta, theta, kind)
                    found = {k: v + sums[k] for k, v in found.items()}
        columns = [pa.array(np.broadcast_to(found[k], len(groups)), pa.float64()) for k in names]
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), *columns], ["_g", *names])
    return run


def _split_counts(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_g, _y, c, off, exp_off``: sums by group and ``_y`` over some rows, those of all of them less those outside the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, off, c, _, row, out = _numbers(batch.select(["_y", "_off", "_c", "_x0", "_out"]), 1)
            kept, code = np.unique(y, return_inverse=True)
            sums = []
            for v in (c, c * y * off, c * np.exp(off)):
                every = np.bincount(code, weights=v, minlength=len(kept))
                sums.append((every - np.bincount(out * len(kept) + code[row], weights=v[row], minlength=n * len(kept)).reshape(n, -1)).reshape(-1))
            at = np.flatnonzero(sums[0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at // len(kept), pa.int64()), pa.array(kept[at % len(kept)], pa.float64()),
                                              pa.array(sums[0][at].astype(np.int64)), *[pa.array(v[at], pa.float64()) for v in sums[1:]]],
                                             ["_g", "_y", "c", "off", "exp_off"])
    return run


def split_errors(rows: SplitRows, betas: Sequence[Mapping[int, np.ndarray]], link: bool = False) -> DataFrame:
    """``_g, model, sq, n``: squared differences of ``_y`` and the fitted values of each model, over the rows outside the group."""
    n, known = rows.n, [np.array([g in b for g in range(rows.n)]) for b in betas]
    p = len(next((v for b in betas for v in b.values()), [0.0]))
    coefs = [np.stack([b.get(g, np.zeros(p)) for g in range(n)]) for b in betas]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sq, times = np.zeros((len(coefs), n)), np.zeros(n, np.int64)
        with np.errstate(all="ignore"):
            for whole in batches:
                for lo in range(0, len(whole), CELLS // 16):
                    y, off, _, x, row, out = _numbers(whole.slice(lo, CELLS // 16), p)
                    times += np.bincount(out, minlength=n)
                    for k, beta in enumerate(coefs):
                        eta = off[row] + (x[row] * beta[out]).sum(axis=1)
                        sq[k] += np.bincount(out, weights=(y[row] - (eta if link else np.exp(eta))) ** 2, minlength=n)
        for k, own in enumerate(known):
            g = np.flatnonzero(own & (times > 0))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([k] * len(g), pa.int32()), pa.array(sq[k][g], pa.float64()),
                                              pa.array(times[g], pa.int64())], ["_g", "model", "sq", "n"])
    parts = rows.rows.mapInArrow(run, "_g long, model int, sq double, n long")
    return parts.groupBy("_g", "model").agg(F.sum("sq").alias("sq"), F.sum("n").alias("n"))


def _sums_of(rows: DataFrame | SplitRows, betas: Mapping[int, Sequence[float] | None], thetas: Mapping[int, float] | None,
             p: int, kind: str) -> DataFrame:
    if isinstance(rows, SplitRows) and kind in ("poisson", "negbin") and betas:
        groups = np.array(sorted(betas), np.int64)
        names = [f"g{i}_{j}" for i, j in _pair_index(p)] + [f"b{k}" for k in range(p)]
        names += ["dev", "loglik", "moment", "overdisp"] if kind == "poisson" else [*[f"t{k}" for k in range(p)], "loglik", "score", "second", "dev"]
        theta = np.array([(thetas or {}).get(g, math.nan) for g in groups])
        run = _split_pass(groups, rows.n, np.stack([np.asarray(betas[g], float) for g in groups]), theta, kind, names)
        parts = rows.rows.mapInArrow(run, ", ".join(["_g long", *[f"{c} double" for c in names]]))
        return parts.groupBy("_g").agg(*[F.sum(c).alias(c) for c in names])
    steps, aggs = _pass_exprs(p, kind)
    data = _plain(rows).join(F.broadcast(_state_df(rows.sparkSession, betas, thetas)), "_g")  # MAX_GROUPS rows at most
    for step in steps:
        data = data.select("*", *step)
    return data.groupBy("_g").agg(*aggs)


def _pass(rows: DataFrame | SplitRows, betas: Mapping[int, Sequence[float] | None], p: int, kind: str,
          thetas: Mapping[int, float] | None = None) -> dict[int, dict]:
    """One pass over the rows of the active groups."""
    out = {}
    for r in _sums_of(rows, betas, thetas, p, kind).collect():
        found = r.asDict()
        G = np.zeros((p, p))
        for i, j in _pair_index(p):
            G[i, j] = G[j, i] = found.pop(f"g{i}_{j}")
        found["G"] = G
        for name in "bt":
            if f"{name}0" in found:
                found[name] = np.array([found.pop(f"{name}{i}") for i in range(p)])
        out[found.pop("_g")] = found
    return out


def _finite(*values) -> bool:
    return all(v is not None and np.all(np.isfinite(v)) for v in values)


def _on(keep: np.ndarray, G: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution on the estimated columns, 0 elsewhere."""
    out = np.zeros(len(b))
    try:
        out[keep] = np.linalg.solve(G[np.ix_(keep, keep)], b[keep])
    except np.linalg.LinAlgError:
        out[keep] = np.linalg.lstsq(G[np.ix_(keep, keep)], b[keep], rcond=None)[0]
    return out


def _inverse_on(keep: np.ndarray, G: np.ndarray) -> np.ndarray:
    out = np.full(G.shape, np.nan)
    try:
        out[np.ix_(keep, keep)] = np.linalg.inv(G[np.ix_(keep, keep)])
    except np.linalg.LinAlgError:
        out[np.ix_(keep, keep)] = np.linalg.pinv(G[np.ix_(keep, keep)])
    return out


def eliminated(G: np.ndarray, sure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(kept, share)``: Cholesky elimination in column order, pivots that come out small passed over.

    ``share`` is what is left of each column's squared norm outside the kept ones before it.
    A column in ``sure`` is kept whatever its share.
    """
    p = len(G)
    kept, share = np.zeros(p, bool), np.zeros(p)
    rest = G.astype(float).copy()
    for k in range(p):
        share[k] = rest[k, k] / G[k, k] if G[k, k] > 0 else 0.0
        if share[k] > _DOUBTFUL or (sure is not None and sure[k] and rest[k, k] > 0):
            kept[k] = True
            rest[k + 1:, k + 1:] -= np.outer(rest[k + 1:, k], rest[k, k + 1:]) / rest[k, k]
    return kept, share


def _independent(rows: DataFrame | SplitRows, grams: Mapping[int, np.ndarray], p: int) -> dict[int, np.ndarray]:
    """Which columns each group's model can estimate."""
    spark = rows.sparkSession
    known = {g: eliminated(G) for g, G in grams.items()}
    sure = {g: kept.copy() for g, (kept, _) in known.items()}
    # A column that is 0 in every row needs no measuring.
    open_ = {g: [k for k in range(p) if not kept[k] and grams[g][k, k] > 0] for g, (kept, _) in known.items()}
    while any(open_.values()):
        asked = sorted({ks[0] for ks in open_.values() if ks})
        schema = T.StructType([T.StructField("_g", T.LongType()),
                               *[T.StructField(f"_a{k}", T.ArrayType(T.DoubleType())) for k in asked]])
        state = []
        for g, ks in open_.items():
            if not ks:
                continue
            fit = []
            for k in asked:
                before = sure[g] & (np.arange(p) < k)
                fit.append([float(v) for v in _on(before, grams[g], grams[g][:, k])] if ks[0] == k else None)
            state.append((int(g), *fit))
        aggs = []
        for k in asked:
            fitted = sum((F.col(f"_a{k}")[j] * F.col(f"_x{j}") for j in range(k)), F.lit(0.0))
            gap = F.col(f"_x{k}") - fitted
            aggs += [F.sum(F.col("_c") * gap * gap).alias(f"r{k}"), F.sum(F.col("_c") * F.col(f"_x{k}") * F.col(f"_x{k}")).alias(f"q{k}")]
        found = _plain(rows).join(F.broadcast(spark.createDataFrame(state, schema)), "_g").groupBy("_g").agg(*aggs).collect()
        for r in found:
            g = r["_g"]
            k = open_[g].pop(0)
            sure[g][k] = r[f"r{k}"] > RANK_TOL ** 2 * r[f"q{k}"]
        for g, ks in open_.items():
            if ks:
                # With one more column kept, others may need no measuring now.
                kept, _ = eliminated(grams[g], sure[g])
                sure[g] |= kept & (np.arange(p) >= ks[0])
                open_[g] = [k for k in ks if not sure[g][k]]
    return sure


def _state_df(spark: SparkSession, betas: Mapping[int, Sequence[float] | None], thetas: Mapping[int, float] | None = None) -> DataFrame:
    schema = T.StructType([T.StructField("_g", T.LongType()),
                           T.StructField("_beta", T.ArrayType(T.DoubleType())),
                           T.StructField("_theta", T.DoubleType())])
    rows = [(int(g), [float(v) for v in beta] if beta is not None else None,
             float(thetas[g]) if thetas and g in thetas else None) for g, beta in betas.items()]
    return spark.createDataFrame(rows, schema)


def stable_rows(rows: DataFrame) -> DataFrame:
    """Input rows for the many passes of a fit.

    The rows (the model's own columns, before any design expansion) are
    written once as a table in the cluster's shared checkpoint folder, which
    cuts the lineage (scans, joins, aggregates): an executor lost mid-fit
    costs a re-read of its files rather than a rerun of the joins.  The table
    is then kept in memory (spilling to disk) for speed.  Design columns are
    derived from it inside each pass, so the staged table stays as narrow as
    the model's inputs.
    """
    staged = stage_table(rows, "model-rows")
    out = staged.persist(StorageLevel.MEMORY_AND_DISK)
    out._staged_path = staged._staged_path
    return out


def prepare_rows(df: DataFrame, design: Design, group: Column | None = None, others: Sequence[str] = ()) -> DataFrame:
    """Project the model columns once: ``_g, _y, _off, _c, _x0 .. _x{p-1}`` (``_c``: rows that a row stands for), and ``others``."""
    c = F.col("_c") if "_c" in df.columns else F.lit(1).cast("long").alias("_c")
    g = F.lit(0).cast("long") if group is None else group.cast("long")
    cols = [g.alias("_g"), F.col(f"`{design.response}`").cast("double").alias("_y"), design.offset().alias("_off"), c]
    cols += [c.alias(f"_x{k}") for k, c in enumerate(design.columns())]
    return df.select(*cols, *others)


@dataclass
class Counts:
    """What a group's rows say by ``y`` alone: how many have each (if held), and sums."""

    y: np.ndarray | None
    c: np.ndarray | None
    n: int
    sum_y: float
    ylogy: float
    lgamma: float
    off: float        # sum of y * offset
    exp_off: float    # sum of exp(offset)

    def start(self, design: Design) -> tuple[np.ndarray, float]:
        """The coefficients without regressors, and their Poisson deviance."""
        beta = np.zeros(design.p)
        rate = 1.0
        if design.formula.intercept:
            rate = max(self.sum_y, 1e-10) / max(self.exp_off, 1e-300)
            beta[0] = math.log(rate)
        return beta, 2.0 * (self.ylogy - self.off - self.sum_y * math.log(rate) - self.sum_y + rate * self.exp_off)

    def gamma_terms(self, theta: float) -> tuple[float, float, float]:
        """Sums of ``lgamma(theta + y) - lgamma(theta)`` and of its two derivatives."""
        return tuple(float(self.c @ (own - base)) for own, base in zip(gamma_np(theta + self.y), gamma_np(np.array([theta])), strict=True))


def _counts(rows: DataFrame | SplitRows) -> dict[int, Counts]:
    """Counts of ``y`` per group, or only sums where there are too many different ones."""
    if isinstance(rows, SplitRows):
        parts = rows.rows.mapInArrow(_split_counts(rows.n), "_g long, _y double, c long, off double, exp_off double")
        table = parts.groupBy("_g", "_y").agg(*[F.sum(c).alias(c) for c in ("c", "off", "exp_off")])
    else:
        table = rows.groupBy("_g", "_y").agg(F.sum("_c").alias("c"), F.sum(F.col("_c") * F.col("_y") * F.col("_off")).alias("off"),
                                             F.sum(F.col("_c") * F.exp("_off")).alias("exp_off"))
    found = table.limit(HISTOGRAM_ROWS + 1).collect()
    out: dict[int, Counts] = {}
    if len(found) <= HISTOGRAM_ROWS:
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r["_g"], []).append(r)
        for g, own in by.items():
            y, c = np.array([r["_y"] for r in own], float), np.array([r["c"] for r in own], float)
            logs = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0)), 0.0)
            out[g] = Counts(y, c, int(c.sum()), float(c @ y), float(c @ logs), float(c @ gamma_np(y + 1.0)[0]),
                            math.fsum(r["off"] for r in own), math.fsum(r["exp_off"] for r in own))
        return out
    y, c = F.col("_y"), F.col("_c")
    sums = _plain(rows).groupBy("_g").agg(
        F.sum(c).alias("n"), F.sum(c * y).alias("sy"), F.sum(c * F.when(y > 0, y * F.log(y)).otherwise(0.0)).alias("yl"),
        F.sum(c * lgamma(y + F.lit(1.0))).alias("lg"), F.sum(c * y * F.col("_off")).alias("off"), F.sum(c * F.exp("_off")).alias("eo"))
    for r in sums.collect():
        out[r["_g"]] = Counts(None, None, int(r["n"]), r["sy"], r["yl"], r["lg"], r["off"], r["eo"])
    return out


def fit_groups(rows: DataFrame | SplitRows, design: Design, family: str = "poisson",
               tol: float = 1e-10, max_iter: int = 100,
               groups: Sequence[int] | None = None, initial: Fit | Mapping[str, Fit] | None = None,
               standard_errors: bool = True) -> dict:
    """Fit one model per value of ``_g`` in ``rows`` (see ``prepare_rows``).

    ``groups`` lists the group keys when the caller knows them (one fit, or
    the CV split ids); otherwise they are those that occur.  ``initial`` is a fit of all rows
    to start every group's from (for ``both``, one of each family), where the groups are samples of one table.
    """
    p = design.p
    if groups is None:
        groups = [r["_g"] for r in rows.select("_g").distinct().limit(MAX_GROUPS + 1).collect()]
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"{len(groups)} groups to fit at once; the limit is {MAX_GROUPS}, fit them in parts")
    counts = _counts(rows)
    # A listed group without rows has nothing to fit.
    groups = [g for g in groups if g in counts]
    given = {family: initial} if isinstance(initial, Fit) else dict(initial or {})
    start = given.get("poisson") or given.get("negbin")
    if start is None:
        first = _pass(rows, dict.fromkeys(groups), p, "start") if groups else {}
        keep = _independent(rows, {g: first[g]["G"] for g in groups}, p)
        trial = {g: _on(keep[g], first[g]["G"], first[g]["b"]) for g in groups}
    else:
        keep, trial = {}, dict.fromkeys(groups, start.beta_scaled)
    fits: dict[int, Fit] = {}
    good = {g: (*counts[g].start(design), None) for g in groups}  # coefficients, deviance, what the pass found
    its, halved, active = dict.fromkeys(groups, 0), dict.fromkeys(groups, 0), set(groups)
    last: dict[int, dict] = {}
    for _ in range(max_iter):
        if not active:
            break
        res = _pass(rows, {g: trial[g] for g in active}, p, "poisson")
        if not keep and active:
            keep = _independent(rows, {g: res[g]["G"] for g in groups}, p)
        for g in list(active):
            r, (beta, dev, _) = res[g], good[g]
            its[g] += 1
            if not _finite(r["dev"], r["G"], r["b"]) or r["dev"] > dev + 1e-9 * (abs(dev) + 0.1):
                halved[g] += 1
                trial[g] = (trial[g] + beta) / 2
                if halved[g] > MAX_HALVINGS:
                    active.discard(g)
                continue
            halved[g] = 0
            good[g] = (trial[g], r["dev"], r)
            step = _on(keep[g], r["G"], r["b"])
            gain = float(step @ r["b"])
            trial[g] = trial[g] + step
            if gain <= tol * (abs(r["dev"]) + 0.1):
                # The last step is taken; its gain is known to second order.
                good[g] = (trial[g], r["dev"] - gain, {**r, "loglik": r["loglik"] + gain / 2})
                active.discard(g)
    for g in groups:
        beta, dev, r = good[g]
        if r is None:  # never better than no regressors: report that, not converged
            last[g] = {"G": np.full((p, p), np.nan), "loglik": -dev / 2 + counts[g].ylogy - counts[g].sum_y, "moment": None, "overdisp": None}
        else:
            last[g] = r
        fits[g] = _make_fit("poisson", design, beta, keep[g], last[g]["G"], last[g]["loglik"] - counts[g].lgamma, dev, counts[g].n,
                            None, its[g], g not in active and r is not None and halved[g] <= MAX_HALVINGS)
    if family == "poisson":
        return fits
    nb = _fit_negbin(rows, design, fits, last, counts, given.get("negbin"), tol, max_iter, standard_errors)
    if family == "both":
        return {g: {"poisson": fits[g], "negbin": nb[g]} for g in groups}
    return nb


def _fit_negbin(rows: DataFrame | SplitRows, design: Design, pois: dict[int, Fit], last: dict, counts: dict[int, Counts],
                initial: Fit | None, tol: float, max_iter: int, standard_errors: bool) -> dict[int, Fit]:
    p = design.p
    held = all(c.y is not None for c in counts.values())
    near = initial is not None and initial.theta is not None and math.isfinite(initial.theta)
    trial, active, fits = {}, set(), {}
    for g, r in last.items():
        # Not over-dispersed at the Poisson fit: the likelihood rises all the
        # way to theta = infinity, where the model is the Poisson one.
        if r["overdisp"] is None or r["overdisp"] <= 0:
            fits[g] = _poisson_limit(pois[g])
            continue
        active.add(g)
        theta = initial.theta if near else min(THETA_POISSON, counts[g].n / r["moment"]) if r["moment"] > 0 else THETA_POISSON
        trial[g] = (np.where(pois[g].aliased, 0.0, initial.beta_scaled if near else pois[g].beta_scaled), math.log(theta))
    good: dict[int, tuple] = {}
    its, halved, done = dict.fromkeys(active, 0), dict.fromkeys(active, 0), set()
    for _ in range(max_iter):
        if not active:
            break
        thetas = {g: math.exp(trial[g][1]) for g in active}
        res = _pass(rows, {g: trial[g][0] for g in active}, p, "negbin" if held else "negbin_gamma", thetas)
        for g in list(active):
            r, (beta, tau) = res[g], trial[g]
            theta, keep = math.exp(tau), ~pois[g].aliased
            its[g] += 1
            h = counts[g].gamma_terms(theta) if held else (r["h0"], r["h1"], r["h2"])
            ll = r["loglik"] + h[0] + counts[g].n * theta * tau - counts[g].lgamma
            before = good.get(g)
            worse = before is not None and ll < before[2] - 1e-10 * (abs(before[2]) + 0.1)
            if not _finite(ll, r["G"], r["b"]) or worse:
                halved[g] += 1
                if before is None or halved[g] > MAX_HALVINGS:
                    active.discard(g)
                else:
                    trial[g] = ((beta + before[0]) / 2, (tau + before[1]) / 2)
                continue
            halved[g] = 0
            score = r["score"] + h[1] + counts[g].n * tau
            second = r["second"] + h[2] + counts[g].n / theta
            good[g] = (beta, tau, ll, r["dev"])
            # theta past THETA_POISSON with a rising likelihood: the counts are not
            # over-dispersed and the model is the Poisson one (theta = infinity).
            if theta >= THETA_MAX or (theta > THETA_POISSON and score > 0):
                fits[g] = _poisson_limit(pois[g])
                active.discard(g)
                continue
            slope, bend, cross = theta * score, -(theta * theta * second + theta * score), -theta * r["t"]
            step, move, gain = _newton(keep, r["G"], r["b"], cross, slope, bend)
            trial[g] = (beta + step, tau + move)
            if gain <= 2 * tol * (abs(ll) + 0.1) and abs(move) < 1e-4:
                good[g] = (*trial[g], ll + gain / 2, r["dev"])
                done.add(g)
                active.discard(g)
    left = {g: v for g, v in good.items() if g not in fits}
    grams = {}
    if left and standard_errors:
        grams = _pass(rows, {g: v[0] for g, v in left.items()}, p, "expected", {g: math.exp(v[1]) for g, v in left.items()})
    for g, (beta, tau, ll, dev) in left.items():
        G = grams[g]["G"] if g in grams else np.full((p, p), np.nan)
        fits[g] = _make_fit("negbin", design, beta, ~pois[g].aliased, G, ll, dev, counts[g].n, math.exp(tau), its[g], g in done)
    for g in pois:
        fits.setdefault(g, _poisson_limit(pois[g], False))
    return fits


def _newton(keep: np.ndarray, G: np.ndarray, b: np.ndarray, cross: np.ndarray, slope: float, bend: float) -> tuple[np.ndarray, float, float]:
    """``(step, move, gain)`` for the coefficients and log theta; apart where they are not at a joint maximum's side."""
    H = np.block([[G, cross[:, None]], [cross[None, :], np.array([[bend]])]])
    both, grad = np.append(keep, True), np.append(b, slope)
    try:
        np.linalg.cholesky(H[np.ix_(both, both)])
        joint = _on(both, H, grad)
        if abs(joint[-1]) <= 2.0:
            return joint[:-1], float(joint[-1]), float(joint @ grad)
    except np.linalg.LinAlgError:
        pass
    step = _on(keep, G, b)
    move = max(-2.0, min(2.0, slope / bend)) if bend > 0 else math.copysign(1.0, slope)
    return step, move, math.inf


def _poisson_limit(f: Fit, converged: bool = True) -> Fit:
    """The negative binomial at theta = infinity: the Poisson fit."""
    return Fit("negbin", f.names, f.beta, f.cov, f.beta_scaled, f.aliased, f.loglik, f.deviance, f.n, math.inf, f.iterations,
               f.converged and converged)


def _make_fit(family: str, design: Design, beta_scaled, keep: np.ndarray, G: np.ndarray, loglik: float, deviance: float, n: int,
              theta, its: int, converged: bool) -> Fit:
    T_ = design.to_original()
    beta_scaled = np.where(keep, np.asarray(beta_scaled, dtype=float), 0.0)
    cov_s = _inverse_on(keep, G) if _finite(G) else np.full(G.shape, np.nan)
    cov = np.full(G.shape, np.nan)
    cov[np.ix_(keep, keep)] = T_[np.ix_(keep, keep)] @ cov_s[np.ix_(keep, keep)] @ T_[np.ix_(keep, keep)].T
    return Fit(family=family, names=list(design.names), beta=T_ @ beta_scaled, cov=cov, beta_scaled=beta_scaled, aliased=~keep,
               loglik=float(loglik), deviance=float(deviance), n=int(n), theta=theta, iterations=its, converged=converged)


def glm(df: DataFrame, formula: Formula | str, family: str = "poisson", levels: dict | None = None,
        factors: Sequence[str] | None = None, tol: float = 1e-10, max_iter: int = 100) -> Fit:
    """Fit one model, such as ``glm(df, "count_region ~ year + region")``, on all complete rows of ``df``.

    ``family`` is ``poisson``, ``negbin`` or ``both`` (then a dict of the
    two fits; the negative binomial starts from that Poisson fit anyway).
    ``factors`` names the variables to code by level; by default those of text and boolean type.

    The complete rows are staged once (``stable_rows``); the design reads
    its constants from them and every pass derives the design columns from
    them on the fly.
    """
    formula = as_formula(formula)
    rows = complete_rows(df, formula)
    factors = factors_of(rows, formula) if factors is None else factors
    if set(formula.variables) <= set(factors):
        # Few distinct rows: every pass reads them with their counts.
        rows = rows.groupBy(*[f"`{c}`" for c in rows.columns]).agg(F.count(F.lit(1)).alias("_c"))
    data = stable_rows(rows)
    try:
        design = build_design(data, formula, factors, levels)
        fits = fit_groups(prepare_rows(data, design), design, family, tol, max_iter, groups=[0])
        if not fits:
            raise ValueError(f"no complete rows to fit {formula.response} on")
        return fits[0]
    finally:
        data.unpersist()
        drop_staged(data)


def score_check(df: DataFrame, formula: Formula | str, family: str = "poisson") -> DataFrame:
    """``term, score``: what the likelihood's derivative still is at the fitted model, as a share of its terms' sizes.

    Zero for every coefficient (and for ``theta``, if finite) at the maximum.
    """
    formula = as_formula(formula)
    fitted = glm(df, formula, family)
    rows = complete_rows(df, formula)
    design = build_design(rows, formula)
    x = [F.col(f"_x{k}") for k in range(design.p)]
    eta = sum((F.lit(float(b)) * x[k] for k, b in enumerate(fitted.beta_scaled)), F.col("_off"))
    data = prepare_rows(rows, design).withColumn("_mu", F.exp(eta))
    y, mu, th = F.col("_y"), F.col("_mu"), fitted.theta
    finite = family == "negbin" and th is not None and math.isfinite(th)
    weight = F.lit(1.0) / (F.lit(1.0) + mu / F.lit(float(th))) if finite else F.lit(1.0)
    aggs = [F.coalesce(F.abs(F.sum(weight * c * (y - mu))) / F.nullif(F.sum(F.abs(weight * c) * (y + mu)), F.lit(0.0)), F.lit(0.0))
            .alias(design.names[k]) for k, c in enumerate(x)]
    if finite:
        t = F.lit(float(th))
        part = (digamma(t + y) - digamma(t) + F.log(t) + F.lit(1.0) - F.log(t + mu) - (y + t) / (mu + t))
        aggs.append((F.abs(F.sum(part)) / F.sum(F.abs(part))).alias("theta"))
    names = [*design.names, *(["theta"] if finite else [])]
    return data.agg(*aggs).unpivot([], [F.col(f"`{n}`") for n in names], "term", "score")


def tidy(spark: SparkSession, fit: Fit) -> DataFrame:
    """Coefficient table: term, estimate, std_error, statistic, p_value, exp_estimate; nulls for aliased terms."""
    return spark.createDataFrame(fit.tidy_rows(), TIDY_SCHEMA)


GLANCE_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("loglik", T.DoubleType()),
    T.StructField("aic", T.DoubleType()),
    T.StructField("deviance", T.DoubleType()),
    T.StructField("theta", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
])


def glance(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """One-row-per-model summary (rank, log-likelihood, AIC, deviance, theta)."""
    rows = [(name, f.n, f.rank, f.loglik, f.aic, f.deviance, f.theta, f.converged) for name, f in fits.items()]
    return spark.createDataFrame(rows, GLANCE_SCHEMA)
