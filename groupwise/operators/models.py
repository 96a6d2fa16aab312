"""Models whose heavy pass is a Spark aggregate and whose small fixed-size system numpy solves."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.operators.sequence import kept


def _one_solver_thread() -> None:
    """numpy's linear algebra in one thread: beside a JVM's many threads its own were seen to wait for each other for ever. Solves are small."""
    maps = Path("/proc/self/maps")
    for path in {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ():
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


_one_solver_thread()


def member_cells(df: DataFrame, row: str, blocks: dict[str, str], y: str) -> DataFrame:
    """(row, y, block, member): one row for each member on each list; blocks maps a block's name to its list column."""
    parts = [df.select(row, y, F.lit(name).alias("block"), F.explode(F.array_distinct(F.col(c))).alias("member")) for name, c in blocks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gram(df: DataFrame, blocks: dict[str, str], y: str, fold: str | None = None) -> DataFrame:
    """X'X, X'1 and X'y of a design of member indicators, as (fold, block_i, member_i, block_j, member_j, n, y).

    Each row's pairs of members (a fixed number) are summed where they arise; only the upper triangle is kept. Diagonal
    entries hold X'1 as n and X'y as y.
    """
    of_fold = F.col(fold) if fold else F.lit(0)
    labelled = lambda name: lambda m: F.struct(F.lit(name).alias("block"), m.alias("member"))
    cells = F.concat(*(F.transform(F.array_distinct(F.col(c)), labelled(name)) for name, c in blocks.items()))
    rows = df.select(of_fold.alias("fold"), F.col(y).cast("double").alias("y"), cells.alias("cells"))
    pairs = rows.select("fold", "y", "cells", F.explode("cells").alias("i")).select("fold", "y", "i", F.explode("cells").alias("j")).where("i <= j")
    return pairs.groupBy("fold", F.col("i.block").alias("block_i"), F.col("i.member").alias("member_i"), F.col("j.block").alias("block_j"), F.col("j.member").alias("member_j")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))


@dataclass
class Ridge:
    """A fitted two-penalty ridge: columns are (block, member)."""

    columns: list[tuple]
    coefficients: np.ndarray
    covariance: np.ndarray
    mean: float
    residual_variance: float
    effective_df: float
    condition: float

    def contrast_error(self, i: int, j: int) -> float:
        """Standard error of the difference of two coefficients."""
        v = self.covariance
        return float(np.sqrt(max(0.0, v[i, i] + v[j, j] - 2 * v[i, j])))


@dataclass
class Moments:
    """What ridge needs of a set of rows."""

    columns: list[tuple]
    xx: np.ndarray
    x1: np.ndarray
    xy: np.ndarray
    n: float
    y: float
    yy: float

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.xx - other.xx, self.x1 - other.x1, self.xy - other.xy, self.n - other.n, self.y - other.y, self.yy - other.yy)


def with_home(df: DataFrame, is_home: str, name: str = "home") -> DataFrame:
    """df with a list column for the home side: one member on it, none away. As a block with a penalty of 0 it is the design's home column."""
    return df.withColumn(name, F.when(F.col(is_home), F.array(F.lit(1).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))


def moments(df: DataFrame, blocks: dict[str, str], y: str, fold: str | None = None) -> dict:
    """Moments by fold from one pass; its size is that of the members' pairs, not of the rows. They come as columns of numbers. No rows give no folds."""
    of_fold = F.col(fold) if fold else F.lit(0)
    entries = kept(gram(df, blocks, y, fold))
    value = F.col(y).cast("double")
    totals = {r["fold"]: r for r in df.groupBy(of_fold.alias("fold")).agg(F.count("*").alias("n"), F.sum(value).alias("y"), F.sum(value * value).alias("yy")).collect()}
    columns = sorted(tuple(r) for r in entries.where("block_i = block_j AND member_i = member_j").select("block_i", "member_i").distinct().collect())
    places = df.sparkSession.createDataFrame([(b, m, k) for k, (b, m) in enumerate(columns)], T.StructType([*entries.select("block_i", "member_i").schema.fields, T.StructField("k", T.IntegerType())])) if columns else None
    out = {k: Moments(columns, np.zeros((len(columns),) * 2), np.zeros(len(columns)), np.zeros(len(columns)), float(r["n"]), float(r["y"] or 0), float(r["yy"] or 0)) for k, r in totals.items()}
    if places is None:
        return out
    named = entries.join(F.broadcast(places.toDF("block_i", "member_i", "i")), ["block_i", "member_i"]).join(F.broadcast(places.toDF("block_j", "member_j", "j")), ["block_j", "member_j"])  # the design's columns
    for key, m in out.items():
        own = named.where(F.col("fold").eqNullSafe(F.lit(key))).select("i", "j", "n", "y").toArrow()
        i, j, n, s = (own.column(c).to_numpy() for c in ("i", "j", "n", "y"))
        m.xx[i, j] = m.xx[j, i] = n
        m.x1[i[i == j]], m.xy[i[i == j]] = n[i == j], s[i == j]
    return out


def solve_ridge(m: Moments, penalties: dict[str, float]) -> Ridge:
    """Coefficients of y less its mean on the member indicators, with a penalty for each block."""
    mean = m.y / m.n
    penalty = np.diag([penalties[b] for b, _ in m.columns])
    system, target = m.xx + penalty, m.xy - mean * m.x1
    try:
        inverse = np.linalg.inv(system)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(system)
    beta = inverse @ target
    hat = inverse @ m.xx
    df = float(np.trace(hat))
    rss = (m.yy - m.n * mean**2) - 2 * beta @ target + beta @ m.xx @ beta
    variance = max(0.0, rss) / max(1.0, m.n - df - 1)
    return Ridge(m.columns, beta, variance * hat @ inverse, mean, variance, df, float(np.linalg.cond(system)))


def select_penalties(by_fold: dict, grid: list[float], blocks: tuple[str, str], free: tuple[str, ...] = ()) -> tuple[dict[str, float], float]:
    """The pair of penalties with the least held-out squared error, from the folds' moments alone: no further pass over rows.

    A pair costs one Cholesky solve a fold. Blocks in `free` have no penalty.
    """
    folds = list(by_fold.values())
    total = folds[0]
    for f in folds[1:]:
        total = Moments(total.columns, total.xx + f.xx, total.x1 + f.x1, total.xy + f.xy, total.n + f.n, total.y + f.y, total.yy + f.yy)
    trained = [(total - held, held) for held in folds]
    best: tuple[dict[str, float], float] | None = None
    for a in grid:
        for b in grid:
            penalties, error = {blocks[0]: a, blocks[1]: b} | dict.fromkeys(free, 0.0), 0.0
            diagonal = np.array([penalties[block] for block, _ in total.columns])
            for fit, held in trained:
                mean = fit.y / fit.n
                beta = _solve(fit.xx + np.diag(diagonal), fit.xy - mean * fit.x1)
                error += held.yy - 2 * mean * held.y + held.n * mean**2 - 2 * beta @ (held.xy - mean * held.x1) + beta @ held.xx @ beta
            if best is None or error / total.n < best[1] - 1e-15:
                best = (penalties, error / total.n)
    return best


def _solve(system: np.ndarray, target: np.ndarray) -> np.ndarray:
    try:
        lower = np.linalg.cholesky(system)
    except np.linalg.LinAlgError:  # a member that a fold lacks, without penalty
        return np.linalg.lstsq(system, target, rcond=None)[0]
    return np.linalg.solve(lower.T, np.linalg.solve(lower, target))


_EFFECTS = "block string, member long, effect double, error double, low double, high double, includes_zero boolean"


def effects(df: DataFrame, blocks: dict[str, str], y: str, penalties: dict[str, float], scale: float = 100.0) -> DataFrame:
    """(block, member, effect, error, low, high, includes_zero) per `scale` rows: one pass, one small solve. No rows give no effects."""
    found = moments(df, blocks, y)
    if not found:
        return df.sparkSession.createDataFrame([], _EFFECTS)
    fit = solve_ridge(found[0], penalties)
    errors = np.sqrt(np.maximum(np.diag(fit.covariance), 0)) * scale
    z = NormalDist().inv_cdf(0.975)
    rows = [(b, int(m), float(c * scale), float(e), float(c * scale - z * e), float(c * scale + z * e), bool(abs(c * scale) <= z * e)) for (b, m), c, e in zip(fit.columns, fit.coefficients, errors, strict=True)]
    return df.sparkSession.createDataFrame(rows, _EFFECTS)


def member_totals(effects: DataFrame, own: str, other: str) -> DataFrame:
    """(member, offence, defence, total, spread) from effects: points allowed count against a member, so the defence's sign turns; spread is how far the two are apart."""
    of = lambda block, name, sign: effects.where(F.col("block") == block).select("member", (sign * F.col("effect")).alias(name))
    both = of(own, "offence", 1).join(of(other, "defence", -1), "member", "full").na.fill(0.0, ["offence", "defence"])
    return both.withColumn("total", F.col("offence") + F.col("defence")).withColumn("spread", F.abs(F.col("offence") - F.col("defence")))


def choice_design(df: DataFrame, mixes: list[str], drivers: dict[str, tuple[int, ...]], n_choices: int, name: str = "x", without: tuple[str, ...] = ()) -> DataFrame:
    """df with a flat design of n_choices * p numbers: a constant for each choice but the first, one term for each column of shares (their log
    ratios to the usual ones, an array of n_choices), and one for each driver, its column's value on the choices that it acts on.

    Terms named in `without` are zero everywhere, which leaves the others where they are: a model without them.
    """
    cells = []
    for k in range(n_choices):
        cells += [F.lit(1.0 if k == j else 0.0) for j in range(1, n_choices)]
        cells += [F.lit(0.0) if m in without else F.coalesce(F.get(m, F.lit(k)).cast("double"), F.lit(0.0)) for m in mixes]
        cells += [F.coalesce(F.col(d).cast("double"), F.lit(0.0)) if k in on and d not in without else F.lit(0.0) for d, on in drivers.items()]
    return df.withColumn(name, F.array(*cells))


def choice_step(df: DataFrame, design: str, chosen: str, theta: np.ndarray, n_choices: int, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Negative log likelihood, gradient, information and rows of a conditional logit at theta, as sums of per-partition sums.

    design is a flat array of n_choices * p numbers a row, chosen the index of the choice made, weight how many equal rows a row stands for.
    """
    p = len(theta)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, info, n = 0.0, np.zeros(p), np.zeros((p, p)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, n_choices, p)
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            u = x @ theta
            u -= u.max(axis=1, keepdims=True)
            q = np.exp(u)
            q /= q.sum(axis=1, keepdims=True)
            loss -= w @ np.log(np.maximum(q[np.arange(len(y)), y], 1e-300))
            mean = np.einsum("nk,nkp->np", q, x)
            grad += w @ (mean - x[np.arange(len(y)), y])
            info += np.einsum("n,nk,nkp,nkq->pq", w, q, x, x, optimize=True) - (mean * w[:, None]).T @ mean
            n += w.sum()
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(2 + p + p * p), pa.int64()), "v": np.concatenate(([loss, n], grad, info.ravel()))})

    rows = df.select(F.col(design).cast("array<double>"), F.col(chosen).cast("int"), (F.col(weight) if weight else F.lit(1)).cast("double")).mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(2 + p + p * p)
    for r in rows:
        v[r["at"]] = r["v"]
    return v[0], v[2 : 2 + p], v[2 + p :].reshape(p, p), int(v[1])


def fit_choice(df: DataFrame, design: str, chosen: str, p: int, n_choices: int, l2: float = 1e-4, free: tuple[int, ...] = (), steps: int = 30, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(theta, covariance, mean loss) of a conditional logit by Newton steps; parameters in `free` have no penalty. One pass over rows a step, which are kept between steps."""
    df = kept(df.select(design, chosen, *([weight] if weight else [])))
    theta, penalty = np.zeros(p), np.array([0.0 if i in free else l2 for i in range(p)])
    for _ in range(steps):
        loss, grad, info, n = choice_step(df, design, chosen, theta, n_choices, weight)
        if not n:
            return theta, np.zeros((p, p)), 0.0
        system = info + np.diag(n * penalty + 1e-12)
        step = np.linalg.solve(system, grad + n * penalty * theta)
        if np.abs(step).max() < 1e-9:
            break
        theta = theta - step
    else:
        raise ValueError(f"no convergence in {steps} steps")
    inverse = np.linalg.inv(system)
    return theta, inverse @ info @ inverse, loss / n


def sign_audit(names: list[str], theta: np.ndarray, errors: np.ndarray, expected: list[int]) -> list[tuple[str, float, float, str]]:
    """agrees, DISAGREES, or indeterminate where the 95 % interval spans 0."""
    z = NormalDist().inv_cdf(0.975)
    verdict = lambda t, e, s: "indeterminate" if abs(t) <= z * e else "agrees" if t * s > 0 else "DISAGREES"
    return [(n, float(t), float(e), verdict(t, e, s)) for n, t, e, s in zip(names, theta, errors, expected, strict=True)]


def power_analysis(n: int, sd: float, alpha: float = 0.05, power: float = 0.8) -> tuple[float, float]:
    """(minimum detectable effect, half-width of the interval) of a mean of n; infinite below two."""
    if n < 2:
        return float("inf"), float("inf")
    q, error = NormalDist().inv_cdf, sd / n**0.5
    return (q(1 - alpha / 2) + q(power)) * error, q(1 - alpha / 2) * error
