"""Whitening of embeddings: leading eigenpairs of a covariance by slicing its spectrum.

Bunch and Parlett's LDL' of V - s I has as many positive pivots as V has eigenvalues above s. Bisection by these counts brackets each leading
eigenvalue apart from its neighbours, Rayleigh quotient iteration from the bracket's middle converges cubically, and two more counts, just above and
just below what it found, certify its number. Sums over rows are Spark's; only a matrix of dimensions by dimensions comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.llm.common import field, stored, table

COMPONENTS = 4
#: Steps to a unit of an entry.
SCALE = 256
#: Bytes of a covariance that the driver takes: 8,192 dimensions.
COVARIANCE_BYTES = 1 << 29
#: Numbers of vectors that a task works on at a time.
CELLS = 1 << 20
_EPS = float(np.finfo(float).eps)


# ---- Eigenpairs


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """(positive, negative, zero) eigenvalues of a symmetric matrix, from the pivots of its LDL' with pivots of one and two rows."""
    a = np.array(matrix, dtype=float)
    positive = negative = zero = 0
    alpha = (1 + 17**0.5) / 8
    while (n := len(a)) > 0:
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0.0)
        most = off.max()
        if max(diagonal[p], most) == 0.0:
            return positive, negative, zero + n
        if diagonal[p] >= alpha * most:
            pivot, rest = a[p, p], np.delete(np.arange(n), p)
            positive, negative = positive + (pivot > 0), negative + (pivot < 0)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:
            i, j = divmod(int(off.argmax()), n)
            rest = np.delete(np.arange(n), [i, j])
            positive, negative = positive + 1, negative + 1  # such a pivot's determinant is negative
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_([i, j], [i, j])], columns.T)
    return positive, negative, zero


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v lie above shift."""
    return inertia(v - shift * np.eye(len(v)))[0]


def _solved(v: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """(v - shift)^-1 x; at an eigenvalue the shift is moved by a last digit."""
    for nudge in (0.0, 4 * _EPS, 64 * _EPS):
        try:
            y = np.linalg.solve(v - (shift + nudge * scale) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and y.any():
            return y
    return x


def _unit(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """x across the vectors found before, of length 1."""
    for _ in range(2):
        for f in found:
            x = x - (f @ x) * f
        x = x / max(np.linalg.norm(x), np.finfo(float).tiny)
    return x


def _iterated(v: np.ndarray, low: float, high: float, found: list[np.ndarray], scale: float, seed: int) -> tuple[float, np.ndarray]:
    """The eigenpair between low and high: one inverse iteration with the middle, then Rayleigh quotient iteration as long as its quotient stays inside."""
    middle = (low + high) / 2
    x = _unit(np.random.default_rng(seed).standard_normal(len(v)), found)
    for _ in range(3):
        x = _unit(_solved(v, middle, x, scale), found)
    best = (np.inf, 0.0, x)
    for _ in range(30):
        rho = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - rho * x))
        if residual < best[0] and low <= rho <= high:
            best = (residual, rho, x)
        elif best[0] <= 64 * _EPS * scale:
            break
        x = _unit(_solved(v, rho if low < rho < high else middle, x, scale), found)
    return best[1], best[2]


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, falling, with unit eigenvectors as rows; certified says how many eigenvalues the counts put above and from each."""

    values: np.ndarray
    vectors: np.ndarray
    certified: list[tuple[int, int]]


def leading(v: np.ndarray, k: int) -> Spectrum:
    """The k largest eigenvalues of a positive semidefinite matrix, those that rounding can't tell from 0 left out.

    Equal eigenvalues share a bracket that can't be cut: their vectors are taken one after the other, each across those before. Every sign is
    that which makes a vector's largest entry positive. A number that the counts don't certify is an error.
    """
    d = len(v)
    trace = float(np.trace(v)) if d else 0.0
    if trace <= 0:
        return Spectrum(np.zeros(0), np.zeros((0, d)), [])
    scale = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is larger
    least, nearest, slack = d * _EPS * scale, 8 * _EPS * scale, 64 * _EPS * scale
    k = min(k, above(v, least))
    values, vectors, certified = [], [], []
    low, high = least, scale * (1 + 4 * _EPS)
    known = {low: above(v, low), high: 0}  # eigenvalues above a shift

    def count(shift: float) -> int:
        if shift not in known:
            known[shift] = above(v, shift)
        return known[shift]

    for number in range(1, k + 1):
        # the narrowest bracket known so far that has eigenvalue `number` inside
        low = max(s for s, c in known.items() if c >= number)
        high = min(s for s, c in known.items() if c < number)
        while count(low) - count(high) > 1 and high - low > nearest:
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        while True:
            value, x = _iterated(v, low - nearest, high + nearest, vectors, scale, number)
            counts = (above(v, value + slack), above(v, value - slack))
            if np.linalg.norm(v @ x - value * x) <= slack and counts[0] < number <= counts[1]:
                break
            if high - low <= nearest:
                raise ArithmeticError(f"eigenvalue {number} is not certified: {counts}")
            for _ in range(8):  # the middle was nearer to another one
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) >= number else (low, middle)
        x = x * np.sign(x[np.abs(x).argmax()])
        values.append(value)
        vectors.append(x)
        certified.append((int(counts[0]), int(counts[1])))
    return Spectrum(np.array(values), np.array(vectors).reshape(len(values), d), certified)


# ---- Sums over rows


def _usable(c: Column) -> Column:
    """Whether a vector and all its entries are there, finite, and within a long once scaled."""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float(1 << 63)))


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): floor(256 * c) of each entry as a long; rows whose vector is null or holds null or non-finite entries go."""
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    return df.select(F.col(id_col), F.col(vector_col)).where(_usable(F.col(vector_col))).select(F.col(id_col).alias("id"), x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Stretches of batches with their vectors as rows of longs."""
    for batch in batches:
        step = max(1, CELLS // max(d, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def _summed(vectors: DataFrame, d: int, of, size: int) -> np.ndarray:
    """Sum over rows of of(x), an array of `size` doubles for a block of vectors: one partial sum a partition, then Spark's sum by place."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _blocks(batches, 0, d):
            total += of(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size), pa.int64()), "v": total})

    out = np.zeros(size)
    rows = vectors.mapInArrow(part, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
    return out


def _exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) in whole numbers: halves of 32 bits are summed apart, so no partition's sum overflows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for block, x in _blocks(batches, 0, d):
            n, high, low = n + block.num_rows, high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(d + 1), pa.int64()), "high": np.append(high, 0), "low": np.append(low, n)})

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in vectors.mapInArrow(part, "at long, high long, low long").groupBy("at").agg(whole("high"), whole("low")).collect()}
    return rows.get(d, 0), [rows.get(j, 0) for j in range(d)]


def _covariance(vectors: DataFrame, d: int, n: int, mean: np.ndarray) -> np.ndarray:
    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return (centred.T @ centred).ravel()

    v = _summed(vectors, d, products, d * d).reshape(d, d) / n
    return (v + v.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: rows, sums, eigenpairs and how far from the identity its own vectors' covariance is once whitened."""

    n: int
    sums: list[int]
    trace: float
    spectrum: Spectrum
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def axes(self) -> np.ndarray:
        """A row a component: its eigenvector over the root of its eigenvalue."""
        return self.spectrum.vectors / np.sqrt(self.spectrum.values)[:, None]


def fit_whitening(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The fit of distinct vectors (x) of d longs: three passes over them, each of which sends numbers of the dimensions alone."""
    if d * d * 8 > COVARIANCE_BYTES:
        raise ValueError(f"a covariance of {d} dimensions is too large for the driver")
    n, sums = _exact_sums(vectors, d)
    if not n:
        return Whitening(0, sums, 0.0, Spectrum(np.zeros(0), np.zeros((0, d)), []), 0.0)
    mean = np.array([s / n for s in sums])
    v = _covariance(vectors, d, n, mean)
    spectrum = leading(v, components)
    fit = Whitening(n, sums, float(np.trace(v)), spectrum, 0.0)
    k = len(spectrum.values)
    if not k:
        return fit
    axes = fit.axes

    def products(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ axes.T
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    sent = _summed(vectors, d, products, k + k * k) / n
    spread = sent[k:].reshape(k, k) - np.outer(sent[:k], sent[:k])  # whitened means are 0 but for rounding
    return Whitening(n, sums, fit.trace, spectrum, float(np.abs(spread - np.eye(k)).max()))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: the id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors become whole numbers x = floor(256 c); the fit is on the distinct ones, so copies count once however many there are: they are put
    together before the shuffle by Spark's partial aggregation, and written to the shared folder. deviation is exact, and null where it
    is no long. Null vectors, those with null or non-finite entries and those whose 256 c is no long go, and so do vectors of another
    length than most have (ties: the longer). Rows with one id, or none, each have their own result. Components without variance, all of a
    table of equal vectors, can't be whitened and have no rows. An empty table gives an empty result. Only the two columns
    are read, so others may have any name.
    """
    schema = T.StructType([field(df, id_col), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    every = quantized(df, id_col, vector_col)
    distinct = stored(every.select("x").distinct(), "whitening")
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    fit = fit_whitening(distinct.where(F.size("x") == d), d, components)
    k = len(fit.spectrum.values)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    mean, axes, explained = fit.mean, fit.axes, fit.spectrum.values / fit.trace

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2: in longs where none can overflow, else in whole numbers of any size."""
        reach = fit.n * float(np.abs(x).max(initial=0)) + max(map(abs, fit.sums))
        if d * reach * reach < float(1 << 62):
            return (((fit.n * x - np.array(fit.sums, np.int64)) ** 2).sum(axis=1)).tolist()
        exact = [sum((fit.n * c - s) ** 2 for c, s in zip(row, fit.sums, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _blocks(batches, 1, d):
            rows = block.num_rows
            each = np.repeat(np.arange(rows), k)
            deviation = pa.array(deviations(x), pa.int64()).take(pa.array(each))
            columns = [block.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fit.n), pa.int64()), deviation]
            columns += [pa.array(((x - mean) @ axes.T).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, fit.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return every.where(F.size("x") == d).mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
