"""Two-penalty ridge on sparse moments: the pairs of members that met stay a DataFrame, and the driver holds vectors of the design's columns.

A product of the moments with some vectors is one pass over the pairs, which are dealt by row and sorted once, so each task ends its rows alone.
Conjugate gradients solve many systems at a time (all folds and penalties). Errors are exact: columns in different components of the graph of pairs
don't meet, so one right side holds a column of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.operators import block_ridge
from groupwise.operators.models import _EFFECTS, gram
from groupwise.operators.sequence import kept

#: Numbers of vectors that a product takes at a time, and of pairs times vectors that a task holds.
CELLS, HELD = 1 << 22, 1 << 20


class Pairs:
    """Moments of member indicators by fold: pairs as rows (fold, i, j, n), both ways, and on the driver each fold's sums by column."""

    def __init__(self, df: DataFrame, blocks: dict[str, str], y: str, fold: str | None = None):
        of_fold = F.col(fold) if fold else F.lit(0)
        value = F.col(y).cast("double")
        self.spark = df.sparkSession
        found = kept(gram(df, blocks, y, fold))
        totals = df.groupBy(of_fold.alias("fold")).agg(F.count("*").alias("n"), F.sum(value).alias("y"), F.sum(value * value).alias("yy")).collect()  # a row a fold
        self.folds = sorted((r["fold"] for r in totals), key=lambda f: (f is None, f))
        by = {r["fold"]: r for r in totals}
        self.n, self.y, self.yy = (np.array([float(by[f][c] or 0) for f in self.folds]) for c in ("n", "y", "yy"))
        same = F.col("block_i").eqNullSafe(F.col("block_j")) & F.col("member_i").eqNullSafe(F.col("member_j"))
        self.columns = sorted(tuple(r) for r in found.where(same).select("block_i", "member_i").distinct().collect())  # the design's columns
        p = self.p = len(self.columns)
        self.x1, self.xy = np.zeros((len(self.folds), p)), np.zeros((len(self.folds), p))
        if not p:
            return
        numbers = self.spark.createDataFrame([(b, m, k) for k, (b, m) in enumerate(self.columns)], T.StructType([*found.select("block_i", "member_i").schema.fields, T.StructField("k", T.IntegerType())]))
        numbered = self.spark.createDataFrame([(f, k) for k, f in enumerate(self.folds)], T.StructType([T.StructField("fold", found.schema["fold"].dataType), T.StructField("f", T.IntegerType())]))
        placed = found.join(F.broadcast(numbered), found["fold"].eqNullSafe(numbered["fold"])).drop("fold")
        placed = placed.join(F.broadcast(numbers.toDF("block_i", "member_i", "i")), ["block_i", "member_i"]).join(F.broadcast(numbers.toDF("block_j", "member_j", "j")), ["block_j", "member_j"]).select("f", "i", "j", F.col("n").cast("double").alias("n"), "y")
        for r in placed.where("i = j").toArrow().to_pylist():  # a row a column and fold
            self.x1[r["f"], r["i"]], self.xy[r["f"], r["i"]] = r["n"], r["y"]
        both = placed.select("f", "i", "j", "n").unionByName(placed.where("i <> j").select("f", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
        self.pairs = kept(both.repartition("i").sortWithinPartitions("i"))

    def _passed(self, shared, row, size: int) -> list[tuple[int, np.ndarray]]:
        """(i, numbers) of row(places, f, j, n, shared) over the pairs; places begin each i's stretch."""
        sent = self.spark.sparkContext.broadcast(shared)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, HELD // size)
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    f, i, j, n = (b.column(c).to_numpy() for c in range(4))
                    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(i[starts]), pa.array([v.tobytes() for v in row(starts, f, j, n, sent.value)], pa.binary())], names=["i", "v"])

        rows = self.pairs.mapInArrow(part, "i int, v binary").toArrow()
        sent.destroy()
        return list(zip(rows.column("i").to_pylist(), rows.column("v").to_pylist(), strict=True))

    def times(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(p, c): column c is the moments of the folds, each taken weights[fold, c] times, by column c of x."""
        out = np.zeros_like(x)
        rows = self._passed((x, weights), lambda starts, f, j, n, s: np.add.reduceat(n[:, None] * s[0][j] * s[1][f], starts, axis=0), x.shape[1])
        for i, v in rows:
            out[i] += np.frombuffer(v)
        return out

    def components(self) -> np.ndarray:
        """For each column the least one that pairs reach from it."""
        label = np.arange(self.p)
        while True:
            new = label.copy()
            for i, v in self._passed(label, lambda starts, f, j, n, s: np.minimum.reduceat(s[j], starts)[:, None].astype(np.int64), 1):
                new[i] = min(new[i], np.frombuffer(v, np.int64)[0])
            while (jumped := new[new]).tolist() != new.tolist():
                new = jumped
            if (new == label).all():
                return label
            label = new

    def solve(self, b: np.ndarray, penalty: np.ndarray, weights: np.ndarray, tolerance: float = 1e-11, most: int = 2000) -> np.ndarray:
        """x with (moments + diag(penalty)) x = b, column by column, by conjugate gradients with the diagonal as preconditioner.

        Columns are worked on in groups of CELLS numbers; those that have converged leave. A column that doesn't within `most` steps is an error.
        """
        x = np.zeros_like(b)
        group = max(1, CELLS // max(self.p, 1))
        for first in range(0, b.shape[1], group):
            on = np.arange(first, min(first + group, b.shape[1]))
            inverse = 1 / np.maximum(self.x1.T @ weights[:, on] + penalty[:, on], 1e-12)
            r = b[:, on].copy()
            scale = np.maximum(np.linalg.norm(r, axis=0), 1e-300)
            z = inverse * r
            d, rz = z.copy(), (r * z).sum(axis=0)
            for _ in range(most):
                open_ = np.linalg.norm(r, axis=0) > tolerance * scale
                if not open_.all():
                    on, inverse, r, scale, z, d, rz = on[open_], inverse[:, open_], r[:, open_], scale[open_], z[:, open_], d[:, open_], rz[open_]
                if not len(on):
                    break
                ad = self.times(d, weights[:, on]) + penalty[:, on] * d
                alpha = rz / np.maximum((d * ad).sum(axis=0), 1e-300)
                x[:, on] += alpha * d
                r -= alpha * ad
                z = inverse * r
                new = (r * z).sum(axis=0)
                d = z + (new / rz) * d
                rz = new
            else:
                raise ArithmeticError(f"no convergence in {most} steps")
        return x


def select_penalties(pairs: Pairs, grid: list[float], blocks: tuple[str, str], free: tuple[str, ...] = ()) -> tuple[dict[str, float], float]:
    """The pair of penalties with the least held-out squared error over the folds, the first of equals; blocks in free have none. All folds and pairs are solved together."""
    k, cells = len(pairs.folds), [(a, b) for a in grid for b in grid]
    systems = [(f, a, b) for a, b in cells for f in range(k)]
    weights = np.array([[0.0 if g == f else 1.0 for f, _, _ in systems] for g in range(k)])
    held = 1 - weights
    mean = (pairs.y @ weights) / np.maximum(pairs.n @ weights, 1)
    target = pairs.xy.T @ weights - mean * (pairs.x1.T @ weights)
    of = {blocks[0]: 1, blocks[1]: 2}
    penalty = np.array([[0.0 if block in free else s[of[block]] for s in systems] for block, _ in pairs.columns]).reshape(pairs.p, len(systems))
    beta = pairs.solve(target, penalty, weights)
    quadratic = np.zeros(len(systems))
    group = max(1, CELLS // max(pairs.p, 1))
    for at in range(0, len(systems), group):
        s = slice(at, at + group)
        quadratic[s] = (beta[:, s] * pairs.times(beta[:, s], held[:, s])).sum(axis=0)
    own = pairs.xy.T @ held - mean * (pairs.x1.T @ held)
    error = pairs.yy @ held - 2 * mean * (pairs.y @ held) + (pairs.n @ held) * mean**2 - 2 * (beta * own).sum(axis=0) + quadratic
    by_cell = error.reshape(len(cells), k).sum(axis=1) / pairs.n.sum()
    best = 0
    for i, e in enumerate(by_cell):
        if e < by_cell[best] - 1e-15:
            best = i
    return {blocks[0]: cells[best][0], blocks[1]: cells[best][1]} | dict.fromkeys(free, 0.0), float(by_cell[best])


def choose_penalties(df: DataFrame, blocks: dict[str, str], y: str, fold: str, grid: list[float]) -> tuple[dict[str, float], float]:
    """select_penalties of the two blocks on rows: by components if none has more than block_ridge.LARGEST columns."""
    parts = block_ridge.Parts(df, blocks, y, fold)
    if parts.largest <= block_ridge.LARGEST:
        return block_ridge.select_penalties(parts, grid, tuple(blocks))
    return select_penalties(Pairs(df, blocks, y, fold), grid, tuple(blocks))


def effects(df: DataFrame, blocks: dict[str, str], y: str, penalties: dict[str, float], scale: float = 100.0) -> DataFrame:
    """(block, member, effect, error, low, high, includes_zero) per `scale` rows, as models.effects, without a matrix on the driver. No rows give no effects.

    Components of up to block_ridge.LARGEST columns are solved where their pairs are; larger ones by conjugate gradients, whose vectors of the design's columns the driver holds.
    """
    parts = block_ridge.Parts(df, blocks, y, bordered=True)
    if parts.largest <= block_ridge.LARGEST:
        return block_ridge.effects(parts, penalties, scale)
    pairs = Pairs(df, blocks, y)
    spark, p = df.sparkSession, pairs.p
    if not p:
        return spark.createDataFrame([], _EFFECTS)
    one = np.ones((1, 1))
    n, mean = pairs.n[0], pairs.y[0] / pairs.n[0]
    d = np.array([penalties[b] for b, _ in pairs.columns])
    target = pairs.xy[0] - mean * pairs.x1[0]
    beta = pairs.solve(target[:, None], d[:, None], one)[:, 0]
    # column k of the inverse is z with M z = e_k; a right side holds a column of each component, at its place there
    label = pairs.components()
    place = np.zeros(p, int)
    seen: dict[int, int] = {}
    for k in range(p):
        place[k] = seen.get(int(label[k]), 0)
        seen[int(label[k])] = place[k] + 1
    rounds = int(place.max()) + 1
    diagonal, squares = np.zeros(p), np.zeros(p)
    group = max(1, CELLS // p)
    for first in range(0, rounds, group):
        of = np.arange(first, min(first + group, rounds))
        b = (place[:, None] == of[None, :]).astype(float)
        z = pairs.solve(b, np.repeat(d[:, None], len(of), axis=1), np.ones((1, len(of))))
        for c, number in enumerate(of):
            mine = np.flatnonzero(place == number)
            owner = dict(zip(label[mine].tolist(), mine.tolist(), strict=True))
            k = np.array([owner.get(x, -1) for x in label.tolist()])  # whose column an entry belongs to
            has = k >= 0
            np.add.at(squares, k[has], (d * z[:, c] ** 2)[has])
            diagonal[mine] = z[mine, c]
    df_used = p - float(d @ diagonal)
    product = pairs.times(beta[:, None], one)[:, 0]
    rss = (pairs.yy[0] - n * mean**2) - 2 * beta @ target + beta @ product
    variance = max(0.0, rss) / max(1.0, n - df_used - 1)
    errors = np.sqrt(np.maximum(variance * (diagonal - squares), 0)) * scale  # z' A z = z_k - z' D z
    q = NormalDist().inv_cdf(0.975)
    rows = [(b, int(m), float(c * scale), float(e), float(c * scale - q * e), float(c * scale + q * e), bool(abs(c * scale) <= q * e)) for (b, m), c, e in zip(pairs.columns, beta, errors, strict=True)]
    return spark.createDataFrame(rows, _EFFECTS)
