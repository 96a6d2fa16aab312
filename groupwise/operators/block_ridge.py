"""Two-penalty ridge by components: members who never meet, not even through others, don't share an equation, so each component is solved where its pairs are.

Rows are dealt by component and their pairs summed there; a task solves a component's small dense systems, and the driver gets sums alone. Blocks of few columns
(a home column meets everybody) are a border: they are left out when components are sought and joined on exactly, by their Schur complement. A component of more than LARGEST
columns is no small system; callers then take the solvers that hold vectors of the design's columns.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.operators.models import _EFFECTS
from groupwise.operators.sequence import kept

#: Columns of a component that a task solves at once, and of a block that is a border.
LARGEST, BORDER = 512, 8


def _components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b), a <= b: component is the least node it reaches. Each round hangs larger neighbours, then smaller ones, on the least."""
    loops = links.where("a = b").select(F.col("a").alias("node")).distinct()
    edges = kept(links.where("a < b").distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while before != (now := state(edges)):
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("least").alias("a"), F.col("other").alias("b")).distinct()
        joined = large.join(large.groupBy("b").agg(F.min("a").alias("least")), "b")
        edges = kept(joined.select(F.col("least").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("least").alias("a"), "b")).where("a <> b").distinct())
    found = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return found.union(loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


class Parts:
    """A design's moments by component and fold: entries (component, fold, block_i, member_i, block_j, member_j, n, y), upper triangle, and totals by fold.

    `largest` is the number of columns of the largest component. Entries are summed only when they are asked for, so a caller can look at that first.
    """

    def __init__(self, df: DataFrame, blocks: dict[str, str], y: str, fold: str | None = None, bordered: bool = False):
        value, lists = F.col(y).cast("double"), [f"list_{name}" for name in blocks]
        listed = df.select((F.col(fold) if fold else F.lit(0)).alias("fold"), value.alias("y"), *(F.array_sort(F.array_distinct(c)).alias(name) for name, c in zip(lists, blocks.values(), strict=True)))
        df = kept(listed.groupBy("fold", *lists).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy")))  # rows of equal lists are summed first
        cell = lambda name: lambda m: F.struct(F.lit(name).alias("block"), m.cast("long").alias("member"))
        cells = {name: F.transform(f"list_{name}", cell(name)) for name in blocks}
        self.spark, self.blocks = df.sparkSession, blocks
        totals = df.groupBy("fold").agg(*(F.sum(c).alias(c) for c in ("n", "y", "yy"))).collect()  # a row a fold
        self.totals = {r["fold"]: (float(r["n"]), float(r["y"] or 0), float(r["yy"] or 0)) for r in totals}
        self.border = [name for name, c in cells.items() if bordered and df.select(F.explode(c).alias("c")).distinct().limit(BORDER + 1).count() <= BORDER]
        own = [cells[name] for name in blocks if name not in self.border]
        rows = df.select("fold", "n", "y", F.concat(*cells.values()).alias("cells"), (F.array_sort(F.concat(*own)) if own else F.array().cast("array<struct<block:string,member:long>>")).alias("own"))
        first = F.get("own", F.lit(0))
        found = _components(rows.select(first.alias("a"), F.explode("own").alias("b")))
        self.columns = kept(found)
        self.largest = int(self.columns.groupBy("component").count().agg(F.max("count")).first()[0] or 0)
        self._rows = rows.withColumn("first", first).join(self.columns.withColumnRenamed("node", "first"), "first", "left").select("component", "fold", "n", "y", "cells")
        self._entries: DataFrame | None = None

    @property
    def entries(self) -> DataFrame:
        if self._entries is None:
            dealt = self._rows.repartition("component")  # a component's rows come together, so its pairs are summed without being shuffled
            pairs = dealt.select("component", "fold", "n", "y", "cells", F.explode("cells").alias("i")).select("component", "fold", "n", "y", "i", F.explode("cells").alias("j")).where("i <= j")
            keys = [F.col("i.block").alias("block_i"), F.col("i.member").alias("member_i"), F.col("j.block").alias("block_j"), F.col("j.member").alias("member_j")]
            self._entries = kept(pairs.groupBy("component", "fold", *keys).agg(F.sum("n").cast("double").alias("n"), F.sum("y").alias("y")))
        return self._entries

    def within(self, f: Callable[[list[tuple], np.ndarray, np.ndarray], pd.DataFrame], schema: str, folds: list) -> DataFrame:
        """f(columns, xx, xy) of each component: xx is (fold, column, column), xy (fold, column), folds in the order of `folds`; border columns, if any, come last."""
        border, number = tuple(self.border), {k: i for i, k in enumerate(folds)}

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            bi, mi, bj, mj = (pdf[c].tolist() for c in ("block_i", "member_i", "block_j", "member_j"))
            columns = sorted(set(zip(bi, mi, strict=True)) | set(zip(bj, mj, strict=True)), key=lambda c: (c[0] in border, c))
            at = {c: k for k, c in enumerate(columns)}
            s = np.array([number[None if pd.isna(k) else k] for k in pdf["fold"].tolist()], int)
            i, j = (np.array([at[c] for c in zip(b, m, strict=True)], int) for b, m in ((bi, mi), (bj, mj)))
            xx, xy = np.zeros((len(folds), len(columns), len(columns))), np.zeros((len(folds), len(columns)))
            xx[s, i, j] = xx[s, j, i] = pdf["n"].to_numpy()
            d = i == j
            xy[s[d], i[d]] = pdf["y"].to_numpy()[d]
            return f(columns, xx, xy)

        return self.entries.groupBy("component").applyInPandas(run, schema)


def _inverse(m: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m)


def _solved(parts: Parts, penalties: dict[str, float], covariance: bool = False) -> tuple[DataFrame, float] | None:
    """(columns, residual variance): (block, member, beta, reach) of each column, reach times the variance being its squared error; with `covariance`, reach is a map of
    the component's columns' covariances. None without rows or columns.
    """
    if not parts.totals or not sum(t[0] for t in parts.totals.values()):
        return None
    n, y, yy = (sum(t[k] for t in parts.totals.values()) for k in range(3))
    mean, border, folds = y / n, tuple(parts.border), sorted(parts.totals, key=lambda f: (f is None, f))
    edge = parts.entries.where(F.col("block_i").isin(*border) & F.col("block_j").isin(*border)).groupBy("block_i", "member_i", "block_j", "member_j").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect() if border else []  # pairs of border columns
    names = sorted({(r["block_i"], r["member_i"]) for r in edge})
    q, place = len(names), {c: k for k, c in enumerate(names)}
    system, right = np.diag([penalties[b] for b, _ in names]).reshape(q, q).astype(float), np.zeros(q)
    for r in edge:
        i, j = place[r["block_i"], r["member_i"]], place[r["block_j"], r["member_j"]]
        system[i, j] += r["n"]
        if i == j:
            right[i] = r["y"] - mean * r["n"]
        else:
            system[j, i] += r["n"]
    d_edge = np.array([penalties[b] for b, _ in names])

    def own(columns: list[tuple], xx: np.ndarray, xy: np.ndarray):
        """Own columns, penalties, inverse, target, inverse times the border (p, q)."""
        m, v = xx.sum(axis=0), xy.sum(axis=0)
        p = sum(b not in border for b, _ in columns)
        d = np.array([penalties[b] for b, _ in columns[:p]])
        h = np.zeros((p, q))
        for k, c in enumerate(columns[p:]):
            h[:, place[c]] = m[:p, p + k]
        inverse = _inverse(m[:p, :p] + np.diag(d))
        return columns[:p], d, inverse, v[:p] - mean * np.diag(m)[:p], inverse @ h, h

    # what the components take from the border's system, and the border's part of the squares
    weighed = np.zeros((q, q))
    if q:
        def taken(columns, xx, xy):
            _, d, _, t, w, h = own(columns, xx, xy)
            v = np.concatenate(((h.T @ w).ravel(), w.T @ t, (w.T @ (d[:, None] * w)).ravel()))
            return pd.DataFrame({"at": np.arange(len(v)), "v": v})

        v = np.zeros(2 * q * q + q)
        for r in parts.within(taken, "at long, v double", folds).groupBy("at").agg(F.sum("v").alias("v")).collect():  # numbers of the border alone
            v[r["at"]] = r["v"]
        system, right, weighed = system - v[: q * q].reshape(q, q), right - v[q * q : q * q + q], v[q * q + q :].reshape(q, q)
    schur = _inverse(system) if q else np.zeros((0, 0))
    edge_beta = schur @ right

    def columns_of(columns, xx, xy):
        names_, d, inverse, t, w, _ = own(columns, xx, xy)
        beta = inverse @ t - w @ edge_beta
        turn = schur @ w.T  # (q, p): what a column's unit right side does to the border, sign turned
        diagonal = np.diag(inverse) + np.einsum("pq,qp->p", w, turn)
        squares = (d[:, None] * inverse**2).sum(axis=0) + 2 * np.einsum("jk,jq,qk->k", d[:, None] * inverse, w, turn) + np.einsum("qk,qr,rk->k", turn, weighed + np.diag(d_edge), turn)
        out = pd.DataFrame({"block": [b for b, _ in names_], "member": [m for _, m in names_], "beta": beta, "reach": diagonal - squares, "lost": d * diagonal, "fitted": beta * t + d * beta**2})
        if covariance:
            v = inverse - inverse @ (d[:, None] * inverse)
            out["others"] = [[{"block": b, "member": m, "v": float(x)} for (b, m), x in zip(names_, line, strict=True)] for line in v]
        return out

    if covariance and q:
        raise ValueError("covariances with a border are not kept")
    schema = "block string, member long, beta double, reach double, lost double, fitted double"
    found = kept(parts.within(columns_of, schema + (", others array<struct<block:string,member:long,v:double>>" if covariance else ""), folds))
    sums = found.agg(F.count("*").alias("p"), F.sum("lost").alias("lost"), F.sum("fitted").alias("fitted")).first()
    # the border's own columns: (block inverse) S^-1, and squares of -W S^-1 and S^-1
    edge_squares = np.diag(schur @ (weighed + np.diag(d_edge)) @ schur) if q else np.zeros(0)
    lost = float(sums["lost"] or 0) + float(d_edge @ np.diag(schur)) if q else float(sums["lost"] or 0)
    raw = right + v[q * q : q * q + q] if q else right  # the border's own targets
    fitted = float(sums["fitted"] or 0) + float(edge_beta @ raw + d_edge @ edge_beta**2)
    variance = max(0.0, yy - n * mean**2 - fitted) / max(1.0, n - (sums["p"] + q - lost) - 1)
    if q:
        edges = parts.spark.createDataFrame([(b, m, float(e), float(s - x)) for (b, m), e, s, x in zip(names, edge_beta, np.diag(schur), edge_squares, strict=True)], "block string, member long, beta double, reach double")
        return found.select("block", "member", "beta", "reach").unionByName(edges), variance
    return found, variance


def effects(parts: Parts, penalties: dict[str, float], scale: float) -> DataFrame:
    """(block, member, effect, error, low, high, includes_zero) per `scale` rows."""
    solved = _solved(parts, penalties)
    if solved is None:
        return parts.spark.createDataFrame([], _EFFECTS)
    found, variance = solved
    z = NormalDist().inv_cdf(0.975)
    both = found.select("block", "member", (F.col("beta") * scale).alias("effect"), (F.sqrt(F.greatest(F.col("reach") * variance, F.lit(0.0))) * scale).alias("error"))
    return both.withColumns({"low": F.col("effect") - z * F.col("error"), "high": F.col("effect") + z * F.col("error"), "includes_zero": F.abs("effect") <= z * F.col("error")})


def select_penalties(parts: Parts, grid: list[float], blocks: tuple[str, str]) -> tuple[dict[str, float], float]:
    """The pair of penalties with the least held-out squared error over the folds, the first of equals. A component solves its own systems; a number a pair comes to the driver."""
    folds = sorted(parts.totals, key=lambda f: (f is None, f))
    n, y, yy = (np.array([parts.totals[f][k] for f in folds]) for k in range(3))
    mean = (y.sum() - y) / np.maximum(n.sum() - n, 1)  # of the rows trained on
    cells = [(a, b) for a in grid for b in grid]

    def errors(columns, xx, xy):
        first = np.array([b == blocks[0] for b, _ in columns])
        x1 = np.einsum("fpp->fp", xx)
        train, held_t = xx.sum(axis=0) - xx, xy - mean[:, None] * x1
        target = (xy.sum(axis=0) - xy) - mean[:, None] * (x1.sum(axis=0) - x1)
        out = []
        for a, b in cells:
            beta = np.linalg.solve(train + np.diag(np.where(first, a, b)), target[:, :, None])[:, :, 0]
            out.append(float(-2 * (beta * held_t).sum() + np.einsum("fp,fpq,fq->", beta, xx, beta)))
        return pd.DataFrame({"cell": np.arange(len(cells)), "v": out})

    found = parts.within(errors, "cell int, v double", folds).groupBy("cell").agg(F.sum("v").alias("v")).collect()  # a row a pair of penalties
    same = float((yy - 2 * mean * y + n * mean**2).sum())
    by_cell = np.full(len(cells), same)
    for r in found:
        by_cell[r["cell"]] += r["v"]
    by_cell /= n.sum()
    best = 0
    for i, e in enumerate(by_cell):
        if e < by_cell[best] - 1e-15:
            best = i
    return {blocks[0]: cells[best][0], blocks[1]: cells[best][1]}, float(by_cell[best])


def running_fits(parts: Parts, blocks: tuple[str, str], penalties: tuple[float, float], buckets: list[int]) -> DataFrame:
    """(bucket, member, offence, defence, error): each member's effect for and against, and their difference's error, from the folds (0, 1, ...) up to the bucket's place in `buckets`."""
    folds = list(range(len(buckets)))
    n, y, yy = (np.cumsum([parts.totals.get(f, (0.0, 0.0, 0.0))[k] for f in folds]) for k in range(3))
    mean = y / np.maximum(n, 1)

    def fits(columns, xx, xy):
        d = np.array([penalties[0] if b == blocks[0] else penalties[1] for b, _ in columns])
        xx, xy, out = xx.cumsum(axis=0), xy.cumsum(axis=0), []
        members = sorted({m for _, m in columns})
        g = np.array([[(1.0 if b == blocks[0] else -1.0) * (m == who) for who in members] for b, m in columns])
        for s in folds:
            inverse = _inverse(xx[s] + np.diag(d))
            t = xy[s] - mean[s] * np.diag(xx[s])
            beta = inverse @ t
            reach = inverse @ g
            v = np.einsum("pk,pk->k", reach, xx[s] @ reach)
            of = lambda sign: (beta[:, None] * (g == sign)).sum(axis=0)
            used, fitted = float((1 - d * np.diag(inverse)).sum()), float(beta @ t + d @ beta**2)
            out.append(pd.DataFrame({"place": s, "member": members, "offence": of(1.0), "defence": of(-1.0), "v": v, "used": [used] + [0.0] * (len(members) - 1), "fitted": [fitted] + [0.0] * (len(members) - 1)}))
        return pd.concat(out)

    found = kept(parts.within(fits, "place int, member long, offence double, defence double, v double, used double, fitted double", folds))
    sums = {r["place"]: r for r in found.groupBy("place").agg(F.sum("used").alias("used"), F.sum("fitted").alias("fitted")).collect()}  # a row a bucket
    variance = [max(0.0, yy[s] - n[s] * mean[s] ** 2 - sums[s]["fitted"]) / max(1.0, n[s] - sums[s]["used"] - 1) if s in sums and n[s] else 0.0 for s in folds]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    each = found.groupBy("place", "member").agg(*(F.sum(c).alias(c) for c in ("offence", "defence", "v")))
    return each.select(of(buckets).alias("bucket"), "member", "offence", "defence", F.sqrt(F.greatest(F.col("v") * of(variance), F.lit(0.0))).alias("error"))


def swap_contrasts(parts: Parts, scenarios: DataFrame, blocks: tuple[str, str], penalties: dict[str, float]) -> DataFrame:
    """(out, in, off, def, variance) of the distinct pairs of scenarios: effects of `in` less those of `out` by block, and the variance of their difference.

    Null, unknown and equal members add nothing. Covariances stay a table of the components' pairs.
    """
    pairs = scenarios.select("out", "in").distinct()
    same = pairs.select("out", "in", *(F.lit(0.0).alias(c) for c in ("off", "def", "variance")))
    solved = _solved(parts, penalties, covariance=True)
    if solved is None:
        return same
    found, variance = solved
    term = lambda block, who, sign: F.struct(F.lit(block).alias("block"), F.col(who).alias("member"), F.lit(sign).alias("sign"))
    terms: Column = F.array(term(blocks[0], "in", 1.0), term(blocks[0], "out", -1.0), term(blocks[1], "in", -1.0), term(blocks[1], "out", 1.0))
    each = pairs.where(~F.col("out").eqNullSafe(F.col("in"))).select("out", "in", terms.alias("terms")).select("out", "in", "terms", F.inline("terms"))
    met = each.join(found.select("block", "member", "beta", "others"), ["block", "member"])
    reach = F.aggregate(F.filter("others", lambda o: F.exists("terms", lambda t: (t["block"] == o["block"]) & (t["member"] == o["member"]))), F.lit(0.0), lambda s, o: s + o["v"] * F.aggregate(F.filter("terms", lambda t: (t["block"] == o["block"]) & (t["member"] == o["member"])), F.lit(0.0), lambda a, t: a + t["sign"]))
    of = lambda block, sign: F.sum(F.when(F.col("block") == block, sign * F.col("sign") * F.col("beta")).otherwise(0.0))
    sums = met.withColumn("reach", F.col("sign") * reach).groupBy("out", "in").agg(of(blocks[0], 1).alias("off"), of(blocks[1], -1).alias("def"), (F.sum("reach") * variance).alias("variance"))
    return same.select("out", "in").join(sums.withColumnsRenamed({"out": "__out", "in": "__in"}), F.col("out").eqNullSafe(F.col("__out")) & F.col("in").eqNullSafe(F.col("__in")), "left").drop("__out", "__in").na.fill(0.0, ["off", "def", "variance"])
