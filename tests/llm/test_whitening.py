"""Whitening against numpy's eigensolver and exact sums, with odd vectors."""

import math
from collections import defaultdict

import numpy as np
import pytest

from groupwise.llm import whitening


def planted(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_those_of_the_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((17, 17))
    a = a + a.T
    if seed % 2:
        np.fill_diagonal(a, 0.0)  # pivots of two rows
    e = np.linalg.eigvalsh(a)
    assert whitening.inertia(a) == (sum(e > 0), sum(e < 0), 0)
    assert all(whitening.above(a, s) == sum(e > s) for s in rng.uniform(-9, 9, 20))
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0, 3) and whitening.inertia(np.zeros((0, 0))) == (0, 0, 0)


@pytest.mark.parametrize(
    "values",
    [[9, 5, 3, 2, 1, 0.5], [1, 1, 1, 1, 1, 1], [5, 5, 5, 1, 1, 0], [3, 2, 0, 0, 0], [7], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.1], [1e8, 1, 1e-3, 1e-9], [2.0, 2.0 + 1e-13, 1, 1], list(np.linspace(1, 1.01, 40))],
)
def test_leading_pairs(values):
    v = planted(values)
    got = whitening.leading(v, 4)
    want = sorted(values, reverse=True)[:4]
    want = [w for w in want if w > 1e-12 * max(values)]
    assert len(got.values) == len(want)
    scale = max(values)
    assert np.allclose(got.values, want, rtol=0, atol=1e-12 * scale)
    assert np.abs(got.vectors @ got.vectors.T - np.eye(len(want))).max() < 1e-12
    assert np.abs(v @ got.vectors.T - got.vectors.T * got.values).max() < 1e-12 * scale
    assert all(a < i <= b for i, (a, b) in enumerate(got.certified, 1))


def brute(rows):
    """(id, component) -> (n, deviation, whitened up to sign, explained) by numpy's own solver."""
    usable = [(i, [math.floor(256 * float(c)) for c in x]) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array(distinct, float) - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    out = defaultdict(list)
    for i, x in usable:
        for k in range(min(4, len(x))):
            if e[-1 - k] > 1e-9 * e[-1]:
                white = (np.array(x) - np.array([s / n for s in sums])) @ q[:, -1 - k] / e[-1 - k] ** 0.5
                out[i, k + 1].append((n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), white, e[-1 - k] / np.trace(v)))
    return out


def check(rows, got):
    want = brute(rows)
    mine = defaultdict(list)
    for r in got:
        mine[r.vec_id, r.component].append((r.n, r.deviation, r.whitened, r.explained))
        assert 0 <= r.identity_error < 1e-9
    assert {k: len(v) for k, v in mine.items()} == {k: len(v) for k, v in want.items()}
    for component in {k for _, k in want}:
        keys = [key for key in want if key[1] == component]
        pairs = [(a, b) for key in keys for a, b in zip(sorted(mine[key], key=lambda t: abs(t[2])), sorted(want[key], key=lambda t: abs(t[2])))]
        sign = 1 if sum(a[2] * b[2] for a, b in pairs) > 0 else -1
        for a, b in pairs:
            assert a[:2] == b[:2] and abs(a[2] - sign * b[2]) < 1e-9 * max(1, abs(b[2])) and abs(a[3] - b[3]) < 1e-12


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(rows, whitening.op11_whitening(spark, sf_dir).collect())


ODD = "vec_id long, embedding array<float>, n long, component int, x string"


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = good + good[:7] + [(200 + i, good[0][1]) for i in range(30)] + [(None, good[1][1]), (None, [-0.0] * 5), (300, [0.0] * 5)] + bad
    others = [(400, [1.0, 2.0]), (401, []), (402, [3e38, 0.0, 0.0, 0.0, 0.0])]  # another length; beyond a long
    frame = spark.createDataFrame([(i, x, 1, 2, "clash") for i, x in rows + others], ODD).repartition(5)
    check(rows, whitening.whiten(frame).collect())
    assert whitening.whiten(frame.where("false")).collect() == []
    assert whitening.whiten(frame.where("vec_id = 100")).collect() == []
    assert whitening.whiten(frame.where("vec_id = 5")).collect() == []  # one vector has no variance
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in whitening.whiten(two).collect()) == [(1, 1, 2, 131072, 1.0, 1.0), (2, 1, 2, 131072, 1.0, 1.0)]


def test_deviations_beyond_longs_are_null_and_those_below_exact(spark):
    big = float(2**40)
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [big / 256, 2.0]), (4, [float(2**22), 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    xs = {1: (0, 0), 2: (0, 256), 3: (2**40, 512), 4: (2**30, 0)}
    sums = [sum(c) for c in zip(*xs.values())]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(x, sums)) for i, x in xs.items()}
    assert got == {i: w if w < 2**63 else None for i, w in want.items()}


def test_halves_add_up(spark):
    rows = [[2**62, -(2**62), -1], [2**62, -(2**62), -1], [2**62 - 1, 5, 2**32]] * 3
    assert whitening._exact_sums(spark.createDataFrame([(r,) for r in rows], "x array<long>"), 3) == (9, [sum(c) for c in zip(*rows)])
