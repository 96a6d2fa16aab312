"""Ridge on sparse moments against the dense solves."""

import random

import numpy as np
import pytest

from groupwise.operators import models, sparse_ridge


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    out = []
    for k in range(1500):
        team = rnd.randrange(4)  # teams 0 and 1 share members, the others don't: three components
        pool = range(0, 12) if team < 2 else range(team * 20, team * 20 + 8)
        own, other = rnd.sample(pool, 4), rnd.sample(pool, 3)
        out.append((k, own, other, rnd.gauss(1 + 0.02 * sum(own) / 20, 1), k % 5, k % 2 == 0))
    return spark.createDataFrame(out, "k long, own array<bigint>, other array<bigint>, y double, fold int, is_home boolean").repartition(4).cache()


BLOCKS = {"own": "own", "other": "other"}


def table(df):
    return {(r.block, r.member): (r.effect, r.error, r.low, r.includes_zero) for r in df.collect()}


def test_effects_and_errors_are_the_dense_ones(rows):
    dense, sparse = (table(f(rows, BLOCKS, "y", {"own": 20.0, "other": 35.0})) for f in (models.effects, sparse_ridge.effects))
    assert dense.keys() == sparse.keys()
    for k, v in dense.items():
        assert sparse[k][:3] == pytest.approx(v[:3], abs=1e-6) and sparse[k][3] == v[3]


def test_a_block_without_penalty(rows):
    home = models.with_home(rows, "is_home")
    dense, sparse = (table(f(home, {**BLOCKS, "home": "home"}, "y", {"own": 20.0, "other": 35.0, "home": 0.0})) for f in (models.effects, sparse_ridge.effects))
    assert all(sparse[k][:2] == pytest.approx(v[:2], abs=1e-6) for k, v in dense.items())


@pytest.mark.parametrize("cells", [1 << 22, 100])
def test_penalties_are_the_dense_ones(rows, monkeypatch, cells):
    monkeypatch.setattr(sparse_ridge, "CELLS", cells)
    grid = [1.0, 30.0, 1000.0] if cells > 100 else [30.0, 1000.0]
    best, error = models.select_penalties(models.moments(rows, BLOCKS, "y", "fold"), grid, ("own", "other"))
    mine, my_error = sparse_ridge.select_penalties(sparse_ridge.Pairs(rows, BLOCKS, "y", "fold"), grid, ("own", "other"))
    assert mine == best and my_error == pytest.approx(error, abs=1e-9)


def test_components_and_products(rows):
    pairs = sparse_ridge.Pairs(rows, BLOCKS, "y", "fold")
    label = pairs.components()
    assert len(set(label.tolist())) == 3
    dense = models.moments(rows, BLOCKS, "y", "fold")
    x, w = np.random.default_rng(0).normal(size=(pairs.p, 3)), np.random.default_rng(1).normal(size=(5, 3))
    want = np.stack([sum(w[f, c] * dense[k].xx @ x[:, c] for f, k in enumerate(pairs.folds)) for c in range(3)], axis=1)
    assert np.allclose(pairs.times(x, w), want)


def test_no_rows(rows):
    assert sparse_ridge.effects(rows.where("false"), BLOCKS, "y", {"own": 1.0, "other": 1.0}).count() == 0
