"""Ridge by components against the dense solves, and how much of it the driver sees."""

import random

import pytest
from pyspark.sql import functions as F

from groupwise.operators import answers, backtest, block_ridge, models, sparse_ridge

BLOCKS = {"own": "own", "other": "other"}


@pytest.fixture(scope="module")
def rows(spark):
    rnd, out = random.Random(4), []
    for k in range(1500):
        team = rnd.randrange(5)  # teams 0 and 1 share members, the others don't
        pool = range(0, 12) if team < 2 else range(team * 20, team * 20 + 8)
        out.append((k, float(k * 30 // 1500), rnd.sample(pool, 4), rnd.sample([m + 20 for m in pool] if team == 4 else list(pool), 3), rnd.gauss(1, 1), k % 5, k % 2 == 0))
    return spark.createDataFrame(out, "k long, at double, own array<bigint>, other array<bigint>, y double, fold int, is_home boolean").repartition(4).cache()


@pytest.fixture
def no_driver_design(monkeypatch):
    """Solvers that hold a vector or a matrix of the design's columns on the driver fail."""

    def held(*_, **__):
        raise AssertionError("the design's columns came to the driver")

    for module, name in ((sparse_ridge, "Pairs"), (models, "moments"), (answers, "moments"), (backtest, "gram")):
        monkeypatch.setattr(module, name, held)


def table(df):
    return {(r.block, r.member): (r.effect, r.error, r.low, r.high) for r in df.collect()}


@pytest.mark.parametrize("largest", [512, 0])
def test_effects_with_a_border(rows, monkeypatch, largest):
    monkeypatch.setattr(block_ridge, "LARGEST", largest)
    home = models.with_home(rows, "is_home")
    for df, blocks, penalties in ((rows, BLOCKS, {"own": 20.0, "other": 35.0}), (home, {**BLOCKS, "home": "home"}, {"own": 20.0, "other": 35.0, "home": 0.0}), (home, {**BLOCKS, "home": "home"}, {"own": 20.0, "other": 35.0, "home": 7.0})):
        want, got = table(models.effects(df, blocks, "y", penalties)), table(sparse_ridge.effects(df, blocks, "y", penalties))
        assert want.keys() == got.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_effects_keep_the_design_off_the_driver(rows, no_driver_design):
    home = models.with_home(rows, "is_home")
    assert sparse_ridge.effects(home, {**BLOCKS, "home": "home"}, "y", {"own": 20.0, "other": 35.0, "home": 0.0}).count() == sum(rows.select(F.explode(c)).distinct().count() for c in ("own", "other")) + 1


def test_penalties(rows, no_driver_design, monkeypatch):
    got, error = sparse_ridge.choose_penalties(rows, BLOCKS, "y", "fold", [1.0, 30.0, 1000.0])
    monkeypatch.undo()
    best, want = models.select_penalties(models.moments(rows, BLOCKS, "y", "fold"), [1.0, 30.0, 1000.0], ("own", "other"))
    assert got == best and error == pytest.approx(want, abs=1e-9)


def test_swaps(spark, rows, no_driver_design, monkeypatch):
    scenarios = spark.createDataFrame([(1, 1, 1.0, 0.1), (1, 2, 0.5, 0.2), (2, 45, 0.5, 0.0), (None, 3, 1.0, 0.3), (3, 999, 0.7, 0.1), (None, None, 1.0, 0.1), (1, 2, 0.25, 0.0), (80, 100, 0.5, 0.1)], "out long, in long, share double, spread double")
    flat = lambda df: {tuple(r)[:4]: tuple(r)[4:] for r in df.collect()}
    frame = answers.projected_swaps(scenarios, rows, ("own", "other"), "y", (20.0, 35.0))
    got = flat(frame)
    monkeypatch.undo()
    dense = answers.project_swaps(scenarios, models.solve_ridge(models.moments(rows, BLOCKS, "y")[0], {"own": 20.0, "other": 35.0}), ("own", "other"))
    want = flat(dense)
    assert frame.schema.names == dense.schema.names and got.keys() == want.keys() and len(got) == 8
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-7)


def test_fits_before_cut_offs(spark, rows, no_driver_design, monkeypatch):
    cutoffs, members = {0: 7.0, 1: 15.0, 2: 29.0}, [0, 5, 47, 85, 105, 999]
    wanted = spark.createDataFrame([(b, m) for b in cutoffs for m in members], "bucket int, member long")
    got = {(r.bucket, r.member): (r.offence, r.defence, r.error) for r in backtest.effects_before(rows, "at", ("own", "other"), "y", (20.0, 35.0), cutoffs, wanted).collect()}
    monkeypatch.undo()
    want = {(p.bucket, p.member): (p.offence, p.defence, p.error) for p in backtest.fits_before(rows, "at", ("own", "other"), "y", (20.0, 35.0), {b: (c, members) for b, c in cutoffs.items()})}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_no_rows(rows):
    empty = rows.where("false")
    assert sparse_ridge.effects(empty, BLOCKS, "y", {"own": 1.0, "other": 1.0}).count() == 0
