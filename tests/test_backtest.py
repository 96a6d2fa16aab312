"""The back-test against refits from the rows, team changes by brute force, and the placebo arm."""

import random
from collections import defaultdict

import numpy as np
import pytest

from groupwise.operators import backtest


def possessions(seed=3, n=3000, members=24):
    """Rows in which blocks of six members change teams at block-wise times."""
    rnd, rows = random.Random(seed), []
    strength = [rnd.gauss(0, 0.3) for _ in range(members)]
    for k in range(n):
        at, block, foe = float(k * 48 // n), rnd.randrange(4), rnd.randrange(4)
        own = sorted(rnd.sample(range(block * 6, block * 6 + 6), 5))
        other = [1000 + m for m in rnd.sample(range(foe * 6, foe * 6 + 6), 5)]
        team = block + (at >= 20 + 3 * block)
        points = max(0, round(rnd.gauss(1.1 + sum(strength[m] for m in own) / 5, 1)))
        rows.append((k, int(at // 24), at, team, (team + 1 + k % 3) % 5, own, other, points))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    found = possessions()
    return found, spark.createDataFrame(found, "game_id long, season long, at double, team long, opponent long, own array<bigint>, other array<bigint>, points long").repartition(4).cache()


def refit(rows, cutoff, penalties):
    early = [r for r in rows if r[2] < cutoff]
    columns = sorted({("own", m) for r in early for m in r[5]} | {("other", m) for r in early for m in r[6]})
    x = np.zeros((len(early), len(columns)))
    for i, r in enumerate(early):
        for b, ms in (("own", r[5]), ("other", r[6])):
            for m in ms:
                x[i, columns.index((b, m))] = 1
    y = np.array([r[7] for r in early], float)
    penalty = np.diag([penalties[0] if b == "own" else penalties[1] for b, _ in columns])
    inverse = np.linalg.inv(x.T @ x + penalty)
    beta = inverse @ x.T @ (y - y.mean())
    residual = y - y.mean() - x @ beta
    df = np.trace(inverse @ x.T @ x)
    return columns, beta, residual @ residual / (len(y) - df - 1) * inverse @ x.T @ x @ inverse


def test_each_bucket_s_fit_is_that_of_its_rows(rows):
    found, frame = rows
    cutoffs = {0: (14.0, [0, 1, 7]), 1: (22.0, [2, 20, 23, 555]), 2: (40.5, [5])}
    got = {(p.bucket, p.member): p for p in backtest.fits_before(frame, "at", ("own", "other"), "points", (50.0, 80.0), cutoffs)}
    assert len(got) == 8
    for b, (cutoff, members) in cutoffs.items():
        columns, beta, covariance = refit(found, cutoff, (50.0, 80.0))
        for m in members:
            at = [columns.index(c) if c in columns else None for c in (("own", m), ("other", m))]
            g = np.zeros(len(beta))
            for i, s in zip(at, (1.0, -1.0)):
                if i is not None:
                    g[i] = s
            p = got[b, m]
            assert p.offence == pytest.approx(beta[at[0]] if at[0] is not None else 0.0, abs=1e-9) and p.error == pytest.approx(np.sqrt(g @ covariance @ g), abs=1e-9)


def test_blocked_substitution():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((150, 150))
    a = a @ a.T + 150 * np.eye(150)
    lower = np.linalg.cholesky(a)
    v = rng.standard_normal((150, 3))
    assert np.allclose(backtest._back(lower, v), np.linalg.solve(a, v), atol=1e-12) and np.allclose(backtest._back(lower, v[:, 0]), np.linalg.solve(a, v[:, 0]), atol=1e-12)
    assert np.allclose(backtest._inverse_diagonal(lower, 64), np.diag(np.linalg.inv(a)), atol=1e-14)


def brute_changes(ratings, cutoffs, least):
    out = {}
    for season, cutoff in set(cutoffs):
        by = defaultdict(lambda: ([], []))
        for s, team, at, value in ratings:
            if s == season:
                by[team][at >= cutoff].append(value)
        change = {t: (np.mean(b), np.mean(a)) for t, (b, a) in by.items() if len(b) >= least and len(a) >= least}
        for t, (b, a) in change.items():
            others = [y - x for u, (x, y) in change.items() if u != t]
            control = np.mean(others) if others else 0.0
            out[season, cutoff, t] = (len(by[t][0]), b, len(by[t][1]), a, control, a - b - control)
    return out


def test_team_changes_against_brute_force(spark):
    rnd = random.Random(1)
    ratings = [(s, t, float(s * 24 + rnd.randrange(24)), rnd.gauss(0, 5)) for s in range(3) for t in range(5) for _ in range(rnd.randrange(2, 20))] + [(7, 1, float(i), 1.0 * i) for i in range(8)]
    cutoffs = [(s, float(s * 24 + c)) for s in range(3) for c in (0, 5, 5, 11, 12, 23)] + [(7, 4.0), (9, 1.0)]
    got = backtest.team_changes(spark.createDataFrame(ratings, "season long, team long, at double, value double"), spark.createDataFrame(cutoffs, "season long, cutoff double"), 2).collect()
    want = brute_changes(ratings, cutoffs, 2)
    assert len(got) == len(want)
    for r in got:
        assert (r.n_before, r.before, r.n_after, r.after, r.control, r.did) == pytest.approx(want[r.season, r.cutoff, r.team])
    assert want[7, 4.0, 1][4] == 0.0  # a team alone has no control


def test_backtest(spark, rows):
    found, frame = rows
    from pyspark.sql import functions as F

    from groupwise.operators.aggregate import moves as changes_of

    games = {}
    for r in found:
        games.setdefault((r[1], r[3], r[2]), []).append(r[7])
    ratings = spark.createDataFrame([(s, t, at, float(np.mean(p))) for (s, t, at), p in games.items()], "season long, team long, at double, value double")
    each = frame.select(F.explode("own").alias("member"), "at", "game_id", "team")
    moved = changes_of(each, "member", ["at", "game_id"], "team", 30).select("member", F.col("to_team").alias("team"), F.floor(F.col("cutoff") / 24).alias("season"), "cutoff", "n_after")
    got = backtest.run_backtest(frame, ratings, moved, "at", ("own", "other"), "points", (50.0, 80.0), "team", "season", n_buckets=3, least_games=2, incumbent=50).collect()
    real, placebo = ([r for r in got if r.arm == arm] for arm in ("move", "placebo"))
    assert real and placebo and all(r.projected == 0 and r.error == 0 for r in placebo)
    first = {b: min(r.cutoff for r in real if r.bucket == b) for b in {r.bucket for r in real}}
    sizes = {}
    for r in found:
        sizes[r[3], r[1]] = sizes.get((r[3], r[1]), 0) + 1
    after = {(r.member, r.team): r.n_after for r in moved.collect()}
    for r in real:
        columns, beta, _ = refit(found, first[r.bucket], (50.0, 80.0))
        net = 100 * (beta[columns.index(("own", r.member))] - 0.0)
        assert r.share == pytest.approx(min(1.0, after[r.member, r.team] / sizes[r.team, r.season])) and r.projected == pytest.approx(r.share * net, abs=1e-6)
    assert not {(r.bucket, r.member) for r in placebo} & {(r.bucket, r.member) for r in real}
    want = brute_changes([tuple(r) for r in ratings.collect()], [(r.season, r.cutoff) for r in got], 2)
    for r in got:
        n_before, before, n_after, later, _, did = want[r.season, r.cutoff, r.team]
        assert (r.games_before, r.games_after) == (n_before, n_after) and (r.observed, r.did) == pytest.approx((later - before, did))
    empty = backtest.run_backtest(frame, ratings, moved.where("false"), "at", ("own", "other"), "points", (50.0, 80.0), "team", "season")
    assert empty.count() == 0
