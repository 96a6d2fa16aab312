"""Examples' surfaces, main teams, assessments, splits held to those seen, boundaries, exposures, result tables and drift, on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupwise.operators import aggregate, answers, features, gates, lineups, metrics, models, reports


def test_example_surfaces(spark):
    shots = [(1, "top_three", True, 3)] * 60 + [(1, "mid_top", False, 2)] * 5 + [(2, "mid_top", True, 2)] * 7 + [(3, "mid_top", True, 2)] * 2
    df = spark.createDataFrame(shots, "who int, zone_id string, made boolean, points int")
    got = {(r.example, r.who, r.zone_id): r for r in aggregate.example_surfaces(df, "who", 50).collect()}
    assert set(got) == {("high volume", 1, "top_three"), ("high volume", 1, "mid_top"), ("low volume", 2, "mid_top")}
    league = (180 + 14 + 4) / 74
    r = got["high volume", 1, "top_three"]
    assert (r.attempts, r.make_rate, r.ppa, r.thin) == (60, 1.0, 3.0, False) and r.vs_league == pytest.approx(3 - league) and got["low volume", 2, "mid_top"].thin
    assert aggregate.example_surfaces(df.where("false"), "who", 50).count() == 0


def test_main_teams_follow_their_cutoffs_and_break_ties_by_season_then_team(spark):
    rows = [([1, 2], 10, 2020, 1), ([1], 10, 2020, 2), ([1], 11, 2021, 3), ([1], 11, 2021, 4), ([1], 12, 2021, 5), ([1, 2], 12, 2021, 6), (None, 13, 2021, 1)]
    cutoffs = [(1, 3), (1, 5), (1, 7), (2, 1), (2, 7), (9, 7), (1, 7)]
    got = aggregate.main_teams(spark.createDataFrame(rows, "own array<int>, team int, season int, at int"), "own", ["team", "season"], "at", spark.createDataFrame(cutoffs, "member int, cutoff int"))
    assert {(r.member, r.cutoff): (r.team, r.season, r.n) for r in got.collect()} == {(1, 3): (10, 2020, 2), (1, 5): (11, 2021, 2), (1, 7): (12, 2021, 2), (2, 7): (12, 2021, 1)}


def test_assessments(spark):
    asked = spark.createDataFrame([(1, "a", [1, 2]), (2, "new", [1, 2]), (3, "b", [3, 1, 9]), (4, "a", [])], "request int, key string, members array<int>")
    seen = spark.createDataFrame([("a", 250), ("b", 10)], "key string, possessions int")
    got = {r.request: r for r in aggregate.assess(asked, seen, spark.createDataFrame([(1, 120), (2, 100), (3, 29)], "member int, n int")).collect()}
    assert (got[1].tier, got[1].counterfactual, got[1].shortfall, got[1].possessions, got[1].min_attempts) == ("reportable", False, [], 250, 100)
    assert (got[2].tier, got[2].counterfactual, got[2].possessions) == ("directional", True, 0)
    assert (got[3].tier, got[3].shortfall, got[3].min_attempts) == ("refused", [3, 9], 0)
    assert got[4].tier == "refused" and got[4].min_attempts == 0


def test_seen_only(spark):
    rows = [("g0", "a", 1), ("g1", "a", 2), ("g0", "b", 3), ("g0", "b", 4), (None, "c", 5), ("g1", "c", 6), ("thin", "d", 7), ("g1", "d", 8), ("g1", None, 9)]
    folds = spark.createDataFrame([("g0", 0), ("g1", 1)], "g string, fold int")
    got = metrics.seen_only(spark.createDataFrame(rows, "g string, who string, row int"), folds, "g", "who")
    assert {(r.row, r.fold) for r in got.collect()} == {(1, 0), (2, 1), (6, 1), (8, 1)}


def test_boundaries(spark):
    rows = [([1, 2], [2, 1], False), ([1, 2], [1, 3], True), ([1, 2], None, True), (None, [1], None), ([4], [4], None), ([1], [2], False)]
    df = spark.createDataFrame(rows, "own array<int>, told array<int>, vague boolean")
    got = features.boundary_summary(df, "own", "told", "vague").first()
    assert tuple(got) == (6, 4, 0.5, 0.5, 0.5)
    assert tuple(features.boundary_summary(df.where("false"), "own", "told", "vague").first())[:4] == (0, 0, 0.0, 0.0)


def test_exposures_and_the_minutes_part(spark):
    rows = [([1, 2], "x")] * 3 + [([2, 3], "x")] + [([4], "y")] * 5
    got = answers.exposures(spark.createDataFrame([(1, "x"), (2, "x"), (4, "x"), (1, "z")], "out int, team string"), spark.createDataFrame(rows, "own array<int>, team string"), "own", "team", 0.5, 0.25)
    assert {(r.out, r.team): (r.share, r.spread) for r in got.collect()} == {(1, "x"): (0.375, 0.1875), (2, "x"): (0.5, 0.25), (4, "x"): (0.0, 0.0), (1, "z"): (0.0, 0.0)}
    rnd = np.random.default_rng(5)
    lists = [(rnd.choice(9, 5, replace=False).tolist(), rnd.choice(9, 5, replace=False).tolist(), float(rnd.normal())) for _ in range(300)]
    fit = models.solve_ridge(models.moments(spark.createDataFrame(lists, "a array<bigint>, b array<bigint>, y double"), {"a": "a", "b": "b"}, "y")[0], {"a": 5.0, "b": 5.0})
    plain, wide, same = (answers.project_swaps(spark.createDataFrame([row], "out long, in long, share double, spread double"), fit, ("a", "b")).first() for row in ((1, 2, 0.5, 0.0), (1, 2, 0.5, 0.3), (1, 1, 0.5, 0.3)))
    minutes = abs(plain.net_delta) / 0.5 * 0.3
    assert plain.minutes_part == 0 and wide.net_delta == plain.net_delta and wide.error == pytest.approx(math.hypot(plain.error, minutes))
    assert wide.minutes_part == pytest.approx(minutes**2 / wide.error**2) and wide.high - wide.low > plain.high - plain.low and (same.error, same.minutes_part) == (0.0, 0.0)


def test_result_table(spark):
    rows = [("s", "full", "log_loss", 0.5, 9), ("s", "full", "brier", 0.2, 9), ("s", "base", "log_loss", 0.625, 9), ("s", "alone", "log_loss", 0.7, 9), ("t", "full", "log_loss", 0.5, 4)]
    df = spark.createDataFrame(rows, "split string, model string, metric string, value double, n int")
    got = {(r.split, r.model): r for r in reports.result_table(df, {"full": "base"}, ["split"], ["log_loss", "brier"]).collect()}
    r = got["s", "full"]
    assert (r.n, r.log_loss, r.brier, r.against, r.gain, r.verdict) == (9, 0.5, 0.2, "base", 0.2, "+20.000% vs base")
    assert [got[k].verdict for k in (("s", "base"), ("s", "alone"), ("t", "full"))] == [None] * 3 and got["s", "base"].brier is None


def test_critical_values():
    got = reports.critical_values()
    assert got["critical_value"] == pytest.approx(1.2815515655446004) and got["omnibus_critical_value"] == pytest.approx(3.218875824868201) and got["omnibus_critical_value"] == pytest.approx(lineups.OMNIBUS_CRITICAL, abs=1e-6)


def test_drift_by_class(spark):
    names = ["log_loss", "ece", "three_resolution", "skill", "recession"]
    now = spark.createDataFrame([(n, 1.0) for n in names], "metric string, value double")
    moved = lambda by: [r.metric for r in gates.drift(now, now.withColumn("value", F.col("value") + by), ["metric"], "value", gates.drift_tolerance(F.col("metric"))).orderBy("metric").collect()]
    assert moved(5e-7) == [] and moved(5e-4) == ["log_loss", "recession"] and moved(5e-3) == sorted(names)
