"""Operators on small hand-made tables: fixtures, identities, planted effects and order independence."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.functions import columns as C
from groupwise.operators import aggregate, answers, conversion, events, features, gates, metrics, models, narratives, plays, presence, priors, reports, retrieval, sequence
from groupwise.plans import queries
from groupwise.sources import tables


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


# ---- Columns


def test_clocks_and_ids(spark):
    rows = [("12:34",), ("0:05",), ("x:10",), ("12",), ("1:2:3",), (None,), ("",)]
    got = values(spark, rows, "c string", C.clock_seconds(F.col("c")), C.minutes_seconds(F.col("c")))
    assert got == [(754, 754), (5, 5), (None, None), (None, 0), (None, 0), (None, 0), (None, 0)]
    ids = [(" 22300061 ",), ("12345678901",), ("1",)]
    assert values(spark, ids, "i string", C.padded_id(F.col("i"))) == [("0022300061",), ("12345678901",), ("0000000001",)]
    assert values(spark, [("0022300061",), ("0029900001",), ("22300061",)], "i string", C.season_of(F.col("i"))) == [(2023,), (2099,), (None,)]
    assert values(spark, [(2023,), (1999,)], "y int", C.season_label(F.col("y"))) == [("2023-24",), ("1999-00",)]


def test_zones(spark):
    points = [(-220, 50, "corner_three_left"), (220, 92, "corner_three_right"), (-230, 100, "wing_three"), (0, 240, "top_three"), (0, 40, "restricted_area"), (80, 190, "paint_non_ra"), (150, 90, "mid_baseline"), (150, 100, "mid_wing"), (90, 200, "mid_top"), (219, 10, "mid_baseline")]
    got = values(spark, points, "x int, y int, z string", C.zone(F.col("x"), F.col("y")), "z")
    assert all(a == b for a, b in got)


def test_group_keys(spark):
    rows = [([5, 3, 1, 2, 4],), ([1, 2, 3, 4, 5],), ([1, 2, 3, 4],), (None,), ([1, 1, 2, 3, 4],), ([0, 1, 2, 3, 4],)]
    got = values(spark, rows, "g array<bigint>", C.group_key(F.col("g")), C.group_fault(F.col("g")))
    assert got[0] == got[1] and got[0][0] and got[0][1] is None
    assert [g[1] for g in got[2:]] == ["wrong size", "missing", "repeated member", "not a positive id"]
    assert got[2][0] is None
    swap = values(spark, [([1, 2, 3], [1, 2, 4]), ([1, 2, 3], [1, 4, 5])], "a array<int>, b array<int>", C.one_for_one(F.col("a"), F.col("b")))
    assert tuple(swap[0][0]) == (3, 4) and swap[1][0] is None


def test_shares_and_forms(spark):
    got = values(spark, [([1.0, 2.0, 1000.0],), ([0.0, 0.0, 0.0],)], "u array<double>", C.softmax(F.col("u")))
    assert got[0][0][2] == pytest.approx(1) and got[1][0] == pytest.approx([1 / 3] * 3)
    m = [[2.0, 0.5], [0.5, 1.0]]
    assert values(spark, [([1.0, 2.0],)], "v array<double>", C.quadratic_form(F.col("v"), m)) == [(8.0,)]
    wald = values(spark, [(1.0, 2.0, 2.0, 0.5, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0)], "a double, b double, p double, q double, r double", C.wald_2(*map(F.col, "abpqr")))
    assert wald[0][0] == pytest.approx(float(np.array([1, 2]) @ np.linalg.inv(np.array(m)) @ np.array([1, 2]))) and wald[1][0] is None


# ---- Sequences


def test_asof_against_a_loop(spark):
    rnd = random.Random(4)
    left = [(i, rnd.randrange(4), rnd.randrange(50)) for i in range(200)] + [(999, None, 5)]
    right = [(j, rnd.randrange(4), rnd.randrange(50)) for j in range(60)]
    got = sequence.asof_join(spark.createDataFrame(left, "i int, g int, t int"), spark.createDataFrame(right, "j int, g int, s int"), ["g"], "t", "s", ["j"], within=6, tie="j")
    for i, g, t, j, matched in got.select("i", "g", "t", "j", "matched").collect():
        before = [(s, k) for k, h, s in right if h == g and s <= t and g is not None]
        want = max(before)[1] if before and t - max(before)[0] <= 6 else None
        assert (j, matched) == (want, want is not None)
    assert got.count() == len(left)


def test_stints(spark):
    rows = [(1, 720, "a", 1), (1, 700, "a", 2), (1, 700, "b", 3), (1, 700, "c", 4), (1, 300, "a", 5)]
    df = spark.createDataFrame(rows, "period int, clock int, five string, n int")
    got = sequence.stints(df, ["period"], "clock", "n", ["five"], C.period_length(F.col("period"))).orderBy("stint_index")
    assert [(r.five, r.start, r.end, r.stint_index) for r in got.collect()] == [("a", 720, 700, 0), ("c", 700, 300, 1), ("a", 300, 0, 2)]


def test_intervals_keep_one_match(spark):
    spans = spark.createDataFrame([(1, 700, 500, 0), (1, 500, 0, 1), (1, 720, 690, 2)], "g int, start int, end int, k int")
    points = spark.createDataFrame([(1, 695), (1, 500), (1, 0), (2, 100)], "g int, at int")
    got = sequence.interval_join(points, spans, ["g"], "at", "start", "end", "k")
    assert sorted((r.at, r.k) for r in got.collect()) == [(500, 1), (695, 0)]
    twice = sequence.interval_join(points.union(points), spans, ["g"], "at", "start", "end", "k")
    assert sorted((r.at, r.k) for r in twice.collect()) == [(500, 1), (500, 1), (695, 0), (695, 0)]
    assert sequence.interval_join(points.where("false"), spans, ["g"], "at", "start", "end", "k").count() == 0


def test_row_numbers_and_bins_need_no_single_task(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(30), i) for i in range(1003)]
    df = spark.createDataFrame(rows, "p int, i int").repartition(7)
    numbered = {r.i: r.row for r in sequence.row_numbers(df, "p", "i").collect()}
    assert [numbered[i] for _, i in sorted(rows)] == list(range(1003))
    sizes = sorted((r.bin, r["count"]) for r in sequence.equal_bins(df, 10, "p", "i").groupBy("bin").count().collect())
    assert sizes == [(b, 101 if b < 3 else 100) for b in range(10)]


def test_tie_bands(spark):
    got = values(spark, [([5.0, 4.8, 4.6, 4.2, 1.0],), ([],)], "x array<double>", sequence.tie_bands(F.col("x"), lambda a, b: F.abs(a - b) > 0.5))
    assert got == [([1, 1, 1, 1, 2],), ([],)]


# ---- Presence


def replayed(start, rows):
    """Contradictions of a group's rows (clock, member, kind), second by second."""
    there, bad = set(start), 0
    for at in sorted({r[0] for r in rows}, reverse=True):
        of = lambda *kinds, at=at: [m for c, m, k in rows if c == at and k in kinds]
        outs, ins, acts = of("OUT", "EJECT"), of("IN"), of("EV")
        bad += len(outs) - len(set(outs) & there)
        left = there - set(outs)
        bad += len(ins) - len(set(ins) - left)
        after = left | set(ins)
        bad += sum(m not in there | after for m in acts) + max(0, len(after) - presence.SIZE)
        there = after
    return bad


def best_group(rows):
    """The rule of starting_groups, by trying all groups."""
    ordered = sorted(rows, key=lambda r: (-r[0], rows.index(r)))
    first = {}
    for _, m, k in ordered:
        first.setdefault(m, k)
    sure, every = sorted(m for m, k in first.items() if k != "IN"), sorted(first)
    pool = sure if len(sure) >= presence.SIZE else every
    if len(sure) != presence.SIZE and not presence.SIZE <= len(pool) <= presence.CANDIDATES:
        return None, "UNDERDETERMINED", 0, 0
    tried = {g: replayed(g, rows) for g in itertools.combinations(pool, presence.SIZE) if len(sure) > presence.SIZE or set(sure) <= set(g)}
    least = min(tried.values())
    clean = [g for g, bad in tried.items() if bad == 0]
    if len(sure) == presence.SIZE:
        return sure, "REPAIRED" if least else "EXACT", least, 1
    if clean:
        return list(max(clean)), "SOLVED" if len(clean) == 1 else "AMBIGUOUS", 0, len(clean)
    return list(min(g for g, bad in tried.items() if bad == least)), "REPAIRED", least, 0


def solved(spark, periods):
    rows = [(g, c, e, m, k) for g, facts in enumerate(periods) for e, (c, m, k) in enumerate(facts)]
    found = presence.starting_groups(spark.createDataFrame(rows, "g int, clock int, e int, m string, k string"), ["g"], "clock", "e", "m", "k").collect()
    return {r.g: (r.members, r.status, r.n_violations, r.n_solutions) for r in found}


def test_starting_groups(spark):
    five = [(700, m, "EV") for m in "abcde"]
    swap = [*five, (400, "a", "OUT"), (400, "f", "IN"), (400, "a", "EV"), (300, "f", "EV")]
    gone = [*five, (300, "a", "OUT"), (200, "a", "EV")]
    hidden = [*five[:4], (500, "f", "IN"), (500, "e", "OUT")]
    four = [*five[:4], (500, "x", "IN"), (500, "a", "OUT")]
    got = solved(spark, [five, swap, gone, hidden, four, five[:3], [(700, m, "EV") for m in "abcdef"]])
    assert got[0] == got[1] == (list("abcde"), "EXACT", 0, 1)
    assert got[2][1:3] == ("REPAIRED", 1)
    assert got[3][:2] == (list("abcde"), "EXACT")
    assert got[4][1] == "REPAIRED" and set("abcd") <= set(got[4][0])
    assert got[5][1] == "UNDERDETERMINED"
    assert got[6][1:] == ("REPAIRED", 1, 0)


def test_costs_add_up_to_a_replay(spark):
    draw = random.Random(4)
    periods = [sorted(((draw.randrange(6), draw.choice("abcdefgh"), draw.choice(["IN", "OUT", "EV", "EV", "EJECT"])) for _ in range(draw.randrange(5, 25))), reverse=True) for _ in range(80)]
    got = solved(spark, periods)
    assert {g: got[g] for g in range(80)} == {g: best_group(rows) for g, rows in enumerate(periods)}
    assert {x[1] for x in got.values()} >= {"REPAIRED", "UNDERDETERMINED"}


def test_claims_of_raw_rows(spark):
    rows = [(8, None, 1, 4, 2, 4, 0, 0), (6, 11, 1, 4, 2, 5, 3, 4), (6, 1, 1, 4, 2, 5, 3, 4), (9, None, 1, 4, 2, 4, 3, 4), (1, None, 1, 4, 2, 3, 3, 4), (11, None, 7, 5, 0, 0, 0, 0), (2, None, 1, 6, 2, 4, 3, 5)]
    df = spark.createDataFrame(rows, "event_type int, action_type int, player1 long, type1 int, player2 long, type2 int, player3 long, type3 int").withColumn("i", F.monotonically_increasing_id())
    got = sorted((r.member, r.side, r.kind) for r in presence.claims(df, ["i"]).collect())
    assert got == sorted([(1, 4, "OUT"), (2, 4, "IN"), (1, 4, "EV"), (2, 5, "EV"), (3, 4, "EV"), (1, 4, "EV"), (7, 5, "EJECT"), (3, 5, "EV")])


def test_starting_groups_job(spark):
    rows = [(1, 700, e, m, "EV") for e, m in enumerate([1, 2, 3, 4, 5])] + [(2, 700, 0, 9, "IN")]
    got = {r.g: r for r in presence.starting_groups(spark.createDataFrame(rows, "g int, clock int, e int, m long, k string"), ["g"], "clock", "e", "m", "k").collect()}
    assert got[1].members == [1, 2, 3, 4, 5] and got[1].quality == "VALID" and got[2].quality == "QUARANTINED" and got[2].members is None


# ---- Priors and errors


def test_beta_prior_by_moments(spark):
    rnd = np.random.default_rng(0)
    n = rnd.integers(5, 200, 60)
    makes = rnd.binomial(n, rnd.beta(20, 30, 60))
    df = spark.createDataFrame([("z", int(m), int(k)) for m, k in zip(makes, n, strict=True)] + [("few", 3, 10), ("few", 0, 0)], "z string, m int, n int")
    got = priors.shrink_rates(df, "m", "n", ["z"]).collect()
    used = n >= 20
    rates = makes[used] / n[used]
    mean = rates.mean()
    true = max(rates.var(ddof=1) - mean * (1 - mean) / n[used].mean(), 1e-6)
    strength = min(max(mean * (1 - mean) / true - 1, 1), 5000)
    for r in got:
        s, m0 = (strength, mean) if r.z == "z" else (10.0, 0.3)
        assert r.prior_mean == pytest.approx(m0) and r.rate_shrunk == pytest.approx((r.m + m0 * s) / (r.n + s)) and r.shrink_weight == pytest.approx(r.n / (r.n + s))
        assert (r.rate_raw is None) == (r.n == 0)


def test_dirichlet_prior_by_moments(spark):
    rnd = np.random.default_rng(1)
    counts = np.array([rnd.multinomial(rnd.integers(20, 300), rnd.dirichlet([6, 3, 1])) for _ in range(50)])
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([tuple(map(int, c)) for c in counts], "a int, b int, c int")
    total = counts.sum(axis=1)
    mean, used = counts.sum(axis=0) / counts.sum(), total >= 50
    bar = total[used].mean()
    rho = ((counts[used] / total[used][:, None]).var(axis=0, ddof=1) / (mean * (1 - mean) / bar) - 1) / (bar - 1)
    order = np.argsort(rho)
    pooled = rho[order][np.searchsorted(np.cumsum(mean[order]) / mean.sum(), 0.5)]
    got = priors.dirichlet_prior(df, cols).collect()
    assert [r.strength for r in got] == pytest.approx([min(max((1 - pooled) / pooled, 1), 5000)] * 3) and [r["mean"] for r in got] == pytest.approx(mean)
    mixes = priors.shrink_mixes(df, cols).collect()
    assert all(r.mix_a + r.mix_b + r.mix_c == pytest.approx(1) for r in mixes)


def test_clustered_error_is_binomial_for_single_rows(spark):
    rows = [("u", i, i % 3 == 0) for i in range(90)] + [("none", i, False) for i in range(30)] + [("one", 1, True)] * 30
    got = {r.u: r for r in aggregate.clustered_rate_errors(spark.createDataFrame(rows, "u string, g int, hit boolean"), "u", "g", F.col("hit"), 10).collect()}
    assert got["u"].error == pytest.approx((1 / 3 * 2 / 3 / 89) ** 0.5)
    assert got["none"].error == pytest.approx((0.5 / 31 * (1 - 0.5 / 31) / 30) ** 0.5) and "one" not in got


# ---- Models


def test_ridge_recovers_planted_effects_and_folds_add_up(spark):
    rnd = np.random.default_rng(2)
    effect = rnd.normal(0, 1, 20)
    rows = []
    for i in range(4000):
        a, b = rnd.choice(20, 5, replace=False), rnd.choice(20, 5, replace=False)
        rows.append((i, i % 4, a.tolist(), b.tolist(), float(effect[a].sum() + rnd.normal())))
    df = spark.createDataFrame(rows, "i int, f int, a array<bigint>, b array<bigint>, y double")
    blocks = {"a": "a", "b": "b"}
    m = models.moments(df, blocks, "y")[0]
    x = np.zeros((4000, 40))
    for i, _, a, b, _ in rows:
        x[i, a], x[i, 20 + np.array(b)] = 1, 1
    y = np.array([r[4] for r in rows])
    assert np.allclose(m.xx, x.T @ x) and np.allclose(m.xy, x.T @ y) and np.isclose(m.yy, y @ y)
    fit = models.solve_ridge(m, {"a": 3.0, "b": 5.0})
    want = np.linalg.solve(x.T @ x + np.diag([3.0] * 20 + [5.0] * 20), x.T @ (y - y.mean()))
    assert np.allclose(fit.coefficients, want)
    assert np.corrcoef(fit.coefficients[:20], effect)[0, 1] > 0.99
    best, error = models.select_penalties(models.moments(df, blocks, "y", "f"), [1.0, 1e5], ("a", "b"))
    assert best["a"] == 1.0 and 0.9 < error < 1.2
    assert fit.contrast_error(0, 0) == 0


def test_choice_model_recovers_its_parameters(spark):
    rnd = np.random.default_rng(5)
    truth = np.array([0.8, -0.5])
    x = rnd.normal(size=(6000, 4, 2))
    u = x @ truth + rnd.gumbel(size=(6000, 4))
    df = spark.createDataFrame([(v.ravel().tolist(), int(c)) for v, c in zip(x, u.argmax(axis=1), strict=True)], "x array<double>, y int")
    theta, covariance, loss = models.fit_choice(df, "x", "y", 2, 4)
    assert np.allclose(theta, truth, atol=0.1) and (np.diag(covariance) > 0).all() and loss < np.log(4)
    base, grad, info, n = models.choice_step(df, "x", "y", theta, 4)
    step = 1e-5
    for i in range(2):
        moved = theta.copy()
        moved[i] += step
        up = models.choice_step(df, "x", "y", moved, 4)
        assert (up[0] - base) / step == pytest.approx(grad[i] + info[i, i] * step / 2, abs=0.05)
    audit = models.sign_audit(["a", "b", "c"], np.array([1.0, 1.0, 0.1]), np.array([0.1, 0.1, 0.2]), [1, -1, 1])
    assert [a[3] for a in audit] == ["agrees", "DISAGREES", "indeterminate"]
    assert models.power_analysis(1, 1.0) == (float("inf"), float("inf")) and models.power_analysis(100, 10.0)[0] == pytest.approx(2.8016, abs=1e-3)


# ---- Splits, gates, text


def test_splits_do_not_leak(spark):
    df = spark.createDataFrame([(f"g{i:03d}", i % 7) for i in range(100)], "game string, k int")
    folds = {r.game: r.fold for r in metrics.walk_forward(df, "game").collect()}
    assert [folds[f"g{i:03d}"] for i in (0, 39, 40, 54, 55, 99)] == [None, None, 0, 0, 1, 3]
    a, b = df.where("k < 4"), df.where("k > 2")
    assert {r.k for r in metrics.overlap(a, b, "k").collect()} == {3} and {r.k for r in metrics.unseen(a, b, "k").collect()} == {4, 5, 6}
    assert metrics.tested_before(df.where("game < 'g050'"), df.where("game >= 'g050'"), "game").first().ordered


def test_gates_and_contracts(spark):
    df = spark.createDataFrame([(1, 1.0, "a", [1, 2]), (2, float("nan"), None, None), (3, None, "c", [])], "i int, d double, s string, l array<int>")
    report = gates.run_gates(df, [gates.Gate("positive", gates.share(F.col("i") > 0), 1.0), gates.Gate("known", gates.share(F.col("s").isNotNull()), 0.9, blocking=False), gates.Gate("finite", gates.no_bad_numbers(df), 1.0)])
    assert [r.status for r in report.collect()] == ["PASS", "WARN", "FAIL"]
    with pytest.raises(ValueError, match="finite"):
        gates.require(report)
    assert gates.run_gates(df.where("false"), [gates.Gate("any", gates.share(F.col("i") > 0), 1.0)]).first().status == "FAIL"
    assert {r.column: r.null_rate for r in gates.profile(df).collect()} == pytest.approx({"i": 0.0, "d": 0.333333, "s": 0.333333, "l": 0.333333})
    same = gates.fingerprint(df.repartition(3).orderBy(F.desc("i"))).first()
    assert tuple(same) == tuple(gates.fingerprint(df.select("l", "s", "d", "i")).first())
    assert tuple(same) != tuple(gates.fingerprint(df.where("i < 3")).first())
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", float("nan"))], "k string, v double")
    new = spark.createDataFrame([("a", 1.0000001), ("b", 2.1), ("c", float("nan")), ("d", 1.0)], "k string, v double")
    assert {(r.k, r.problem) for r in gates.drift(new, old, ["k"], "v", F.lit(1e-6)).collect()} == {("b", "differs"), ("d", "new")}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red red car"), (3, "blue sky"), (4, None)], "d int, t string")
    asked = spark.createDataFrame([(1, "red fox")], "q int, t string")
    scores = retrieval.bm25(docs, asked.withColumnRenamed("t", "qt"), "d", "t", "q", "qt")
    ranked = retrieval.ranks(scores)
    assert [(r.doc, r.rank) for r in ranked.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    relevant = spark.createDataFrame([(1, 2), (1, 3)], "query int, doc int")
    got = metrics.ranking_metrics(ranked, relevant).first()
    assert (got.recall, got.mrr) == (0.5, 0.5) and got.ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    fused = retrieval.fuse(ranked, ranked).orderBy("doc").collect()
    assert fused[0].score == pytest.approx(2 / 61)


def test_registered_questions_are_whole_items(spark, sf_dir, tmp_path):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    runs = lambda t: {tuple(t[i : i + 8]) for i in range(len(t) - 7)}
    held = {d: runs(t) for d, t in docs.items()}
    relevant = {(i, d) for i, t in items.items() for d in docs if held[d] & runs(t)}
    assert {tuple(r) for r in queries._holding(spark, sf_dir).collect()} == relevant
    scored = {(r.query, r.doc) for r in queries.bm25_scores(spark, sf_dir).collect()}
    assert scored == {(i, d) for i, t in items.items() for d, u in docs.items() if set(t) & set(u)}
    assert {(r.query, r.doc) for r in queries.fused_ranking(spark, sf_dir).collect()} >= scored
    said = [f"w{i}" for i in range(30)]
    spark.createDataFrame([(1, " ".join(said))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    late = [(7, " ".join(["other", *said[12:20]])), (8, " ".join(said[12:19])), (9, "nothing of it")]
    spark.createDataFrame(late, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in queries._holding(spark, str(tmp_path)).collect()] == [(1, 7)]
    assert {r.doc for r in queries.fused_ranking(spark, str(tmp_path)).collect()} == {7, 8}


def test_numbers_are_traced(spark):
    said = spark.createDataFrame([(1, "Made 45% of 120 in Q4, so 0.31 and -7.")], "d int, t string")
    facts = spark.createDataFrame([(1, 0.45), (1, 120.0), (1, 31.0)], "d int, v double")
    got = {r.said: r.traced for r in retrieval.traced_numbers(said, facts, "d", "t", "v").collect()}
    assert got == {"45%": True, "120": True, "0.31": True, "-7": False}
    odd = spark.createDataFrame([(1, "41% per 100 possessions, 41% and 0.41"), (2, "0.41 or 0 out of 5")], "d int, t string")
    facts = spark.createDataFrame([(1, 4100.0), (2, 41.0), (2, 0.0)], "d int, v double")
    got = sorted((r.doc, r.at, r.said, r.traced) for r in retrieval.traced_numbers(odd, facts, "d", "t", "v").collect())
    assert got == [(1, 0, "41%", False), (1, 1, "41%", False), (1, 2, "0.41", False), (2, 0, "0.41", True), (2, 1, "0", True)]


# ---- Sources


def test_partitions_and_manifests(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = spark.createDataFrame([(1, "a", 2021), (1, "b", 2022), (2, "c", 2022)], "id int, name string, season int")
    tables.write_partition(rows, path)
    tables.write_partition(rows.where("season = 2022").withColumn("name", F.lit("z")), path)
    assert sorted(map(tuple, tables.read_partitions(spark, path).select("id", "name", "season").collect())) == [(1, "a", 2021), (1, "z", 2022), (2, "z", 2022)]
    assert tables.read_partitions(spark, path, values=[2021]).count() == 1 and tables.partitions_of(spark, path).count() == 2
    assert sorted((r.id, r.name) for r in tables.earliest_row(rows, "id").collect()) == [(1, "a"), (2, "c")]
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    assert tables.read_optional(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_optional(spark, str(tmp_path / "none"), schema, required=True)
    (tmp_path / "raw.csv").write_text("id,v\n0012,3\n")
    assert tables.read_raw_csv(spark, str(tmp_path / "raw.csv")).first().id == "0012"
    assert tables.manifest(spark, str(tmp_path / "*.csv")).first().bytes == 12
    entries = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, fetched_at int, sha string")
    assert tables.latest_entries(entries).first().sha == "b"
    assert tables.as_json(spark.createDataFrame([(1, float("nan"))], "a int, b double")).first().json == '{"a":1,"b":null}'


# ---- Answers


def test_masking_and_tiers(spark):
    rows = [("a", "reportable", 2.0), ("b", "directional", -2.0), ("c", "refused", 1.0), ("d", "directional", 0.0)]
    df = spark.createDataFrame(rows, "k string, tier string, v double")
    got = {r.k: (r.v, r.direction) for r in answers.masked(df, "tier", ["v"], "v").collect()}
    assert got == {"a": (2.0, "gain"), "b": (None, "loss"), "d": (None, "flat")}
    worst = values(spark, [("reportable", "refused"), ("directional", "reportable")], "a string, b string", answers.worse_tier(F.col("a"), F.col("b")))
    assert worst == [("refused",), ("directional",)]
    assert values(spark, [(1,), (5,)], "x int", answers.warnings(small=F.col("x") < 3, odd=F.col("x") % 2 == 1)) == [(["small", "odd"],), (["odd"],)]


def test_choice_scores_follow_the_softmax(spark):
    design = [0.0, 1.0, 1.0, 0.0, 0.5, 0.5]
    got = answers.choice_scores(spark.createDataFrame([(design, 1)], "x array<double>, y int"), "x", [1.0, -1.0], [2.0, 3.0, 1.0])
    u = np.exp([-1.0, 1.0, 0.0])
    row = got.first()
    assert row.mix == pytest.approx((u / u.sum()).tolist()) and row.per_100 == pytest.approx(100 * (u / u.sum()) @ [2, 3, 1])
    scores = answers.choice_metrics(got, "mix", "y", 3).first()
    assert scores.log_loss == pytest.approx(-np.log(u[1] / u.sum())) and scores.top_1 == 1.0


def test_a_swap_with_oneself_is_nothing_and_swaps_mirror(spark):
    rnd = np.random.default_rng(8)
    rows = [(rnd.choice(9, 5, replace=False).tolist(), rnd.choice(9, 5, replace=False).tolist(), float(rnd.normal())) for _ in range(400)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, y double")
    fit = models.solve_ridge(models.moments(df, {"a": "a", "b": "b"}, "y")[0], {"a": 5.0, "b": 5.0})
    scenarios = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5), (None, 3, 1.0)], "out long, in long, share double")
    got = {(r.out, r["in"]): r for r in answers.project_swaps(scenarios, fit, ("a", "b")).collect()}
    assert got[1, 1].net_delta == 0 and got[1, 1].error == 0
    assert got[1, 2].net_delta == pytest.approx(-got[2, 1].net_delta) and got[1, 2].error == pytest.approx(got[2, 1].error)
    assert got[None, 3].low < got[None, 3].net_delta < got[None, 3].high


def test_projection_scores(spark):
    got = answers.projection_scores(spark.createDataFrame([(1.0, 2.0), (-1.0, -3.0), (0.0, 1.0), (2.0, -1.0)], "p double, a double"), "p", "a").first()
    assert (got.n, got.mae) == (4, 1.75) and got.signs == pytest.approx(2 / 3) and got.signs_high == 1.0


def test_polygons_and_paths(spark):
    edges = spark.createDataFrame([("t", 0.0, 0.0, 4.0, 0.0), ("t", 4.0, 0.0, 0.0, 4.0), ("t", 0.0, 4.0, 0.0, 0.0)], "a string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, -1.0, 1.0)], "i int, x double, y double")
    assert [r.i for r in answers.in_polygons(points, edges, ["i"], "a").collect()] == [1]
    assert values(spark, [([(0.0, 1.0), (2.0, 3.5)],)], "c array<struct<x:double,y:double>>", answers.outline_path(F.col("c"))) == [("M0.0 1.0 L2.0 3.5 Z",)]


def test_negative_control_moves_lists_together(spark):
    df = spark.createDataFrame([(i, [i], [i * 10]) for i in range(50)], "k int, a array<int>, b array<int>")
    got = answers.shuffled_lists(df, "k", ["a", "b"], 1).collect()
    assert sorted(r.a[0] for r in got) == list(range(50)) and all(r.b[0] == 10 * r.a[0] for r in got) and sum(r.a[0] == r.k for r in got) < 10


def test_table_definitions(spark):
    df = spark.createDataFrame([], "a long, l array<string>, season int")
    assert answers.create_table(df.schema, "t", ["season"]) == "CREATE TABLE t (\n  a BIGINT,\n  l ARRAY<STRING>,\n  season INT\n) USING parquet\nPARTITIONED BY (season)"
    with pytest.raises(ValueError, match="not supported"):
        answers.create_table(spark.createDataFrame([], "d date").schema, "t", [])


def test_ranked_plays_and_comparisons(spark):
    names, theta, prices = ["a", "b", "c"], np.array([1.0, -0.5]), [2.0, 3.0, 1.0]
    cov = np.array([[0.02, 0.005], [0.005, 0.03]])
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(4, 6))
    df = spark.createDataFrame([(i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(x, x[[1, 0, 2, 3]], strict=True))], "i int, l array<double>, r array<double>")

    def worth(v, t):
        u = np.exp(v.reshape(3, 2) @ t)
        return 100 * np.array(prices) * u / u.sum()

    for r in plays.rank_plays(df, "i", "l", names, theta, cov, prices).collect():
        k, step = names.index(r.choice), 1e-6
        grad = np.array([(worth(x[r.request], theta + step * e)[k] - worth(x[r.request], theta - step * e)[k]) / (2 * step) for e in np.eye(2)])
        assert r.value == pytest.approx(worth(x[r.request], theta)[k]) and r.error == pytest.approx((grad @ cov @ grad) ** 0.5, rel=1e-4)
        assert r.band is None or 1 <= r.band <= 3
    got = {(r.request, r.choice): r for r in plays.compare(df, "i", "l", "r", names, theta, cov, prices).collect()}
    for c in [*names, "total"]:
        assert got[0, c].delta == pytest.approx(-got[1, c].delta) and got[0, c].error == pytest.approx(got[1, c].error)
        assert got[2, c].delta == 0 and got[2, c].error == 0 and not got[2, c].separable
    assert got[0, "total"].delta == pytest.approx(sum(got[0, c].delta for c in names)) and sum(got[0, c].delta_share for c in names) == pytest.approx(0)


def test_calibration_slope(spark):
    rnd = np.random.default_rng(4)
    logits = rnd.normal(size=5000)
    y = rnd.random(5000) < 1 / (1 + np.exp(-(0.5 * logits + 0.3)))
    df = spark.createDataFrame([(int(a), float(1 / (1 + np.exp(-b)))) for a, b in zip(y, logits, strict=True)], "y int, p double")
    slope, intercept = metrics.calibration_slope(df, "y", "p")
    assert slope == pytest.approx(0.5, abs=0.08) and intercept == pytest.approx(0.3, abs=0.08)
    assert metrics.calibration_slope(df.where("y = 1"), "y", "p") is None


@pytest.mark.parametrize("tied", [True, False])
def test_bins_put_few_rows_in_order(spark, monkeypatch, tied):
    rnd = random.Random(8)
    rows = [(rnd.choice([0.1, 0.25, 0.5]) if tied else rnd.random(), rnd.randrange(3000) if i % 50 else None, i, rnd.randrange(2)) for i in range(4003)]
    rows += [(1.0, 5, 5000, 1), (0.0, None, 5001, 0)]
    df = spark.createDataFrame(rows, "p double, a long, b int, y int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    seen, number = [], sequence.row_numbers

    def watched(df, *order, name="row"):
        seen.append(df.count())
        return number(df, *order, name=name)

    monkeypatch.setattr(metrics, "row_numbers", watched)
    monkeypatch.setattr(sequence, "row_numbers", watched)

    def expected(p, y, k):
        size, more = divmod(len(p), k)
        ends = np.cumsum([size + (b < more) for b in range(k)])
        return [(len(a), np.mean(a), np.mean(b)) for a, b in zip(np.split(p, ends[:-1]), np.split(y, ends[:-1]), strict=True)]

    got = {r.bin: r for r in metrics.calibration_bins(df, "y", "p", ["a", "b"]).collect()}
    for b, (n, mean_p, mean_y) in enumerate(expected(np.array([r[0] for r in ordered]), np.array([r[3] for r in ordered]), 20)):
        assert got[b].n == n and got[b].mean_p == pytest.approx(mean_p) and got[b].mean_y == pytest.approx(mean_y)
    mixed = df.withColumn("mix", F.array("p", 1 - F.col("p")))
    errors = {r.choice: r for r in metrics.class_errors(mixed, "mix", "y", 2, ["a", "b"]).collect()}
    for choice in (0, 1):
        own = sorted(rows, key=lambda r: (r[0] if choice == 0 else 1 - r[0], r[1] is not None, r[1] or 0, r[2]))
        bins = expected(np.array([r[0] if choice == 0 else 1 - r[0] for r in own]), np.array([float(r[3] == choice) for r in own]), 10)
        assert errors[choice].n == len(rows) and errors[choice].ece == pytest.approx(sum(n * abs(p - y) for n, p, y in bins) / len(rows))
    assert seen and max(seen) < len(rows) / 4
    assert metrics.calibration_bins(df.limit(0), "y", "p", ["a", "b"]).count() == 0
    assert sorted(r.n for r in metrics.calibration_bins(df.limit(7), "y", "p", ["a", "b"]).collect()) == [1] * 7


def test_the_floor_after_each_event(spark):
    rows = [(1, 700, e, m, "EV") for e, m in enumerate([1, 2, 3, 4, 5])] + [(1, 400, 9, 1, "OUT"), (1, 400, 9, 6, "IN"), (2, 700, 0, 9, "IN")]
    df = spark.createDataFrame(rows, "g int, clock int, e int, m long, k string")
    starts = presence.starting_groups(df, ["g"], "clock", "e", "m", "k")
    got = {(r.g, r.e): r.members for r in presence.floor_after(df, starts, ["g"], "clock", "e", "m", "k").collect()}
    assert got[1, 0] == [1, 2, 3, 4, 5] and got[1, 9] == [2, 3, 4, 5, 6] and got[2, 0] is None


def test_registered_periods_are_solved_beyond_the_smallest_tables(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    people: dict = {}
    for r in queries.floor_assertions(spark, big).collect():
        people.setdefault((r.floor, r.day, r.period), []).append(r)
    got = {(r.floor, r.day, r.period): r for r in queries.starting_groups(spark, big).collect()}
    assert got.keys() == people.keys()
    few = set()
    for at, rows in people.items():
        rows.sort(key=lambda r: (-r.clock, r.event_id))
        first: dict = {}
        for r in rows:
            first.setdefault(r.user_id, r.kind)
        assert len(first) <= presence.CANDIDATES
        if len(first) < presence.SIZE:
            few.add(at)
        assert (got[at].status == "UNDERDETERMINED") == (at in few)
    assert len(few) < len(got) / 2
    floors = {r.event_id: r.members for r in queries.floor_states(spark, big).collect()}
    assert len(floors) == sum(map(len, people.values()))
    for at, rows in people.items():
        there = None if at in few else {int(m) for m in got[at].members.split(",")}
        for r in rows:
            if there is not None:
                there = there - {r.user_id} if r.kind == "OUT" else there | {r.user_id} if r.kind == "IN" else there
            assert floors[r.event_id] == (None if there is None else ",".join(map(str, sorted(there))))


# ---- Features


def test_request_faults(spark):
    five = [1, 2, 3, 4, 5]
    rows = [(five, [6, 7, 8, 9, 10], 1, 10), (five, [], 1, None), (five, None, None, 0), ([1, 2], [], 1, 1), (five, [6, 7], 1, 1), (five, [5, 7, 8, 9, 10], 1, 1), (five, [], 9, 1), (five, [], 1, 25)]
    got = values(spark, rows, "o array<bigint>, d array<bigint>, m bigint, s int", features.request_fault(F.col("o"), F.col("d"), F.col("m"), F.col("s")))
    assert [g[0] for g in got] == [None, None, None, "offence: wrong size", "defence: wrong size", "a member on both sides", "member not in the offence", "clock out of range"]


def test_flags_sides_and_scores(spark):
    df = spark.createDataFrame([("steal", 3, 100, 4, 2), ("made shot", 20, 100, 4, 10), (None, None, None, None, None)], "t string, s int, c int, p int, m int")
    got = features.play_flags(df, "t", "s", "c", "p", "m").collect()
    assert [(r.live_ball, r.transition, r.late_clock, r.clutch) for r in got] == [(1, 1, 0, 1), (0, 0, 1, 0), (0, 0, 0, 0)]
    sides = values(spark, [(True, [1], [2]), (False, [1], [2]), (None, [1], [2])], "h boolean, a array<int>, b array<int>", *features.by_side(F.col("h"), F.col("a"), F.col("b")))
    assert sides == [([1], [2]), ([2], [1]), (None, None)]
    z = features.standardised(spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double"), "v", spark.createDataFrame([(1.0,), (3.0,)], "v double"))
    assert [r.v_z for r in z.collect()] == [-1.0, 1.0, 0.0]


def test_canonical_order_puts_nulls_last(spark):
    rows = [("g", 1, 10, 2), ("g", 1, 700, 1), (None, 1, 5, 1), ("g", 1, None, 3), ("g", 2, 720, 9)]
    got = spark.createDataFrame(rows, "g string, p int, c int, e int").orderBy(*features.canonical_order("g", "p", "c", "e")).collect()
    assert [r.e for r in got] == [1, 2, 3, 9, 1]


def test_split_half_is_that_of_averaged_ranks(spark):
    rnd = np.random.default_rng(6)
    x = rnd.integers(0, 8, 200).astype(float)
    y = x + rnd.normal(0, 2, 200)
    a = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, v double")
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "k int, v double")
    got = features.split_half(a, b, "k", "v").first()
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    assert got.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and got.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert got.corrected == pytest.approx(2 * got.pearson / (1 + got.pearson))


def test_member_lookup_leaves_the_named_one_out(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], 1), (2, [4, 5], None)], "r int, m array<int>, o int")
    rates = spark.createDataFrame([(1, 0.9), (2, 0.5), (4, 0.1)], "member int, rate double")
    got = {r.r: (r["mean"], r.least, r.total) for r in features.member_lookup(df, "r", "m", rates, 0.3, "o").collect()}
    assert got[1] == pytest.approx((0.4, 0.3, 0.8)) and got[2] == pytest.approx((0.2, 0.1, 0.4))


def test_ranked_plays_are_held_against_the_usual_mix(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0])], "i int, l array<double>")
    args = (df, "i", "l", ["a", "b", "c"], np.array([1.0]), np.array([[0.01]]), [2.0, 3.0, 1.0])
    plain, against = ({r.choice: r for r in plays.rank_plays(*args, usual=u).collect()} for u in (None, [0.2, 0.3, 0.5]))
    for c, price, usual in zip("abc", [2.0, 3.0, 1.0], [0.2, 0.3, 0.5], strict=True):
        assert against[c].value == pytest.approx(plain[c].value - 100 * price * usual) and against[c].error == pytest.approx(plain[c].error)


def test_home_column_and_totals(spark):
    rnd = np.random.default_rng(3)
    rows = [(rnd.choice(6, 5, replace=False).tolist(), rnd.choice(6, 5, replace=False).tolist(), bool(i % 2), float(i % 2) * 3 + float(rnd.normal())) for i in range(600)]
    df = models.with_home(spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, h boolean, y double"), "h")
    found = models.effects(df, {"a": "a", "b": "b", "home": "home"}, "y", {"a": 50.0, "b": 50.0, "home": 0.0}, scale=1.0)
    home = found.where("block = 'home'").first()
    assert home.effect == pytest.approx(3, abs=0.3)
    totals = models.member_totals(found, "a", "b").collect()
    of = {(r.block, r.member): r.effect for r in found.collect()}
    assert all(r.total == pytest.approx(of["a", r.member] - of["b", r.member]) for r in totals)
    assert models.effects(df.where("false"), {"a": "a", "b": "b"}, "y", {"a": 1.0, "b": 1.0}).count() == 0


def test_seasons_and_game_types(spark):
    rows = [("0022300001", "2023-24"), ("0042300001", "2023-25"), ("0092300001", "23-24"), ("22300001", "1900-01"), (None, None)]
    got = values(spark, rows, "i string, l string", F.struct(C.season_of(F.col("i")), events.game_type(F.col("i")), events.season_of_label(F.col("l"))))
    assert [tuple(r[0]) for r in got] == [(2023, "regular", 2023), (2023, "playoffs", None), (2023, None, None), (None, None, None), (None, None, None)]
    with pytest.raises(Exception, match="no known game type"):
        values(spark, rows[2:3], "i string, l string", events.game_type(F.col("i"), strict=True))
    df = spark.createDataFrame(rows[:2], "i string, l string")
    events.require_season(df, "i", 2023)
    with pytest.raises(ValueError, match="2022 asked for"):
        events.require_season(df, "i", 2022)


def test_typed_events(spark):
    raw = spark.createDataFrame([("22300001", "5", "11:41", "a"), ("22300001", "5", "11:40", "b"), ("22300001", "x", "bad", "c"), ("12300001", "1", "1:00", "d")], "game_id string, event_num string, clock string, t string")
    got = sorted((r.game_id, r.event_num, r.seconds_remaining, r.t, r.game_type) for r in events.type_events(raw, ("event_num",)).collect() if r.event_num)
    assert got == [("0022300001", 5, 700, "b", "regular")]
    with pytest.raises(ValueError, match="no features: made"):
        events.design_columns(spark.createDataFrame([(1, 2)], "a int, made int"), ["a", "made"])


def test_nested_results_differ(spark):
    a = spark.createDataFrame([(1, {"n": 1.0, "l": [1, 2], "t": "x"})], "k int, v struct<n:double,l:array<int>,t:string>")
    b = spark.createDataFrame([(1, {"n": 1.0000001, "l": [1, 3, 4], "t": "y"})], "k int, v struct<n:double,l:array<int>,t:string>")
    got = sorted((r.path, r.problem) for r in reports.nested_diff(a, b, ["k"], 1e-3).collect())
    assert got == [("v.l", "length"), ("v.l[1]", "value"), ("v.l[2]", "missing"), ("v.t", "value")]
    assert reports.nested_diff(a, a, ["k"], 0.0).count() == 0


def test_contract_drift(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string")
    before = reports.contracts({"a": a, "b": a, "c": a})
    now = reports.contracts({"a": a, "b": a.where("i = 1"), "d": a.withColumn("i", F.col("i").cast("long"))})
    got = sorted((r.table, r.drift) for r in reports.contract_drift(now, before).collect())
    assert got == [("b", "hash"), ("b", "rows"), ("c", "table"), ("d", "table")]


def test_summaries_of_model_outputs(spark):
    ranked = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (2, 1), (3, None)], "request int, band int")
    got = reports.ranking_refusals(ranked).first()
    assert (got.requests, got.mean_bands, got.with_ties, got.unordered, got.ordered_pairs, got.pairs) == (2, 1.5, 1.0, 0.5, 2, 4)
    compared = spark.createDataFrame([("total", 1.0, 3.0, True), ("total", 1.0, 1.0, False), ("a", 9.0, 9.0, True)], "choice string, error double, v double, separable boolean")
    got = reports.comparison_variance(compared, "v").first()
    assert got.profile_share == pytest.approx(4 / 6) and got.widening == pytest.approx((1 / (1 - 4 / 6)) ** 0.5) and got.separable == 1
    projected = spark.createDataFrame([(0.2, -1.0, 1.0), (0.8, 1.0, 2.0), (float("nan"), -2.0, 0.0), (None, 1.0, 2.0)], "s double, low double, high double")
    got = reports.projection_variance(projected, "s").first()
    assert (got.n, got.missing, got.mean, got["median"], got.dominated, got.spans_zero) == (4, 2, 0.5, 0.5, 0.5, 0.5)


def test_narratives_keep_to_their_documents(spark):
    docs = spark.createDataFrame([(i, [f"Ana Maria{'bcdefg'[i]}", f"Otto Zander{'bcdefg'[i]}"], 120 + 37 * i, 101.5 + 13 * i, 0.41 - 0.05 * i, 0.2 + 0.07 * i, 0.1, "at the usual", i % 2 == 0) for i in range(5)], "doc int, names array<string>, rows int, per_100 double, three double, rim double, mid double, level string, below_floor boolean")
    told = narratives.narratives(docs)
    assert told.count() == 15
    got = {r.template: r for r in narratives.corpus_scores(told, docs).collect()}
    assert got["faithful"].grounded == 1.0 and got["faithful"].traceability == 1.0 and got["faithful"].easy == 0.0 and got["faithful"].near_miss == 0.0
    assert got["overclaiming"].grounded == pytest.approx(2 / 5) and got["hallucinating"].grounded == 0.0
    counts = {(r.template, r.failure): r.n for r in narratives.failure_counts(told, docs).collect()}
    assert counts == {("overclaiming", "tier_consistency"): 3, ("hallucinating", "player_scope"): 5}
    wrong = spark.createDataFrame([(0, "t", "Ana Mariab had many. From the elbow, fewer three attempts.")], "doc int, template string, text string")
    assert set(narratives.checked(wrong.join(docs, "doc")).first().failures) == {"zone_vocabulary", "direction"}
    with pytest.raises(ValueError, match="no variant"):
        narratives.rendered(docs, "x")


def test_conversion_features_leave_the_shooter_out(spark):
    rnd = random.Random(2)
    rows = [(i, 1 + i % 5, "restricted_area" if i % 2 else "top_three", 2 if i % 2 else 3, rnd.random() < 0.5, [1, 2, 3, 4, 5], [11, 12, 13, 14, 15], float(i % 30), False, i % 7 == 0, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "row long, shooter_id long, zone_id string, points int, made boolean, own array<bigint>, defence array<bigint>, distance double, clutch boolean, late_clock boolean, fold int")
    of = conversion.profiles(df, least=10)
    got = {r.row: r for r in conversion.features(df, of).collect()}
    threes = {m: np.mean([r[3] == 3 for r in rows if r[1] == m]) for m in range(1, 6)}
    base = np.mean([r[3] == 3 for r in rows])
    for i in (0, 3, 17):
        others = [threes[m] - base for m in range(1, 6) if m != rows[i][1]]
        assert got[i].spacing_sum == pytest.approx(sum(others)) and got[i].spacing_min == pytest.approx(min(others))
        assert got[i].opp_rim == pytest.approx(np.mean([r[4] for r in rows if r[2] == "restricted_area"]))
    table = conversion.train_and_evaluate(df, {"out": "fold"}, ("zone", "full")).collect()
    assert {(r.model, r.metric) for r in table} == {(m, x) for m in ("zone", "full") for x in ("log_loss", "brier")}
    assert all(r.n == 400 and 0 < r.value < 1.5 for r in table)


def test_manifests_name_missing_sources_and_empties_are_typed(spark, tmp_path):
    entries = spark.createDataFrame([("a", 3)], "key string, bytes int")
    got = {(r.key, r.status, r.bytes) for r in tables.with_missing(entries, spark.createDataFrame([("a",), ("b",), ("b",)], "key string")).collect()}
    assert got == {("a", "present", 3), ("b", "missing", None)}
    for name in tables.TYPED:
        assert tables.typed_empty(spark, name).count() == 0
    df = spark.createDataFrame([(1, "x", 2020), (2, "y", 2021)], "i int, t string, season int")
    tables.write_tables({"one": df}, str(tmp_path))
    tables.write_tables({"one": df.where("season = 2021").withColumn("t", F.lit("z"))}, str(tmp_path))
    assert {(r.i, r.t) for r in tables.read_partitions(spark, f"{tmp_path}/one").collect()} == {(1, "x"), (2, "z")}
    tables.write_pooled(df, f"{tmp_path}/pooled")
    assert tables.read_pooled(spark, f"{tmp_path}/pooled").count() == 2


def test_json_has_no_odd_numbers_however_deep(spark):
    df = spark.createDataFrame([(float("nan"), {"a": float("inf"), "b": [1.0, float("nan")]}, {"k": float("inf")})], "x double, s struct<a:double,b:array<double>>, m map<string,double>")
    assert tables.as_json(df).first().json == '{"x":null,"s":{"a":null,"b":[1.0,null]},"m":{"k":null}}'


def test_both_sides_are_as_good_as_the_weaker(spark):
    rows = [(1, s, 700, e + 10 * s, m + 10 * s, "EV") for s in (0, 1) for e, m in enumerate([1, 2, 3, 4, 5])] + [(1, 0, 300, 30, 1, "OUT"), (1, 0, 200, 31, 1, "EV")]
    df = spark.createDataFrame(rows, "g int, side int, clock int, e int, m long, k string")
    keys = (["g", "side"], "clock", "e", "m", "k")
    starts = presence.starting_groups(df, *keys)
    got = {r.e: r for r in presence.both_floors(presence.floor_after(df, starts, *keys), starts, ["g", "side"], "side", "e", 0, 1).collect()}
    assert got[0].home == [1, 2, 3, 4, 5] and got[0].away is None and got[0].quality == "QUARANTINED"
    assert got[31].home == [2, 3, 4, 5] and got[31].away == [11, 12, 13, 14, 15] and got[31].quality == "IMPUTED" and got[31].method == "REPAIRED/EXACT"


def test_choice_design_has_terms_where_they_act(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], 1.0)], "mix array<double>, late double")
    got = models.choice_design(df, ["mix"], {"late": (2,)}, 3).first().x
    assert got == [0.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.2, 0.0, 0.0, 1.0, 0.3, 1.0]
    assert models.choice_design(df, ["mix"], {"late": (2,)}, 3, without=("mix", "late")).first().x == [0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def _operators(df):
    """The plan of df before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_stints_move_and_sort_rows_once(spark):
    rows = spark.createDataFrame([(g, c, c // 3) for g in range(4) for c in range(20)], "g long, clock int, five int")
    found = sequence.stints(rows, ["g"], "clock", "five", ["five"], F.lit(25))
    plan = _operators(found)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Aggregate" not in plan
    one = [(r.five, r.n_rows, r.start, r.end, r.stint_index) for r in found.where("g = 2").orderBy("stint_index").collect()]
    assert one == [(6, 2, 25, 17, 0), (5, 3, 17, 14, 1), (4, 3, 14, 11, 2), (3, 3, 11, 8, 3), (2, 3, 8, 5, 4), (1, 3, 5, 2, 5), (0, 3, 2, 0, 6)]


def test_interval_join_does_not_group_points(spark):
    points = spark.createDataFrame([(1, 50, "x")] * 3 + [(1, 10, "y"), (1, 99, "out"), (2, 50, "other")], "g long, at int, name string")
    spans = spark.createDataFrame([(1, 60, 5, 2), (1, 55, 45, 1), (1, 10, 10, 0)], "g long, start int, end int, k int")
    found = sequence.interval_join(points, spans, ["g"], "at", "start", "end", "k")
    assert "name" not in "".join(line for line in _operators(found).splitlines() if "Aggregate" in line)
    assert sorted((r.at, r.name, r.k) for r in found.collect()) == [(10, "y", 2)] + [(50, "x", 1)] * 3


def test_co_occurrence_counts_equal_groups_before_pairs(spark):
    rows = spark.createDataFrame([(i, [1, 2], [3]) for i in range(50)] + [(99, [2, 1], [4])], "g long, own array<long>, other array<long>")
    found = aggregate.co_occurrence(rows, "g", ["own", "other"])
    assert sorted((r.member, r.rows, r.partner, r.share) for r in found.collect()) == [(1, 51, 2, 1.0), (2, 51, 1, 1.0), (3, 50, 1, 1.0), (4, 1, 1, 1.0)]
    assert "Generate explode(m" in _operators(found) and "own" not in _operators(found).split("Generate explode(m")[-1]


def test_floor_after_solves_starting_groups_once(spark, monkeypatch):
    from groupwise.operators import presence

    times = spark.sparkContext.accumulator(0)
    starts = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "p int, members array<long>")

    def counted(batches):
        for batch in batches:
            times.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(1, 100, 1, 1, "OUT"), (1, 90, 2, 6, "IN")], "p int, clock int, event long, member long, kind string")
    found = presence.floor_after(rows, starts.mapInPandas(counted, starts.schema), ["p"], "clock", "event", "member", "kind")
    assert {r.event: r.members for r in found.collect()} == {1: [2, 3, 4, 5], 2: [2, 3, 4, 5, 6]}
    assert times.value == 1
