"""Queries of examples, main teams, what may be said of a group, splits held to those seen, exposures, result tables and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.functions import columns as C
from groupwise.operators import aggregate, answers, features, gates, metrics, models, reports
from groupwise.plans.registry import query, rounded
from groupwise.plans.roles import GROUPS_SQL, SCORERS_SQL, SEASONS_SQL, SHOTS_SQL, possessions, scorers, season_possessions, shots, table


@query(f"""WITH {SHOTS_SQL}, c AS (SELECT shooter_id, count(*) AS n FROM shots GROUP BY shooter_id), cut AS (SELECT floor(avg(n)) AS a FROM c),
ex AS (SELECT * FROM (SELECT shooter_id, 'high volume' AS example FROM c ORDER BY n DESC, shooter_id LIMIT 1) t UNION ALL SELECT * FROM (SELECT shooter_id, 'low volume' AS example FROM c, cut WHERE n < a ORDER BY n DESC, shooter_id LIMIT 1) u),
w AS (SELECT avg(CAST(made AS INT) * points) AS league FROM shots)
SELECT example, shots.shooter_id, zone_id, count(*) AS attempts, round(avg(CAST(made AS INT)), 6) AS make_rate, round(avg(CAST(made AS INT) * points), 6) AS ppa, round(avg(CAST(made AS INT) * points) - max(league), 6) AS vs_league, count(*) < 50 AS thin
FROM shots JOIN ex ON shots.shooter_id = ex.shooter_id CROSS JOIN w GROUP BY example, shots.shooter_id, zone_id""")
def example_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone surfaces of the shooter of the most attempts, and of that below the mean number."""
    s = shots(spark, sf_dir)
    mean = s.groupBy("shooter_id").agg(F.count("*").alias("n")).agg(F.floor(F.avg("n")).alias("a")).first()["a"]
    return rounded(aggregate.example_surfaces(s, "shooter_id", mean))


#: Months at whose beginning every member's team is asked.
_CUTOFFS = (1994 * 12 + 7, 1996 * 12 + 3)


@query(f"""WITH {SEASONS_SQL}, e AS (SELECT unnest(own) AS member, team, season, mon FROM sp), c AS (SELECT unnest([{_CUTOFFS[0]}, {_CUTOFFS[1]}]) AS cutoff),
n AS (SELECT member, cutoff, team, season, count(*) AS n FROM e, c WHERE mon < cutoff GROUP BY member, cutoff, team, season), r AS (SELECT *, row_number() OVER (PARTITION BY member, cutoff ORDER BY n DESC, season DESC, team DESC) AS place FROM n)
SELECT member, cutoff, team, season, n FROM r WHERE place = 1""")
def main_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member's main team and season before two cut-offs."""
    rows = season_possessions(spark, sf_dir)
    cutoffs = rows.select(F.explode("own").alias("member")).distinct().select("member", F.explode(F.array(*map(F.lit, _CUTOFFS))).alias("cutoff"))
    return aggregate.main_teams(rows, "own", ["team", "season"], "at", cutoffs)


@query(f"""WITH {GROUPS_SQL}, k AS (SELECT own_key, ntile(4) OVER (ORDER BY md5('0:' || own_key), own_key) - 1 AS fold FROM possessions GROUP BY own_key HAVING count(*) >= 25),
p AS (SELECT possessions.own_key, unit, points, fold FROM possessions LEFT JOIN k ON k.own_key = possessions.own_key), u AS (SELECT unit, fold, count(*) AS n, sum(count(*)) OVER (PARTITION BY unit) AS a FROM p GROUP BY unit, fold)
SELECT CAST(p.fold AS INT) AS fold, count(*) AS n, count(DISTINCT p.unit) AS units, CAST(sum(points) AS BIGINT) AS points FROM p JOIN u ON u.unit = p.unit AND u.fold = p.fold AND u.n < u.a GROUP BY p.fold""")
def seen_in_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each held-out fold of groups whose customer the other folds know."""
    rows = possessions(spark, sf_dir)
    kept = metrics.seen_only(rows, metrics.leave_groups_out(rows, "own_key", 4, 25), "own_key", "unit")
    return kept.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("unit").alias("units"), F.sum("points").alias("points"))


@query(f"""WITH {GROUPS_SQL}, {SCORERS_SQL}, s AS (SELECT own_key AS key, count(*) AS possessions, min(own) AS own, min(unit) AS u, min(game_id) AS request FROM possessions GROUP BY own_key),
q AS (SELECT request, list_sort(CASE WHEN u % 2 = 1 THEN list_concat(list_slice(own, 2, 5), [own[1] + 8]) ELSE own END) AS members FROM s), a AS (SELECT member, count(*) AS n FROM scorers WHERE member % 8 <> 3 GROUP BY member),
e AS (SELECT request, unnest(members) AS member, unnest(range(5)) AS seat FROM q), l AS (SELECT request, min(coalesce(n, 0)) AS min_attempts, array_to_string(coalesce(list(e.member ORDER BY seat) FILTER (coalesce(n, 0) < 30), []), ',') AS shortfall FROM e LEFT JOIN a ON a.member = e.member GROUP BY request)
SELECT q.request, coalesce(possessions, 0) AS possessions, min_attempts, shortfall, possessions IS NULL AS counterfactual, CASE WHEN coalesce(possessions, 0) >= 200 AND min_attempts >= 100 THEN 'reportable' WHEN min_attempts >= 30 THEN 'directional' ELSE 'refused' END AS tier
FROM q JOIN l ON l.request = q.request LEFT JOIN s ON s.key = md5(array_to_string(members, ','))""")
def assessed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be said of every group, and of groups of which one member has been exchanged for one of another team."""
    seen = possessions(spark, sf_dir).groupBy(F.col("own_key").alias("key")).agg(F.count("*").alias("possessions"), F.min("own").alias("own"), F.min("unit").alias("u"), F.min("game_id").alias("request"))
    members = F.sort_array(F.when(F.col("u") % 2 == 1, F.concat(F.slice("own", 2, 4), F.array(F.get("own", F.lit(0)) + 8))).otherwise(F.col("own")))
    asked = seen.select("request", members.alias("members")).withColumn("key", C.group_key(F.col("members")))
    attempts = scorers(spark, sf_dir).where("member % 8 <> 3").groupBy("member").agg(F.count("*").alias("n"))
    found = aggregate.assess(asked, seen.select("key", "possessions"), attempts)
    return found.select("request", "possessions", "min_attempts", F.array_join(F.col("shortfall").cast("array<string>"), ",").alias("shortfall"), "counterfactual", "tier")


@query(f"""WITH {GROUPS_SQL}, o AS (SELECT offense_team_id, own, CASE WHEN game_id % 13 = 0 THEN NULL WHEN game_id % 9 = 0 THEN list_concat(list_slice(own, 2, 5), [own[1] + 8]) ELSE list_reverse(own) END AS told,
  CASE WHEN unit % 19 = 0 THEN NULL ELSE points = 7 END AS ambiguous FROM possessions), s AS (SELECT *, CASE WHEN told IS NOT NULL THEN CAST(list_sort(own) = list_sort(told) AS INT) END AS same FROM o)
SELECT count(*) AS n, count(same) AS n_compared, round(coalesce(avg(same), 0), 6) AS agreement, round(coalesce(avg(CASE WHEN NOT ambiguous THEN same END), 0), 6) AS unambiguous_agreement, round(avg(CAST(ambiguous AS INT)), 6) AS ambiguous_rate FROM s""")
def boundary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often lists told by another source agree, over all rows and those with clear bounds."""
    told = F.when(F.col("game_id") % 13 == 0, None).when(F.col("game_id") % 9 == 0, F.concat(F.slice("own", 2, 4), F.array(F.get("own", F.lit(0)) + 8))).otherwise(F.reverse("own"))
    rows = possessions(spark, sf_dir).withColumns({"told": told, "ambiguous": F.when(F.col("unit") % 19 != 0, F.col("points") == 7)})
    return rounded(features.boundary_summary(rows, "own", "told", "ambiguous"))


#: The rule for a newcomer's minutes: the share of the vacated ones, and how far it may be off.
_SHARE, _SPREAD = 0.8, 0.2


def _scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = possessions(spark, sf_dir).withColumn("team", F.expr("unit div 50"))
    swaps = rows.select("team", F.get("own", F.lit(0)).alias("out"), F.get("own", F.lit(4)).alias("in")).distinct()
    return answers.exposures(swaps, rows, "own", "team", _SHARE, _SPREAD), rows


@query(f"""WITH {GROUPS_SQL}, w AS (SELECT unit // 50 AS team, count(*) AS n FROM possessions GROUP BY unit // 50), t AS (SELECT team, out, count(*) AS n FROM (SELECT unit // 50 AS team, unnest(own) AS out FROM possessions) GROUP BY team, out),
s AS (SELECT DISTINCT unit // 50 AS team, own[1] AS out, own[5] AS "in" FROM possessions)
SELECT s.team, s.out, "in", round(t.n / w.n * {_SHARE}, 6) AS share, round(t.n / w.n * {_SPREAD}, 6) AS spread FROM s JOIN w ON w.team = s.team JOIN t ON t.team = s.team AND t.out = s.out""")
def swap_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a team's time a swap of its first and last member would be for."""
    return rounded(_scenarios(spark, sf_dir)[0].select("team", "out", "in", "share", "spread"))


@query()
def projection_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the variance of projected swaps comes from minutes."""
    scenarios, rows = _scenarios(spark, sf_dir)
    rows = rows.withColumn("other", F.transform("other", lambda m: m - 1000000000))  # the two lists name their members apart
    return rounded(reports.projection_variance(answers.projected_swaps(scenarios, rows, ("own", "other"), "points", (2000.0, 4000.0)), "minutes_part"), 4)


_P_SQL = "CAST(0.2 + (l_partkey * 7 + l_linenumber * 13) % 720 / 2000.0 AS DOUBLE)"
_SCORES_SQL = f"""s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {_P_SQL} AS p, CAST(year(l_shipdate) AS INT) AS season FROM lineitem), b AS (SELECT avg(y) AS base FROM s),
m AS (SELECT season, 'full' AS model, count(*) AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg(pow(p - y, 2)) AS brier FROM s GROUP BY season UNION ALL SELECT season, 'base', count(*), avg(-(y * ln(base) + (1 - y) * ln(1 - base))), avg(pow(base - y, 2)) FROM s, b GROUP BY season)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(season, model, metric, value, n) of two ways to foretell a flag."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", f"{_P_SQL} AS full", "year(l_shipdate) AS season")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("y").alias("base"))))  # one row
    each = rows.select("season", "y", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("full", "base")))))
    wide = each.groupBy("season", "model").agg(F.count("*").alias("n"), metrics.log_loss(F.col("y"), F.col("p")).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return wide.select("season", "model", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("log_loss", "brier")))), "n")


@query(f"""WITH {_SCORES_SQL} SELECT f.season, f.model, f.n, round(f.log_loss, 6) AS log_loss, round(f.brier, 6) AS brier, CASE WHEN f.model = 'full' THEN 'base' END AS against, CASE WHEN f.model = 'full' THEN round((g.log_loss - f.log_loss) / g.log_loss, 6) END AS gain,
CASE WHEN f.model = 'full' THEN printf('%+.3f%% vs base', 100 * (g.log_loss - f.log_loss) / g.log_loss) END AS verdict FROM m f JOIN m g ON f.season = g.season AND g.model = 'base'""")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models' losses by season with what they gain on their counterparts, in words."""
    return rounded(reports.result_table(_scores(spark, sf_dir), {"full": "base"}, ["season"], ["log_loss", "brier"]))


@query(f"""WITH {_SCORES_SQL}, v AS (SELECT season, model, log_loss AS now, 'log_loss' AS metric FROM m UNION ALL SELECT season, model, brier, 'three_resolution' FROM m),
o AS (SELECT *, CASE WHEN season % 4 = 0 THEN NULL ELSE now + (season % 4 - 1) * 0.0008 END AS before FROM v)
SELECT season, model, metric, round(now, 6) AS now, round(before, 6) AS before, CASE WHEN before IS NULL THEN 'new' ELSE 'differs' END AS problem FROM o WHERE before IS NULL OR abs(now - before) > CASE WHEN metric = 'log_loss' THEN 1e-6 ELSE 1e-3 END""")
def metric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that differ from an earlier run's by more than their class allows."""
    now = _scores(spark, sf_dir).drop("n").withColumn("metric", F.when(F.col("metric") == "brier", "three_resolution").otherwise(F.col("metric")))
    before = now.where("season % 4 <> 0").withColumn("value", F.col("value") + (F.col("season") % 4 - 1) * 0.0008)
    return rounded(gates.drift(now, before, ["season", "model", "metric"], "value", gates.drift_tolerance(F.col("metric"))))
