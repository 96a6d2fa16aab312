"""Queries of summaries, filters and checks: n-way metrics, usable rows, reconciliations, means by category, centring and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.functions import columns as C
from groupwise.operators import aggregate, features, metrics
from groupwise.plans.registry import query, rounded
from groupwise.plans.roles import GROUPS_SQL, SHOTS, SHOTS_SQL, possessions, shots, table

_ZONES = ", ".join(f"'{z}'" for z in C.ZONES)
_GROUPS = {"three": [C.ZONES.index(z) for z in C.THREES], "rim": [C.ZONES.index("restricted_area")]}
_ORDER = ["game_id", "line", "part", "shooter_id"]


def _group_sql(name: str, places: list[int]) -> str:
    """CTEs of a group's scores from q (rows with p, chosen)."""
    p = " + ".join(f"p[{i + 1}]" for i in places)
    return f"""{name}_r AS (SELECT {', '.join(_ORDER)}, CASE WHEN chosen IN ({', '.join(map(str, places))}) THEN 1.0 ELSE 0.0 END AS y, round({p}, 12) AS pr FROM q),
{name}_b AS (SELECT y, pr, ntile(20) OVER (ORDER BY pr, {', '.join(_ORDER)}) AS b FROM {name}_r), {name}_c AS (SELECT b, count(*) AS n, avg(pr) AS mp, avg(y) AS my FROM {name}_b GROUP BY b),
{name}_w AS (SELECT sum(n) AS a, sum(n * my) / sum(n) AS base FROM {name}_c),
{name}_s AS (SELECT round(avg(-(y * ln(pr) + (1 - y) * ln(1 - pr))), 6) AS {name}_log_loss, round(avg(pow(pr - y, 2)), 6) AS {name}_brier FROM {name}_r),
{name}_d AS (SELECT round(sum(n / a * pow(my - base, 2)), 6) AS {name}_resolution, round(sum(n / a * abs(mp - my)), 6) AS {name}_ece FROM {name}_c, {name}_w)"""


@query(f"""WITH {SHOTS_SQL.replace("SELECT l_orderkey AS game_id", "SELECT l_partkey AS part, l_linenumber AS line, l_orderkey AS game_id", 1)},
x AS (SELECT {', '.join(_ORDER)}, list_position([{_ZONES}], zone_id) - 1 AS chosen, [1.0 + (part * (z + 3) + line * 7) % 11 for z in range(9)] AS w FROM shots),
q AS (SELECT *, [round(v / list_sum(w), 12) for v in w] AS p FROM x), e AS (SELECT *, unnest(range(9)) AS z FROM q),
c AS (SELECT z, p[z + 1] AS pr, CASE WHEN chosen = z THEN 1.0 ELSE 0.0 END AS y, ntile(10) OVER (PARTITION BY z ORDER BY p[z + 1], {', '.join(_ORDER)}) AS b FROM e),
bins AS (SELECT z, b, count(*) AS n, avg(pr) AS mp, avg(y) AS my FROM c GROUP BY z, b), ece AS (SELECT z, sum(n * abs(mp - my)) / sum(n) AS e FROM bins GROUP BY z),
{', '.join(_group_sql(n, g) for n, g in _GROUPS.items())}
SELECT count(*) AS n, round(avg(-ln(p[chosen + 1])), 6) AS log_loss, round(avg(CASE WHEN list_position(p, list_max(p)) - 1 = chosen THEN 1.0 ELSE 0.0 END), 6) AS top_1, (SELECT round(avg(e), 6) FROM ece) AS class_ece,
{', '.join(f'(SELECT {n}_{c} FROM {n}_{t}) AS {n}_{c}' for n in _GROUPS for c, t in (('log_loss', 's'), ('brier', 's'), ('resolution', 'd'), ('ece', 'd')))} FROM q""")
def choice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine-way probabilities of every shot's zone: log loss, first guesses, calibration within each zone, and the threes and the rim as groups."""
    raw = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS part", "l_linenumber AS line", *(f"{e} AS {n}" for n, e in SHOTS.items()))
    zone = C.zone(F.col("loc_x"), F.col("loc_y"))
    weights = F.array(*((1 + (F.col("part") * (z + 3) + F.col("line") * 7) % 11).cast("double") for z in range(len(C.ZONES))))
    rows = raw.withColumn("chosen", (F.array_position(F.array(*map(F.lit, C.ZONES)), zone) - 1).cast("int")).withColumn("w", weights)
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    mixed = rows.withColumn("mix", F.transform(F.array(total), lambda t: F.transform("w", lambda v: v / t))[0])
    return rounded(metrics.choice_report(mixed, "mix", "chosen", len(C.ZONES), _GROUPS, _ORDER))


_FLAGGED_SQL = f"""{GROUPS_SQL}, f AS (SELECT game_id, CASE WHEN unit % 11 = 0 THEN list_slice(own, 1, 4) WHEN unit % 13 = 0 THEN NULL ELSE own END AS own, other, points,
  CASE WHEN unit % 7 = 0 THEN 'APPROX' WHEN unit % 17 = 0 THEN NULL ELSE 'VALID' END AS quality, CASE WHEN unit % 19 = 0 THEN NULL ELSE points = 7 END AS ambiguous, offense_team_id FROM possessions)"""


@query(f"WITH {_FLAGGED_SQL} SELECT offense_team_id, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM f WHERE len(own) = 5 AND len(other) = 5 AND quality = 'VALID' AND NOT ambiguous GROUP BY offense_team_id")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by team that a fit may use: whole lists, of quality VALID, without ambiguous bounds."""
    unit = F.col("unit")
    rows = possessions(spark, sf_dir).withColumns({"own": F.when(unit % 11 == 0, F.slice("own", 1, 4)).when(unit % 13 != 0, F.col("own")), "quality": F.when(unit % 7 == 0, "APPROX").when(unit % 17 != 0, "VALID"), "ambiguous": F.when(unit % 19 != 0, F.col("points") == 7)})
    return features.usable(rows, ["own", "other"], "quality", "ambiguous").groupBy("offense_team_id").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


_TOTALS_SQL = """d AS (SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS v FROM lineitem WHERE l_linenumber < 6 GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS k, CAST(coalesce(v, 0) AS BIGINT) AS derived, CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS truth FROM orders LEFT JOIN d ON d.k = o_orderkey)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 100).cast("long")
    derived = table(spark, sf_dir, "lineitem").where("l_linenumber < 6").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(cents).alias("v"))
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 50 == 0, F.lit(0).cast("long")).otherwise(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    return aggregate.reconcile(derived, truth, ["k"], "v")


@query(f"WITH {_TOTALS_SQL} SELECT k, derived, truth, abs(derived - truth) AS delta FROM r")
def reconciled_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's total from its lines beside the total that it states."""
    return _reconciled(spark, sf_dir)


@query(f"""WITH {_TOTALS_SQL}, t AS (SELECT *, abs(derived - truth) AS delta FROM r) SELECT round(avg(delta), 4) AS mean_delta, round(quantile_cont(delta, 0.95), 4) AS p95_delta, max(delta) AS max_delta,
  round(abs(sum(derived) - sum(truth)) / sum(truth), 6) AS total_gap, count(CASE WHEN truth = 0 AND derived > 0 THEN 1 END) AS phantom FROM t""")
def reconciliation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate.reconcile_summary(_reconciled(spark, sf_dir))
    named = found.toDF("mean_delta", "p95_delta", "max_delta", "total_gap", "phantom")
    return named.select(F.round("mean_delta", 4).alias("mean_delta"), F.round("p95_delta", 4).alias("p95_delta"), "max_delta", F.round("total_gap", 6).alias("total_gap"), "phantom")


@query(f"WITH {SHOTS_SQL} SELECT zone_id, count(*) AS n, round(avg(CASE WHEN made THEN points ELSE 0 END), 6) AS mean FROM shots GROUP BY zone_id")
def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean points and count by zone, best first."""
    rows = shots(spark, sf_dir).withColumn("worth", F.when(F.col("made"), F.col("points")).otherwise(0))
    return rounded(features.category_means(rows, "zone_id", "worth"))


@query("""WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price, avg(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS mean FROM orders) SELECT o_orderkey, round(price - mean, 3) AS centred FROM c""")
def centred_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's price less its customer's mean."""
    rows = table(spark, sf_dir, "orders").withColumn("price", F.round(F.col("o_totalprice") * 100).cast("long"))
    return rows.select("o_orderkey", F.round(metrics.centred(rows, "price", "o_custkey"), 3).alias("centred"))


@query("""WITH g AS (SELECT DISTINCT o_orderdate AS game FROM orders), r AS (SELECT game, (row_number() OVER (ORDER BY game) - 1) % 2 AS half FROM g)
SELECT half, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN r ON o_orderdate = game GROUP BY half""")
def odd_even_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the odd and the even days, by the day's place among all."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("game"))
    return rows.join(metrics.odd_even_games(rows, "game"), "game").groupBy(F.col("half").cast("long").alias("half")).agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


@query(f"""WITH {GROUPS_SQL}, o AS (SELECT *, CASE WHEN game_id % 9 = 0 THEN list_concat(list_slice(own, 2, 5), [own[1] + 8]) ELSE list_reverse(own) END AS told FROM possessions)
SELECT offense_team_id, count(*) AS n, count(CASE WHEN list_sort(own) = list_sort(told) THEN 1 END) AS agreed FROM o GROUP BY offense_team_id""")
def list_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two lists of a row hold the same members, whatever their order."""
    told = F.when(F.col("game_id") % 9 == 0, F.concat(F.slice("own", 2, 4), F.array(F.get("own", F.lit(0)) + 8))).otherwise(F.reverse("own"))
    rows = possessions(spark, sf_dir).withColumn("told", told)
    return rows.groupBy("offense_team_id").agg(F.count("*").alias("n"), F.count_if(C.same_members(F.col("own"), F.col("told"))).alias("agreed"))
