"""Registered queries: each operator over the roles of the given tables, with SQL for the same rows where SQL has the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupwise.functions import columns as C
from groupwise.operators import aggregate, answers, features, gates, latent, metrics, models, plays, presence, priors, retrieval, sequence, sparse_ridge
from groupwise.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from groupwise.plans.roles import GROUPS_SQL, SCORERS_SQL, SHOTS_SQL, assertions, floor_assertions, possessions, scorers, shots, table

def _epoch():
    """Seconds of ts, which has no time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6D")


def _wide(columns) -> str:
    return ", ".join(columns)


# ---- Surfaces, shares and shrinkage


@query(f"""WITH {SHOTS_SQL}, whole AS (SELECT avg(CAST(made AS INT) * points) AS league FROM shots)
SELECT zone_id, count(*) AS attempts, round(avg(CAST(made AS INT)), 6) AS make_rate, round(avg(CAST(made AS INT) * points), 6) AS ppa,
  round(avg(CAST(made AS INT) * points) - max(league), 6) AS vs_league, count(*) < 50 AS thin FROM shots, whole GROUP BY zone_id""")
def zone_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.zone_surface(shots(spark, sf_dir)))


@query(f"""WITH {SHOTS_SQL}, c AS (SELECT shooter_id, count(*) AS n FROM shots GROUP BY shooter_id), cut AS (SELECT avg(n) AS a FROM c)
SELECT * FROM (SELECT shooter_id, n, 'high volume' AS example FROM c ORDER BY n DESC, shooter_id LIMIT 1) t
UNION ALL SELECT * FROM (SELECT shooter_id, n, 'low volume' AS example FROM c, cut WHERE n < floor(a) ORDER BY n DESC, shooter_id LIMIT 1) u""")
def volume_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    mean = s.groupBy("shooter_id").agg(F.count("*").alias("n")).agg(F.floor(F.avg("n")).alias("a")).first()["a"]
    return aggregate.volume_examples(s, "shooter_id", mean)


@query(f"""WITH {SHOTS_SQL} SELECT shooter_id, {_wide(f"count(CASE WHEN zone_id = '{z}' THEN 1 END) AS n_{z}" for z in C.ZONES)}, count(*) AS n,
  {_wide(f"round(count(CASE WHEN zone_id = '{z}' THEN 1 END) / count(*), 6) AS share_{z}" for z in C.ZONES)} FROM shots GROUP BY shooter_id""")
def category_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.category_mix(shots(spark, sf_dir), "shooter_id", "zone_id", list(C.ZONES)))


def _makes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots(spark, sf_dir).groupBy("shooter_id", "zone_id").agg(F.sum(F.col("made").cast("long")).alias("makes"), F.count("*").alias("attempts"))


_PRIOR_SQL = f"""WITH {SHOTS_SQL},
k AS (SELECT shooter_id, zone_id, CAST(sum(CAST(made AS INT)) AS BIGINT) AS makes, count(*) AS attempts FROM shots GROUP BY shooter_id, zone_id),
st AS (SELECT zone_id, avg(CASE WHEN attempts >= 20 THEN makes / attempts END) AS m, var_samp(CASE WHEN attempts >= 20 THEN makes / attempts END) AS v,
  avg(CASE WHEN attempts >= 20 THEN attempts END) AS mean_n, count(CASE WHEN attempts >= 20 THEN 1 END) AS units, sum(makes) / sum(attempts) AS rate FROM k GROUP BY zone_id),
tr AS (SELECT *, greatest(v - m * (1 - m) / mean_n, 1e-6) AS t FROM st),
pr AS (SELECT zone_id, CASE WHEN units < 2 THEN rate ELSE m END AS prior_mean,
  CASE WHEN units < 2 THEN 10.0 WHEN m * (1 - m) <= 0 THEN 1.0 ELSE least(greatest(m * (1 - m) / (CASE WHEN t >= m * (1 - m) THEN m * (1 - m) * 0.99 ELSE t END) - 1, 1.0), 5000.0) END AS s FROM tr)"""


@query(f"""{_PRIOR_SQL} SELECT k.shooter_id, k.zone_id, makes, attempts, round(prior_mean, 6) AS prior_mean, round(makes / attempts, 6) AS rate_raw,
  round((makes + prior_mean * s) / (attempts + s), 6) AS rate_shrunk, round(attempts / (attempts + s), 6) AS shrink_weight FROM k JOIN pr ON k.zone_id = pr.zone_id""")
def beta_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(priors.shrink_rates(_makes(spark, sf_dir), "makes", "attempts", ["zone_id"]))


_ZONE_LIST = ", ".join(f"'{z}'" for z in C.ZONES)


@query(f"""WITH {SHOTS_SQL}, zs AS (SELECT unnest([{_ZONE_LIST}]) AS zone_id, unnest(range({len(C.ZONES)})) AS place), u AS (SELECT shooter_id, count(*) AS n FROM shots GROUP BY shooter_id),
c AS (SELECT u.shooter_id, u.n, zs.zone_id, place, count(s.zone_id) AS x FROM u CROSS JOIN zs LEFT JOIN shots s ON s.shooter_id = u.shooter_id AND s.zone_id = zs.zone_id GROUP BY u.shooter_id, u.n, zs.zone_id, place),
nb AS (SELECT avg(CASE WHEN n >= 50 THEN n END) AS n_bar, count(CASE WHEN n >= 50 THEN 1 END) AS units FROM u),
v AS (SELECT zone_id, place, sum(x) / sum(n) AS mean, var_samp(CASE WHEN n >= 50 THEN x / n END) AS var FROM c GROUP BY zone_id, place),
r AS (SELECT *, CASE WHEN mean > 0 AND mean < 1 AND n_bar > 1 THEN (var / (mean * (1 - mean) / n_bar) - 1) / (n_bar - 1) END AS rho FROM v, nb), rp AS (SELECT *, CASE WHEN rho > 0 THEN rho END AS good FROM r),
o AS (SELECT good, sum(CASE WHEN good IS NOT NULL THEN mean ELSE 0 END) OVER (ORDER BY good NULLS LAST, place ROWS UNBOUNDED PRECEDING) AS up_to, sum(CASE WHEN good IS NOT NULL THEN mean ELSE 0 END) OVER () AS whole FROM rp),
po AS (SELECT min(CASE WHEN good IS NOT NULL AND up_to >= 0.5 * whole THEN good END) AS pooled FROM o),
st AS (SELECT CASE WHEN units < 2 OR NOT coalesce(n_bar > 1, FALSE) THEN 25.0 WHEN pooled IS NULL THEN 5000.0 ELSE least(greatest((1 - pooled) / pooled, 1.0), 5000.0) END AS s FROM po, nb)
SELECT c.shooter_id, {_wide(f"max(CASE WHEN c.zone_id = '{z}' THEN x END) AS {z}" for z in C.ZONES)}, {_wide(f"round(max(CASE WHEN c.zone_id = '{z}' THEN (x + s * mean) / (n + s) END), 6) AS mix_{z}" for z in C.ZONES)}, round(max(n / (n + s)), 6) AS mix_weight
FROM c JOIN v ON c.zone_id = v.zone_id CROSS JOIN st GROUP BY c.shooter_id""")
def dirichlet_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate.category_mix(shots(spark, sf_dir), "shooter_id", "zone_id", list(C.ZONES)).select("shooter_id", *(F.col(f"n_{z}").alias(z) for z in C.ZONES))
    return rounded(priors.shrink_mixes(counts, list(C.ZONES)))


@query(f"""WITH {SHOTS_SQL},
p AS (SELECT shooter_id, game_id, count(*) AS n, sum(CASE WHEN points = 3 THEN 1 ELSE 0 END) AS t FROM shots GROUP BY shooter_id, game_id),
u AS (SELECT shooter_id, sum(n) AS total, sum(t) AS hits, count(*) AS g FROM p GROUP BY shooter_id),
q AS (SELECT p.shooter_id, sum(pow((t - hits / total * n) / total, 2)) AS s FROM p JOIN u ON p.shooter_id = u.shooter_id GROUP BY p.shooter_id)
SELECT u.shooter_id, CAST(total AS BIGINT) AS n, round(hits / total, 6) AS rate, round(CASE WHEN hits = 0 OR hits = total THEN sqrt((hits + 0.5) / (total + 1) * (1 - (hits + 0.5) / (total + 1)) / total)
  ELSE sqrt(s * g / (g - 1)) END, 6) AS error FROM u JOIN q ON u.shooter_id = q.shooter_id WHERE g >= 2 AND total >= 20""")
def clustered_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.clustered_rate_errors(shots(spark, sf_dir), "shooter_id", "game_id", F.col("points") == 3, 20))


@query(f"""WITH {SHOTS_SQL}, c AS (SELECT shooter_id, team_id, count(*) AS n FROM shots GROUP BY shooter_id, team_id)
SELECT shooter_id, team_id FROM (SELECT *, row_number() OVER (PARTITION BY shooter_id ORDER BY n DESC, team_id) AS r FROM c) t WHERE r = 1""")
def modal_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.modal_value(shots(spark, sf_dir), "shooter_id", "team_id")


# ---- Groups, evidence and ratings


@query(f"""WITH {GROUPS_SQL}, e AS (SELECT unnest(own) AS member, points FROM possessions UNION ALL SELECT unnest(other) AS member, points FROM possessions)
SELECT member, CAST(sum(points) AS BIGINT) AS points FROM e GROUP BY member""")
def member_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.member_sums(possessions(spark, sf_dir), ["own", "other"], "points")


_SUPPORT_SQL = f"""WITH {GROUPS_SQL}, {SCORERS_SQL}, a AS (SELECT member, count(*) AS n FROM scorers WHERE l_returnflag = 'R' GROUP BY member),
g AS (SELECT own_key, CAST(sum(points) AS BIGINT) AS points, count(*) AS n_rows, min(own) AS own FROM possessions GROUP BY own_key),
x AS (SELECT own_key, points, n_rows, unnest(own) AS member FROM g),
sup AS (SELECT own_key, max(points) AS points, max(n_rows) AS n_rows, min(coalesce(n, 0)) AS min_attempts FROM x LEFT JOIN a ON x.member = a.member GROUP BY own_key)"""


@query(f"""{_SUPPORT_SQL} SELECT own_key, points, n_rows, min_attempts, CASE WHEN n_rows >= 200 AND min_attempts >= 100 THEN 'reportable' WHEN min_attempts >= 30 THEN 'directional' ELSE 'refused' END AS tier FROM sup""")
def group_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = scorers(spark, sf_dir).where("l_returnflag = 'R'").groupBy("member").agg(F.count("*").alias("n"))
    found = aggregate.support(possessions(spark, sf_dir), "own_key", "own", attempts, "points")
    return found.select("own_key", "points", "n_rows", "min_attempts", aggregate.tier(F.col("n_rows"), F.col("min_attempts")).alias("tier"))


@query(f"""WITH {GROUPS_SQL}, m AS (SELECT game_id, unnest(list_concat(own, other)) AS a FROM possessions), r AS (SELECT a, count(*) AS n FROM m GROUP BY a),
p AS (SELECT x.a, y.a AS b, count(*) AS c FROM m x JOIN m y ON x.game_id = y.game_id AND x.a <> y.a GROUP BY x.a, y.a),
s AS (SELECT p.a, b, n, round(c / n, 6) AS share, row_number() OVER (PARTITION BY p.a ORDER BY round(c / n, 6) DESC, b) AS k FROM p JOIN r ON p.a = r.a)
SELECT a AS member, n AS rows, b AS partner, share, share > 0.85 AS flagged FROM s WHERE k = 1 ORDER BY share DESC, a LIMIT 50""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.co_occurrence(possessions(spark, sf_dir), "game_id", ["own", "other"])


@query(f"""WITH {GROUPS_SQL}, o AS (SELECT year(played) AS game_id, offense_team_id AS team_id, 100 * avg(points) AS off_rating, count(*) AS n_off FROM possessions GROUP BY year(played), offense_team_id),
d AS (SELECT year(played) AS game_id, defense_team_id AS team_id, 100 * avg(points) AS def_rating, count(*) AS n_def FROM possessions GROUP BY year(played), defense_team_id)
SELECT o.game_id, o.team_id, round(off_rating, 6) AS off_rating, n_off, round(def_rating, 6) AS def_rating, n_def, round(off_rating - def_rating, 6) AS net_rating
FROM o JOIN d ON o.game_id = d.game_id AND o.team_id = d.team_id""")
def team_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.ratings(possessions(spark, sf_dir).withColumn("game_id", F.year("played"))))


@query(f"""WITH {GROUPS_SQL}, p AS (SELECT own, own_key, other FROM possessions),
u AS (SELECT own_key, min(own) AS own FROM p GROUP BY own_key)
SELECT a.own_key AS a_key, b.own_key AS b_key, list_filter(a.own, lambda x: NOT list_contains(b.own, x))[1] AS went, list_filter(b.own, lambda x: NOT list_contains(a.own, x))[1] AS came
FROM u a JOIN u b ON a.own_key < b.own_key WHERE len(list_filter(a.own, lambda x: NOT list_contains(b.own, x))) = 1""")
def one_for_one_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = possessions(spark, sf_dir).groupBy("own_key").agg(F.min("own").alias("own"))
    # groups that differ by one member share four: each group's five subsets of four are the join key, so no pair is tried in vain
    four = lambda side: groups.select(F.col("own_key").alias(f"{side}_key"), F.col("own").alias(f"{side}_own"), F.explode("own").alias("without")).withColumn("rest", F.array_remove(F.col(f"{side}_own"), F.col("without"))).drop("without")
    pairs = four("a").join(four("b"), "rest").where("a_key < b_key")
    return pairs.withColumn("swap", C.one_for_one(F.col("a_own"), F.col("b_own"))).where("swap is not null").select("a_key", "b_key", F.col("swap.out").alias("went"), F.col("swap.in").alias("came"))


@query(f"""{_SUPPORT_SQL}, ans AS (SELECT own_key, n_rows, min_attempts, points / n_rows - (SELECT avg(points) FROM possessions) AS delta,
  CASE WHEN n_rows >= 200 AND min_attempts >= 100 THEN 'reportable' WHEN min_attempts >= 30 THEN 'directional' ELSE 'refused' END AS tier FROM sup)
SELECT own_key, n_rows, min_attempts, CASE WHEN tier = 'reportable' THEN round(delta, 6) END AS delta, tier,
  CASE WHEN delta > 0 THEN 'gain' WHEN delta < 0 THEN 'loss' ELSE 'flat' END AS direction FROM ans WHERE tier <> 'refused'""")
def masked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = possessions(spark, sf_dir)
    attempts = scorers(spark, sf_dir).where("l_returnflag = 'R'").groupBy("member").agg(F.count("*").alias("n"))
    whole = rows.agg(F.avg("points").alias("base"))
    found = aggregate.support(rows, "own_key", "own", attempts, "points").crossJoin(F.broadcast(whole))
    answer = found.select("own_key", "n_rows", "min_attempts", (F.col("points") / F.col("n_rows") - F.col("base")).alias("delta"), aggregate.tier(F.col("n_rows"), F.col("min_attempts")).alias("tier"))
    return rounded(answers.masked(answer, "tier", ["delta"], "delta"))


@query("""WITH m AS (SELECT DISTINCT s_nationkey AS m FROM supplier), r AS (SELECT unnest(range(200)) AS request),
k AS (SELECT request, m, row_number() OVER (PARTITION BY request ORDER BY md5('0:' || request || ':' || m), m) AS n FROM r, m)
SELECT request, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS members FROM k WHERE n <= 5 GROUP BY request""")
def request_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.request_sets(table(spark, sf_dir, "supplier"), "s_nationkey", 200)
    return found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(f"""WITH {GROUPS_SQL}, g AS (SELECT own_key, offense_team_id, count(*) AS n, avg(points) AS mean FROM possessions GROUP BY own_key, offense_team_id HAVING count(*) >= 3),
s AS (SELECT *, (rank() OVER (ORDER BY round(mean, 9)) - 1) / count(*) OVER () AS share FROM g),
l AS (SELECT *, CASE WHEN share >= 0.8 THEN 'elite' WHEN share >= 0.6 THEN 'above average' WHEN share >= 0.4 THEN 'average' WHEN share >= 0.2 THEN 'below average' ELSE 'poor' END AS level FROM s)
SELECT own_key, offense_team_id, n, round(mean, 6) AS mean, level FROM l""")
def group_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(answers.group_documents(possessions(spark, sf_dir), "own_key", ["offense_team_id"], "points", 3)).drop("text")


@query(f"""WITH {SHOTS_SQL}, p AS (SELECT DISTINCT loc_x AS x, loc_y AS y FROM shots)
SELECT x, y, 'wedge' AS area FROM p WHERE y >= 0 AND y < 100 AND x >= y AND x < 200 - y UNION ALL SELECT x, y, 'box' AS area FROM p WHERE x >= -50 AND x < 50 AND y >= -20 AND y < 120""")
def polygon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    outlines = {"wedge": [(0, 0), (200, 0), (100, 100)], "box": [(-50, -20), (50, -20), (50, 120), (-50, 120)]}
    edges = spark.createDataFrame([(n, *map(float, a), *map(float, b)) for n, c in outlines.items() for a, b in zip(c, c[1:] + c[:1], strict=True)], "area string, x1 double, y1 double, x2 double, y2 double")
    points = shots(spark, sf_dir).select(F.col("loc_x").alias("x"), F.col("loc_y").alias("y")).distinct()
    return answers.in_polygons(points, edges, ["x", "y"], "area")


@query()
def swap_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exchanging a member for another would change, by the ridge's effects."""
    rows = possessions(spark, sf_dir).withColumn("other", F.transform("other", lambda m: m - 1000000000))  # the two lists name their members apart
    # the first and the last member of each five change places
    scenarios = rows.select(F.get("own", F.lit(0)).alias("out"), F.get("own", F.lit(4)).alias("in")).distinct().withColumn("share", F.lit(0.5))
    return rounded(answers.projected_swaps(scenarios, rows, ("own", "other"), "points", (2000.0, 4000.0)), 4)


@query(f"""WITH {GROUPS_SQL}, {SCORERS_SQL}, r AS (SELECT member, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS rate FROM scorers WHERE member % 8 <> 3 GROUP BY member),
e AS (SELECT game_id, own[1] AS gone, unnest(own) AS member FROM possessions)
SELECT game_id, round(avg(coalesce(rate, 0.25)), 6) AS mean, round(min(coalesce(rate, 0.25)), 6) AS least, round(sum(coalesce(rate, 0.25)), 6) AS total FROM e LEFT JOIN r ON e.member = r.member WHERE e.member <> gone GROUP BY game_id""")
def member_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = scorers(spark, sf_dir).where("member % 8 <> 3").groupBy("member").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("rate"))
    rows = possessions(spark, sf_dir).withColumn("gone", F.get("own", F.lit(0)))
    return rounded(features.member_lookup(rows, "game_id", "own", rates, 0.25, without="gone"))


@query(f"""WITH {GROUPS_SQL}, l AS (SELECT *, 1 + (game_id * 7 + unit) % 40 AS seconds FROM possessions) SELECT count(*) AS n, round(avg(CASE WHEN seconds <= 35 THEN 1.0 ELSE 0.0 END), 6) AS covered, round(avg(seconds), 6) AS mean_length, CAST(median(seconds) AS DOUBLE) AS median_length,
  round(avg(CASE WHEN offense_team_id < 10 THEN points END), 6) AS live_points, round(avg(CASE WHEN offense_team_id >= 10 THEN points END), 6) AS set_points FROM l""")
def possession_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = possessions(spark, sf_dir).withColumn("seconds", 1 + (F.col("game_id") * 7 + F.col("unit")) % 40)
    return rounded(features.possession_summary(rows, "points", "seconds", F.col("offense_team_id") < 10, F.col("seconds") <= 35))


@query("""WITH v AS (SELECT o_custkey AS unit, epoch(o_orderdate) AS t, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
k AS (SELECT unit, (min(t) + max(t)) / 2 AS cutoff FROM v GROUP BY unit)
SELECT v.unit, count(CASE WHEN t < cutoff THEN 1 END) AS n_before, round(avg(CASE WHEN t < cutoff THEN price END), 6) AS before, count(CASE WHEN t >= cutoff THEN 1 END) AS n_after, round(avg(CASE WHEN t >= cutoff THEN price END), 6) AS after
FROM v JOIN k ON v.unit = k.unit GROUP BY v.unit""")
def before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate) / 1e6D")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), at.alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("price"))
    cutoffs = rows.groupBy("unit").agg(((F.min("at") + F.max("at")) / 2).alias("cutoff"))
    return rounded(features.before_and_after(rows, cutoffs, "unit", "at", "price", "cutoff"), 6)


@query("""WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
c AS (SELECT o_custkey, avg(CASE WHEN r * 2 > n THEN o_totalprice END) - avg(CASE WHEN r * 2 <= n THEN o_totalprice END) AS change FROM o WHERE n >= 10 GROUP BY o_custkey)
SELECT count(*) AS units, round(stddev_samp(change), 4) AS sd FROM c""")
def change_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.change_noise(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 10), 4)


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN a <= 100 THEN 'head' ELSE 'tail' END AS "end" FROM r WHERE a <= 100 OR a > n - 100""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.first_and_last(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", "o_orderkey").select("o_orderkey", "end")


@query(f"""WITH {SHOTS_SQL}, f AS (SELECT unnest(range(5)) AS fold),
k AS (SELECT fold, shooter_id, zone_id, CAST(sum(CAST(made AS INT)) AS BIGINT) AS makes, count(*) AS attempts FROM shots, f WHERE game_id % 5 <> fold GROUP BY fold, shooter_id, zone_id),
z AS (SELECT fold, zone_id, sum(makes) / sum(attempts) AS c FROM k GROUP BY fold, zone_id),
st AS (SELECT fold, zone_id, avg(CASE WHEN attempts >= 20 THEN makes / attempts END) AS m, var_samp(CASE WHEN attempts >= 20 THEN makes / attempts END) AS v,
  avg(CASE WHEN attempts >= 20 THEN attempts END) AS mean_n, count(CASE WHEN attempts >= 20 THEN 1 END) AS units, sum(makes) / sum(attempts) AS rate FROM k GROUP BY fold, zone_id),
tr AS (SELECT *, greatest(v - m * (1 - m) / mean_n, 1e-6) AS t FROM st),
pr AS (SELECT fold, zone_id, CASE WHEN units < 2 THEN rate ELSE m END AS prior_mean,
  CASE WHEN units < 2 THEN 10.0 WHEN m * (1 - m) <= 0 THEN 1.0 ELSE least(greatest(m * (1 - m) / (CASE WHEN t >= m * (1 - m) THEN m * (1 - m) * 0.99 ELSE t END) - 1, 1.0), 5000.0) END AS s FROM tr),
sr AS (SELECT k.fold, k.shooter_id, k.zone_id, (makes + prior_mean * s) / (attempts + s) AS m FROM k JOIN pr ON k.zone_id = pr.zone_id AND k.fold = pr.fold),
x AS (SELECT CAST(made AS INT) AS y, c, coalesce(m, c) AS m FROM shots JOIN z ON z.fold = game_id % 5 AND z.zone_id = shots.zone_id LEFT JOIN sr ON sr.fold = game_id % 5 AND sr.zone_id = shots.zone_id AND sr.shooter_id = shots.shooter_id),
w AS (SELECT y, least(greatest(c, 1e-15), 1 - 1e-15) AS c, least(greatest(m, 1e-15), 1 - 1e-15) AS m FROM x)
SELECT round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS category_loss, round(avg(-(y * ln(m) + (1 - y) * ln(1 - m))), 6) AS member_loss, count(*) AS n FROM w""")
def baseline_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is judged by rates and priors of the folds that it is not in."""
    s = shots(spark, sf_dir).withColumn("fold", F.col("game_id") % 5)
    by_zone = features.out_of_fold(s, "fold", ["zone_id"], "made").select("fold", "zone_id", (F.col("makes") / F.col("attempts")).alias("c"))
    shrunk = priors.shrink_rates(features.out_of_fold(s, "fold", ["shooter_id", "zone_id"], "made"), "makes", "attempts", ["fold", "zone_id"])
    scored = s.join(by_zone, ["fold", "zone_id"]).join(shrunk.select("fold", "shooter_id", "zone_id", "rate_shrunk"), ["fold", "shooter_id", "zone_id"], "left")
    y, m = F.col("made").cast("int"), F.coalesce("rate_shrunk", "c")
    return rounded(scored.agg(metrics.log_loss(y, F.col("c")).alias("category_loss"), metrics.log_loss(y, m).alias("member_loss"), F.count("*").alias("n")))


@query(f"""WITH {GROUPS_SQL}, q AS (SELECT game_id, own, other, own[1] + unit % 3 AS member, unit % 30 AS seconds FROM possessions),
f AS (SELECT CASE WHEN NOT list_contains(own, member) THEN 'member not in the offence' WHEN seconds > 24 THEN 'clock out of range' ELSE 'valid' END AS fault FROM q)
SELECT fault, count(*) AS n FROM f GROUP BY fault""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = possessions(spark, sf_dir).withColumn("member", F.get("own", F.lit(0)) + F.col("unit") % 3).withColumn("seconds", F.col("unit") % 30)
    fault = F.coalesce(features.request_fault(F.col("own"), F.col("other"), F.col("member"), F.col("seconds")), F.lit("valid"))
    return asked.groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


# ---- Sequences


@query("""WITH e AS (SELECT *, epoch(ts) AS t FROM events), p AS (SELECT user_id, epoch(ts) AS pt, event_id AS pid FROM events WHERE event_type = 'purchase'),
j AS (SELECT e.event_id, e.t, p.pid, p.pt, row_number() OVER (PARTITION BY e.event_id ORDER BY p.pt DESC NULLS LAST, p.pid DESC) AS r
  FROM e LEFT JOIN p ON e.user_id = p.user_id AND p.pt <= e.t WHERE e.event_type = 'click')
SELECT event_id, CASE WHEN t - pt <= 86400 THEN pid END AS purchase_id, coalesce(t - pt <= 86400, false) AS matched FROM j WHERE r = 1""")
def asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("t", _epoch())
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "t")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("t").alias("bought"), F.col("event_id").alias("purchase_id"))
    return sequence.asof_join(clicks, buys, ["user_id"], "t", "bought", ["purchase_id"], within=86400.0, tie="purchase_id").select("event_id", "purchase_id", "matched")


@query("""SELECT event_id, user_id, coalesce(lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS start, epoch(ts) AS finish FROM events""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("finish", _epoch())
    return events.select("event_id", "user_id", sequence.previous_end(events, ["user_id"], ["ts", "event_id"], "finish", F.lit(0.0)).alias("start"), "finish")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS least_event, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, event_type, g""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sequence.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return marked.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.min("event_id").alias("least_event"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("run")


@query(f"""WITH {SHOTS_SQL}, s AS (SELECT DISTINCT game_id, period, seconds_remaining, team_id FROM shots),
o AS (SELECT *, lag(team_id) OVER w AS before, row_number() OVER w AS r, CASE WHEN period <= 4 THEN 720 ELSE 300 END AS opening FROM s
  WINDOW w AS (PARTITION BY game_id, period ORDER BY seconds_remaining DESC, team_id)),
n AS (SELECT *, sum(CASE WHEN r = 1 OR team_id = before THEN 0 ELSE 1 END) OVER (PARTITION BY game_id, period ORDER BY seconds_remaining DESC, team_id) AS run FROM o),
g AS (SELECT game_id, period, run, min(team_id) AS team_id, max(seconds_remaining) AS first, max(opening) AS opening, count(*) AS n_rows FROM n GROUP BY game_id, period, run),
t AS (SELECT *, CASE WHEN run = 0 THEN opening ELSE first END AS start, coalesce(lead(first) OVER (PARTITION BY game_id, period ORDER BY run), 0) AS stop FROM g)
SELECT game_id, period, team_id, n_rows, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", row_number() OVER (PARTITION BY game_id, period ORDER BY run) - 1 AS stint_index FROM t WHERE start > stop""")
def stint_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by what stints are made within, so that neither they nor the distinct rows move again
    s = sequence.dealt(shots(spark, sf_dir).select("game_id", "period", "seconds_remaining", "team_id"), "game_id", "period").distinct()
    found = sequence.stints(s, ["game_id", "period"], "seconds_remaining", "team_id", ["team_id"], C.period_length(F.col("period")))
    return found.select("game_id", "period", "team_id", "n_rows", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("stint_index").cast("long").alias("stint_index"))


@query(f"""WITH {SHOTS_SQL}, sp AS (SELECT DISTINCT team_id, period, 100 * (seconds_remaining // 100) + 100 AS start, 100 * (seconds_remaining // 100) AS stop, seconds_remaining // 100 AS k FROM shots),
d AS (SELECT game_id, shooter_id, team_id, period, seconds_remaining, row_number() OVER () AS r FROM shots)
SELECT game_id, shooter_id, d.team_id, d.period, d.seconds_remaining, min(k) AS k FROM d JOIN sp ON d.team_id = sp.team_id AND d.period = sp.period AND d.seconds_remaining <= start AND d.seconds_remaining > stop GROUP BY r, game_id, shooter_id, d.team_id, d.period, d.seconds_remaining""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shots(spark, sf_dir).select("game_id", "shooter_id", "team_id", "period", "seconds_remaining")
    k = F.floor(F.col("seconds_remaining") / 100)
    spans = d.select("team_id", "period", (100 * k + 100).alias("start"), (100 * k).alias("stop"), k.alias("k")).distinct()
    return sequence.interval_join(d, spans, ["team_id", "period"], "seconds_remaining", "start", "stop", "k").select(*d.columns, "k")


@query("""WITH o AS (SELECT o_custkey AS unit, o_orderdate, o_orderkey, o_orderstatus AS team, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS g FROM orders),
r AS (SELECT unit, team, g, count(*) AS n, min(o_orderdate) AS cutoff, min(struct_pack(d := o_orderdate, k := o_orderkey)) AS s FROM o GROUP BY unit, team, g),
b AS (SELECT *, lag(team) OVER (PARTITION BY unit ORDER BY s) AS from_team, lag(n) OVER (PARTITION BY unit ORDER BY s) AS n_before FROM r)
SELECT unit, from_team, team AS to_team, n_before, n AS n_after, cutoff FROM b WHERE n_before >= 2 AND n >= 2""")
def unit_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey AS unit", "o_orderdate", "o_orderkey", "o_orderstatus AS team")
    return aggregate.moves(orders, "unit", ["o_orderdate", "o_orderkey"], "team", 2)


@query()
def starting_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = presence.starting_groups(floor_assertions(spark, sf_dir), ["floor", "day", "period"], "clock", "event_id", "user_id", "kind")
    return found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) // 6 AS INT) AS period, 86400 - hour(ts) * 3600 - minute(ts) * 60 - CAST(floor(second(ts)) AS INT) AS clock, event_id, user_id,
  CASE event_type WHEN 'signup' THEN 'IN' WHEN 'error' THEN 'OUT' ELSE 'EV' END AS kind FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY day, period, user_id ORDER BY -clock, event_id) AS k FROM a)
SELECT day, period, user_id, kind AS first, kind <> 'IN' AS started FROM r WHERE k = 1""")
def presence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assertions(spark, sf_dir).withColumn("at", -F.col("clock"))
    return presence.facts(rows, ["day", "period"], ["at", "event_id"], "user_id", "kind")


# ---- Models


@query(f"""WITH {GROUPS_SQL}, c AS (SELECT game_id, points, 'own' AS b, unnest(own) AS m FROM possessions UNION ALL SELECT game_id, points, 'other' AS b, unnest(other) AS m FROM possessions)
SELECT 0 AS fold, x.b AS block_i, x.m AS member_i, y.b AS block_j, y.m AS member_j, count(*) AS n, CAST(sum(x.points) AS DOUBLE) AS y
FROM c x JOIN c y ON x.game_id = y.game_id AND (x.b < y.b OR (x.b = y.b AND x.m <= y.m)) GROUP BY x.b, x.m, y.b, y.m""")
def ridge_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.gram(possessions(spark, sf_dir), {"own": "own", "other": "other"}, "points")


@query()
def ridge_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sparse_ridge.effects(possessions(spark, sf_dir), {"own": "own", "other": "other"}, "points", {"own": 2000.0, "other": 4000.0}), 4)


@query()
def ridge_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_game = possessions(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("game_id"), F.lit(5)))
    best, error = sparse_ridge.choose_penalties(by_game, {"own": "own", "other": "other"}, "points", "fold", [float(round(10 ** (1.5 + k / 3))) for k in range(10)])
    return spark.createDataFrame([(best["own"], best["other"], round(float(error), 6))], "own double, other double, held_out_error double")


def _zone_choice(spark: SparkSession, sf_dir: str):
    """(designs by shooter, theta, covariance, mean loss): eight zone constants and the shooter's log share of a zone against the whole's."""
    s = shots(spark, sf_dir)
    mix = priors.shrink_mixes(aggregate.category_mix(s, "shooter_id", "zone_id", list(C.ZONES)).select("shooter_id", *(F.col(f"n_{z}").alias(z) for z in C.ZONES)), list(C.ZONES))
    whole = s.agg(*(F.avg((F.col("zone_id") == z).cast("double")).alias(f"all_{z}") for z in C.ZONES))
    ratio = F.array(*(F.ln(F.greatest(F.col(f"mix_{z}"), F.lit(1e-9)) / F.greatest(F.col(f"all_{z}"), F.lit(1e-9))) for z in C.ZONES))
    design = F.flatten(F.array(*(F.concat(F.array(*(F.lit(1.0 if j == i else 0.0) for j in range(1, len(C.ZONES)))), F.array(F.get("ratio", F.lit(i)))) for i in range(len(C.ZONES)))))
    designs = mix.crossJoin(F.broadcast(whole)).select("shooter_id", ratio.alias("ratio")).select("shooter_id", design.alias("x"))
    designs = sequence.kept(designs)
    attempts = s.groupBy("shooter_id", (F.array_position(F.array(*map(F.lit, C.ZONES)), F.col("zone_id")) - 1).alias("chosen")).agg(F.count("*").alias("n"))
    return designs, *models.fit_choice(attempts.join(designs, "shooter_id"), "x", "chosen", len(C.ZONES), len(C.ZONES), free=tuple(range(len(C.ZONES) - 1)), weight="n")


@query()
def zone_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, theta, covariance, loss = _zone_choice(spark, sf_dir)
    names = [f"constant_{z}" for z in C.ZONES[1:]] + ["shooter_mix"]
    audit = models.sign_audit(names, theta, covariance.diagonal() ** 0.5, [1] * len(names))
    return spark.createDataFrame([(n, round(t, 4), round(e, 4), v, round(float(loss), 6)) for n, t, e, v in audit], "term string, estimate double, error double, verdict string, log_loss double")


def _prices(spark: SparkSession, sf_dir: str) -> list[float]:
    surface = {r["zone_id"]: float(r["ppa"]) for r in aggregate.zone_surface(shots(spark, sf_dir)).collect()}
    return [surface.get(z, 0.0) for z in C.ZONES]


@query()
def ranked_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shooter, the zones' worth a hundred attempts, in bands that the evidence separates."""
    designs, theta, covariance, _ = _zone_choice(spark, sf_dir)
    usual = {r["zone_id"]: r["share"] for r in shots(spark, sf_dir).groupBy("zone_id").agg(F.count("*").alias("n")).select("zone_id", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share")).collect()}  # nine rows
    return rounded(plays.rank_plays(designs, "shooter_id", "x", list(C.ZONES), theta, covariance, _prices(spark, sf_dir), usual=[usual.get(z, 0.0) for z in C.ZONES]), 4)


@query()
def shooter_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shooter against the one with the next id."""
    designs, theta, covariance, _ = _zone_choice(spark, sf_dir)
    both = designs.join(designs.select((F.col("shooter_id") - 1).alias("shooter_id"), F.col("x").alias("other")), "shooter_id")
    return rounded(plays.compare(both, "shooter_id", "x", "other", list(C.ZONES), theta, covariance, _prices(spark, sf_dir)), 4)


@query()
def floor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is there after each event, where a period's starting group is known."""
    rows = floor_assertions(spark, sf_dir)
    keys = (["floor", "day", "period"], "clock", "event_id", "user_id", "kind")
    found = presence.floor_after(rows, presence.starting_groups(rows, *keys), *keys)
    return found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


# ---- Splits and metrics


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS game FROM lineitem), n AS (SELECT count(*) AS n FROM g), r AS (SELECT game, row_number() OVER (ORDER BY game) - 1 AS p FROM g)
SELECT game, CASE WHEN p >= CAST(floor(n * 0.4) AS BIGINT) THEN CAST(floor((p - floor(n * 0.4)) / ceil((n - floor(n * 0.4)) / 4)) AS INT) END AS fold FROM r, n""")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.walk_forward(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game")), "game")


@query(f"""WITH {GROUPS_SQL}, k AS (SELECT own_key, count(*) AS n FROM possessions GROUP BY own_key HAVING count(*) >= 25)
SELECT own_key, CAST(ntile(4) OVER (ORDER BY md5('0:' || own_key), own_key) - 1 AS INT) AS fold FROM k""")
def leave_group_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leave_groups_out(possessions(spark, sf_dir), "own_key", 4, 25)


_SCORED = {"row": "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber", "y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "p": "0.2 + (l_partkey * 7 + l_linenumber * 13) % 720 / 2000.0"}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "CAST(l_extendedprice AS DOUBLE) AS price", *(f"{e} AS {n}" for n, e in _SCORED.items())).withColumn("p", F.col("p").cast("double"))


_BINS_SQL = f"""WITH s AS (SELECT l_suppkey, l_extendedprice AS price, {_SCORED['row']} AS row, {_SCORED['y']} AS y, CAST(0.2 + (l_partkey * 7 + l_linenumber * 13) % 720 / 2000.0 AS DOUBLE) AS p FROM lineitem),
b AS (SELECT y, p, ntile(20) OVER (ORDER BY p, row, l_suppkey, price, y) - 1 AS bin FROM s),
bins AS (SELECT CAST(bin AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM b GROUP BY bin)"""


@query(f"{_BINS_SQL} SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM bins")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_bins(_scored(spark, sf_dir), "y", "p", ["row", "l_suppkey", "price", "y"]))


@query(f"""{_BINS_SQL}, w AS (SELECT sum(n) AS a, sum(n * mean_y) / sum(n) AS base FROM bins)
SELECT round(sum(n / a * pow(mean_p - mean_y, 2)), 6) AS reliability, round(sum(n / a * pow(mean_y - base, 2)), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty, round(sum(n / a * abs(mean_p - mean_y)), 6) AS ece FROM bins, w""")
def brier_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.brier_parts(metrics.calibration_bins(_scored(spark, sf_dir), "y", "p", ["row", "l_suppkey", "price", "y"])))


@query(f"""WITH s AS (SELECT {_SCORED['y']} AS y, CAST(0.2 + (l_partkey * 7 + l_linenumber * 13) % 720 / 2000.0 AS DOUBLE) AS p FROM lineitem)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM s""")
def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).agg(metrics.log_loss(F.col("y"), F.col("p")).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.count("*").alias("n")))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT k, 'both' AS side FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT k, 'unseen' AS side FROM b WHERE k NOT IN (SELECT k FROM a)""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"))
    a, b = rows.where("l_orderkey % 2 = 0").select("k"), rows.where("l_orderkey % 2 = 1").select("k")
    return metrics.overlap(a, b, "k").withColumn("side", F.lit("both")).union(metrics.unseen(a, b, "k").withColumn("side", F.lit("unseen")))


# ---- Gates and contracts


@query(f"""WITH {SHOTS_SQL}, m AS (SELECT avg(CASE WHEN shooter_id > 0 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN seconds_remaining BETWEEN 1 AND 650 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN three = (points = 3) THEN 1.0 ELSE 0.0 END) AS c FROM shots)
SELECT 'shooter is positive' AS gate, round(a, 6) AS value, 1.0 AS threshold, CASE WHEN a >= 1.0 THEN 'PASS' ELSE 'FAIL' END AS status FROM m
UNION ALL SELECT 'clock is plausible', round(b, 6), 0.95, CASE WHEN b >= 0.95 THEN 'PASS' ELSE 'WARN' END FROM m
UNION ALL SELECT 'points agree with the line', round(c, 6), 0.99, CASE WHEN c >= 0.99 THEN 'PASS' ELSE 'FAIL' END FROM m""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = [
        gates.Gate("shooter is positive", gates.share(F.col("shooter_id") > 0), 1.0),
        gates.Gate("clock is plausible", gates.share(F.col("seconds_remaining").between(1, 650)), 0.95, blocking=False),
        gates.Gate("points agree with the line", gates.share(C.is_three(F.col("loc_x"), F.col("loc_y")) == (F.col("points") == 3)), 0.99),
    ]
    return rounded(gates.run_gates(shots(spark, sf_dir), on))


_PROFILED = (("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderpriority", False))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, round(1 - count({c}) / count(*), 6) AS null_rate, {'CAST(min(' + c + ') AS DOUBLE)' if n else 'CAST(NULL AS DOUBLE)'} AS low, {'CAST(max(' + c + ') AS DOUBLE)' if n else 'CAST(NULL AS DOUBLE)'} AS high FROM orders" for c, n in _PROFILED))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.profile(table(spark, sf_dir, "orders").select(*(c for c, _ in _PROFILED))).drop("dtype")


@query()
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.fingerprint(table(spark, sf_dir, "orders"))


@query("""WITH m AS (SELECT l_orderkey AS k, list_sort(list(1 + l_suppkey % 8)) AS g FROM lineitem GROUP BY l_orderkey),
f AS (SELECT CASE WHEN len(g) <> 5 THEN 'wrong size' WHEN len(list_distinct(g)) <> 5 THEN 'repeated member' ELSE 'valid' END AS fault FROM m)
SELECT fault, count(*) AS n FROM f GROUP BY fault""")
def group_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(1 + F.col("l_suppkey") % 8).alias("g"))
    return lists.groupBy(F.coalesce(C.group_fault(F.col("g")), F.lit("valid")).alias("fault")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE contains(lower(s_name), '1') ORDER BY s_acctbal DESC, s_suppkey LIMIT 25""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "supplier").where(F.contains(F.lower("s_name"), F.lit("1")))
    return found.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25).select("s_suppkey", "s_name", "s_nationkey")


# ---- Text


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))


_BM25_SQL = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_length FROM t),
p AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t), tf AS (SELECT term, doc_id, max(length) AS length, count(*) AS tf FROM p GROUP BY term, doc_id),
q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id AS query, doc_id AS doc, sum(times * greatest(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM tf JOIN df ON tf.term = df.term JOIN qt ON tf.term = qt.term, s GROUP BY item_id, doc_id)"""


@query(f"{_BM25_SQL} SELECT query, doc, round(score, 6) AS score FROM sc")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), "doc_id", "text", "item_id", "question"))


@query(f"{_BM25_SQL}, r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return rounded(retrieval.ranks(bm25_scores(spark, sf_dir)).where("rank <= 10"))


def _exact(value: str) -> str:
    """A sum that doesn't depend on the order of rows, as retrieval.exact_sum, so that equal documents tie."""
    return f"CAST(sum(CAST({value} AS DECIMAL(38, 15))) AS DOUBLE)"


_FUSED_SQL = f"""{_BM25_SQL}, idf AS (SELECT term, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM df, s WHERE df >= 2),
wd AS (SELECT tf.term, doc_id, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term), wq AS (SELECT qt.term, item_id, times * idf AS w FROM qt JOIN idf ON qt.term = idf.term),
nd AS (SELECT doc_id, sqrt({_exact('w * w')}) AS norm FROM wd GROUP BY doc_id), nq AS (SELECT item_id, sqrt({_exact('w * w')}) AS norm FROM wq GROUP BY item_id),
sx AS (SELECT item_id AS query, doc_id AS doc, {_exact('times * greatest(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))')} AS score
  FROM tf JOIN df ON tf.term = df.term JOIN qt ON tf.term = qt.term, s GROUP BY item_id, doc_id),
dots AS (SELECT wq.item_id, wd.doc_id, {_exact('wd.w * wq.w')} AS dot FROM wd JOIN wq ON wd.term = wq.term GROUP BY wq.item_id, wd.doc_id),
legs AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sx
  UNION ALL SELECT dots.item_id, dots.doc_id, row_number() OVER (PARTITION BY dots.item_id ORDER BY round(dot / nd.norm / nq.norm, 9) DESC, dots.doc_id) FROM dots JOIN nd ON nd.doc_id = dots.doc_id JOIN nq ON nq.item_id = dots.item_id),
fu AS (SELECT query, doc, sum(1 / (60 + rank)) AS score FROM legs GROUP BY query, doc)"""


@query(f"{_FUSED_SQL} SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM fu")
def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    # a leg is written before the next is made: what is shuffled for it goes then
    legs = [sequence.written(retrieval.ranks(f(docs, asked, "doc_id", "text", "item_id", "question", total=retrieval.exact_sum)).select("query", "doc", "rank")) for f in (retrieval.bm25, retrieval.tfidf_cosine)]
    return rounded(retrieval.ranks(retrieval.fuse(*legs)))


@query()
def latent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest to each benchmark item in a latent space of sixteen directions."""
    found = latent.lsa_scores(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), "doc_id", "text", "item_id", "question", k=16, top=10, iterations=4)
    return rounded(retrieval.ranks(found))


#: Words in a row that a document shares with a benchmark item it holds a passage of.
SHARED_RUN = 8


def _holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, doc) of the items and the documents that share any run of SHARED_RUN words."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")

    def held(df: DataFrame, key: str, name: str) -> DataFrame:
        words = df.select(F.col(key).alias(name), C.tokens(F.col("text")).alias("t")).where(F.size("t") >= SHARED_RUN)
        of = F.transform(F.sequence(F.lit(1), F.size("t") - SHARED_RUN + 1), lambda i: F.array_join(F.slice("t", i, SHARED_RUN), " "))
        return words.select(name, F.explode(of).alias("run"))

    return held(docs, "doc_id", "doc").join(held(items, "item_id", "query"), "run").select("query", "doc").distinct()


_RUNS_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS side, {i} AS id, unnest(list_transform(range(1, len(w) - {SHARED_RUN - 2}), lambda i: array_to_string(w[i:i + {SHARED_RUN - 1}], ' '))) AS run FROM (SELECT {i}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {t}) WHERE len(w) >= {SHARED_RUN}" for k, i, t in (("doc", "doc_id", "documents"), ("item", "item_id", "benchmark")))


@query(f"""{_BM25_SQL}, runs AS ({_RUNS_SQL}), rel AS (SELECT DISTINCT b.id AS query, a.id AS doc FROM runs a JOIN runs b ON a.run = b.run AND a.side = 'doc' AND b.side = 'item'),
rk AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS place FROM sc), n AS (SELECT query, count(*) AS n FROM rel GROUP BY query),
h AS (SELECT rk.query, count(CASE WHEN place <= 10 THEN 1 END) AS found, min(place) AS first, sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM rk JOIN rel ON rel.query = rk.query AND rel.doc = rk.doc GROUP BY rk.query)
SELECT n.query, round(coalesce(found, 0) / least(n, 10), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) for i in range(1, least(n, 10) + 1)]), 6) AS ndcg FROM n LEFT JOIN h ON h.query = n.query""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the words of a benchmark item find the documents that hold a passage of it."""
    docs = table(spark, sf_dir, "documents")
    ranked = retrieval.ranks(retrieval.bm25(docs, _questions(spark, sf_dir), "doc_id", "text", "item_id", "question"))
    return rounded(metrics.ranking_metrics(ranked, _holding(spark, sf_dir)))


@query("""WITH c AS (SELECT s_suppkey AS doc, count(*) AS n, round(avg(l_quantity), 1) AS a FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey),
s AS (SELECT doc, 0 AS "at", CAST(n AS VARCHAR) AS said FROM c UNION ALL SELECT doc, 1, printf('%.1f', a * 3) FROM c UNION ALL SELECT doc, 2, printf('%.2f', n / 100) FROM c UNION ALL SELECT doc, 3, CAST(n AS VARCHAR) || '%' FROM c),
x AS (SELECT doc, "at", said, CAST(replace(said, '%', '') AS DOUBLE) AS v, CASE WHEN ends_with(said, '%') THEN CAST(replace(said, '%', '') AS DOUBLE) / 100 ELSE CAST(said AS DOUBLE) * 100 END AS w FROM s),
f AS (SELECT doc, CAST(n AS DOUBLE) AS fact FROM c UNION ALL SELECT doc, a FROM c)
SELECT x.doc, "at", said, bool_or(CASE WHEN fact = 0 THEN abs(v) < 1e-9 OR abs(w) < 1e-9 ELSE least(abs(v - fact) / abs(fact), abs(w - fact) / abs(fact), abs(v - fact * 100) / abs(fact * 100), abs(w - fact * 100) / abs(fact * 100)) <= 0.02 END) AS traced
FROM x JOIN f ON x.doc = f.doc GROUP BY x.doc, "at", said""")
def traced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 1).alias("a"))
    text = F.format_string("Seen %d times, %.1f each per 100 possessions, so %.2f or %d%%.", F.col("n"), F.col("a") * 3, F.col("n") / 100, F.col("n"))
    values = facts.select("doc", F.explode(F.array(F.col("n").cast("double"), F.col("a"))).alias("value"))
    return retrieval.traced_numbers(facts.select("doc", text.alias("text")), values, "doc", "text", "value")




# further queries register themselves
from groupwise.plans import ablations, checks, lineups, more, summaries  # noqa: E402, F401
