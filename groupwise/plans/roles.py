"""Roles that the given tables play for the operators: shots, groups of five, possessions, windows and presence facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.functions import columns as C
from groupwise.operators.presence import CANDIDATES

#: Expressions that Spark and DuckDB both read.
SHOTS = {
    "game_id": "l_orderkey",
    "shooter_id": "l_suppkey",
    "team_id": "l_partkey % 30",
    "season": "year(l_shipdate)",
    "period": "1 + l_partkey % 5",
    "seconds_remaining": "(l_partkey * 7 + l_linenumber * 13) % 720",
    "loc_x": "(l_partkey * 37 + l_linenumber * 11) % 501 - 250",
    "loc_y": "(l_suppkey * 53 + l_linenumber * 29 + l_partkey) % 470 - 47",
    "made": "l_returnflag = 'R'",
}
ZONE_SQL = """CASE
  WHEN three AND loc_y <= 92.5 AND loc_x < 0 THEN 'corner_three_left' WHEN three AND loc_y <= 92.5 THEN 'corner_three_right'
  WHEN three AND abs(loc_x) > loc_y THEN 'wing_three' WHEN three THEN 'top_three'
  WHEN sqrt(loc_x * loc_x + loc_y * loc_y) <= 40 THEN 'restricted_area'
  WHEN abs(loc_x) <= 80 AND loc_y <= 190 THEN 'paint_non_ra' WHEN loc_y <= 92.5 THEN 'mid_baseline'
  WHEN abs(loc_x) > loc_y THEN 'mid_wing' ELSE 'mid_top' END"""
SHOTS_SQL = f"""raw_shots AS (SELECT {', '.join(f'{e} AS {n}' for n, e in SHOTS.items())} FROM lineitem),
lined AS (SELECT *, CASE WHEN loc_y <= 92.5 THEN abs(loc_x) >= 220 ELSE sqrt(loc_x * loc_x + loc_y * loc_y) >= 237.5 END AS three FROM raw_shots),
zoned AS (SELECT *, {ZONE_SQL} AS zone_id FROM lined),
shots AS (SELECT *, CASE WHEN zone_id IN ('corner_three_left', 'corner_three_right', 'wing_three', 'top_three') THEN 3 ELSE 2 END AS points FROM zoned)"""
#: Each order is one possession: its five of the eight members of its customers' team (fifty customers are a team, so members grow with
#: the tables), a like five of another eight, and its lines as points.
GROUPS_SQL = """seats AS (SELECT o_orderkey AS game_id, o_orderdate AS played, o_custkey AS unit, o_custkey // 50 AS team, o_orderkey AS k, o_orderkey * 5 + 3 AS j FROM orders),
lines AS (SELECT l_orderkey AS game_id, count(*) AS points FROM lineitem GROUP BY l_orderkey),
possessions AS (SELECT game_id, list_sort([1 + team * 8 + (k % 8 + i * (1 + 2 * ((k // 8) % 2))) % 8 for i in range(5)]) AS own,
  list_sort([1000000001 + team * 8 + (j % 8 + i * (1 + 2 * ((j // 8) % 2))) % 8 for i in range(5)]) AS other, points, played, unit, unit % 30 AS offense_team_id,
  (unit + 7) % 30 AS defense_team_id, md5(array_to_string(list_sort([1 + team * 8 + (k % 8 + i * (1 + 2 * ((k // 8) % 2))) % 8 for i in range(5)]), ',')) AS own_key FROM seats JOIN lines USING (game_id))"""
#: A line's member: the supplier's place among the eight of the order's team.
SCORERS_SQL = "scorers AS (SELECT 1 + (o_custkey // 50) * 8 + l_suppkey % 8 AS member, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in SHOTS.items()))
    return raw.withColumn("zone_id", C.zone(F.col("loc_x"), F.col("loc_y"))).withColumn("points", C.shot_points(F.col("zone_id")))


def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a possession: game_id, own, other, points, played, unit, offense_team_id, defense_team_id, own_key."""
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(F.count("*").alias("points"))
    five = lambda first, n: f"sort_array(transform(sequence(0, 4), i -> {first} + (o_custkey div 50) * 8 + ({n} % 8 + i * (1 + 2 * (({n} div 8) % 2))) % 8))"
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS game_id", f"{five('1', 'o_orderkey')} AS own", f"{five('1000000001', '(o_orderkey * 5 + 3)')} AS other", "o_orderdate AS played", "o_custkey AS unit", "o_custkey % 30 AS offense_team_id", "(o_custkey + 7) % 30 AS defense_team_id")
    return orders.join(points, "game_id").withColumn("own_key", C.group_key(F.col("own")))


#: Each line as a shot with lists: its shooter is one of its order's five.
LINED_SQL = f"""{SHOTS_SQL}, {GROUPS_SQL}, ls AS (SELECT s.game_id, p.own[1 + s.shooter_id % 5] AS shooter, p.own, p.other, s.zone_id, s.points FROM shots s JOIN possessions p ON s.game_id = p.game_id)"""


def lined_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots with their shooter among own, other, team_season, chosen (the zone's place), seconds, live_ball, second_chance, clutch."""
    lists = possessions(spark, sf_dir).select("game_id", "own", "other", "offense_team_id", "unit")
    rows = shots(spark, sf_dir).join(lists, "game_id")
    chosen = F.array_position(F.array(*map(F.lit, C.ZONES)), F.col("zone_id")).cast("int") - 1
    clutch = (F.col("period") >= 4) & (F.col("seconds_remaining") <= 300)
    return rows.select(
        "game_id", F.get("own", F.col("shooter_id") % 5).alias("shooter"), "own", "other", (F.col("offense_team_id") * 100 + F.col("season") % 100).alias("team_season"), "zone_id", "points", "made", chosen.alias("chosen"),
        (F.col("seconds_remaining") % 24).cast("double").alias("seconds"), (F.col("unit") % 3 == 0).cast("double").alias("live_ball"), (F.col("seconds_remaining") % 5 == 0).cast("double").alias("second_chance"), clutch.cast("double").alias("clutch"), "period", "seconds_remaining",
    )


#: Orders as possessions of teams by season and month: a block of fifty customers plays for the team of its number, and for the next one from a day of its own on.
SEASONS_SQL = f"""{GROUPS_SQL}, sd AS (SELECT o_orderkey AS game_id, o_custkey // 50 AS block, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, year(o_orderdate) AS season, year(o_orderdate) * 12 + month(o_orderdate) AS mon FROM orders),
st AS (SELECT *, block + CASE WHEN day >= 300 + (block * 97) % 1500 THEN 1 ELSE 0 END AS team FROM sd),
sp AS (SELECT st.game_id, season, mon, team, abs(team - 1 - st.game_id % 2) AS opponent, own, other, points FROM st JOIN possessions p ON st.game_id = p.game_id)"""


def season_possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, season, at, team, opponent, own, other, points) of each order; at is the month, and a block's members change teams once."""
    block, day = F.expr("o_custkey div 50"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    team = block + F.when(day >= 300 + (block * 97) % 1500, 1).otherwise(0)
    season = F.year("o_orderdate").cast("long")
    when = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), season.alias("season"), (season * 12 + F.month("o_orderdate")).alias("at"), team.cast("long").alias("team"))
    against = F.transform("other", lambda m: m - 1000000000 + 8)  # members of the block after their own, under one name for both lists
    rows = when.join(possessions(spark, sf_dir).select("game_id", "own", against.alias("other"), "points"), "game_id")
    return rows.withColumn("opponent", F.abs(F.col("team") - 1 - F.col("game_id") % 2))


def scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, l_returnflag) of each line."""
    team = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey div 50 AS team")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(team, "l_orderkey").selectExpr("1 + team * 8 + l_suppkey % 8 AS member", "l_returnflag")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence facts from events: signup enters, error leaves, others act; periods are quarters of days."""
    kind = F.when(F.col("event_type") == "signup", "IN").when(F.col("event_type") == "error", "OUT").otherwise("EV")
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).cast("int").alias("period"), (86400 - F.hour("ts") * 3600 - F.minute("ts") * 60 - F.second("ts")).alias("clock"), "event_id", "user_id", kind.alias("kind"))


#: Users of a floor: as many as a period can have candidates, so that none is left unsolved for having too many.
FLOOR = CANDIDATES


def floor_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence facts by floors of FLOOR users: floors grow with the table, a period's members do not."""
    return assertions(spark, sf_dir).withColumn("floor", F.expr(f"user_id div {FLOOR}"))
