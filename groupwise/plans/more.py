"""Further registered queries: raw events, reports, gates, contracts, narratives and the conversion ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.functions import columns as C
from groupwise.operators import aggregate, answers, conversion, events, gates, metrics, models, narratives, presence, priors, reports, sparse_ridge
from groupwise.plans.registry import QUERIES, query, rounded
from groupwise.plans.roles import GROUPS_SQL, SCORERS_SQL, SHOTS_SQL, possessions, scorers, shots, table

# ---- Raw events

#: Expressions that Spark and DuckDB both read: text ids without their zeros, some event numbers and clocks that are none.
_RAW = {
    "game_id": "CAST((1 + l_orderkey % 7) * 10000000 + (l_suppkey % 30) * 100000 + l_orderkey % 100000 AS VARCHAR(12))",
    "event_num": "CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR(12)) END",
    "clock": "CASE WHEN l_partkey % 11 = 0 THEN 'n/a' ELSE concat(lpad(CAST(l_partkey % 12 AS VARCHAR(12)), 2, '0'), ':', lpad(CAST(l_suppkey % 60 AS VARCHAR(12)), 2, '0')) END",
}
_RAW_SQL = f"""raw AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _RAW.items())} FROM lineitem),
padded AS (SELECT lpad(game_id, 10, '0') AS game_id, TRY_CAST(event_num AS BIGINT) AS event_num, clock FROM raw),
kept AS (SELECT *, row_number() OVER (PARTITION BY game_id, event_num ORDER BY clock) AS r FROM padded WHERE substr(game_id, 1, 3) IN ('002', '004', '005')),
typed AS (SELECT game_id, event_num, 2000 + CAST(substr(game_id, 4, 2) AS INT) AS season, CASE substr(game_id, 1, 3) WHEN '002' THEN 'regular' WHEN '004' THEN 'playoffs' ELSE 'playin' END AS game_type,
  CASE WHEN clock <> 'n/a' THEN CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT) END AS seconds_remaining FROM kept WHERE r = 1)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _RAW.items()))
    return events.type_events(raw.select(*(F.col(c).cast("string").alias(c) for c in _RAW)), ("event_num",))


@query(f"WITH {_RAW_SQL} SELECT season, game_type, count(*) AS n, count(event_num) AS numbered, CAST(sum(seconds_remaining) AS BIGINT) AS seconds, count(DISTINCT game_id) AS games FROM typed GROUP BY season, game_type")
def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text event rows typed, by season and game type."""
    return _typed(spark, sf_dir).groupBy("season", "game_type").agg(F.count("*").alias("n"), F.count("event_num").alias("numbered"), F.sum("seconds_remaining").cast("long").alias("seconds"), F.countDistinct("game_id").alias("games"))


@query(f"WITH {_RAW_SQL}, d AS (SELECT game_id, substr(game_id, 4, 2) AS digits FROM padded) SELECT digits, count(*) AS n FROM d WHERE digits <> '23' GROUP BY digits")
def season_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that name another season than the one asked for."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(f"{_RAW['game_id']} AS game_id")
    return events.wrong_seasons(raw.select(C.padded_id(F.col("game_id")).alias("game_id")), "game_id", 2023)


@query("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS season FROM orders)
SELECT season, printf('%d-%02d', season, (season + 1) % 100) AS label, printf('%02d', season % 100) AS two_digit, season + 1 AS file_year, season AS from_label, CAST(NULL AS INT) AS from_wrong FROM y""")
def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasons of the orders with their labels, and what labels are read as."""
    found = events.season_table(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")), "y")
    wrong = F.concat(F.substring("label", 1, 5), F.format_string("%02d", (F.col("season") + 2) % 100))
    return found.withColumn("from_label", events.season_of_label(F.col("label"))).withColumn("from_wrong", events.season_of_label(wrong))


_CLAIMS = {
    "event_type": "1 + l_partkey % 20", "action_type": "l_suppkey % 32", "player1": "l_suppkey", "type1": "3 + l_linenumber % 4", "player2": "l_partkey",
    "type2": "4 + l_orderkey % 3", "player3": "l_partkey % 50 - 5", "type3": "4 + l_suppkey % 2",
}


@query(f"""WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _CLAIMS.items())} FROM lineitem),
a AS (SELECT *, event_type NOT IN (8, 9, 11, 12, 13, 18) AND NOT (event_type = 6 AND action_type IN (10, 11, 12, 13, 16, 18, 19, 25, 30)) AS acts FROM r),
c AS (SELECT player1 AS member, type1 AS side, CASE WHEN event_type = 8 THEN 'OUT' WHEN event_type = 11 THEN 'EJECT' WHEN acts THEN 'EV' END AS kind FROM a
  UNION ALL SELECT player2, type2, CASE WHEN event_type = 8 THEN 'IN' WHEN acts AND event_type IN (1, 5, 6, 10) THEN 'EV' END FROM a
  UNION ALL SELECT player3, type3, CASE WHEN acts AND event_type IN (2, 6, 10) THEN 'EV' END FROM a)
SELECT side, kind, count(*) AS n, CAST(sum(member) AS BIGINT) AS members FROM c WHERE kind IS NOT NULL AND side IN (4, 5) AND member > 0 GROUP BY side, kind""")
def presence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence claims of raw event rows, by side and kind."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _CLAIMS.items()))
    return presence.claims(raw, []).groupBy("side", "kind").agg(F.count("*").alias("n"), F.sum("member").alias("members"))


# ---- Joins and reports


@query(f"""WITH {GROUPS_SQL}, e AS (SELECT l_orderkey AS game_id, l_linenumber AS event FROM lineitem WHERE l_linenumber <= 6), s AS (SELECT l_orderkey AS game_id, l_linenumber AS event, l_returnflag FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(p.own_key) AS with_list, CAST(sum(p.own[1]) AS BIGINT) AS firsts FROM s LEFT JOIN e ON s.game_id = e.game_id AND s.event = e.event LEFT JOIN possessions p ON e.game_id = p.game_id GROUP BY l_returnflag""")
def shots_with_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots with the lists of who was there, where there are any."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("event"), "l_returnflag")
    lists = lines.where("event <= 6").select("game_id", "event").join(possessions(spark, sf_dir).select("game_id", "own", "own_key"), "game_id")
    return reports.with_lists(lines, lists, ["game_id", "event"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("own_key").alias("with_list"), F.sum(F.get("own", F.lit(0))).alias("firsts"))


def _oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, oracle): an independent list of most possessions, in another order and sometimes with another member."""
    swapped = F.when(F.col("game_id") % 17 == 0, F.concat(F.array(F.lit(0).cast("bigint")), F.slice("own", 2, 4))).otherwise(F.col("own"))
    return possessions(spark, sf_dir).where("game_id % 10 <> 0").select("game_id", F.reverse(swapped).alias("oracle"))


@query(f"""WITH {GROUPS_SQL}, p AS (SELECT game_id, own, CASE WHEN game_id % 10 <> 0 THEN CASE WHEN game_id % 17 = 0 THEN list_concat([CAST(0 AS BIGINT)], own[2:5]) ELSE own END END AS oracle FROM possessions),
a AS (SELECT game_id, oracle, CAST(CAST(list_sort(oracle) = list_sort(own) AS INT) AS DOUBLE) AS same FROM p)
SELECT count(*) AS n, round(avg(CASE WHEN oracle IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS covered, round(avg(same), 6) AS agree, round(avg(CASE WHEN game_id % 13 <> 0 THEN same END), 6) AS agree_clear FROM a""")
def oracle_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an independent list has the same members."""
    return rounded(reports.agreement(possessions(spark, sf_dir), _oracle(spark, sf_dir), ["game_id"], "own", "oracle", F.col("game_id") % 13 == 0))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS attempts FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey), r AS (SELECT l_suppkey, round(avg(l_quantity), 6) AS rating FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey)
SELECT s_suppkey, s_name, coalesce(attempts, 0) AS attempts, coalesce(rating, 0) AS rating FROM supplier LEFT JOIN a ON s_suppkey = a.l_suppkey LEFT JOIN r ON s_suppkey = r.l_suppkey""")
def member_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers with what is known of them."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    attempts = lines.where("l_returnflag = 'R'").groupBy("s_suppkey").agg(F.count("*").alias("attempts"))
    rating = lines.where("s_suppkey % 3 <> 0").groupBy("s_suppkey").agg(F.round(F.avg("l_quantity"), 6).alias("rating"))
    return reports.directory(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", attempts, rating)


@query("""SELECT s_suppkey, s_name FROM (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) t WHERE r <= 500""")
def member_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first suppliers by balance: 700 are asked for, 500 are the most."""
    return reports.listing(table(spark, sf_dir, "supplier"), 700, F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_name")


_STATUS_SQL = "CASE WHEN game_id % 10 < 6 THEN 'EXACT' WHEN game_id % 10 < 8 THEN 'SOLVED' WHEN game_id % 10 = 8 THEN 'REPAIRED' ELSE 'UNDERDETERMINED' END"


@query(f"""WITH {SHOTS_SQL}, b AS (SELECT game_id, {_STATUS_SQL} AS status, CASE WHEN shooter_id % 9 = 0 THEN '3PT Jump Shot' WHEN three THEN '3PT Pullup' ELSE 'Layup' END AS label, three, period <= 4 AS covered FROM shots)
SELECT count(*) AS n, count(DISTINCT game_id) AS games, round(avg(CASE WHEN status = 'EXACT' THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN status IN ('EXACT', 'SOLVED') THEN 1.0 ELSE 0.0 END), 6) AS resolved,
  count(CASE WHEN status IN ('EXACT', 'SOLVED') THEN 1 END) AS valid, count(CASE WHEN status = 'REPAIRED' THEN 1 END) AS imputed, count(CASE WHEN status = 'UNDERDETERMINED' THEN 1 END) AS quarantined,
  round(avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END), 6) AS covered, round(avg(CASE WHEN contains(label, '3PT') = three THEN 1.0 ELSE 0.0 END), 6) AS label_agrees FROM b""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shots(spark, sf_dir).withColumn("status", F.expr(_STATUS_SQL))
    three = C.is_three(F.col("loc_x"), F.col("loc_y"))
    label = F.when(F.col("shooter_id") % 9 == 0, "3PT Jump Shot").when(three, "3PT Pullup").otherwise("Layup")
    return rounded(reports.build_report(rows, "game_id", F.col("status"), presence.quality_of(F.col("status")), F.col("period") <= 4, label, three))


@query(f"""WITH {GROUPS_SQL}, g AS (SELECT own_key, count(*) AS n, sum(points) AS points FROM possessions GROUP BY own_key)
SELECT count(*) AS groups, CAST(median(n) AS DOUBLE) AS median_evidence, count(CASE WHEN n >= 30 THEN 1 END) AS n_reportable, round(avg(CASE WHEN n >= 30 THEN 1.0 ELSE 0.0 END), 6) AS share_reportable, round(sum(CASE WHEN n >= 30 THEN points ELSE 0 END) / sum(points), 6) AS measure_reportable,
  count(CASE WHEN n >= 10 THEN 1 END) AS n_directional, round(avg(CASE WHEN n >= 10 THEN 1.0 ELSE 0.0 END), 6) AS share_directional, round(sum(CASE WHEN n >= 10 THEN points ELSE 0 END) / sum(points), 6) AS measure_directional FROM g""")
def estimability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there is enough evidence for."""
    groups = possessions(spark, sf_dir).groupBy("own_key").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    return rounded(reports.estimability(groups, "n", "points", {"reportable": 30, "directional": 10}))


_MOVES_SQL = """o AS (SELECT o_custkey AS unit, o_orderdate, o_orderkey, o_orderstatus AS team, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS g FROM orders),
r AS (SELECT unit, team, g, count(*) AS n, min(o_orderdate) AS cutoff, min(struct_pack(d := o_orderdate, k := o_orderkey)) AS s FROM o GROUP BY unit, team, g),
b AS (SELECT *, lag(team) OVER (PARTITION BY unit ORDER BY s) AS from_team, lag(n) OVER (PARTITION BY unit ORDER BY s) AS n_before FROM r),
moves AS (SELECT unit, from_team, team AS to_team, n_before, n AS n_after, cutoff FROM b WHERE n_before >= 2 AND n >= 2)"""


@query(f"WITH {_MOVES_SQL} SELECT from_team, to_team, count(*) AS n, CAST(median(n_after) AS DOUBLE) AS median_after FROM moves GROUP BY from_team, to_team")
def move_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.move_summary(QUERIES["unit_moves"](spark, sf_dir), ["from_team", "to_team"], "n_after")


@query(f"""WITH {_MOVES_SQL}, n AS (SELECT *, ntile(6) OVER (ORDER BY cutoff, unit, from_team, to_team, n_before, n_after) - 1 AS bucket FROM moves)
SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, min(cutoff) AS label, CAST(sum(unit) AS BIGINT) AS units FROM n GROUP BY bucket""")
def move_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.move_buckets(QUERIES["unit_moves"](spark, sf_dir), 6, "cutoff", "unit", "from_team", "to_team", "n_before", "n_after")
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.sum("unit").alias("units"))


@query("""WITH v AS (SELECT CAST(l_quantity AS DOUBLE) - 25 AS v FROM lineitem)
SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, max(abs(v)) AS max_abs, round(avg(CASE WHEN abs(v) < 5 THEN 1.0 ELSE 0.0 END), 6) AS within FROM v""")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.distribution(table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") - 25).alias("v")), "v", 5.0))


@query(f"""WITH {SHOTS_SQL} SELECT CAST(season AS INT) AS season, count(*) AS n, count(DISTINCT game_id) AS games, round(avg(CASE WHEN period <= 4 THEN 1.0 ELSE 0.0 END), 6) AS covered, round(avg(CASE WHEN {_STATUS_SQL} IN ('EXACT', 'SOLVED') THEN 1.0 ELSE 0.0 END), 6) AS clean FROM shots GROUP BY season""")
def quality_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, coverage and the clean share of each season."""
    rows = shots(spark, sf_dir).withColumn("status", F.expr(_STATUS_SQL))
    return rounded(rows.groupBy(F.col("season").cast("int").alias("season")).agg(F.count("*").alias("n"), F.countDistinct("game_id").alias("games"), reports.share(F.col("period") <= 4).alias("covered"), reports.share(F.col("status").isin("EXACT", "SOLVED")).alias("clean")))


# ---- Gates and contracts


@query(f"""WITH {GROUPS_SQL}, {_RAW_SQL}, s AS (SELECT l_orderkey AS game_id, l_linenumber AS event FROM lineitem), p AS (SELECT *, 1 + (game_id * 7 + unit) % 40 AS seconds, CASE WHEN game_id % 10 <> 0 THEN CASE WHEN game_id % 17 = 0 THEN list_concat([CAST(0 AS BIGINT)], own[2:5]) ELSE own END END AS oracle FROM possessions),
m AS (SELECT 'valid groups have five a side' AS gate, avg(CASE WHEN len(own) = 5 AND len(other) = 5 THEN 1.0 ELSE 0.0 END) AS v, 1.0 AS t FROM p
  UNION ALL SELECT 'hash does not depend on order', avg(CASE WHEN md5(array_to_string(list_sort(list_reverse(own)), ',')) = own_key THEN 1.0 ELSE 0.0 END), 1.0 FROM p
  UNION ALL SELECT 'durations are positive', avg(CASE WHEN seconds > 0 THEN 1.0 ELSE 0.0 END), 1.0 FROM p
  UNION ALL SELECT 'length is plausible', avg(CASE WHEN seconds BETWEEN 1 AND 35 THEN 1.0 ELSE 0.0 END), 0.95 FROM p
  UNION ALL SELECT 'oracle agrees', avg(CASE WHEN list_sort(oracle) = own THEN 1.0 ELSE 0.0 END), 0.93 FROM p WHERE oracle IS NOT NULL
  UNION ALL SELECT 'oracle agrees where clear', avg(CASE WHEN list_sort(oracle) = own THEN 1.0 ELSE 0.0 END), 0.96 FROM p WHERE oracle IS NOT NULL AND game_id % 13 <> 0
  UNION ALL SELECT 'shots have lists', avg(CASE WHEN event <= 6 THEN 1.0 ELSE 0.0 END), 0.99 FROM s
  UNION ALL SELECT 'shots lie in possessions', avg(CASE WHEN p.game_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.99 FROM s LEFT JOIN p ON s.game_id = p.game_id
  UNION ALL SELECT 'ids name their season', avg(CASE WHEN season = 2000 + CAST(substr(game_id, 4, 2) AS INT) THEN 1.0 ELSE 0.0 END), 1.0 FROM typed)
SELECT gate, round(v, 6) AS value, t AS threshold, CASE WHEN v >= t THEN 'PASS' ELSE 'FAIL' END AS status FROM m""")
def named_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates that a build must pass, each on its table in one pass."""
    p = possessions(spark, sf_dir).withColumn("seconds", 1 + (F.col("game_id") * 7 + F.col("unit")) % 40)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("event"))
    placed = lines.join(p.select("game_id", F.lit(True).alias("placed")), "game_id", "left")
    both = p.join(_oracle(spark, sf_dir), "game_id")
    clear = F.col("game_id") % 13 != 0
    parts = [
        gates.run_gates(p, gates.group_gates("own", "other", "own_key", "seconds")),
        gates.run_gates(both, gates.oracle_gates("own", "oracle")),
        gates.run_gates(both.where(clear), gates.oracle_gates("own", "oracle", clear=True)),
        gates.run_gates(placed, gates.placement_gates(F.col("event") <= 6, F.col("placed"))),
        gates.run_gates(_typed(spark, sf_dir), [gates.season_gate("game_id", "season")]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


_CONTRACTED = {"region": ("r_name", "r_regionkey"), "nation": ("n_name", "n_nationkey", "n_regionkey"), "benchmark": ("item_id", "text")}


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH h AS (SELECT sha256({" || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(92) || 'N')" for c in cs)}) AS h FROM {t})
SELECT '{t}' AS "table", count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS digest FROM h)""" for t, cs in _CONTRACTED.items()))
def contract_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest of each contracted table."""
    return reports.contracts({t: table(spark, sf_dir, t).select(*cs) for t, cs in _CONTRACTED.items()}).drop("columns")


@query("""WITH c AS (SELECT n_regionkey, count(*) AS a, count(CASE WHEN n_nationkey <> 3 THEN 1 END) AS b FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, 'nested.n' AS path, 'value' AS problem FROM c WHERE a <> b UNION ALL SELECT n_regionkey, 'nested.keys', 'length' FROM c WHERE a <> b
UNION ALL SELECT n_regionkey, 'nested.keys[' || CAST(i AS VARCHAR) || ']', CASE WHEN i >= len(y) THEN 'new' ELSE 'value' END FROM
  (SELECT n_regionkey, x, y, unnest(range(len(x))) AS i FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS x, list(n_nationkey ORDER BY n_nationkey) FILTER (WHERE n_nationkey <> 3) AS y FROM nation GROUP BY n_regionkey) t) u
  WHERE i >= len(y) OR x[i + 1] <> y[i + 1]""")
def nested_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two nested results differ, one of them without a nation."""
    nested = lambda df: df.groupBy("n_regionkey").agg(F.struct(F.count("*").alias("n"), F.sort_array(F.collect_list("n_nationkey")).alias("keys")).alias("nested"))
    nation = table(spark, sf_dir, "nation")
    return reports.nested_diff(nested(nation), nested(nation.where("n_nationkey <> 3")), ["n_regionkey"], 1e-9)


@query("""SELECT item_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS pin FROM benchmark""")
def pinned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of texts whose lines ended another way in between."""
    return table(spark, sf_dir, "benchmark").select("item_id", reports.pinned(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("pin"))


# ---- Published answers


@query(f"""WITH {GROUPS_SQL} SELECT DISTINCT own_key, array_to_string(own, ',') AS canonical FROM possessions""")
def group_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's key and canonical form, from its members in any order."""
    back = F.reverse("own")
    return possessions(spark, sf_dir).select(C.group_key(back).alias("own_key"), F.array_join(F.sort_array(back).cast("array<string>"), ",").alias("canonical")).distinct()


@query(f"""WITH {SHOTS_SQL} SELECT zone_id, max(points) AS points, count(*) AS attempts, min(loc_x) AS low_x, max(loc_x) AS high_x, min(loc_y) AS low_y, max(loc_y) AS high_y,
  printf('M%.1f %.1f L%.1f %.1f L%.1f %.1f L%.1f %.1f Z', CAST(min(loc_x) AS DOUBLE), CAST(min(loc_y) AS DOUBLE), CAST(max(loc_x) AS DOUBLE), CAST(min(loc_y) AS DOUBLE), CAST(max(loc_x) AS DOUBLE), CAST(max(loc_y) AS DOUBLE), CAST(min(loc_x) AS DOUBLE), CAST(max(loc_y) AS DOUBLE)) AS path FROM shots GROUP BY zone_id""")
def zone_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones that shots lie in, with the box around them as a path."""
    low, high = (lambda c: F.min(c)), (lambda c: F.max(c))
    found = shots(spark, sf_dir).groupBy("zone_id").agg(F.max("points").alias("points"), F.count("*").alias("attempts"), low("loc_x").alias("low_x"), high("loc_x").alias("high_x"), low("loc_y").alias("low_y"), high("loc_y").alias("high_y"))
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    corners = F.array(corner("low_x", "low_y"), corner("high_x", "low_y"), corner("high_x", "high_y"), corner("low_x", "high_y"))
    return found.withColumn("path", answers.outline_path(corners))


_SUPPORTED = f"""WITH {GROUPS_SQL}, {SCORERS_SQL}, a AS (SELECT member, count(*) AS n FROM scorers WHERE l_returnflag = 'R' GROUP BY member),
g AS (SELECT own_key, CAST(sum(points) AS BIGINT) AS points, count(*) AS n_rows, min(own) AS own FROM possessions GROUP BY own_key),
x AS (SELECT own_key, points, n_rows, unnest(own) AS member FROM g),
sup AS (SELECT own_key, max(points) AS points, max(n_rows) AS n_rows, min(coalesce(n, 0)) AS min_attempts FROM x LEFT JOIN a ON x.member = a.member GROUP BY own_key)"""


@query(f"{_SUPPORTED} SELECT own_key, n_rows, points, min_attempts FROM sup WHERE min_attempts >= 30")
def support_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the groups above the floor of directions."""
    attempts = scorers(spark, sf_dir).where("l_returnflag = 'R'").groupBy("member").agg(F.count("*").alias("n"))
    return aggregate.support(possessions(spark, sf_dir), "own_key", "own", attempts, "points").where("min_attempts >= 30").select("own_key", "n_rows", "points", "min_attempts")


@query(f"""WITH {SHOTS_SQL}, t AS (SELECT team_id, zone_id, count(*) AS n FROM shots GROUP BY team_id, zone_id), a AS (SELECT team_id, sum(n) AS n FROM t GROUP BY team_id)
SELECT 'price' AS profile, -1 AS key, zone_id, round(avg(CAST(made AS INT) * points), 6) AS value, count(*) AS n FROM shots GROUP BY zone_id
UNION ALL SELECT 'mix', CAST(t.team_id AS INT), zone_id, round(t.n / a.n, 6), t.n FROM t JOIN a ON t.team_id = a.team_id
UNION ALL SELECT 'rate', CAST(team_id AS INT), zone_id, round(avg(CAST(made AS INT)), 6), count(*) FROM shots GROUP BY team_id, zone_id""")
def selection_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup tables of the choice model in one long table."""
    s = shots(spark, sf_dir).withColumn("team", F.col("team_id").cast("int"))
    made = F.col("made").cast("double")
    price = s.groupBy("zone_id").agg(F.avg(made * F.col("points")).alias("value"), F.count("*").alias("n")).select(F.lit("price").alias("profile"), F.lit(-1).alias("key"), "zone_id", "value", "n")
    by_team = s.groupBy("team", "zone_id").agg(F.avg(made).alias("rate"), F.count("*").alias("n"))
    whole = by_team.groupBy("team").agg(F.sum("n").alias("all"))
    mix = by_team.join(whole, "team").select(F.lit("mix").alias("profile"), F.col("team").alias("key"), "zone_id", (F.col("n") / F.col("all")).alias("value"), "n")
    rate = by_team.select(F.lit("rate").alias("profile"), F.col("team").alias("key"), "zone_id", F.col("rate").alias("value"), "n")
    return rounded(price.unionByName(mix).unionByName(rate))


@query()
def home_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' totals from a ridge with a column for the home side, which has no penalty."""
    rows = models.with_home(possessions(spark, sf_dir).withColumn("is_home", F.col("game_id") % 2 == 0), "is_home")
    found = sparse_ridge.effects(rows, {"own": "own", "other": "other", "home": "home"}, "points", {"own": 200.0, "other": 400.0, "home": 0.0})
    # the two lists name their members apart
    same = found.withColumn("member", F.when(F.col("block") == "other", F.col("member") - 1000000000).otherwise(F.col("member")))
    return rounded(models.member_totals(same, "own", "other"), 4)


# ---- Evaluation

_P_SQL = "CAST(0.2 + (l_partkey * 7 + l_linenumber * 13) % 720 / 2000.0 AS DOUBLE)"


@query(f"""WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {_P_SQL} AS p, CAST(year(l_shipdate) AS INT) AS season FROM lineitem), b AS (SELECT avg(y) AS base FROM s),
m AS (SELECT season, 'full' AS model, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS value FROM s GROUP BY season UNION ALL SELECT season, 'base', avg(-(y * ln(base) + (1 - y) * ln(1 - base))) FROM s, b GROUP BY season)
SELECT f.season, 'full' AS model, round(f.value, 6) AS value, round(g.value, 6) AS against, round((g.value - f.value) / g.value, 6) AS relative FROM m f JOIN m g ON f.season = g.season AND f.model = 'full' AND g.model = 'base'""")
def model_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much a model's loss lies below its counterpart's, by season."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", f"{_P_SQL} AS p", "year(l_shipdate) AS season")
    base = rows.agg(F.avg("y").alias("base"))
    one = lambda name, p, df: df.groupBy("season").agg(metrics.log_loss(F.col("y"), F.col(p)).alias("value")).withColumn("model", F.lit(name))
    values = one("full", "p", rows).unionByName(one("base", "base", rows.crossJoin(F.broadcast(base))))  # one row
    return rounded(reports.improvements(values, {"full": "base"}, ["season"]))


@query()
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", f"{_P_SQL} AS p", "l_orderkey", "l_linenumber")
    return rounded(reports.calibration_report(rows, "y", "p", ["l_orderkey", "l_linenumber"]))


@query()
def ranking_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.ranking_refusals(QUERIES["ranked_plays"](spark, sf_dir).withColumnRenamed("shooter_id", "request")))


def _conversion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groupwise.operators.sequence import written

    lists = possessions(spark, sf_dir).select("game_id", "own", F.col("other").alias("defence"))
    rows = shots(spark, sf_dir).join(lists, "game_id").select(
        F.monotonically_increasing_id().alias("row"), "game_id", "shooter_id", "zone_id", "points", "made", "own", "defence", F.sqrt(F.col("loc_x") * F.col("loc_x") + F.col("loc_y") * F.col("loc_y")).alias("distance"),
        (F.col("period") >= 4).alias("clutch"), (F.col("seconds_remaining") % 24 >= 17).alias("late_clock"), (F.col("game_id") % 2).alias("out"), F.when(F.col("season") >= 1997, F.lit(0)).alias("later"),
    )
    return written(rows)


@query()
def conversion_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion models' losses, on games held out and on later games."""
    return rounded(conversion.train_and_evaluate(_conversion_rows(spark, sf_dir), {"games_out": "out", "forward": "later"}), 4)


@query()
def conversion_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lists of members add to foretelling makes on half of the games, beside the same with the lists moved to other rows."""
    return rounded(conversion.lineup_control(_conversion_rows(spark, sf_dir), F.col("out") == 1, 11))


@query()
def conversion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By zone, what the final fit of all rows foretells beside what happened."""
    scored = conversion.fit_and_foretell(_conversion_rows(spark, sf_dir))[1]
    return rounded(scored.groupBy("zone_id").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), metrics.log_loss(F.col("y"), F.col("p")).alias("log_loss")), 4)


# ---- Narratives


def _group_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of members: names from their numbers, shares from their shots."""
    s = shots(spark, sf_dir)
    at = lambda *zones: F.avg(F.col("zone_id").isin(*zones).cast("double"))
    word = lambda c, tail: F.concat(F.lit("M"), F.translate(c.cast("string"), "0123456789", "abcdefghij"), F.lit(f"o {tail}"))
    found = s.groupBy(F.col("shooter_id").alias("doc")).agg(F.count("*").alias("rows"), (100 * F.avg(F.col("made").cast("double") * F.col("points"))).alias("per_100"), at(*C.THREES).alias("three"), at("restricted_area").alias("rim"), at("mid_baseline", "mid_wing", "mid_top").alias("mid"))
    level = F.when(F.col("per_100") > 60, "above the usual").otherwise("at the usual")
    return found.withColumn("names", F.array(word(F.col("doc"), "Dabarelli"), word(F.col("doc") + 7, "Estevanor"))).withColumn("level", level).withColumn("below_floor", F.col("rows") % 3 == 0)


@query(f"""WITH {SHOTS_SQL}, g AS (SELECT shooter_id AS doc, count(*) AS n, avg(CASE WHEN points = 3 THEN 1.0 ELSE 0.0 END) AS three, avg(CASE WHEN zone_id = 'restricted_area' THEN 1.0 ELSE 0.0 END) AS rim,
  avg(CASE WHEN zone_id IN ('mid_baseline', 'mid_wing', 'mid_top') THEN 1.0 ELSE 0.0 END) AS mid FROM shots GROUP BY shooter_id)
SELECT doc, n AS rows, CASE WHEN three >= 0.45 THEN 'a heavy share' WHEN three >= 0.35 THEN 'an above-average share' WHEN three >= 0.22 THEN 'a modest share' ELSE 'a small share' END || ' (' || CAST(CAST(round_even(100 * three, 0) AS INT) AS VARCHAR) || '%)' AS phrase,
  coalesce(nullif(concat_ws(',', CASE WHEN three >= 0.42 THEN 'three-heavy' END, CASE WHEN rim >= 0.34 THEN 'rim-pressuring' END, CASE WHEN mid >= 0.22 THEN 'mid-range-reliant' END), ''), 'balanced') AS tags,
  CASE WHEN three >= 0.45 AND rim <= 0.25 THEN 'perimeter scorer' WHEN rim >= 0.45 AND three <= 0.15 THEN 'interior big' WHEN three >= 0.35 AND rim >= 0.30 THEN 'stretch big' WHEN rim >= 0.38 THEN 'slashing guard' ELSE 'balanced wing' END AS archetype FROM g""")
def style_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' shares in words."""
    three, rim, mid = F.col("three"), F.col("rim"), F.col("mid")
    return _group_documents(spark, sf_dir).select("doc", "rows", narratives.share_phrase(three).alias("phrase"), F.array_join(narratives.style_tags(three, rim, mid), ",").alias("tags"), narratives.archetype(three, rim).alias("archetype"))


@query()
def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in all variants."""
    docs = _group_documents(spark, sf_dir)
    parts = [narratives.rendered(docs, v).withColumn("variant", F.lit(v)) for v in narratives.VARIANTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {SHOTS_SQL}, g AS (SELECT shooter_id AS doc, count(*) AS n, 100 * avg(CAST(made AS INT) * points) AS per_100, avg(CASE WHEN points = 3 THEN 1.0 ELSE 0.0 END) AS three, avg(CASE WHEN zone_id = 'restricted_area' THEN 1.0 ELSE 0.0 END) AS rim,
  avg(CASE WHEN zone_id IN ('mid_baseline', 'mid_wing', 'mid_top') THEN 1.0 ELSE 0.0 END) AS mid FROM shots GROUP BY shooter_id),
f AS (SELECT *, [CAST(n AS DOUBLE), round(per_100, 2), round(three, 4), round(rim, 4), round(mid, 4)] AS facts FROM g),
e AS (SELECT *, list_concat(facts, list_transform(facts, lambda x: round(100 * x, 4))) AS ev, round_even(100 * three, 1) AS a, round_even(100 * rim, 1) AS b, round(per_100, 1) AS c FROM f),
o AS (SELECT n % 3 = 0 AS below, len(list_filter(ev, lambda x: CASE WHEN x = 0 THEN abs(a) < 1e-9 ELSE least(abs(a - x), abs(a / 100 - x)) / abs(x) <= 0.02 END)) > 0
    AND len(list_filter(ev, lambda x: CASE WHEN x = 0 THEN abs(b) < 1e-9 ELSE least(abs(b - x), abs(b / 100 - x)) / abs(x) <= 0.02 END)) > 0 AS shares,
  len(list_filter(ev, lambda x: CASE WHEN x = 0 THEN abs(c) < 1e-9 ELSE least(abs(c - x), abs(c * 100 - x)) / abs(x) <= 0.02 END)) > 0 AS worth FROM e)
SELECT t.template, count(*) AS n, round(avg(CASE t.template WHEN 'faithful' THEN CAST(shares AS INT) WHEN 'overclaiming' THEN CAST(worth AND NOT below AS INT) ELSE 0 END), 6) AS grounded
FROM o, (SELECT unnest(['faithful', 'overclaiming', 'hallucinating']) AS template) t GROUP BY t.template""")
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of narratives of each template that keep to their documents."""
    docs = _group_documents(spark, sf_dir)
    return rounded(narratives.corpus_scores(narratives.narratives(docs), docs)).select("template", "n", "grounded")


@query()
def groundedness_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groundedness with traceability and both controls, and whether the controls are blind."""
    docs = _group_documents(spark, sf_dir)
    found = rounded(narratives.corpus_scores(narratives.narratives(docs), docs))
    return found.withColumn("warnings", F.array_join(answers.warnings(blind_easy=F.col("easy") > 0.5, blind_near_miss=F.col("near_miss") > 0.5), ","))


# ---- The whole choice model
