"""A back-test of projections: fits before each cut-off, team changes against those of teams that stayed as they were, and a placebo arm.

One pass sums the ridge's moments up by stretch between cut-offs; a bucket's fit is the sum of the stretches before it. Team changes come from sums
by team and stretch, and a team's control is the whole season's sum less its own, so neither a game nor a team is joined with every cut-off's games.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groupwise.operators import block_ridge
from groupwise.operators.models import gram
from groupwise.operators.reports import move_buckets
from groupwise.operators.sequence import asof_join, kept

#: Games that a window must hold on either side of a cut-off, buckets of cut-offs, rows that make a member an incumbent.
LEAST_GAMES, BUCKETS, INCUMBENT = 10, 6, 500


def team_changes(ratings: DataFrame, cutoffs: DataFrame, least: int = LEAST_GAMES) -> DataFrame:
    """(season, cutoff, team, n_before, before, n_after, after, control, did) for each cut-off of a season and each team with `least` games on both sides.

    ratings is (season, team, at, value), cutoffs (season, cutoff). before and after are means of the games before the cut-off and from it on; control is the mean
    change of the season's other teams with as many games, 0 without any; did is the team's own change less that.
    """
    points = kept(cutoffs.select("season", "cutoff").distinct())
    placed = points.withColumn("place", F.row_number().over(Window.partitionBy("season").orderBy("cutoff")))  # a row a cut-off of the season
    since = asof_join(ratings.select("season", "team", "at", "value"), placed.select("season", F.col("cutoff").alias("seen"), "place"), ["season"], "at", "seen", ["place"])
    sums = since.groupBy("season", "team", F.coalesce("place", F.lit(0)).alias("place")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    # a team's stretches and all cut-offs of its season, so that each cut-off finds what lies before it
    teams = sums.select("season", "team").distinct()
    grid = teams.join(placed, "season").join(sums, ["season", "team", "place"], "full").select("season", "team", "place", "cutoff", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))
    up_to = Window.partitionBy("season", "team").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    from_on = Window.partitionBy("season", "team").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    both = grid.select("season", "team", "cutoff", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{name}") for c in ("n", "total") for w, name in ((up_to, "before"), (from_on, "after"))))
    sound = both.where(F.col("cutoff").isNotNull() & (F.col("n_before") >= least) & (F.col("n_after") >= least))
    change = sound.select("season", "cutoff", "team", "n_before", (F.col("total_before") / F.col("n_before")).alias("before"), "n_after", (F.col("total_after") / F.col("n_after")).alias("after")).withColumn("change", F.col("after") - F.col("before"))
    whole = change.groupBy("season", "cutoff").agg(F.sum("change").alias("changes"), F.count("*").alias("teams"))
    control = F.when(F.col("teams") > 1, (F.col("changes") - F.col("change")) / (F.col("teams") - 1)).otherwise(0.0)
    found = change.join(whole, ["season", "cutoff"]).withColumn("control", control)
    return found.select("season", "cutoff", "team", "n_before", "before", "n_after", "after", "control", (F.col("change") - F.col("control")).alias("did"))


@dataclass
class Projected:
    """A member's effect for and against, and the error of their difference, from rows before a cut-off."""

    bucket: int
    member: int
    offence: float
    defence: float
    error: float


def effects_before(rows: DataFrame, at: str, blocks: tuple[str, str], y: str, penalties: tuple[float, float], cutoffs: dict[int, float], wanted: DataFrame) -> DataFrame:
    """(bucket, member, offence, defence, error) of wanted (bucket, member) pairs, as fits_before, from rows before each bucket's cut-off.

    Components of up to block_ridge.LARGEST columns are fitted where their pairs are, and nothing of a member's size comes to the driver; larger ones take fits_before.
    """
    order = sorted(cutoffs, key=lambda b: cutoffs[b])
    stretch = F.lit(0)
    for b in order:
        stretch = stretch + (F.col(at) >= F.lit(cutoffs[b])).cast("int")
    early = rows.withColumn("__stretch", stretch).where(F.col("__stretch") < len(order))
    parts = block_ridge.Parts(early, {"own": blocks[0], "other": blocks[1]}, y, "__stretch")
    if parts.largest > block_ridge.LARGEST:
        members: dict[int, tuple[float, list[int]]] = {b: (c, []) for b, c in cutoffs.items()}
        for r in wanted.select("bucket", "member").distinct().collect():  # columns of the design, which the driver holds then
            members[r["bucket"]][1].append(r["member"])
        found = [(p.bucket, p.member, p.offence, p.defence, p.error) for p in fits_before(rows, at, blocks, y, penalties, members)]
        return rows.sparkSession.createDataFrame(found, "bucket int, member long, offence double, defence double, error double")
    fits = block_ridge.running_fits(parts, ("own", "other"), penalties, order)
    return wanted.select("bucket", "member").distinct().join(fits, ["bucket", "member"], "left").na.fill(0.0, ["offence", "defence", "error"])


def fits_before(rows: DataFrame, at: str, blocks: tuple[str, str], y: str, penalties: tuple[float, float], wanted: dict[int, tuple[float, list[int]]]) -> list[Projected]:
    """Effects of wanted members, {bucket: (cut-off, members)}, by a two-penalty ridge on the rows strictly before each bucket's cut-off.

    One pass: rows are summed up by the stretch between cut-offs that they lie in, and a fit adds its stretches to those before. What is held is one matrix of
    the design's columns; a fit is one Cholesky factor, and only the wanted columns of its inverse are solved for.
    Members without rows before have no effect: 0, with an error of 0.
    """
    order = sorted(wanted, key=lambda b: wanted[b][0])
    stretch = F.lit(0)
    for b in order:
        stretch = stretch + (F.col(at) >= F.lit(wanted[b][0])).cast("int")
    early = rows.withColumn("__stretch", stretch).where(F.col("__stretch") < len(order))
    entries = kept(gram(early, {"own": blocks[0], "other": blocks[1]}, y, "__stretch"))
    value = F.col(y).cast("double")
    totals = {r["s"]: r for r in early.groupBy(F.col("__stretch").alias("s")).agg(F.count("*").alias("n"), F.sum(value).alias("y"), F.sum(value * value).alias("yy")).collect()}  # a row a stretch
    columns = sorted(tuple(r) for r in entries.where("block_i = block_j AND member_i = member_j").select("block_i", "member_i").distinct().collect())
    place = {c: i for i, c in enumerate(columns)}
    p = len(columns)
    named = None
    if p:
        places = rows.sparkSession.createDataFrame([(b, m, i) for (b, m), i in place.items()], T.StructType([*entries.select("block_i", "member_i").schema.fields, T.StructField("k", T.IntegerType())]))
        named = entries.join(F.broadcast(places.toDF("block_i", "member_i", "i")), ["block_i", "member_i"]).join(F.broadcast(places.toDF("block_j", "member_j", "j")), ["block_j", "member_j"])  # the design's columns
    xx, x1, xy, n, total, yy = np.zeros((p, p)), np.zeros(p), np.zeros(p), 0.0, 0.0, 0.0
    penalty = np.array([penalties[0] if b == "own" else penalties[1] for b, _ in columns])
    out: list[Projected] = []
    for s, b in enumerate(order):
        if s in totals:
            own = named.where(F.col("fold") == s).select("i", "j", "n", "y").toArrow()
            i, j, count, sums = (own.column(c).to_numpy() for c in ("i", "j", "n", "y"))
            np.add.at(xx, (i, j), count)
            off = i != j
            np.add.at(xx, (j[off], i[off]), count[off])
            np.add.at(x1, i[~off], count[~off])
            np.add.at(xy, i[~off], sums[~off])
            n, total, yy = n + totals[s]["n"], total + totals[s]["y"], yy + totals[s]["yy"]
        members = wanted[b][1]
        if not n:
            out += [Projected(b, m, 0.0, 0.0, 0.0) for m in members]
            continue
        mean = total / n
        lower = np.linalg.cholesky(xx + np.diag(penalty))
        solve = lambda v: _back(lower, v)
        beta = solve(xy - mean * x1)
        rss = (yy - n * mean**2) - 2 * beta @ (xy - mean * x1) + beta @ xx @ beta
        hat = p - float(penalty @ _inverse_diagonal(lower))
        variance = max(0.0, rss) / max(1.0, n - hat - 1)
        at_ = [(place.get(("own", m)), place.get(("other", m))) for m in members]
        sign = np.zeros((p, len(members)))
        for k, (o, d) in enumerate(at_):
            if o is not None:
                sign[o, k] = 1.0
            if d is not None:
                sign[d, k] = -1.0
        reached = solve(sign)  # inverse times the contrasts
        errors = np.sqrt(np.maximum(variance * np.einsum("pk,pk->k", reached, xx @ reached), 0))
        of = lambda i: float(beta[i]) if i is not None else 0.0
        out += [Projected(b, m, of(o), of(d), float(e)) for m, (o, d), e in zip(members, at_, errors, strict=True)]
    return out


def _back(lower: np.ndarray, v: np.ndarray, block: int = 64) -> np.ndarray:
    """Solves L L' x = v by blocked substitution: products of blocks, and small solves on the diagonal."""
    p = len(lower)
    x = np.array(v, float)
    starts = range(0, p, block)
    for s in starts:
        e = min(p, s + block)
        x[s:e] = np.linalg.solve(lower[s:e, s:e], x[s:e] - lower[s:e, :s] @ x[:s])
    for s in reversed(starts):
        e = min(p, s + block)
        x[s:e] = np.linalg.solve(lower[s:e, s:e].T, x[s:e] - lower[e:, s:e].T @ x[e:])
    return x


def _inverse_diagonal(lower: np.ndarray, block: int = 256) -> np.ndarray:
    """Diagonal of (L L')^-1, by columns of the identity in blocks."""
    p = len(lower)
    out = np.zeros(p)
    for s in range(0, p, block):
        e = min(p, s + block)
        unit = np.zeros((p, e - s))
        unit[np.arange(s, e), np.arange(e - s)] = 1.0
        out[s:e] = _back(lower, unit)[np.arange(s, e), np.arange(e - s)]
    return out


def member_evidence(rows: DataFrame, at: str, members: str, team: str, season: str, cutoffs: dict[int, float], seasons: dict[int, int]) -> DataFrame:
    """(bucket, member, n, team, season): rows of each member before each bucket's cut-off, and the team of most of those in the cut-off's season (ties: the lesser one), as only there a window has two sides.

    Rows are counted by stretch first; a bucket adds up the stretches before it.
    """
    order = sorted(cutoffs, key=lambda b: cutoffs[b])
    stretch = F.lit(0)
    for b in order:
        stretch = stretch + (F.col(at) >= F.lit(cutoffs[b])).cast("int")
    counts = rows.select(stretch.alias("stretch"), F.explode(members).alias("member"), F.col(team).alias("team"), F.col(season).alias("season")).groupBy("member", "team", "season", "stretch").agg(F.count("*").alias("n"))
    later = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(seasons[b]).cast("long").alias("season"), F.lit(s).alias("s")) for s, b in enumerate(order)))
    each = counts.select("member", "team", "season", "n", F.explode(F.filter(later, lambda x: x["s"] >= F.col("stretch"))).alias("b")).groupBy("b.bucket", F.col("b.season").alias("own"), "member", "team", "season").agg(F.sum("n").alias("n"))
    here = F.col("season") == F.col("own")
    return each.groupBy("bucket", F.col("own").alias("season"), "member").agg(F.sum("n").alias("n"), F.max_by(F.when(here, F.col("team")), F.struct(here, "n", -F.col("team"))).alias("team"))


def placebos(moves: DataFrame, evidence: DataFrame, seed: int = 0, least: int = INCUMBENT) -> DataFrame:
    """(bucket, bucket_cutoff, member, team, season): as many incumbents of each bucket as it has moves, by a seeded hash; its movers are none of them."""
    sizes = moves.groupBy("bucket", "bucket_cutoff").agg(F.count("*").alias("moves"))
    eligible = evidence.where((F.col("n") >= least) & F.col("team").isNotNull()).join(moves.select("bucket", "member").distinct(), ["bucket", "member"], "left_anti")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "bucket", "member")), "member"))
    return eligible.join(F.broadcast(sizes), "bucket").withColumn("place", place).where(F.col("place") <= F.col("moves")).select("bucket", "bucket_cutoff", "member", "team", "season")  # a row a bucket


def run_backtest(rows: DataFrame, ratings: DataFrame, moves: DataFrame, at: str, blocks: tuple[str, str], y: str, penalties: tuple[float, float], team: str, season: str, n_buckets: int = BUCKETS, least_games: int = LEAST_GAMES, incumbent: int = INCUMBENT, seed: int = 0, per: float = 100.0) -> DataFrame:
    """(arm, bucket, member, team, season, cutoff, games_before, games_after, share, projected, error, observed, did) of every move that can be judged, and of the placebo arm.

    moves is (member, team, season, cutoff, n_after): n_after of the new team's rows of the season are taken over, and share is their part. What is projected is share times
    the member's net effect over an average one's, of rows before the bucket's cut-off. A placebo changes nobody, so it projects exactly 0; its change is that of the
    team that the incumbent had most rows with in the cut-off's season. Moves and placebos whose team lacks `least_games` on either side are left out.
    """
    changes = kept(team_changes(ratings, moves.select("season", "cutoff"), least_games))
    judged = moves.join(changes.select("season", "cutoff", "team", "n_before", "before", F.col("n_after").alias("games_after"), "after", "did"), ["season", "cutoff", "team"])
    bucketed = kept(move_buckets(kept(judged), n_buckets, "cutoff", "member").withColumnRenamed("label", "bucket_cutoff"))
    first = bucketed.groupBy("bucket").agg(F.min("bucket_cutoff").alias("cutoff"), F.min("season").alias("season")).collect()  # a row a bucket
    cut, seasons = {r["bucket"]: r["cutoff"] for r in first}, {r["bucket"]: r["season"] for r in first}
    schema = "arm string, bucket int, member long, team long, season long, cutoff double, games_before long, games_after long, share double, projected double, error double, observed double, did double"
    if not cut:
        return rows.sparkSession.createDataFrame([], schema)
    fitted = effects_before(rows, at, blocks, y, penalties, cut, bucketed)
    effects = fitted.select("bucket", "member", (per * (F.col("offence") - F.col("defence"))).alias("net"), (per * F.col("error")).alias("net_error"))
    size = rows.groupBy(F.col(team).alias("team"), F.col(season).alias("season")).agg(F.count("*").alias("team_rows"))
    share = F.least(F.greatest(F.col("n_after"), F.lit(1)) / F.greatest(F.col("team_rows"), F.lit(1)), F.lit(1.0))
    real = bucketed.join(effects, ["bucket", "member"]).join(size, ["team", "season"]).withColumn("share", share).select(F.lit("move").alias("arm"), "bucket", "member", "team", "season", "cutoff", F.col("n_before").alias("games_before"), "games_after", "share", (F.col("share") * F.col("net")).alias("projected"), (F.col("share") * F.col("net_error")).alias("error"), (F.col("after") - F.col("before")).alias("observed"), "did")
    chosen = kept(placebos(bucketed, member_evidence(rows, at, blocks[0], team, season, cut, seasons), seed, incumbent))
    their = team_changes(ratings, chosen.select("season", F.col("bucket_cutoff").alias("cutoff")), least_games)
    zero = F.lit(0.0)
    still = chosen.withColumnRenamed("bucket_cutoff", "cutoff").join(their, ["season", "cutoff", "team"]).select(F.lit("placebo").alias("arm"), "bucket", "member", "team", "season", "cutoff", F.col("n_before").alias("games_before"), F.col("n_after").alias("games_after"), zero.alias("share"), zero.alias("projected"), zero.alias("error"), (F.col("after") - F.col("before")).alias("observed"), "did")
    return real.unionByName(still)
