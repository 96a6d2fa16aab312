"""Aggregates: surfaces, members of lists, evidence, co-occurrence and clustered errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupwise.operators.sequence import kept

THIN = 50


def zone_surface(shots: DataFrame, thin: int = THIN) -> DataFrame:
    """Attempts, make rate, points an attempt, their deviation from all attempts, and a thin-sample flag, by zone_id."""
    price = F.col("made").cast("double") * F.col("points")
    whole = shots.agg(F.avg(price).alias("league"))
    by_zone = shots.groupBy("zone_id").agg(F.count("*").alias("attempts"), F.avg(F.col("made").cast("double")).alias("make_rate"), F.avg(price).alias("ppa"))
    return by_zone.crossJoin(F.broadcast(whole)).select("zone_id", "attempts", "make_rate", "ppa", (F.col("ppa") - F.col("league")).alias("vs_league"), (F.col("attempts") < thin).alias("thin"))


def volume_examples(df: DataFrame, key: str, thin: int) -> DataFrame:
    """The key with the most rows, and the one with the most among those below thin; ties to the least key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(1).withColumn("example", F.lit("high volume"))
    low = counts.where(F.col("n") < thin).orderBy(F.desc("n"), key).limit(1).withColumn("example", F.lit("low volume"))
    return top.union(low)


def example_surfaces(shots: DataFrame, key: str, thin: int) -> DataFrame:
    """The zone surfaces of volume_examples' keys: (example, key, zone_id, attempts, make_rate, ppa, vs_league, thin), against all rows' mean."""
    examples = volume_examples(shots, key, thin).select(key, "example")
    price = F.col("made").cast("double") * F.col("points")
    whole = shots.agg(F.avg(price).alias("league"))
    rows = shots.join(F.broadcast(examples), key).crossJoin(F.broadcast(whole))  # two keys, one row
    by_zone = rows.groupBy("example", key, "zone_id").agg(F.count("*").alias("attempts"), F.avg(F.col("made").cast("double")).alias("make_rate"), F.avg(price).alias("ppa"), (F.avg(price) - F.max("league")).alias("vs_league"))
    return by_zone.withColumn("thin", F.col("attempts") < THIN)


def main_teams(rows: DataFrame, members: str, by: list[str], at: str, cutoffs: DataFrame) -> DataFrame:
    """(member, cutoff, by, n): for each cut-off (member, cutoff) where most of the member's rows before it were, and how many; ties to the largest `by`, last column
    first. Who has no row before has none here; a member may have several cut-offs.

    Rows are summed up by member, place and moment before they meet cut-offs.
    """
    each = rows.select(F.explode(members).alias("member"), *by, at).groupBy("member", *by, at).agg(F.count("*").alias("n"))
    before = each.join(cutoffs.select("member", "cutoff").distinct(), "member").where(F.col(at) < F.col("cutoff"))
    placed = before.groupBy("member", "cutoff", *by).agg(F.sum("n").alias("n"))
    best = placed.groupBy("member", "cutoff").agg(F.max(F.struct("n", *reversed(by))).alias("__b"))
    return best.select("member", "cutoff", *(F.col(f"__b.{c}").alias(c) for c in by), F.col("__b.n").alias("n"))


def assess(requests: DataFrame, seen: DataFrame, attempts: DataFrame, measure: str = "possessions") -> DataFrame:
    """requests (request, key, members) with possessions, min_attempts, tier, counterfactual (nobody has seen the group) and shortfall, the members, in order, that are
    below the directional floor. seen is (key, possessions), attempts (member, n); what is missing there counts 0."""
    each = requests.select("request", F.posexplode("members").alias("at", "member")).join(attempts.select("member", "n"), "member", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = F.collect_list(F.when(F.col("n") < DIRECTIONAL_ATTEMPTS, F.struct("at", "member")))
    least = each.groupBy("request").agg(F.min("n").alias("min_attempts"), F.transform(F.array_sort(short), lambda x: x["member"]).alias("shortfall"))
    found = seen.select("key", F.col(measure).alias("possessions"))
    rows = requests.join(least, "request", "left").join(found, "key", "left").withColumn("counterfactual", F.col("possessions").isNull())
    rows = rows.withColumns({"possessions": F.coalesce("possessions", F.lit(0)), "min_attempts": F.coalesce("min_attempts", F.lit(0))})
    return rows.withColumn("tier", tier(F.col("possessions"), F.col("min_attempts")))


def member_sums(df: DataFrame, lists: list[str], measure: str) -> DataFrame:
    """(member, measure): the measure summed over the rows on whose lists a member is."""
    both = None
    for c in lists:
        part = df.select(F.explode(c).alias("member"), measure)
        both = part if both is None else both.unionByName(part)
    return both.groupBy("member").agg(F.sum(measure).alias(measure))


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties to the least. Counted first, so a hot key is a few rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def support(rows: DataFrame, key: str, members: str, attempts: DataFrame, measure: str) -> DataFrame:
    """Evidence of each group: measure summed, and the least attempts of its members; `attempts` is (member, n), missing ones 0."""
    groups = rows.groupBy(key).agg(F.sum(measure).alias(measure), F.count("*").alias("n_rows"), F.min(members).alias("members"))
    each = groups.select(key, F.explode("members").alias("member")).join(attempts, "member", "left")
    least = each.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("min_attempts"))
    return groups.join(least, key)


#: Fixed floors of the evidence tiers: possessions and attempts for a reportable figure, attempts for a direction.
REPORTABLE, REPORTABLE_ATTEMPTS, DIRECTIONAL_ATTEMPTS = 200, 100, 30


def tier(possessions: Column, min_attempts: Column) -> Column:
    """reportable, directional or refused."""
    return F.when((possessions >= REPORTABLE) & (min_attempts >= REPORTABLE_ATTEMPTS), "reportable").when(min_attempts >= DIRECTIONAL_ATTEMPTS, "directional").otherwise("refused")


def category_mix(df: DataFrame, key: str, category: str, values: list[str]) -> DataFrame:
    """Counts and shares of fixed categories by key, missing ones 0."""
    counts = df.groupBy(key).agg(*(F.count(F.when(F.col(category) == v, 1)).alias(f"n_{v}") for v in values), F.count("*").alias("n"))
    return counts.select("*", *((F.col(f"n_{v}") / F.col("n")).alias(f"share_{v}") for v in values))


def clustered_rate_errors(df: DataFrame, unit: str, cluster: str, hit: Column, least: int) -> DataFrame:
    """(unit, n, rate, error): a share's standard error, clustered; at 0 and 1 the binomial one with half a hit and half a miss more.

    Units of one cluster or fewer than `least` rows have none and go. Sums by unit and cluster first; the rest is on those.
    """
    per = df.groupBy(unit, cluster).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("t"))
    of_unit = per.groupBy(unit).agg(F.sum("n").alias("total"), F.sum("t").alias("hits"), F.count("*").alias("clusters"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("t") * F.col("n")).alias("tn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    rate = F.col("hits") / F.col("total")
    # sum of ((t - rate n) / total)^2 from three sums
    squares = F.greatest(F.col("tt") - 2 * rate * F.col("tn") + rate * rate * F.col("nn"), F.lit(0.0)) / (F.col("total") * F.col("total"))
    shifted = (F.col("hits") + 0.5) / (F.col("total") + 1)
    edge = (F.col("hits") == 0) | (F.col("hits") == F.col("total"))
    error = F.when(edge, F.sqrt(shifted * (1 - shifted) / F.col("total"))).otherwise(F.sqrt(squares * F.col("clusters") / (F.col("clusters") - 1)))
    return of_unit.where((F.col("clusters") >= 2) & (F.col("total") >= least)).select(unit, F.col("total").alias("n"), rate.alias("rate"), error.alias("error"))


def co_occurrence(df: DataFrame, row: str, lists: list[str], ceiling: float = 0.85, top: int = 50) -> DataFrame:
    """Members that share the most of their rows with one partner: (member, rows, partner, share, flagged), the top ones.

    Rows hold a bounded list of members (a group's size). Rows of the same members are counted first, so pairs are a fixed multiple of the
    distinct groups, whatever the number of rows.
    """
    every = kept(df.select(F.sort_array(F.array_distinct(F.concat(*lists))).alias("m")).groupBy("m").agg(F.count("*").alias("n")))
    rows = every.select(F.explode("m").alias("member"), "n").groupBy("member").agg(F.sum("n").alias("rows"))
    pairs = every.select(F.explode("m").alias("member"), "m", "n").select("member", F.explode("m").alias("partner"), "n").where("member <> partner")
    shared = pairs.groupBy("member", "partner").agg(F.sum("n").alias("both")).join(rows, "member")
    share = shared.select("member", "rows", "partner", F.round(F.col("both") / F.col("rows"), 6).alias("share"))
    best = share.groupBy("member", "rows").agg(F.min_by(F.struct("partner", "share"), F.struct(-F.col("share"), F.col("partner"))).alias("b"))
    return best.select("member", "rows", "b.partner", "b.share", (F.col("b.share") > ceiling).alias("flagged")).orderBy(F.desc("share"), "member").limit(top)


def ratings(possessions: DataFrame) -> DataFrame:
    """Points for and against a hundred possessions and their difference, by game and team."""
    offence = possessions.groupBy("game_id", F.col("offense_team_id").alias("team_id")).agg((100 * F.avg("points")).alias("off_rating"), F.count("*").alias("n_off"))
    defence = possessions.groupBy("game_id", F.col("defense_team_id").alias("team_id")).agg((100 * F.avg("points")).alias("def_rating"), F.count("*").alias("n_def"))
    return offence.join(defence, ["game_id", "team_id"]).withColumn("net_rating", F.col("off_rating") - F.col("def_rating"))


def reconcile(derived: DataFrame, truth: DataFrame, keys: list[str], value: str) -> DataFrame:
    """truth with the derived value, 0 where there is none, and the absolute difference."""
    d = derived.select(*keys, F.col(value).alias("derived"))
    return truth.select(*keys, F.col(value).alias("truth")).join(d, keys, "left").withColumn("derived", F.coalesce("derived", F.lit(0))).withColumn("delta", F.abs(F.col("derived") - F.col("truth")))


def reconcile_summary(df: DataFrame) -> DataFrame:
    """Mean, 95th percentile and largest difference, the relative gap of the totals, and rows whose truth is 0 but not the derived value."""
    return df.agg(F.avg("delta").alias("mean_delta"), F.percentile("delta", 0.95).alias("p95_delta"), F.max("delta").alias("max_delta"), (F.abs(F.sum("derived") - F.sum("truth")) / F.sum("truth")).alias("total_gap"), F.count_if((F.col("truth") == 0) & (F.col("derived") > 0)).alias("only_derived"))


def moves(df: DataFrame, unit: str, order: list[str], team: str, least: int) -> DataFrame:
    """A unit's changes of team along its rows: teams and rows just before and after, where both stretches hold `least` rows or more."""
    from groupwise.operators.sequence import runs

    stretches = runs(df, [unit], order, [team]).groupBy(unit, "run").agg(F.first(team).alias("to_team"), F.count("*").alias("n_after"), F.min(F.struct(*order)).alias("cutoff"))
    w = Window.partitionBy(unit).orderBy("run")
    both = stretches.withColumn("from_team", F.lag("to_team").over(w)).withColumn("n_before", F.lag("n_after").over(w))
    return both.where((F.col("n_before") >= least) & (F.col("n_after") >= least)).select(unit, "from_team", "to_team", "n_before", "n_after", F.col(f"cutoff.{order[0]}").alias("cutoff"))
