"""Answers built on evidence: masking, scoring, projections, request sets, documents and polygons."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.functions.columns import correlation, direction, shares, softmax
from groupwise.operators import block_ridge
from groupwise.operators.models import Ridge, moments, solve_ridge
from groupwise.operators.sequence import row_numbers


def masked(df: DataFrame, tier: str, magnitudes: list[str], signed: str) -> DataFrame:
    """Answers as their tier allows: below reportable the magnitudes are null and only the direction of `signed` is told; refused rows go."""
    kept = df.where(F.col(tier) != "refused").withColumn("direction", direction(F.col(signed)))
    open_ = F.col(tier) == "reportable"
    return kept.select(*(F.when(open_, F.col(c)).alias(c) if c in magnitudes else F.col(c) for c in kept.columns))


def refused(df: DataFrame, tier: str, possessions: str, min_attempts: str, floor: int) -> DataFrame:
    """The refused rows, with what they have, what they lack and why."""
    lack = F.greatest(F.lit(floor) - F.col(min_attempts), F.lit(0))
    return df.where(F.col(tier) == "refused").withColumn("shortfall", lack).withColumn("error", F.lit("insufficient_support"))


def worse_tier(a: Column, b: Column) -> Column:
    """A comparison may say what its weaker side may."""
    return F.when((a == "refused") | (b == "refused"), "refused").when((a == "directional") | (b == "directional"), "directional").otherwise("reportable")


def warnings(**conditions: Column) -> Column:
    """Names of the conditions that hold, as an array."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())), lambda x: x.isNotNull())


def choice_scores(df: DataFrame, design: str, theta: list[float], prices: list[float]) -> DataFrame:
    """df with mix (shares of the choices by a conditional logit) and per_100 (their expected price a hundred times).

    design is a flat array of numbers, a choice's own ones together, as in models.fit_choice.
    """
    p, n = len(theta), len(prices)
    weights, price = F.array(*map(F.lit, map(float, theta))), F.array(*map(F.lit, map(float, prices)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    utility = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: dot(F.slice(F.col(design), k * p + 1, p), weights))
    return df.withColumn("utility", utility).withColumn("mix", softmax(F.col("utility"))).withColumn("per_100", 100 * dot(F.col("mix"), price)).drop("utility")


def choice_metrics(df: DataFrame, mix: str, chosen: str, n_choices: int, floor: float = 1e-15) -> DataFrame:
    """Log loss, top-1 share and Brier score of n-way probabilities, renormalised; the first largest is the guess."""
    rows = df.select(shares(F.col(mix)).alias("q"), F.col(chosen).alias("chosen"))
    q, chosen = F.col("q"), F.col("chosen")
    hit = F.greatest(F.get(q, chosen), F.lit(floor))
    brier = F.aggregate(F.transform(q, lambda x, i: F.pow(x - F.when(i == chosen, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda s, x: s + x)
    return rows.agg(F.avg(-F.ln(hit)).alias("log_loss"), F.avg((F.array_position(q, F.array_max(q)) - 1 == chosen).cast("double")).alias("top_1"), F.avg(brier).alias("brier"), F.count("*").alias("n"))


#: Bytes of a covariance that may be sent to every task; the design's columns are fixed, its rows play no part.
COVARIANCE_BYTES = 256_000_000


def project_swaps(scenarios: DataFrame, fit: Ridge, blocks: tuple[str, str], per: float = 100.0) -> DataFrame:
    """(out, in, share) scenarios with off_delta, def_delta, net_delta, error, minutes_part and an 80 % interval.

    With a column spread (how far the share may be off), the minutes' error joins the members' in error and interval, and minutes_part is its part of the variance; without,
    or without any variance, it is 0.

    A member's effects are looked up by block; a null or unknown member is an average one, whose effects are zero; the same member out
    and in changes nothing. Errors are exact contrasts of the fit's covariance: four of its rows and columns a scenario, in batches.
    """
    if fit.covariance.nbytes > COVARIANCE_BYTES:
        raise ValueError("the covariance is too large to send to tasks")
    at = {c: i for i, c in enumerate(fit.columns)}
    # one more column of zeros for members without effects
    beta, covariance = np.append(fit.coefficients, 0.0) * per, np.pad(fit.covariance, (0, 1)) * per * per
    z, new = NormalDist().inv_cdf(0.9), ("off_delta", "def_delta", "net_delta", "error", "minutes_part", "low", "high")
    schema = T.StructType([*(f for f in scenarios.schema if f.name not in new), *(T.StructField(n, T.DoubleType()) for n in new)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = lambda block, who: np.array([at.get((block, None if pd.isna(m) else int(m)), len(at)) for m in batch[who]], int)
            where = np.stack([place(blocks[0], "in"), place(blocks[0], "out"), place(blocks[1], "in"), place(blocks[1], "out")], axis=1)
            sign, share = np.array([1.0, -1.0, -1.0, 1.0]), batch["share"].to_numpy(float)
            off, def_ = beta[where[:, 0]] - beta[where[:, 1]], beta[where[:, 2]] - beta[where[:, 3]]
            variance = np.einsum("i,nij,j->n", sign, covariance[where[:, :, None], where[:, None, :]], sign)
            net = share * (off - def_)
            minutes = ((off - def_) * batch["spread"].to_numpy(float)) ** 2 if "spread" in batch.columns else np.zeros(len(batch))
            whole = share**2 * np.maximum(variance, 0) + minutes
            error, part = np.sqrt(whole), np.divide(minutes, whole, out=np.zeros(len(batch)), where=whole != 0)
            yield batch.assign(off_delta=share * off, def_delta=share * def_, net_delta=net, error=error, minutes_part=part, low=net - z * error, high=net + z * error)[schema.names]

    return scenarios.drop(*new).mapInPandas(run, schema)


def projected_swaps(scenarios: DataFrame, rows: DataFrame, blocks: tuple[str, str], y: str, penalties: tuple[float, float], per: float = 100.0) -> DataFrame:
    """project_swaps with the ridge of rows, whose columns of members have the blocks' names. A fit by components keeps effects and covariances in tables; only where a component
    has more than block_ridge.LARGEST columns does the driver hold a matrix of the design's columns.
    """
    lists, penalty = {b: b for b in blocks}, dict(zip(blocks, penalties, strict=True))
    parts = block_ridge.Parts(rows, lists, y)
    if parts.largest > block_ridge.LARGEST:
        return project_swaps(scenarios, solve_ridge(moments(rows, lists, y)[0], penalty), blocks, per)
    new, z = ("off_delta", "def_delta", "net_delta", "error", "minutes_part", "low", "high"), NormalDist().inv_cdf(0.9)
    asked = scenarios.drop(*new)
    contrasts = block_ridge.swap_contrasts(parts, asked, blocks, penalty).select(F.col("out").alias("__out"), F.col("in").alias("__in"), *((per * F.col(c)).alias(f"__{c}") for c in ("off", "def")), (per * per * F.col("variance")).alias("__variance"))
    met = asked.join(contrasts, F.col("out").eqNullSafe(F.col("__out")) & F.col("in").eqNullSafe(F.col("__in")))
    net, share = F.col("__off") - F.col("__def"), F.col("share").cast("double")
    minutes = F.pow(net * F.col("spread").cast("double"), 2) if "spread" in asked.columns else F.lit(0.0)
    whole = share * share * F.greatest("__variance", F.lit(0.0)) + minutes
    found = met.select(*asked.columns, (share * F.col("__off")).alias("off_delta"), (share * F.col("__def")).alias("def_delta"), (share * net).alias("net_delta"), F.sqrt(whole).alias("error"), F.when(whole != 0, minutes / whole).otherwise(0.0).alias("minutes_part"))
    return found.withColumns({"low": F.col("net_delta") - z * F.col("error"), "high": F.col("net_delta") + z * F.col("error")})


def exposures(scenarios: DataFrame, rows: DataFrame, members: str, team: str, share: float, spread: float) -> DataFrame:
    """scenarios (out, team) with share and spread: the part of the team's rows that `out` was there for, times the rule's share and spread of them. Teams or members without
    rows are 0."""
    whole = rows.groupBy(F.col(team).alias("team")).agg(F.count("*").alias("__whole"))
    there = rows.select(F.col(team).alias("team"), F.explode(members).alias("out")).groupBy("team", "out").agg(F.count("*").alias("__there"))
    part = F.coalesce(F.col("__there") / F.col("__whole"), F.lit(0.0))
    return scenarios.join(whole, "team", "left").join(there, ["team", "out"], "left").withColumns({"share": part * share, "spread": part * spread}).drop("__whole", "__there")


def projection_scores(df: DataFrame, projected: str, actual: str) -> DataFrame:
    """Means, spreads, correlation, mean absolute error and the share of signs foretold (projections of 0 left out), with its 95 % interval."""
    p, a = F.col(projected), F.col(actual)
    told = F.when(p != 0, (F.signum(p) == F.signum(a)).cast("double"))
    half = 1.96 * F.sqrt(0.25 / F.count(told))
    return df.agg(F.count("*").alias("n"), F.avg(p).alias("mean_projected"), F.avg(a).alias("mean_actual"), F.stddev_samp(a).alias("sd_actual"), correlation(p, a).alias("correlation"), F.avg(F.abs(p - a)).alias("mae"), F.avg(told).alias("signs"), F.greatest(F.avg(told) - half, F.lit(0.0)).alias("signs_low"), F.least(F.avg(told) + half, F.lit(1.0)).alias("signs_high"))


def request_sets(members: DataFrame, member: str, n: int, size: int = 5, seed: int = 0) -> DataFrame:
    """n groups (request, members): for each, the members with the least seeded hashes, sorted. members is a small dimension."""
    requests = members.sparkSession.range(n).withColumnRenamed("id", "request")
    keyed = requests.crossJoin(F.broadcast(members.select(F.col(member).alias("m")).distinct()))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), "request", "m"))
    return keyed.groupBy("request").agg(F.sort_array(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(place.alias("h"), "m"))), 1, size), lambda s: s["m"])).alias("members"))


def group_documents(df: DataFrame, key: str, by: list[str], value: str, least: int) -> DataFrame:
    """(key, by, n, mean, level, text) of groups with `least` rows or more; level says where a group's mean lies among all of them."""
    groups = df.groupBy(key, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least).withColumn("m", F.round("mean", 9))
    ranked = row_numbers(groups, "m", key, *by, name="__row")
    below = ranked.groupBy("m").agg(F.min("__row").alias("below"))
    total = ranked.agg(F.count("*").alias("total"))
    placed = ranked.join(below, "m").crossJoin(F.broadcast(total)).withColumn("share", F.col("below") / F.col("total"))  # one row
    s = F.col("share")
    level = F.when(s >= 0.8, "elite").when(s >= 0.6, "above average").when(s >= 0.4, "average").when(s >= 0.2, "below average").otherwise("poor")
    text = F.format_string("Seen %d times, %.2f a time: %s.", "n", "mean", level)
    return placed.select(key, *by, "n", "mean", level.alias("level"), text.alias("text"))


def in_polygons(points: DataFrame, edges: DataFrame, point: list[str], polygon: str) -> DataFrame:
    """(point, polygon) for each polygon that holds a point, by the even-odd rule.

    points have x and y; edges (polygon, x1, y1, x2, y2) are the closed outlines, a small dimension. A ray to the right
    crosses an edge whose ends lie on both sides of the point's height.
    """
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = points.crossJoin(F.broadcast(edges)).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))).where(crossing)
    return hits.groupBy(*point, polygon).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*point, polygon)


def outline_path(corners: Column) -> Column:
    """An SVG path through an array of (x, y)."""
    return F.concat(F.lit("M"), F.array_join(F.transform(corners, lambda c: F.format_string("%.1f %.1f", c["x"], c["y"])), " L"), F.lit(" Z"))


def shuffled_lists(df: DataFrame, key: str, lists: list[str], seed: int) -> DataFrame:
    """df with its lists, together, moved to other rows by a seeded order: a negative control."""
    rows = row_numbers(df.drop(*lists), key, name="__row")
    moved = row_numbers(df.select(key, *lists).withColumn("__h", F.xxhash64(key, F.lit(seed))), "__h", key, name="__row").select("__row", *lists)
    return rows.join(moved, "__row").drop("__row").select(*df.columns)


def create_table(schema, name: str, partitions: list[str]) -> str:
    """CREATE TABLE for a schema of the eight supported column types; another type is an error."""
    allowed = {"bigint", "int", "double", "float", "string", "boolean", "array<bigint>", "array<string>"}
    lines = []
    for f in schema:
        kind = f.dataType.simpleString()
        if kind not in allowed:
            raise ValueError(f"{f.name}: {kind} is not supported")
        lines.append(f"  {f.name} {kind.upper()}")
    tail = f"\nPARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + f"\n) USING parquet{tail}"


def same_table(schema, name: str, partitions: list[str], text: str) -> bool:
    """Whether a CREATE TABLE text is what the schema gives today, whatever its line ends and trailing blanks: parity of a kept statement with the tables."""
    plain = lambda t: "\n".join(line.rstrip() for line in t.replace("\r\n", "\n").strip().split("\n"))
    return plain(text) == plain(create_table(schema, name, partitions))
