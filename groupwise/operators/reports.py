"""Reports over built tables: builds, evidence, distributions, calibration, contracts and differences between results."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupwise.operators import gates, metrics
from groupwise.operators.sequence import equal_bins

#: The most rows a listing gives.
MOST_ROWS = 500


def share(condition: Column) -> Column:
    """Share of rows that meet a condition, null counting as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def with_lists(rows: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the lists of the same keys, null where there are none."""
    return rows.join(lists, keys, "left")


def agreement(rows: DataFrame, oracle: DataFrame, keys: list[str], own: str, other: str, ambiguous: Column) -> DataFrame:
    """(n, covered, agree, agree_clear): how many rows an independent list is there for, and the share that has the same members, in all and where nothing is ambiguous."""
    both = rows.join(oracle, keys, "left")
    same = F.when(F.col(other).isNotNull(), F.sort_array(own) == F.sort_array(other)).cast("double")
    return both.agg(F.count("*").alias("n"), share(F.col(other).isNotNull()).alias("covered"), F.avg(same).alias("agree"), F.avg(F.when(~ambiguous, same)).alias("agree_clear"))


def directory(members: DataFrame, key: str, *measures: DataFrame) -> DataFrame:
    """members with the columns of tables of the same key; numbers that a member lacks are 0."""
    out = members
    for m in measures:
        out = out.join(m, key, "left").na.fill(0, [c for c in m.columns if c != key])
    return out


def listing(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first rows in a total order: as many as asked for, none to MOST_ROWS."""
    return df.orderBy(*order).limit(max(0, min(MOST_ROWS, limit)))


def build_report(df: DataFrame, game: str, status: Column, quality: Column, covered: Column, label: Column, three: Column) -> DataFrame:
    """One row: rows, games, share exact and resolved, counts by quality, share with lists, and how often a label's "3PT" agrees with the geometry."""
    count = lambda q: F.count_if(quality == q)
    return df.agg(
        F.count("*").alias("n"), F.countDistinct(game).alias("games"), share(status == "EXACT").alias("exact"), share(status.isin("EXACT", "SOLVED")).alias("resolved"),
        count("VALID").alias("valid"), count("IMPUTED").alias("imputed"), count("QUARANTINED").alias("quarantined"), share(covered).alias("covered"), share(F.contains(label, F.lit("3PT")) == three).alias("label_agrees"),
    )


def estimability(groups: DataFrame, evidence: str, measure: str, floors: dict[str, int]) -> DataFrame:
    """One row: groups, their median evidence, and for each floor how many and what share of them reach it and what share of the measure they hold."""
    stats = [F.count("*").alias("groups"), F.median(evidence).alias("median_evidence")]
    for name, floor in floors.items():
        reach = F.col(evidence) >= floor
        stats += [F.count_if(reach).alias(f"n_{name}"), share(reach).alias(f"share_{name}"), (F.sum(F.when(reach, F.col(measure)).otherwise(0)) / F.sum(measure)).alias(f"measure_{name}")]
    return groups.agg(*stats)


def move_summary(moves: DataFrame, kind: list[str], after: str) -> DataFrame:
    """(kind, n, median_after) of moves."""
    return moves.groupBy(*kind).agg(F.count("*").alias("n"), F.median(after).alias("median_after"))


def move_buckets(moves: DataFrame, k: int, cutoff: str, *ties: str) -> DataFrame:
    """moves with bucket, from 0, of k groups of equal count by cut-off, and label, the bucket's earliest cut-off; fewer moves make fewer groups."""
    binned = equal_bins(moves, max(1, min(k, moves.count())), cutoff, *ties, name="bucket")
    first = binned.groupBy("bucket").agg(F.min(cutoff).alias("label"))
    return binned.join(F.broadcast(first), "bucket")  # k rows


def distribution(df: DataFrame, value: str, band: float, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """One row: n, mean, sd, percentiles, the largest size and the share within a band around 0."""
    v = F.col(value).cast("double")
    percentiles = [F.percentile(v, F.lit(q)).alias(f"p{round(100 * q)}") for q in at]
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), *percentiles, F.max(F.abs(v)).alias("max_abs"), F.avg((F.abs(v) < band).cast("double")).alias("within"))


def ranking_refusals(ranked: DataFrame) -> DataFrame:
    """From rank_plays: one row of requests, their mean number of bands, the share with a tie, the share in one band (unordered), and pairs told apart of all."""
    kept = ranked.where("band is not null")
    bands = kept.groupBy("request", "band").agg(F.count("*").alias("c")).groupBy("request").agg(F.count("*").alias("bands"), F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("tied"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return bands.agg(F.count("*").alias("requests"), F.avg("bands").alias("mean_bands"), share(F.col("tied") > 0).alias("with_ties"), share((F.col("bands") == 1) & (F.col("n") > 1)).alias("unordered"), F.sum(pairs - F.col("tied")).alias("ordered_pairs"), F.sum(pairs).alias("pairs"))


def comparison_variance(compared: DataFrame, profile_variance: str) -> DataFrame:
    """From compare with a column of the variance that comes from profiles: its pooled share of all, by what it widens intervals, and separable totals."""
    whole = F.col(profile_variance) + F.col("error") * F.col("error")
    pooled = F.sum(profile_variance) / F.sum(whole)
    return compared.where("choice = 'total'").agg(F.count("*").alias("n"), pooled.alias("profile_share"), F.when(pooled < 1, 1 / F.sqrt(1 - pooled)).alias("widening"), F.count_if("separable").alias("separable"))


def projection_variance(projected: DataFrame, part: str, low: str = "low", high: str = "high") -> DataFrame:
    """One row: n, missing, mean and median of a part's share of variance, how often it is more than half, and how often an interval holds 0; NaN counts as missing."""
    x = F.when(~F.isnan(part), F.col(part))
    return projected.agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.avg((x > 0.5).cast("double")).alias("dominated"), share((F.col(low) <= 0) & (F.col(high) >= 0)).alias("spans_zero"))


def calibration_report(df: DataFrame, y: str, p: str, order: list[str]) -> DataFrame:
    """One row of binary scores: n, log loss, Brier score and skill, reliability, resolution, uncertainty, ECE, slope and intercept (null where y has one value)."""
    scores = df.agg(F.count("*").alias("n"), metrics.log_loss(F.col(y), F.col(p)).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("base"))
    parts = metrics.brier_parts(metrics.calibration_bins(df, y, p, order))
    slope = metrics.calibration_slope(df, y, p) or (None, None)
    skill = F.when(F.col("base").between(1e-12, 1 - 1e-12), 1 - F.col("brier") / (F.col("base") * (1 - F.col("base"))))
    return scores.withColumn("skill", skill).drop("base").crossJoin(F.broadcast(parts)).withColumn("slope", F.lit(slope[0]).cast("double")).withColumn("intercept", F.lit(slope[1]).cast("double"))


def improvements(values: DataFrame, counterpart: dict[str, str], by: list[str]) -> DataFrame:
    """(by, model, value, against, relative): by what share of its counterpart's value a model's lies below it."""
    of = F.create_map(*(F.lit(x) for pair in counterpart.items() for x in pair))
    left = values.withColumn("against_model", of[F.col("model")]).where("against_model is not null")
    right = values.select(*by, F.col("model").alias("against_model"), F.col("value").alias("against"))
    return left.join(right, [*by, "against_model"]).select(*by, "model", "value", "against", ((F.col("against") - F.col("value")) / F.col("against")).alias("relative"))


def result_table(values: DataFrame, counterpart: dict[str, str], by: list[str], metrics_: list[str], measure: str = "log_loss") -> DataFrame:
    """(by, model, n, a column a metric, against, gain, verdict) of rows (by, model, metric, value, n): each model beside its counterpart, and in words by how much its
    measure lies below, or above, the counterpart's. Models without a counterpart, or whose counterpart has no row, have no verdict."""
    wide = values.groupBy(*by, "model").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics_))
    gains = improvements(values.where(F.col("metric") == measure), counterpart, by).select(*by, "model", F.col("relative").alias("gain"))
    pairs = F.create_map(*(F.lit(x) for pair in counterpart.items() for x in pair))
    percent = F.format_string("%+.3f%% vs %s", 100 * F.col("gain"), F.col("against"))
    rows = wide.join(gains, [*by, "model"], "left").withColumn("against", F.when(F.col("gain").isNotNull(), pairs[F.col("model")]))
    return rows.withColumn("verdict", F.when(F.col("gain").isNotNull(), percent))


def critical_values(ranking: float = 0.8, comparison: float = 0.8) -> dict[str, float]:
    """What rankings and comparisons are held to: their levels, the two-sided normal quantile of the first, the chi-squared value with two degrees of freedom that the second implies."""
    return {"ranking_confidence": ranking, "critical_value": NormalDist().inv_cdf(0.5 + ranking / 2), "comparison_confidence": comparison, "omnibus_critical_value": -2 * math.log(1 - comparison)}


# ---- Contracts and differences# ---- Contracts and differences


def contract(df: DataFrame, name: str) -> DataFrame:
    """(table, rows, columns, digest) of a table; columns as name:type in order of names."""
    columns = ",".join(f"{c}:{kind}" for c, kind in sorted(df.dtypes))
    return gates.fingerprint(df).select(F.lit(name).alias("table"), "rows", F.lit(columns).alias("columns"), "digest")


def contracts(tables: dict[str, DataFrame]) -> DataFrame:
    """contract of each table, one below the other."""
    out = None
    for name, df in tables.items():
        out = contract(df, name) if out is None else out.unionByName(contract(df, name))
    return out


def contract_drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """(table, drift, before, now): what differs between two sets of contracts: tables on one side only, rows, columns or types, and digests."""
    side = lambda df, n: df.select("table", F.struct("rows", "columns", "digest").alias(n))
    both = side(now, "now").join(side(before, "before"), "table", "full")
    gone = F.when(F.col("before").isNull() | F.col("now").isNull(), F.struct(F.lit("table").alias("drift"), F.col("before.digest").alias("before"), F.col("now.digest").alias("now")))
    of = lambda name, what: F.when(F.col(f"before.{what}") != F.col(f"now.{what}"), F.struct(F.lit(name).alias("drift"), F.col(f"before.{what}").cast("string").alias("before"), F.col(f"now.{what}").cast("string").alias("now")))
    return both.select("table", F.inline(F.array_compact(F.array(gone, of("rows", "rows"), of("columns", "columns"), of("hash", "digest")))))


def pinned(text: Column) -> Column:
    """SHA-256 of a text whose lines end in line feeds, however they ended."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def _leaves(name: str, x: Column, kind: T.DataType) -> Column:
    """Array of (path, type, number, text) of a value's leaves, by its type."""
    leaf = lambda t, number, text: F.array(F.struct(F.lit(name).alias("path"), F.when(x.isNull(), "null").otherwise(t).alias("type"), number.cast("double").alias("number"), text.cast("string").alias("text")))
    none = F.lit(None)
    if isinstance(kind, T.StructType):
        return F.concat(*(_leaves(f"{name}.{f.name}", x[f.name], f.dataType) for f in kind))
    if isinstance(kind, T.ArrayType):
        each = F.transform(F.coalesce(x, F.array().cast(kind)), lambda v, i: F.transform(_leaves("", v, kind.elementType), lambda leaf: F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"), leaf["path"]).alias("path"), leaf["type"].alias("type"), leaf["number"].alias("number"), leaf["text"].alias("text"))))
        return F.concat(leaf("list", F.size(x), none), F.flatten(each))
    if isinstance(kind, T.BooleanType):
        return leaf("boolean", none, x)
    if isinstance(kind, T.NumericType):
        return leaf("number", x, none)
    return leaf("text", none, x)


def leaves(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, type, number, text) of all leaves of nested rows; a list is a leaf of its own, its number its length."""
    parts = [_leaves(f.name, F.col(f.name), f.dataType) for f in df.schema if f.name not in keys]
    return df.select(*keys, F.inline(F.concat(*parts)))


def nested_diff(now: DataFrame, before: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, path, problem): where two nested results differ: new, missing, type, length, value (beyond the relative tolerance for numbers; NaN equals NaN)."""
    side = lambda df, n: leaves(df, keys).select(*keys, "path", F.struct("type", "number", "text").alias(n))
    both = side(now, "now").join(side(before, "before"), [*keys, "path"], "full")
    a, b = F.col("now.number"), F.col("before.number")
    near = (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))
    same = F.col("now.text").eqNullSafe(F.col("before.text"))
    problem = (
        F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now.type") != F.col("before.type"), "type")
        .when((F.col("now.type") == "list") & (a != b), "length").when((F.col("now.type") == "number") & ~near, "value").when(F.col("now.type").isin("text", "boolean") & ~same, "value")
    )
    return both.select(*keys, "path", problem.alias("problem")).where("problem is not null")
