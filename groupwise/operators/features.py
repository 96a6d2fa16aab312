"""Features and summaries: sides, requests, flags, member lookups, summaries, windows around cut-offs, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupwise.functions.columns import correlation, group_fault, same_members
from groupwise.operators.sequence import row_numbers

#: Fixed starts of a possession after which play is live, and the seconds that make one a transition, and late.
LIVE_STARTS, TRANSITION_SECONDS, LATE_SECONDS = ("steal", "defensive rebound"), 6, 7


def by_side(is_home: Column, home: Column, away: Column) -> tuple[Column, Column]:
    """(own, other) lists of a row by its side; both null where the side is unknown."""
    return F.when(is_home, home).when(~is_home, away), F.when(is_home, away).when(~is_home, home)


def request_fault(offence: Column, defence: Column, member: Column, seconds: Column) -> Column:
    """Why a request can't be answered, or null: the offence is five distinct ids that hold the member, the defence none or five others, the clock 0 to 24."""
    own, other = group_fault(offence), group_fault(defence)
    return (
        F.when(own.isNotNull(), F.concat(F.lit("offence: "), own))
        .when(defence.isNotNull() & (F.size(defence) > 0) & other.isNotNull(), F.concat(F.lit("defence: "), other))
        .when(F.arrays_overlap(offence, F.coalesce(defence, F.array().cast("array<bigint>"))), "a member on both sides")
        .when(member.isNotNull() & ~F.array_contains(offence, member), "member not in the offence")
        .when(seconds.isNotNull() & ~seconds.between(0, 24), "clock out of range")
    )


def usable(df: DataFrame, lists: list[str], quality: str | None = None, ambiguous: str | None = None, size: int = 5) -> DataFrame:
    """Rows whose lists have size members, of quality VALID and without ambiguous bounds; null flags don't pass."""
    out = df
    for c in lists:
        out = out.where(F.size(c) == size)
    out = out.where(F.col(quality) == "VALID") if quality else out
    return out.where(~F.col(ambiguous)) if ambiguous else out


def play_flags(df: DataFrame, start_type: str, seconds: str, clock: str, period: str, margin: str) -> DataFrame:
    """df with live_ball, transition, late_clock and clutch as 0 or 1; what isn't known is 0."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    live = F.col(start_type).isin(*LIVE_STARTS)
    clutch = (F.col(period) >= 4) & (F.col(clock) <= 300) & (F.abs(F.col(margin)) <= 5)
    return df.withColumns({"live_ball": flag(live), "transition": flag(live & (F.col(seconds) <= TRANSITION_SECONDS)), "late_clock": flag(F.col(seconds) >= 24 - LATE_SECONDS), "clutch": flag(clutch)})


def standardised(df: DataFrame, value: str, train: DataFrame) -> DataFrame:
    """df with <value>_z by the train rows' mean and population spread; a missing value is the mean, no spread counts as 1."""
    stats = train.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    spread = F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).withColumn(f"{value}_z", (F.coalesce(F.col(value).cast("double"), F.col("__m")) - F.col("__m")) / spread).drop("__m", "__s")


def member_lookup(df: DataFrame, row: str, members: str, rates: DataFrame, default: float, without: str | None = None) -> DataFrame:
    """(row, mean, least, total) of the members' rates; `rates` is (member, rate), unknown ones the default; `without` names a column whose member is left out."""
    each = df.select(row, F.explode(members).alias("member"), *([F.col(without).alias("__out")] if without else []))
    each = each.where(~F.col("member").eqNullSafe(F.col("__out"))) if without else each
    rate = F.coalesce("rate", F.lit(default))
    return each.join(rates.select("member", "rate"), "member", "left").groupBy(row).agg(F.avg(rate).alias("mean"), F.min(rate).alias("least"), F.sum(rate).alias("total"))


def canonical_order(game: str, period: str, clock: str, event: str) -> list[Column]:
    """Sort keys of events: the clock runs down; nulls last."""
    return [F.asc_nulls_last(game), F.asc_nulls_last(period), F.desc_nulls_last(clock), F.asc_nulls_last(event)]


def first_and_last(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first and last k rows in a total order, with end: head or tail; a row that is both is head.

    Two ordered limits, and no sort of the whole: of the last k, those that are among the first k by the order's columns go.
    """
    head = df.orderBy(*order).limit(k)
    tail = df.orderBy(*(F.desc_nulls_last(c) for c in order)).limit(k)
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"__h{i}"))
    only = tail.join(F.broadcast(head.select(*(F.col(c).alias(f"__h{i}") for i, c in enumerate(order)))), same, "left_anti")  # k rows
    return head.withColumn("end", F.lit("head")).unionByName(only.withColumn("end", F.lit("tail")))


def possession_summary(df: DataFrame, points: str, length: str, live: Column, covered: Column) -> DataFrame:
    """One row: rows, share covered, mean and median length, and mean points of live-ball and other rows."""
    mean = lambda c: F.avg(F.when(c, F.col(points)))
    return df.agg(F.count("*").alias("n"), F.avg(covered.cast("double")).alias("covered"), F.avg(length).alias("mean_length"), F.median(length).alias("median_length"), mean(live).alias("live_points"), mean(~live).alias("set_points"))


def boundary_summary(df: DataFrame, own: str, told: str, ambiguous: str) -> DataFrame:
    """One row: rows, rows where both lists are known, the share of these whose lists agree, of those without an ambiguous bound too, and the share of ambiguous rows.

    A null bound is neither ambiguous nor clear; without compared rows agreement is 0.
    """
    same = F.when(F.col(own).isNotNull() & F.col(told).isNotNull(), same_members(F.col(own), F.col(told)).cast("double"))
    clear = F.when(~F.col(ambiguous), same)
    return df.agg(F.count("*").alias("n"), F.count(same).alias("n_compared"), F.coalesce(F.avg(same), F.lit(0.0)).alias("agreement"), F.coalesce(F.avg(clear), F.lit(0.0)).alias("unambiguous_agreement"), F.avg(F.col(ambiguous).cast("double")).alias("ambiguous_rate"))


def category_means(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, n, mean), best first, ties by name."""
    return df.groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).orderBy(F.desc("mean"), category)


def before_and_after(values: DataFrame, cutoffs: DataFrame, unit: str, order: str, value: str, cutoff: str) -> DataFrame:
    """(unit, n_before, before, n_after, after): a value's means around each unit's cut-off."""
    early = F.col(order) < F.col(cutoff)
    return values.join(cutoffs.select(unit, cutoff), unit).groupBy(unit).agg(F.count_if(early).alias("n_before"), F.avg(F.when(early, F.col(value))).alias("before"), F.count_if(~early).alias("n_after"), F.avg(F.when(~early, F.col(value))).alias("after"))


def change_noise(df: DataFrame, unit: str, order: list[str], value: str, least: int = 20) -> DataFrame:
    """(units, sd): the spread over units of the second half's mean less the first's, where a unit has `least` rows or more."""
    w = Window.partitionBy(unit)
    halves = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(*order))).where(F.col("__n") >= least)
    late = F.col("__r") * 2 > F.col("__n")
    each = halves.groupBy(unit).agg((F.avg(F.when(late, F.col(value))) - F.avg(F.when(~late, F.col(value)))).alias("change"))
    return each.agg(F.count("*").alias("units"), F.stddev_samp("change").alias("sd"))


def out_of_fold(df: DataFrame, fold: str, keys: list[str], made: str) -> DataFrame:
    """(fold, keys, makes, attempts) of the rows outside each fold: totals less the fold's own, so no fold is judged by its rows."""
    own = df.groupBy(fold, *keys).agg(F.sum(F.col(made).cast("long")).alias("__m"), F.count("*").alias("__n"))
    whole = own.groupBy(*keys).agg(F.sum("__m").alias("__all_m"), F.sum("__n").alias("__all_n"))
    folds = df.select(fold).distinct()
    every = whole.crossJoin(F.broadcast(folds)).join(own, [fold, *keys], "left")  # a few folds
    left = lambda c: F.col(f"__all_{c}") - F.coalesce(f"__{c}", F.lit(0))
    return every.select(fold, *keys, left("m").alias("makes"), left("n").alias("attempts")).where("attempts > 0")


def baselines(train: DataFrame, test: DataFrame, member: str, category: str, made: str, shrunk: DataFrame) -> DataFrame:
    """test with p_category (the category's train rate) and p_member (the member's shrunken rate there, the category's without one).

    shrunk is (member, category, rate_shrunk). Categories that train lacks get its rate of all rows.
    """
    by_category = train.groupBy(category).agg(F.avg(F.col(made).cast("double")).alias("__c"))
    whole = train.agg(F.avg(F.col(made).cast("double")).alias("__w"))
    joined = test.join(by_category, category, "left").crossJoin(F.broadcast(whole)).join(shrunk.select(member, category, F.col("rate_shrunk").alias("__m")), [member, category], "left")
    p = F.coalesce("__c", "__w")
    return joined.withColumn("p_category", p).withColumn("p_member", F.coalesce("__m", p)).drop("__c", "__w", "__m")


def split_half(a: DataFrame, b: DataFrame, key: str, value: str, least: int = 0, rows: str | None = None) -> DataFrame:
    """(n, pearson, spearman, corrected) of two halves' values by key; ranks of ties are averaged, corrected is for twice the length.

    With rows, the column of each half's number of rows, keys of fewer than `least` in either half are left out.
    """
    side = lambda df, c: (df.where(F.col(rows) >= least) if rows else df).select(key, F.col(value).alias(c))
    both = side(a, "x").join(side(b, "y"), key)

    def ranked(df: DataFrame, c: str) -> DataFrame:
        # rows of one value share the mean of their places
        places = row_numbers(df.select(key, c), c, key, name="__place").groupBy(c).agg((F.avg("__place") + 1).alias(f"{c}_rank"))
        return df.join(places, c)

    r = ranked(ranked(both, "x"), "y")
    pearson = correlation("x", "y")
    return r.agg(F.count("*").alias("n"), pearson.alias("pearson"), correlation("x_rank", "y_rank").alias("spearman"), (2 * pearson / (1 + pearson)).alias("corrected"))
