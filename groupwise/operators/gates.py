"""Quality gates, table profiles, fingerprints and drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.functions.columns import group_key, same_members, season_of


@dataclass(frozen=True)
class Gate:
    """A measure of a table and the bound it must keep: at least (or at most) the threshold; a warning only, if not blocking."""

    name: str
    measure: Column
    threshold: float
    at_least: bool = True
    blocking: bool = True


def share(condition: Column) -> Column:
    """Share of rows that meet the condition, null counting as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def run_gates(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """(gate, value, threshold, status) of all gates on a table, from one pass; an empty table measures 0."""
    measured = df.agg(*(F.coalesce(g.measure.cast("double"), F.lit(0.0)).alias(f"m{i}") for i, g in enumerate(gates)))
    status = lambda g, v: F.when(v >= g.threshold if g.at_least else v <= g.threshold, "PASS").otherwise("FAIL" if g.blocking else "WARN")
    rows = F.array(*(F.struct(F.lit(g.name).alias("gate"), F.col(f"m{i}").alias("value"), F.lit(float(g.threshold)).alias("threshold"), status(g, F.col(f"m{i}")).alias("status")) for i, g in enumerate(gates)))
    return measured.select(F.explode(rows).alias("g")).select("g.*")


def group_gates(own: str, other: str, key: str, seconds: str) -> list[Gate]:
    """Gates on groups and their stretches: five a side, keys that no order changes, durations above 0, lengths from 1 to 35 seconds."""
    return [
        Gate("valid groups have five a side", share((F.size(own) == 5) & (F.size(other) == 5)), 1.0),
        Gate("hash does not depend on order", share(group_key(F.reverse(own)) == F.col(key)), 1.0),
        Gate("durations are positive", share(F.col(seconds) > 0), 1.0),
        Gate("length is plausible", share(F.col(seconds).between(1, 35)), 0.95),
    ]


def oracle_gates(own: str, oracle: str, clear: bool = False) -> list[Gate]:
    """How often an independent list has the same members; where nothing is ambiguous it must more often."""
    name, least = ("oracle agrees where clear", 0.96) if clear else ("oracle agrees", 0.93)
    return [Gate(name, share(same_members(F.col(own), F.col(oracle))), least)]


def placement_gates(listed: Column, placed: Column) -> list[Gate]:
    """How many shots have lists, and lie in a possession."""
    return [Gate("shots have lists", share(listed), 0.99), Gate("shots lie in possessions", share(placed), 0.99)]


def season_gate(game: str, season: str) -> Gate:
    """Ids must name the season of their partition."""
    return Gate("ids name their season", share(season_of(F.col(game)) == F.col(season)), 1.0)


def require(report: DataFrame) -> None:
    """Raises if a blocking gate failed."""
    failed = [r["gate"] for r in report.where("status = 'FAIL'").collect()]
    if failed:
        raise ValueError(f"gates failed: {', '.join(failed)}")


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, null_rate, low, high) of each column in one pass; low and high of numeric ones, as numbers."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    is_number = lambda kind: kind.startswith(numeric)
    null = F.lit(None).cast("double")
    stats = [F.count("*").alias("rows")]
    for i, (c, kind) in enumerate(df.dtypes):
        stats += [F.count(F.col(c)).alias(f"n{i}"), (F.min(F.col(c)).cast("double") if is_number(kind) else null).alias(f"l{i}"), (F.max(F.col(c)).cast("double") if is_number(kind) else null).alias(f"h{i}")]
    one = df.agg(*stats)
    rate = lambda i: F.when(F.col("rows") > 0, F.round(1 - F.col(f"n{i}") / F.col("rows"), 6)).otherwise(0.0)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("dtype"), F.col("rows").alias("rows"), rate(i).alias("null_rate"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, (c, kind) in enumerate(df.dtypes)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """(rows, digest): the sum of the rows' hashes, so no order and no sort; doubles are rounded, nulls marked."""

    def text(c: str, kind: str) -> Column:
        x = F.round(F.col(c), digits) if kind in ("double", "float") else F.col(c)
        x = F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("\\N"))), "\x1e") if kind.startswith("array") else x.cast("string")
        return F.coalesce(x, F.lit("\\N"))

    row = F.sha2(F.concat_ws("\x1f", *(text(c, k) for c, k in sorted(df.dtypes))), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("rows"), half(1).alias("a"), half(16).alias("b"))
    return sums.select("rows", F.concat_ws(":", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")).alias("digest"))


def drift(now: DataFrame, before: DataFrame, keys: list[str], value: str, tolerance: Column) -> DataFrame:
    """Keys whose values differ by more than the tolerance or stand on one side only: (keys, now, before, problem)."""
    a, b = now.select(*keys, F.col(value).alias("now")), before.select(*keys, F.col(value).alias("before"))
    joined = a.join(b, keys, "full_outer")
    nan = lambda x: F.coalesce(F.isnan(x), F.lit(False))
    same = (nan(F.col("now")) & nan(F.col("before"))) | (F.abs(F.col("now") - F.col("before")) <= tolerance)
    problem = F.when(F.col("before").isNull() & F.col("now").isNull(), None).when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "missing").when(~same, "differs")
    return joined.withColumn("problem", problem).where("problem is not null")


#: How far a metric may drift, metrics of bins (parts of names), whose edges move rows, and how far those may.
DRIFT, BINNED, BINNED_DRIFT = 1e-6, ("ece", "reliability", "resolution", "skill"), 1e-3


def drift_tolerance(metric: Column) -> Column:
    """How far a metric of that name may drift: one of bins, or one made of such, further than others."""
    return F.when(F.arrays_overlap(F.split(metric, "_"), F.array(*map(F.lit, BINNED))), BINNED_DRIFT).otherwise(DRIFT)


def no_bad_numbers(df: DataFrame) -> Column:
    """Share of rows whose floating-point columns are all finite or null."""
    bad = F.lit(False)
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            bad |= F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    return F.avg((~bad).cast("double"))
