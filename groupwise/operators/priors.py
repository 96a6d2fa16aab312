"""Empirical-Bayes priors by moments, and rates and mixes shrunk toward them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the fits: least attempts of a unit that counts, the prior without two such units, bounds of the strength.
BETA_LEAST, BETA_FALLBACK, DIRICHLET_LEAST, DIRICHLET_FALLBACK, LARGEST = 20, 10.0, 50, 25.0, 5000.0


def beta_priors(df: DataFrame, makes: str, attempts: str, by: list[str]) -> DataFrame:
    """(by, prior_mean, strength): the rates' spread beyond what sampling explains sets the strength, in one aggregate."""
    counted = F.col(attempts) >= BETA_LEAST
    rate = F.when(counted, F.col(makes) / F.col(attempts))
    stats = df.groupBy(*by).agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(F.when(counted, F.col(attempts))).alias("mean_n"), F.count_if(counted).alias("units"), F.sum(makes).alias("makes"), F.sum(attempts).alias("attempts"))
    m, spread = F.col("m"), F.col("m") * (1 - F.col("m"))
    true = F.greatest(F.col("v") - spread / F.col("mean_n"), F.lit(1e-6))
    capped = F.when(true >= spread, spread * 0.99).otherwise(true)
    strength = F.least(F.greatest(F.when(spread > 0, spread / capped - 1).otherwise(F.lit(1.0)), F.lit(1.0)), F.lit(LARGEST))
    few = F.col("units") < 2
    pooled = F.when(F.col("attempts") > 0, F.col("makes") / F.col("attempts")).otherwise(F.lit(0.5))
    return stats.select(*by, F.when(few, pooled).otherwise(m).alias("prior_mean"), F.when(few, F.lit(BETA_FALLBACK)).otherwise(strength).alias("strength"))


def shrink_rates(df: DataFrame, makes: str, attempts: str, by: list[str]) -> DataFrame:
    """df with prior_mean, rate_raw (null without attempts), rate_shrunk and shrink_weight."""
    joined = df.join(beta_priors(df, makes, attempts, by), by)
    whole = F.col(attempts) + F.col("strength")
    raw = F.when(F.col(attempts) > 0, F.col(makes) / F.col(attempts))
    shrunk = (F.col(makes) + F.col("prior_mean") * F.col("strength")) / whole
    return joined.select(*df.columns, "prior_mean", raw.alias("rate_raw"), shrunk.alias("rate_shrunk"), (F.col(attempts) / whole).alias("shrink_weight"))


def dirichlet_prior(counts: DataFrame, columns: list[str]) -> DataFrame:
    """(category, mean, strength) for counts by unit in fixed columns: the weighted median over categories of the correlation within units."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    units = counts.withColumn("__n", total)
    used = F.col("__n") >= DIRICHLET_LEAST
    stats = units.agg(*(F.sum(c).alias(f"s_{c}") for c in columns), *(F.var_samp(F.when(used, F.col(c) / F.col("__n"))).alias(f"v_{c}") for c in columns), F.avg(F.when(used, F.col("__n"))).alias("n_bar"), F.count_if(used).alias("units"), F.sum("__n").alias("all"))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("category"), (F.col(f"s_{c}") / F.col("all")).alias("mean"), F.col(f"v_{c}").alias("var")) for i, c in enumerate(columns))))
    each = stats.select("n_bar", "units", rows.alias("r")).select("n_bar", "units", "r.*")
    rho = (F.col("var") / (F.col("mean") * (1 - F.col("mean")) / F.col("n_bar")) - 1) / (F.col("n_bar") - 1)
    with_rho = each.withColumn("rho", F.when((F.col("mean") > 0) & (F.col("mean") < 1) & (F.col("n_bar") > 1), rho)).withColumn("rho", F.when(F.col("rho") > 0, F.col("rho")))
    w = Window.orderBy(F.col("rho").asc_nulls_last(), "place").rowsBetween(Window.unboundedPreceding, 0)  # one row a category
    weight = F.when(F.col("rho").isNotNull(), F.col("mean")).otherwise(0.0)
    summed = with_rho.withColumn("__up_to", F.sum(weight).over(w)).withColumn("__all", F.sum(weight).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pooled = summed.agg(F.min(F.when(F.col("rho").isNotNull() & (F.col("__up_to") >= 0.5 * F.col("__all")), F.col("rho"))).alias("pooled"))
    few = (F.col("units") < 2) | ~(F.col("n_bar") > 1)
    strength = F.when(few, F.lit(DIRICHLET_FALLBACK)).when(F.col("pooled").isNull(), F.lit(LARGEST)).otherwise(F.least(F.greatest((1 - F.col("pooled")) / F.col("pooled"), F.lit(1.0)), F.lit(LARGEST)))
    return each.crossJoin(F.broadcast(pooled)).select("category", "mean", strength.alias("strength"))


def shrink_mixes(counts: DataFrame, columns: list[str]) -> DataFrame:
    """counts with mix_<category> for each column and mix_weight, shrunk toward the mix of all units."""
    prior = dirichlet_prior(counts, columns).groupBy().pivot("category", columns).agg(F.first("mean").alias("mean"), F.first("strength").alias("strength"))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    strength = F.col(f"{columns[0]}_strength")
    joined = counts.crossJoin(F.broadcast(prior))
    return joined.select(*counts.columns, *(((F.col(c) + strength * F.col(f"{c}_mean")) / (total + strength)).alias(f"mix_{c}") for c in columns), (total / (total + strength)).alias("mix_weight"))
