"""Raw, partitioned and pooled tables, the ingest manifest, and JSON results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groupwise.functions.columns import finite


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, so that zeros before ids stay."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """A table, or an empty one of the schema if it is not there and not required."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if required or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_partition(df: DataFrame, path: str, by: str = "season") -> None:
    """Replaces the partitions that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, by: str = "season") -> None:
    """Each table under its name, replacing the partitions that it holds: the typed, enriched and solved tables between raw and final ones."""
    for name, df in tables.items():
        write_partition(df, f"{root}/{name}", by)


def write_pooled(df: DataFrame, path: str) -> None:
    """One table over all partitions, replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def read_pooled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Types of the tables that a season without input has nevertheless.
TYPED = {
    "solutions": "game_id string, period int, side int, members array<bigint>, status string, n_violations int, n_solutions int, quality string",
    "stints": "game_id string, period int, stint_index int, start int, end int, home array<bigint>, away array<bigint>, quality string",
    "shots": "game_id string, event_num bigint, shooter_id bigint, zone_id string, points int, made boolean",
}


def typed_empty(spark: SparkSession, name: str) -> DataFrame:
    """A table of TYPED without rows."""
    return spark.createDataFrame([], TYPED[name])


def read_partitions(spark: SparkSession, path: str, by: str = "season", values: list | None = None) -> DataFrame:
    """All partitions as one table, or those named; only their files are read."""
    df = spark.read.parquet(path)
    return df if values is None else df.where(F.col(by).isin(values))


def partitions_of(spark: SparkSession, path: str, by: str = "season") -> DataFrame:
    return spark.read.parquet(path).select(by).distinct()


def earliest_row(df: DataFrame, key: str, by: str = "season") -> DataFrame:
    """One row a key, that of the earliest partition; ties by all columns."""
    order = [F.col(by), *(F.col(c) for c in df.columns if c not in (key, by))]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def manifest(spark: SparkSession, glob: str) -> DataFrame:
    """path, bytes, sha256 and time of each file."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("fetched_at"))


def with_missing(entries: DataFrame, expected: DataFrame, key: str = "key") -> DataFrame:
    """The manifest's entries, and one of status missing for each expected source that it lacks; the others are present."""
    found = entries.withColumn("status", F.lit("present"))
    return found.unionByName(expected.select(key).distinct().join(entries, key, "left_anti").withColumn("status", F.lit("missing")), allowMissingColumns=True)


def latest_entries(entries: DataFrame, key: str = "key", time: str = "fetched_at") -> DataFrame:
    """The latest manifest row of each key."""
    rest = [c for c in entries.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.struct(time, *(c for c in rest if c != time))).alias("row")
    return entries.groupBy(key).agg(latest).select(key, "row.*")


def _safe(x, kind: T.DataType):
    """x with numbers that aren't finite null, however deep they lie."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return finite(x)
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(_safe(x[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _safe(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: _safe(v, kind.valueType))
    return x


def as_json(df: DataFrame) -> DataFrame:
    """Each row as compact JSON in column order; numbers that aren't finite are null, in nested values too."""
    safe = [_safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))
