"""Sequences: as-of and interval joins, runs, previous ends, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="groupwise-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as it is now, in the folder that spark.checkpoint.dir names."""
    _folder(df.sparkSession)
    return df.checkpoint()


#: Shuffle files of an execution go at its end, if this is set when it begins; else they stay for as long as the driver's collector leaves them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as it is now, as compressed Parquet beside what `kept` writes: for tables that grow with the input.

    A checkpoint holds rows as they are in memory, which for lists and names is many times as much, and what was shuffled for it stays on disk; here it goes once the table is written.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/written-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that was `written`, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        if path.getName().startswith("written-"):
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a task sorts or counts at a time, about.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by the columns `by` in partitions of TASK_ROWS rows or fewer, unless a key holds more: what a task holds doesn't grow with the table."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // TASK_ROWS)), *by)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, take: list[str], within: float | None = None, tie: str | None = None) -> DataFrame:
    """left with the columns `take` of the right row of the same `by` whose right_at is the latest up to `at`.

    The two are stacked and a window carries the last right row forward, so the cost is one shuffle and sort by the keys
    whatever the number of rows a key has on either side. Ties among right rows go to the largest `tie`. With `within`, a
    match further back is none. Left rows always stay; null keys match nothing.
    """
    carried = F.struct(F.col(right_at).alias("__seen"), *take)
    rows = left.withColumn("__t", F.col(at).cast("double")).withColumn("__side", F.lit(1)).withColumn("__row", F.lit(None).cast(right.select(carried.alias("r")).schema["r"].dataType)).withColumn("__tie", F.lit(None).cast("long"))
    found = right.select(*by, F.col(right_at).cast("double").alias("__t"), F.lit(0).alias("__side"), carried.alias("__row"), (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("__tie"))
    order = Window.partitionBy(*by).orderBy("__t", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.unionByName(found, allowMissingColumns=True).withColumn("__last", F.last("__row", ignorenulls=True).over(order)).where("__side = 1")
    known = F.col("__last").isNotNull()
    for c in by:
        known &= F.col(c).isNotNull()
    if within is not None:
        known &= F.col("__t") - F.col("__last.__seen").cast("double") <= within
    return last.select(*left.columns, *(F.when(known, F.col(f"__last.{c}")).alias(c) for c in take), known.alias("matched"))


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, order: str, width: float = 60.0) -> DataFrame:
    """points with the one span of the same `by` that holds them on a countdown clock (at <= start, at > end), the least `order` if several do; others go.

    Spans are cut into stretches of `width` on the clock, and a point meets those of its stretch alone, whatever a key holds in all. Each place on a
    key's clock is looked up once, and points then meet the one span of their place, so that they are neither grouped nor multiplied.
    """
    extra = [c for c in spans.columns if c not in by]
    place = lambda c: F.floor(c.cast("double") / width)
    cut = spans.where(F.col(start) > F.col(end)).select(*by, F.struct(*extra).alias("__s"), F.explode(F.sequence(place(F.col(end)), place(F.col(start)))).alias("__at"))
    asked = points.select(*by, F.col(at).alias("__t")).distinct().withColumn("__at", place(F.col("__t")))
    holds = (F.col("__t") <= F.col(f"__s.{start}")) & (F.col("__t") > F.col(f"__s.{end}"))
    best = asked.join(cut, [*by, "__at"]).where(holds).groupBy(*by, "__t").agg(F.min_by("__s", F.struct(f"__s.{order}", "__s")).alias("__s"))
    found = points.withColumn("__t", F.col(at)).join(best, [*by, "__t"])
    return found.select(*points.columns, *(F.col(f"__s.{c}") for c in extra))


def previous_end(df: DataFrame, by: list[str], order: list[str], end: str, opening: Column) -> Column:
    """The end of the row before, or the opening for the first: a row's start."""
    return F.coalesce(F.lag(end).over(Window.partitionBy(*by).orderBy(*order)), opening)


def runs(df: DataFrame, by: list[str], order: list[str], key: list[str]) -> DataFrame:
    """df with run: the number, from 0, of the maximal stretch of rows in order in which the key doesn't change."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    changed = F.lit(False)
    for k in key:
        changed |= ~F.col(k).eqNullSafe(F.lag(k).over(ordered))
    first = F.row_number().over(ordered) == 1
    marked = df.withColumn("__new", F.when(first, 0).otherwise(changed.cast("int")))
    return marked.withColumn("run", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def stints(df: DataFrame, by: list[str], clock: str, order: str, key: list[str], opening: Column) -> DataFrame:
    """One row a run of constant key on a countdown clock: start, end, n_rows and stint_index; runs without length go unnumbered.

    A run starts at its own first clock (the first one when the period opens) and ends where the next begins, the last at 0.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(clock), order)
    changed = F.lit(False)
    for k in key:
        changed |= ~F.col(k).eqNullSafe(F.lag(k).over(w))
    # a run is the row that it begins with: all else follows from the next one's, in the one order that rows are sorted in
    placed = df.withColumn("__place", F.row_number().over(w)).withColumn("__new", (F.col("__place") == 1) | changed).withColumn("__all", F.count("*").over(Window.partitionBy(*by)))
    first = placed.where("__new").withColumn("n_rows", F.coalesce(F.lead("__place").over(w), F.col("__all") + 1) - F.col("__place"))
    spans = first.withColumn("start", F.when(F.col("__place") == 1, opening).otherwise(F.col(clock))).withColumn("end", F.coalesce(F.lead(clock).over(w), F.lit(0)))
    found = spans.where("start > end").withColumn("stint_index", F.row_number().over(w) - 1)
    return found.select(*by, *(k for k in key if k not in by), "n_rows", "start", "end", "stint_index")


def row_numbers(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """df with its place, from 0, in a total order over the whole table, without bringing it into one task.

    Rows are dealt by ranges and sorted in each; the sizes of the ranges, one number a partition, give each its offset. The dealt rows are
    written to the shared folder, as they must be the same ones when they are counted and when they are numbered.
    """
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("__part", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("__shift"))
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def running_total(df: DataFrame, value: str, *order: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before, in a total order over the whole table, without bringing it into one task."""
    ranged = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__shift")).drop("__part", "__shift")


def share_below(df: DataFrame, value: str, *ties: str, name: str = "share") -> DataFrame:
    """df with the share of all rows whose value, to nine digits, is less than the row's own."""
    ranked = row_numbers(df.withColumn("__m", F.round(value, 9)), "__m", *ties, name="__row")
    below = ranked.groupBy("__m").agg(F.min("__row").alias("__first"))
    total = ranked.agg(F.count("*").alias("__total"))
    return ranked.join(below, "__m").crossJoin(F.broadcast(total)).withColumn(name, F.col("__first") / F.col("__total")).drop("__m", "__row", "__first", "__total")  # one row


def equal_bins(df: DataFrame, k: int, *order: Column | str, name: str = "bin") -> DataFrame:
    """df with a bin from 0 to k - 1 of as many rows each, the first ones one more if it doesn't divide, in a total order."""
    ranked = row_numbers(df, *order, name="__row")
    n = df.count()
    size, more = divmod(n, k)
    row = F.col("__row")
    bin_ = F.when(row < more * (size + 1), F.floor(row / (size + 1))).otherwise(more + F.floor((row - more * (size + 1)) / max(size, 1)))
    return ranked.withColumn(name, bin_.cast("int")).drop("__row")


def tie_bands(items: Column, separable) -> Column:
    """Band numbers, from 1, along a sorted array: an item opens a new band when it is separable from all of the current one."""
    start = F.struct(F.lit(0).alias("band"), F.lit(0).alias("from"), F.lit(0).alias("i"), F.array().cast(T.ArrayType(T.IntegerType())).alias("out"))

    def step(s: Column, x: Column) -> Column:
        current = F.slice(items, s["from"] + 1, s["i"] - s["from"])
        opens = (s["i"] == 0) | F.forall(current, lambda y: separable(y, x))
        band = s["band"] + F.when(opens, 1).otherwise(0)
        return F.struct(band.alias("band"), F.when(opens, s["i"]).otherwise(s["from"]).alias("from"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(band)).alias("out"))

    return F.aggregate(items, start, step)["out"]
