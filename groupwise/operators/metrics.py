"""Splits that do not leak, and metrics of probabilities and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from groupwise.operators.sequence import equal_bins, kept, row_numbers, running_total

CLIP = 1e-15
#: Stretches of a probability, and of what breaks its ties, that rows are counted by before any are put in order.
STRETCHES, TIE_STRETCHES = 65_536, 512


def walk_forward(df: DataFrame, game: str, folds: int = 4, least: float = 0.4) -> DataFrame:
    """(game, fold): the fold in which a game is tested, in order of games; the first `least` of them are only trained on (fold null).

    Fold f trains on all games before its own. Only the table of distinct games is ranked.
    """
    games = df.select(game).distinct()
    n = games.count()
    first = int(n * least)
    ranked = row_numbers(games, game, name="place")
    size = max(1, -(-(n - first) // folds))
    return ranked.select(game, F.when(F.col("place") >= first, F.floor((F.col("place") - first) / size).cast("int")).alias("fold"))


def leave_groups_out(df: DataFrame, group: str, folds: int, least: int, seed: int = 0) -> DataFrame:
    """(group, fold) for groups of `least` rows or more, dealt into folds of equal size by the order of a seeded hash."""
    kept = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hashed = kept.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    return equal_bins(hashed, folds, "h", group, name="fold").select(group, "fold")


def seen_only(df: DataFrame, folds: DataFrame, group: str, who: str) -> DataFrame:
    """df's rows of groups with a fold, with it, that a fold may be tested on: their `who` has a row that the fold doesn't hold, so it is seen in training.

    Rows are counted by who and fold before anything is joined; a null who is seen nowhere.
    """
    placed = df.join(folds.select(group, "fold"), group, "left")
    inside = placed.where(F.col(who).isNotNull()).groupBy(who, "fold").agg(F.count("*").alias("n"))
    all_ = inside.groupBy(who).agg(F.sum("n").alias("all"))
    allowed = inside.join(all_, who).where("fold is not null and n < all").select(who, "fold")
    return placed.join(allowed, [who, "fold"], "left_semi")


def loss(y: Column, p: Column) -> Column:
    """A row's log loss."""
    bounded = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return -(y * F.ln(bounded) + (1 - y) * F.ln(1 - bounded))


def log_loss(y: Column, p: Column) -> Column:
    return F.avg(loss(y, p))


def _bins(df: DataFrame, by: str, y: str, p: str, order: list[str], k: int | Column) -> DataFrame:
    """(by, bin, n, mean_p, mean_y) of k bins of equal counts by p within each `by`, ties by `order`; few values of `by`, of which k may be a function.

    Bins need sums alone, and only their edges need an order. Rows are counted by stretches of p first; those of a stretch that an edge cuts by
    their p and stretches of the order's first column, if it is a number; only what an edge cuts then is put in order. Each level holds at most k - 1 cuts a `by`.
    """
    numeric = isinstance(df.schema[order[0]].dataType, T.NumericType)
    first = F.col(order[0]).cast("double") if numeric else F.lit(0.0)
    stretch = F.when(F.col("__p").isNull(), -2 * STRETCHES).otherwise(F.floor(F.greatest(F.least("__p", F.lit(2.0)), F.lit(-1.0)) * STRETCHES))
    rows = df.select(F.col(by).alias("__by"), F.col(p).cast("double").alias("__p"), F.col(y).cast("double").alias("__y"), *order).withColumn("__s", stretch)
    sums = [F.count("*").alias("n"), F.sum("__p").alias("sum_p"), F.count("__p").alias("n_p"), F.sum("__y").alias("sum_y"), F.count("__y").alias("n_y")]
    named = ["__by", "bin", "n", "sum_p", "n_p", "sum_y", "n_y"]

    def bin_at(place: Column) -> Column:
        size, more = F.floor(F.col("__all") / F.col("__k")), F.col("__all") % F.col("__k")
        return F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")

    def cut(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups with a place `__at` within `by` that lie in one bin, and the others."""
        last = bin_at(F.col("__at") + F.col("n") - 1)
        found = groups.withColumn("bin", bin_at(F.col("__at"))).withColumn("__whole", F.col("bin") == last)
        return found.where("__whole").select(named), found.where("not __whole")

    low, high = F.min(first).alias("__low"), F.max(first).alias("__high")
    ranged = running_total(rows.groupBy("__by", "__s").agg(*sums, low, high), "n", "__by", "__s", name="__before")
    begins = ranged.groupBy("__by").agg(F.min("__before").alias("__begin"), F.sum("n").alias("__all")).withColumn("__k", (F.lit(k) if isinstance(k, int) else k).cast("long"))
    whole, open_ = cut(ranged.join(F.broadcast(begins), "__by").withColumn("__at", F.col("__before") - F.col("__begin")))  # a row a `by`
    size = ["__all", "__k"]

    part = F.floor(F.try_divide(first - F.col("__low"), F.col("__high") - F.col("__low")) * TIE_STRETCHES)
    tied = F.when(F.col(order[0]).isNull(), -1).otherwise(F.coalesce(part, F.lit(0))) if numeric else F.lit(0)
    edges = kept(open_.select("__by", "__s", "__low", "__high", F.col("__at").alias("__from"), *size))
    inner = rows.join(F.broadcast(edges), ["__by", "__s"]).withColumn("__o", tied)  # fewer than k rows a `by`
    own = running_total(inner.groupBy("__by", "__s", "__p", "__o").agg(*sums), "n", "__by", "__s", "__p", "__o", name="__before")
    begins = own.groupBy("__by", "__s").agg(F.min("__before").alias("__begin"))
    more, open_ = cut(own.join(F.broadcast(edges.join(begins, ["__by", "__s"])), ["__by", "__s"]).withColumn("__at", F.col("__from") + F.col("__before") - F.col("__begin")))

    keys = ["__by", "__s", "__p", "__o"]
    last = kept(open_.select(*keys, F.col("__at").alias("__start")))
    same = [inner[c].eqNullSafe(last[c]) for c in keys]
    few = inner.join(F.broadcast(last), same[0] & same[1] & same[2] & same[3]).select(*(inner[c] for c in keys), "__y", "__start", *size, *order)
    placed = row_numbers(kept(few), *keys, *order, name="__row")  # kept, as dealing by ranges reads its rows twice
    begins = placed.groupBy("__by", "__start").agg(F.min("__row").alias("__begin"))
    each = placed.join(F.broadcast(begins), ["__by", "__start"]).withColumn("bin", bin_at(F.col("__start") + F.col("__row") - F.col("__begin")))
    single = each.groupBy("__by", "bin").agg(*sums).select(named)

    found = whole.unionByName(more).unionByName(single).groupBy("__by", "bin").agg(*(F.sum(c).alias(c) for c in named[2:]))
    return found.select(F.col("__by").alias(by), "bin", "n", F.try_divide("sum_p", "n_p").alias("mean_p"), F.try_divide("sum_y", "n_y").alias("mean_y"))


def calibration_bins(df: DataFrame, y: str, p: str, order: list[str], k: int = 20) -> DataFrame:
    """(bin, n, mean_p, mean_y) of k bins of equal counts by p, ties by `order`."""
    return _bins(df.withColumn("__all_rows", F.lit(0)), "__all_rows", y, p, order, k).drop("__all_rows")


def brier_parts(bins: DataFrame) -> DataFrame:
    """Reliability, resolution, uncertainty and expected calibration error from calibration bins."""
    n = F.col("n")
    whole = bins.agg(F.sum("n").alias("all"), (F.sum(n * F.col("mean_y")) / F.sum("n")).alias("base"))
    each = bins.crossJoin(F.broadcast(whole))
    share = n / F.col("all")
    return each.agg(F.sum(share * F.pow(F.col("mean_p") - F.col("mean_y"), 2)).alias("reliability"), F.sum(share * F.pow(F.col("mean_y") - F.col("base"), 2)).alias("resolution"), F.first(F.col("base") * (1 - F.col("base"))).alias("uncertainty"), F.sum(share * F.abs(F.col("mean_p") - F.col("mean_y"))).alias("ece"))


def pooled(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Metrics (by, fold, value, n) over folds, weighted by n; values that aren't finite are left out."""
    sound = ~F.isnan("value") & (F.abs("value") != float("inf"))
    return metrics.groupBy(*by).agg((F.sum(F.when(sound, F.col("value") * F.col("n"))) / F.sum(F.when(sound, F.col("n")))).alias("value"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Recall@k (of the most that can be found), reciprocal rank over the whole ranking and nDCG@k of each query.

    ranked is (query, doc, rank), relevant (query, doc). Queries without relevant documents have no row.
    """
    known = relevant.select("query", "doc").distinct()
    totals = known.groupBy("query").agg(F.count("*").alias("relevant"))
    hits = ranked.join(known, ["query", "doc"]).groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return totals.join(hits, "query", "left").select("query", (F.coalesce("found", F.lit(0)) / F.least("relevant", F.lit(k))).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: empty if a split doesn't leak. Null keys don't count."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b, key, "left_semi")


def unseen(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys of test that train lacks."""
    return test.select(key).distinct().join(train, key, "left_anti")


def tested_before(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """The last key of train, the first of test, and whether time runs from one to the other."""
    last, first = train.agg(F.max(key).alias("train_last")), test.agg(F.min(key).alias("test_first"))
    return last.crossJoin(first).withColumn("ordered", F.col("train_last") < F.col("test_first"))


def odd_even_games(df: DataFrame, game: str) -> DataFrame:
    """(game, half) by the parity of a game's place among all."""
    return row_numbers(df.select(game).distinct(), game, name="place").select(game, (F.col("place") % 2).alias("half"))


def centred(df: DataFrame, value: str, by: str) -> Column:
    """value less its mean within `by`."""
    return F.col(value) - F.avg(value).over(Window.partitionBy(by))


def calibration_slope(df: DataFrame, y: str, p: str, steps: int = 25) -> tuple[float, float] | None:
    """(slope, intercept) of an unpenalised logistic regression of y on the logit of p; None if y has one value. Each Newton step is one aggregate."""
    from groupwise.functions.columns import logit

    rows = kept(df.select(F.col(y).cast("double").alias("y"), logit(F.col(p), CLIP).alias("x")))
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    if low is None or low == high:
        return None
    slope, intercept = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(slope * F.col("x") + intercept)))
        v = rows.withColumn("e", F.col("y") - q).withColumn("w", q * (1 - q))
        s = v.agg(F.sum("e").alias("g0"), F.sum(F.col("e") * F.col("x")).alias("g1"), F.sum("w").alias("h0"), F.sum(F.col("w") * F.col("x")).alias("h1"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("h2")).first()
        det = s["h0"] * s["h2"] - s["h1"] ** 2
        if det <= 0:
            return None
        d0, d1 = (s["h2"] * s["g0"] - s["h1"] * s["g1"]) / det, (s["h0"] * s["g1"] - s["h1"] * s["g0"]) / det
        intercept, slope = intercept + d0, slope + d1
        if abs(d0) + abs(d1) < 1e-10:
            return slope, intercept
    raise ValueError(f"no convergence in {steps} steps")


def class_errors(df: DataFrame, mix: str, chosen: str, n_choices: int, order: list[str], k: int = 10) -> DataFrame:
    """(choice, n, ece): the expected calibration error of each choice's probability, in k bins of equal counts within the choice. `order` breaks ties."""
    each = df.select(*order, F.posexplode(mix).alias("choice", "p"), F.col(chosen).alias("__chosen"))
    each = each.where(F.col("choice") < n_choices).withColumn("y", (F.col("choice") == F.col("__chosen")).cast("double"))
    return _class_errors(_bins(each, "choice", "y", "p", order, k))


def _class_errors(bins: DataFrame) -> DataFrame:
    return bins.groupBy("choice").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def choice_report(df: DataFrame, mix: str, chosen: str, n_choices: int, groups: dict[str, list[int]], order: list[str], k: int = 10, k_groups: int = 20) -> DataFrame:
    """One row about probabilities of n choices: n, log_loss, top_1, the mean over choices of class_errors, and for each group of choices its log loss, Brier score, resolution and ECE.

    Probabilities are held above 1e-12, made to add up to 1 and rounded to 12 digits, so that equal ones stay equal in bins; the first largest is the guess. No rows give n = 0 and nulls.
    Groups are binned beside the choices, as further ones, in the same passes.
    """
    bounded = F.transform(mix, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12)))
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda s, v: s + v)
    summed = F.transform(F.array(bounded), lambda b: F.struct(b.alias("b"), total(b).alias("t")))  # a sum a row, not one an element
    own = F.transform(summed, lambda s: F.transform(s["b"], lambda x: F.round(x / s["t"], 12)))
    together = lambda q: [F.greatest(F.least(F.round(sum((F.get(q, F.lit(i)) for i in places), F.lit(0.0)), 12), F.lit(1 - 1e-12)), F.lit(1e-12)) for places in groups.values()]
    sound = kept(df.select(*order, F.col(chosen).alias("chosen"), F.transform(own, lambda q: F.concat(F.slice(q, 1, n_choices), F.array(*together(q)).cast("array<double>")))[0].alias("p")))
    scores, y = [], F.col("choice") == F.col("chosen")
    for at, (name, places) in enumerate(groups.items(), n_choices):
        inside, p = F.col("chosen").isin(places), F.get("p", F.lit(at))
        scores += [log_loss(inside.cast("double"), p).alias(f"{name}_log_loss"), F.avg(F.pow(p - inside.cast("double"), 2)).alias(f"{name}_brier")]
        y = F.when(F.col("choice") == at, inside).otherwise(y)
    each = sound.select(*order, "chosen", F.posexplode("p").alias("choice", "p")).withColumn("y", y.cast("double"))
    bins = kept(_bins(each, "choice", "y", "p", order, F.when(F.col("__by") < n_choices, k).otherwise(k_groups)))
    q = F.slice("p", 1, n_choices)
    whole = sound.agg(F.count("*").alias("n"), F.avg(-F.ln(F.get("p", F.col("chosen")))).alias("log_loss"), F.avg((F.array_position(q, F.array_max(q)) - 1 == F.col("chosen")).cast("double")).alias("top_1"), *scores)
    out = whole.crossJoin(F.broadcast(_class_errors(bins.where(F.col("choice") < n_choices)).agg(F.avg("ece").alias("class_ece"))))  # one row each
    for at, name in enumerate(groups):
        parts = brier_parts(bins.where(F.col("choice") == n_choices + at)).select(F.col("resolution").alias(f"{name}_resolution"), F.col("ece").alias(f"{name}_ece"))
        out = out.crossJoin(F.broadcast(parts))
    return out.select("n", "log_loss", "top_1", "class_ece", *(f"{name}_{c}" for name in groups for c in ("log_loss", "brier", "resolution", "ece")))
