"""Column functions: clocks, ids, court geometry, group keys, logits and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the court, in tenths of a foot from the basket.
RIM_RADIUS, PAINT_HALF_WIDTH, PAINT_DEPTH, CORNER_X, ARC, CORNER_MAX_Y = 40, 80, 190, 220, 237.5, 92.5
#: Fixed names of the nine zones.
ZONES = ("restricted_area", "paint_non_ra", "mid_baseline", "mid_wing", "mid_top", "corner_three_left", "corner_three_right", "wing_three", "top_three")
THREES = ("corner_three_left", "corner_three_right", "wing_three", "top_three")
GROUP_SIZE = 5


def clock_seconds(clock: Column) -> Column:
    """Seconds of "MM:SS"; null for anything else."""
    parts = F.split(clock, ":")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int"))


def minutes_seconds(clock: Column) -> Column:
    """As clock_seconds, but null, empty and one-part values are 0; a part that is no number stays null."""
    return F.when(F.coalesce(F.size(F.split(clock, ":")), F.lit(0)) == 2, clock_seconds(clock)).otherwise(0)


def padded_id(value: Column, width: int = 10) -> Column:
    """The trimmed value with zeros before it up to width; longer ones are never cut."""
    bare = F.trim(value)
    return F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare)


def period_length(period: Column) -> Column:
    return F.when(period <= 4, 720).otherwise(300)


def elapsed(period: Column, remaining: Column) -> Column:
    """Seconds since the period opened."""
    return period_length(period) - remaining


def season_of(game_id: Column) -> Column:
    """First year of the season that digits 4 and 5 of a ten-digit id name, all of this century; null for other ids."""
    return F.when(game_id.rlike(r"^\d{10}$"), 2000 + F.substring(game_id, 4, 2).try_cast("int"))


def season_label(year: Column) -> Column:
    return F.format_string("%d-%02d", year.cast("int"), ((year + 1) % 100).cast("int"))


def is_three(x: Column, y: Column) -> Column:
    """Behind the line: 22 feet to the side below the break, a radius above it."""
    return F.when(y <= CORNER_MAX_Y, F.abs(x) >= CORNER_X).otherwise(F.sqrt(x * x + y * y) >= ARC)


def zone(x: Column, y: Column) -> Column:
    """One of ZONES; the first rule that holds decides."""
    three, low, wide = is_three(x, y), y <= CORNER_MAX_Y, F.abs(x) > y
    rules = (
        ("corner_three_left", three & low & (x < 0)),
        ("corner_three_right", three & low),
        ("wing_three", three & wide),
        ("top_three", three),
        ("restricted_area", F.sqrt(x * x + y * y) <= RIM_RADIUS),
        ("paint_non_ra", (F.abs(x) <= PAINT_HALF_WIDTH) & (y <= PAINT_DEPTH)),
        ("mid_baseline", low),
        ("mid_wing", wide),
    )
    out = F.lit("mid_top")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def shot_points(zone_id: Column) -> Column:
    return F.when(zone_id.isin(*THREES), 3).otherwise(2)


def group_key(members: Column, size: int = GROUP_SIZE) -> Column:
    """A key that no order of the members changes; null unless there are exactly size of them."""
    text = F.array_join(F.transform(F.sort_array(members), lambda x: x.cast("string")), ",")
    return F.when(F.size(members) == size, F.md5(text))


def group_fault(members: Column, size: int = GROUP_SIZE) -> Column:
    """Why members are no valid group, or null."""
    return (
        F.when(members.isNull(), "missing")
        .when(F.size(members) != size, "wrong size")
        .when(F.exists(members, lambda x: x.isNull() | (x <= 0)), "not a positive id")
        .when(F.size(F.array_distinct(members)) != size, "repeated member")
    )


def one_for_one(before: Column, after: Column) -> Column:
    """(out, in) if exactly one member was exchanged, else null."""
    gone, came = F.array_except(before, after), F.array_except(after, before)
    return F.when((F.size(gone) == 1) & (F.size(came) == 1), F.struct(F.get(gone, F.lit(0)).alias("out"), F.get(came, F.lit(0)).alias("in")))


def same_members(a: Column, b: Column) -> Column:
    return F.sort_array(a) == F.sort_array(b)


def logit(p: Column, floor: float = 1e-9) -> Column:
    bounded = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.ln(bounded / (1 - bounded))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is found once a row, however often f names it: a lambda's own argument is not put in place of its name."""
    return F.transform(F.array(value), f)[0]


def shares(weights: Column) -> Column:
    """Shares of an array of numbers in their sum."""
    whole = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    return bound(weights, lambda w: bound(whole(w), lambda t: F.transform(w, lambda x: x / t)))


def softmax(utilities: Column) -> Column:
    """Shares of an array of utilities, shifted by the largest."""
    return shares(bound(utilities, lambda u: bound(F.array_max(u), lambda m: F.transform(u, lambda x: F.exp(x - m)))))


def quadratic_form(vector: Column, matrix: list[list[float]]) -> Column:
    """v' M v for a fixed small matrix."""
    rows = F.array(*(F.array(*map(F.lit, row)) for row in matrix))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot(vector, F.transform(rows, lambda row: dot(row, vector)))


def wald_2(a: Column, b: Column, var_a: Column, cov: Column, var_b: Column) -> Column:
    """(a, b) M^-1 (a, b)' for a 2 x 2 covariance; null where that is not positive definite."""
    det = var_a * var_b - cov * cov
    return F.when((var_a > 0) & (det > 0), (a * a * var_b - 2 * a * b * cov + b * b * var_a) / det)


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def numbers(text: Column) -> Column:
    """Numbers that aren't glued to a word, as written, with a % sign if one follows."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\w.])(-?\d+(?:\.\d+)?%?)(?![\w])"), 1)


def direction(x: Column) -> Column:
    return F.when(x > 0, "gain").when(x < 0, "loss").when(x == 0, "flat")


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation, null where either side doesn't vary; the built-in one divides by zero there."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)
