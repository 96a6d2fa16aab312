"""Typing of raw event rows: ids, clocks, seasons and game types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.functions.columns import clock_seconds, padded_id, season_label, season_of

#: Fixed prefixes of ids and the game types they name, and the types that are modelled.
GAME_TYPES = {"001": "preseason", "002": "regular", "003": "allstar", "004": "playoffs", "005": "playin", "006": "cupfinal"}
MODELLED = ("regular", "playoffs", "playin")
#: Fixed bounds of a plausible first year of a season.
FIRST_YEAR, LAST_YEAR = 1946, 2100


def game_type(game_id: Column, strict: bool = False) -> Column:
    """The game type that an id's first three digits name; null, or with strict an error, for unknown ones and ids that aren't ten digits."""
    prefix, out = F.substring(game_id, 1, 3), F.lit(None).cast("string")
    for digits, name in GAME_TYPES.items():
        out = F.when(prefix == digits, name).otherwise(out)
    found = F.when(game_id.rlike(r"^\d{10}$"), out)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no known game type: "), game_id))) if strict else found


def season_of_label(label: Column, strict: bool = False) -> Column:
    """First year of a season label such as 2023-24; null, or with strict an error, for malformed, inconsistent and implausible ones."""
    year = F.when(label.rlike(r"^\d{4}-\d{2}$"), F.substring(label, 1, 4).try_cast("int"))
    sound = F.when(year.between(FIRST_YEAR, LAST_YEAR) & (season_label(year) == label), year)
    return F.coalesce(sound, F.raise_error(F.concat(F.lit("no season: "), label))) if strict else sound


def season_table(df: DataFrame, year: str) -> DataFrame:
    """(season, label, two_digit, file_year) of the seasons in df; file_year is the year in which a season ends, by which some sources name files."""
    y = F.col("season")
    return df.select(F.col(year).cast("int").alias("season")).where(y.between(FIRST_YEAR, LAST_YEAR)).distinct().select("season", season_label(y).alias("label"), F.format_string("%02d", y % 100).alias("two_digit"), (y + 1).alias("file_year"))


def type_events(raw: DataFrame, integers: tuple[str, ...], game: str = "game_id", event: str = "event_num", clock: str = "clock") -> DataFrame:
    """Text rows with ids padded, whole numbers and clocks read (null where they can't be), season and game_type; modelled game types alone, one row of each (game, event).

    Of several rows the least one in all other columns stays. Rows whose id names no season or type go.
    """
    typed = raw.withColumn(game, padded_id(F.col(game))).withColumns({c: F.col(c).try_cast("bigint") for c in integers})
    typed = typed.withColumns({"seconds_remaining": clock_seconds(F.col(clock)), "season": season_of(F.col(game)), "game_type": game_type(F.col(game))}).where(F.col("game_type").isin(*MODELLED))
    rest = [c for c in typed.columns if c not in (game, event)]
    return typed.groupBy(game, event).agg(F.min(F.struct(*rest)).alias("row")).select(game, event, "row.*")


def wrong_seasons(df: DataFrame, game: str, season: int) -> DataFrame:
    """(digits, n): season digits of ids other than the requested season's; none if the table is what it says."""
    digits = F.substring(F.col(game), 4, 2)
    return df.groupBy(digits.alias("digits")).agg(F.count("*").alias("n")).where(F.col("digits").isNotNull() & (F.col("digits") != f"{season % 100:02d}"))


def require_season(df: DataFrame, game: str, season: int) -> None:
    """Raises if ids name another season."""
    found = [r["digits"] for r in wrong_seasons(df, game, season).orderBy("digits").collect()]  # a hundred at most
    if found:
        raise ValueError(f"season {season} asked for, but ids name {', '.join(found)}")


#: Parts of names that no feature of a model may have, as they tell its result.
FORBIDDEN = ("made", "outcome", "result", "points", "label", "target")


def design_columns(df: DataFrame, allowed: list[str], forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """The allowed columns alone; a forbidden name among them, or one that isn't there, is an error."""
    told = [c for c in allowed if any(f in c.lower().split("_") for f in forbidden)]
    missing = [c for c in allowed if c not in df.columns]
    if told or missing:
        raise ValueError(f"no features: {', '.join(told)}; not there: {', '.join(missing)}")
    return df.select(*allowed)
