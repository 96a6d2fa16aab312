"""Who was present: facts from event rows, the starting group of a period, and replay.

What a member's rows contradict depends only on whether they started, so Spark windows work out both cases for each member by
themselves. A group of starters then costs the sum of its members' contradictions, and what crowds add second by second.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groupwise.operators.sequence import kept

SIZE = 5
#: A rule of the operator: with more candidates than these a period is left unsolved rather than guessed at.
CANDIDATES = 16
#: Fixed codes of raw event rows: types that tell nothing of who is there, those whose second and third slots hold someone who
#: is, substitutions, ejections, fouls, the fouls that members off the floor can get, and the two sides' kinds of person.
SILENT_TYPES, SLOT_2_TYPES, SLOT_3_TYPES = (9, 12, 13, 18), (1, 5, 6, 10), (2, 6, 10)
SUBSTITUTION, EJECTION, FOUL = 8, 11, 6
TECHNICAL_FOULS = (10, 11, 12, 13, 16, 18, 19, 25, 30)
SIDES = (4, 5)


def claims(raw: DataFrame, keep: list[str], kind: str = "event_type", action: str = "action_type", slots: tuple[tuple[str, str], ...] = (("player1", "type1"), ("player2", "type2"), ("player3", "type3"))) -> DataFrame:
    """(keep, member, side, kind) of each presence that an event row claims: none to three rows, of kinds IN, OUT, EJECT and EV.

    A slot holds a member if its person is of one of the two sides and its id positive. The first of a substitution leaves, the second enters.
    """
    code = F.col(kind)
    technical = (code == FOUL) & F.coalesce(F.col(action).isin(*TECHNICAL_FOULS), F.lit(False))
    acts = ~code.isin(*SILENT_TYPES, SUBSTITUTION, EJECTION) & ~technical
    says = (
        F.when(code == SUBSTITUTION, "OUT").when(code == EJECTION, "EJECT").when(acts, "EV"),
        F.when(code == SUBSTITUTION, "IN").when(acts & code.isin(*SLOT_2_TYPES), "EV"),
        F.when(acts & code.isin(*SLOT_3_TYPES), "EV"),
    )
    every = F.array(*(F.when(says_.isNotNull() & F.col(person).isin(*SIDES) & (F.col(member) > 0), F.struct(F.col(member).alias("member"), F.col(person).alias("side"), says_.alias("kind"))) for says_, (member, person) in zip(says, slots, strict=True)))
    return raw.select(*keep, F.inline(F.array_compact(every)))


def facts(df: DataFrame, group: list[str], order: list[str], member: str, kind: str) -> DataFrame:
    """(group, member, first, started): a member's first fact; one whose first is IN can't have started."""
    first = F.min_by(kind, F.struct(*order)).alias("first")
    return df.groupBy(*group, member).agg(first).withColumn("started", F.col("first") != "IN")


def _seconds(df: DataFrame, group: list[str], clock: str, member: str, kind: str) -> DataFrame:
    """(group, member, clock, outs, ins, acts, was): a member's rows of one clock second; was: whether they were there by the seconds before, null if nothing moved them yet."""
    count = lambda *which: F.count_if(F.col(kind).isin(*which))
    summed = df.groupBy(*group, member, clock).agg(count("OUT", "EJECT").alias("outs"), count("IN").alias("ins"), count("EV").alias("acts"))
    moved = F.when((F.col("ins") > 0) | (F.col("outs") > 0), F.col("ins") > 0)
    before = Window.partitionBy(*group, member).orderBy(F.desc(clock)).rowsBetween(Window.unboundedPreceding, -1)
    return summed.withColumn("moves", moved).withColumn("was", F.last("moves", ignorenulls=True).over(before))


def member_costs(df: DataFrame, group: list[str], clock: str, event: str, member: str, kind: str) -> DataFrame:
    """(group, member, started, idle, starting, until): contradictions of a member's rows if they did not start and if they did, and the clock of their first move.

    Rows of one clock second have no order: who leaves goes first, then others enter, and who was there before or after may act.
    """

    def wrong(start: int) -> Column:
        there = F.coalesce(F.col("was").cast("int"), F.lit(start))
        left = F.when(F.col("outs") > 0, 0).otherwise(there)
        after = F.when(F.col("ins") > 0, 1).otherwise(left)
        leaving = F.greatest(F.col("outs") - there, F.lit(0))
        entering = F.greatest(F.col("ins") - (1 - left), F.lit(0))
        return leaving + entering + F.when((there == 0) & (after == 0), F.col("acts")).otherwise(0)

    each = _seconds(df, group, clock, member, kind).groupBy(*group, member).agg(F.sum(wrong(0)).alias("idle"), F.sum(wrong(1)).alias("starting"), F.max(F.when(F.col("moves").isNotNull(), F.col(clock))).alias("until"))
    first = facts(df.withColumn("__at", -F.col(clock)), group, ["__at", event, kind], member, kind)
    same = reduce(and_, (F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*group, member]))
    return each.alias("c").join(first.alias("f"), same).select("c.*", "f.started")


def _crowds(df: DataFrame, group: list[str], clock: str, member: str, kind: str) -> DataFrame:
    """(group, clock, moved): how many of those whom something has moved are there after each second."""
    change = F.coalesce(F.col("moves").cast("int") - F.coalesce(F.col("was").cast("int"), F.lit(0)), F.lit(0))
    by_second = _seconds(df, group, clock, member, kind).groupBy(*group, clock).agg(F.sum(change).alias("change"))
    return by_second.withColumn("moved", F.sum("change").over(Window.partitionBy(*group).orderBy(F.desc(clock)).rowsBetween(Window.unboundedPreceding, 0)))


def pick(members: np.ndarray, started: np.ndarray, idle: np.ndarray, starting: np.ndarray, until: np.ndarray, clocks: np.ndarray, moved: np.ndarray) -> tuple[list | None, str, int, int]:
    """(members, status, violations, clean groups) of a period from its members' costs, members sorted, and its crowds.

    EXACT: five certain starters without contradiction. SOLVED: one clean five of the candidates. AMBIGUOUS: several, of which the
    largest sorted one stands. REPAIRED: none, and the first with the fewest violations stands. UNDERDETERMINED: fewer candidates
    than five, or too many. Certain starters are in every group tried if there are up to five, else all candidates are of them.
    """
    sure = np.flatnonzero(started)
    pool = sure if len(sure) >= SIZE else np.arange(len(members))
    if len(sure) != SIZE and not SIZE <= len(pool) <= CANDIDATES:
        return None, "UNDERDETERMINED", 0, 0
    groups = np.array(list(combinations(pool.tolist(), SIZE)))
    if len(sure) < SIZE:
        groups = groups[np.isin(groups, sure).sum(axis=1) == len(sure)]
    own = idle.sum() + (starting - idle)[groups].sum(axis=1)
    still = (until[groups][:, :, None] < clocks).sum(axis=1)  # starters whom nothing has moved up to a second, that one too
    bad = own + np.maximum(still + moved - SIZE, 0).sum(axis=1)
    clean = np.flatnonzero(bad == 0)
    best = clean[-1] if len(clean) else bad.argmin()
    if len(sure) == SIZE:
        return members[groups[0]].tolist(), "REPAIRED" if bad[0] else "EXACT", int(bad[0]), 1
    status = "REPAIRED" if not len(clean) else "SOLVED" if len(clean) == 1 else "AMBIGUOUS"
    return members[groups[best]].tolist(), status, int(bad[best]), len(clean)


def starting_groups(df: DataFrame, group: list[str], clock: str, event: str, member: str, kind: str) -> DataFrame:
    """One row a period and side: members, status, n_violations, n_solutions and quality; a period has few dozen members and seconds.

    Clocks run down. Null ids are no members.
    """
    df = df.where(F.col(member).isNotNull())
    own = F.struct(F.col(member).alias("member"), "started", "idle", "starting", F.coalesce(F.col("until").cast("double"), F.lit(float("-inf"))).alias("until"))
    costs = member_costs(df, group, clock, event, member, kind).groupBy(*group).agg(F.sort_array(F.collect_list(own)).alias("rows"))
    crowd = _crowds(df, group, clock, member, kind).groupBy(*(F.col(c).alias(f"_{c}") for c in group)).agg(F.collect_list(F.struct(F.col(clock).cast("double").alias("at"), "moved")).alias("crowd"))
    both = costs.join(crowd, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group))).select(*group, "rows", "crowd")
    # as many partitions as shuffles make, however few bytes they hold: picking takes time, not room
    both = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in group)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for rows, seconds in zip(batch["rows"], batch["crowd"], strict=True):
                column = lambda name, kind, of=rows: np.array([r[name] for r in of], kind)
                found.append(pick(np.array([r["member"] for r in rows]), column("started", bool), column("idle", int), column("starting", int), column("until", float), column("at", float, seconds), column("moved", int, seconds)))
            solved = pd.DataFrame(found, columns=["members", "status", "n_violations", "n_solutions"], index=batch.index)
            yield pd.concat([batch[group], solved], axis=1)

    of = df.schema[member].dataType.simpleString()
    solved = both.mapInPandas(solve, f"{kinds}, members array<{of}>, status string, n_violations int, n_solutions int")
    return solved.withColumn("quality", quality_of(F.col("status")))


def quality_of(status: Column) -> Column:
    """VALID, IMPUTED or QUARANTINED, by how a period's group was found."""
    return F.when(status.isin("EXACT", "SOLVED"), "VALID").when(status.isin("REPAIRED", "AMBIGUOUS"), "IMPUTED").otherwise("QUARANTINED")


def worse_quality(a: Column, b: Column) -> Column:
    """A stint of two sides is only as good as its weaker one."""
    return F.when((a == "QUARANTINED") | (b == "QUARANTINED"), "QUARANTINED").when((a == "IMPUTED") | (b == "IMPUTED"), "IMPUTED").otherwise("VALID")


def floor_after(df: DataFrame, starts: DataFrame, group: list[str], clock: str, event: str, member: str, kind: str) -> DataFrame:
    """(group, event, members): who is there after each event row, sorted; null where the period has no starting group.

    A row's members leave before its others enter. starts is starting_groups' result. A member is there after a row if the last row up to it that
    moved them brought them in, or none has and they started: one window over members and rows, and nothing is replayed. Starting groups are
    written once, so that they aren't solved again by each use.
    """
    starts = kept(starts.select(*group, "members"))
    moves = df.groupBy(*group, event, member).agg(F.max(F.when(F.col(kind).isin("IN"), 2).when(F.col(kind).isin("OUT", "EJECT"), 1)).alias("moved")).where("moved is not null")
    rows = df.groupBy(*group, event).agg(F.max(clock).alias("__clock"))
    starters = starts.select(*group, F.explode("members").alias(member), F.lit(2).alias("moved"))
    of_members = moves.select(*group, member, event, "moved").unionByName(starters.withColumn(event, F.lit(None).cast(df.schema[event].dataType)))
    # every member that a period's start or moves name, at each of its rows
    named = of_members.select(*group, member).distinct()
    known = starts.where("members is not null").select(*group)
    on = [*group]
    grid = rows.join(known, on).join(named, on)
    placed = grid.join(moves, [*group, event, member], "left").join(starters.select(*group, member, F.lit(True).alias("began")), [*group, member], "left")
    upto = Window.partitionBy(*group, member).orderBy(F.desc("__clock"), event).rowsBetween(Window.unboundedPreceding, 0)
    there = F.coalesce(F.last("moved", ignorenulls=True).over(upto) == 2, F.col("began"), F.lit(False))
    found = placed.withColumn("there", there).groupBy(*group, event).agg(F.sort_array(F.collect_list(F.when(F.col("there"), F.col(member)))).alias("members"))
    return rows.join(found, [*group, event], "left").select(*group, event, "members")


def both_floors(after: DataFrame, starts: DataFrame, group: list[str], side: str, event: str, home, away) -> DataFrame:
    """(group without side, event, home, away, quality, method): both sides' members after each row, only as good as the weaker side.

    after is floor_after's result, starts starting_groups', both with side among their group.
    """
    keys = [c for c in group if c != side]
    known = starts.select(*group, "status", "quality")
    one = lambda which, name: after.where(F.col(side) == which).join(known, group, "left").select(*keys, event, F.col("members").alias(name), F.col("status").alias(f"{name}_status"), F.coalesce("quality", F.lit("QUARANTINED")).alias(f"{name}_quality"))
    rows = one(home, "home").join(one(away, "away"), [*keys, event], "full")
    # a row of one side alone leaves the other as it was
    upto = Window.partitionBy(*keys).orderBy(event).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("home", "away", "home_status", "away_status", "home_quality", "away_quality")})
    bad = F.lit("QUARANTINED")
    quality = worse_quality(F.coalesce("home_quality", bad), F.coalesce("away_quality", bad))
    return filled.select(*keys, event, "home", "away", quality.alias("quality"), F.concat_ws("/", F.coalesce("home_status", F.lit("none")), F.coalesce("away_status", F.lit("none"))).alias("method"))
