"""Documents about groups, narratives about documents, and whether a narrative says only what its document holds.

A document is a row (doc, names, rows, per_100, three, rim, mid, level, below_floor): its members' names, how many rows are behind it, its
worth a hundred times, its shares of attempts from three places, where its worth lies, and whether it is below the reporting floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupwise.functions.columns import numbers
from groupwise.operators.retrieval import TOLERANCE, UNIT_PHRASES, says_any, stated_direction
from groupwise.operators.sequence import row_numbers

#: Least shares of the phrases for a share, of the style tags, and of the archetypes.
SHARE_PHRASES = ((0.45, "a heavy share"), (0.35, "an above-average share"), (0.22, "a modest share"))
SMALL_SHARE = "a small share"
STYLE_TAGS = (("three", 0.42, "three-heavy"), ("rim", 0.34, "rim-pressuring"), ("mid", 0.22, "mid-range-reliant"))
NO_TAG = "balanced"
#: Fixed words: places that are no zones, claims of a point estimate, and directions with their signs; and the usual share of threes.
NO_ZONES = ["elbow", "short corner", "dunker spot", "nail", "floater range"]
POINT_CLAIMS = ["exactly", "precisely", "is worth", "will score", "scores exactly"]
DIRECTIONS = {"more": 1, "higher": 1, "above": 1, "better": 1, "increases": 1, "fewer": -1, "lower": -1, "below": -1, "worse": -1, "decreases": -1}
USUAL_THREES = 0.39
#: Fixed pattern of names (two or more capitalised words), and the letters a name must have.
NAME, LEAST_LETTERS = r"\b[A-Z][A-Za-z'.\-]*(?:\s+[A-Z][A-Za-z'.\-]*)+", 8
TEMPLATES = ("faithful", "overclaiming", "hallucinating")
VARIANTS = ("events", "numbers", "full")


def percent(share: Column, exact: bool = False) -> Column:
    """A share in whole per cent, or in tenths of one."""
    said = F.bround(100 * share, 1) if exact else F.bround(100 * share, 0).cast("int")
    return F.concat(said.cast("string"), F.lit("%"))


def share_phrase(share: Column) -> Column:
    """A share in words, with its per cent."""
    words = F.lit(SMALL_SHARE)
    for least, phrase in reversed(SHARE_PHRASES):
        words = F.when(share >= least, phrase).otherwise(words)
    return F.concat(words, F.lit(" ("), percent(share), F.lit(")"))


def style_tags(three: Column, rim: Column, mid: Column) -> Column:
    """The tags whose shares are reached, or that of none."""
    of = {"three": three, "rim": rim, "mid": mid}
    tags = F.array_compact(F.array(*(F.when(of[name] >= least, tag) for name, least, tag in STYLE_TAGS)))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(NO_TAG)))


def archetype(three: Column, rim: Column) -> Column:
    """A member's kind by shares from three and at the rim; the first rule that holds decides."""
    return (
        F.when((three >= 0.45) & (rim <= 0.25), "perimeter scorer")
        .when((rim >= 0.45) & (three <= 0.15), "interior big")
        .when((three >= 0.35) & (rim >= 0.30), "stretch big")
        .when(rim >= 0.38, "slashing guard")
        .otherwise("balanced wing")
    )


def names_in(text: Column) -> Column:
    """Capitalised names in a text, as written."""
    return F.regexp_extract_all(text, F.lit(f"({NAME})"), 1)


def letters(name: Column) -> Column:
    """A name's letters in lower case: what tells names apart."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}]", "")


def strangers(text: Column, names: Column) -> Column:
    """Names of LEAST_LETTERS letters or more that a text holds and that neither hold one of `names` nor are held by one."""
    own = F.transform(names, letters)
    known = lambda x: F.exists(own, lambda n: F.contains(n, x) | F.contains(x, n))
    return F.filter(names_in(text), lambda x: (F.length(letters(x)) >= LEAST_LETTERS) & ~known(letters(x)))


def rendered(docs: DataFrame, variant: str) -> DataFrame:
    """(doc, text) of documents as a log of their names and places, as numbers, or in full with words for the numbers, and with archetypes if there are such."""
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant}; there are {', '.join(VARIANTS)}")
    names = F.array_join("names", ", ")
    places = F.concat_ws(" ", F.concat(F.lit("three "), percent(F.col("three"))), F.concat(F.lit("rim "), percent(F.col("rim"))), F.concat(F.lit("mid-range "), percent(F.col("mid"))))
    numbers_ = F.format_string("group %s rows=%d per_100=%.2f three=%.4f rim=%.4f mid=%.4f", F.col("doc").cast("string"), "rows", "per_100", "three", "rim", "mid")
    roles = [F.concat(F.lit("Roles: "), F.array_join("archetypes", ", "), F.lit("."))] if "archetypes" in docs.columns else []
    full = F.concat_ws(
        " ", F.format_string("%s were together for %d rows.", names, "rows"), *roles, F.concat(F.lit("Style: "), F.array_join(style_tags(F.col("three"), F.col("rim"), F.col("mid")), ", "), F.lit(".")),
        F.format_string("Worth %.1f per 100, %s.", "per_100", "level"), F.concat(share_phrase(F.col("three")), F.lit(" from three, "), share_phrase(F.col("rim")), F.lit(" at the rim.")),
        F.when(F.col("below_floor"), "Below the reporting floor: a direction alone.").otherwise("Enough for a point estimate."),
    )
    return docs.select("doc", {"events": F.concat_ws(" ", names, places), "numbers": numbers_, "full": full}[variant].alias("text"))


def with_intruders(docs: DataFrame) -> DataFrame:
    """docs with intruder, the first name of the first other document by id."""
    two = docs.where(F.size("names") > 0).orderBy("doc").limit(2).agg(F.sort_array(F.collect_list(F.struct("doc", F.get("names", F.lit(0)).alias("name")))).alias("__two"))
    other = F.filter("__two", lambda x: x["doc"] != F.col("doc"))
    return docs.crossJoin(F.broadcast(two)).withColumn("intruder", F.get(other, F.lit(0))["name"]).drop("__two")  # one row


def narratives(docs: DataFrame) -> DataFrame:
    """(doc, template, text): three narratives of each document, one that keeps to it, one that claims more than its evidence allows, one that names a stranger."""
    first, second, n = F.get("names", F.lit(0)), F.coalesce(F.get("names", F.lit(1)), F.get("names", F.lit(0))), F.col("rows")
    hedge = F.when(F.col("below_floor"), "which gives a direction and no point estimate").otherwise("enough for a point estimate")
    texts = {
        "faithful": F.format_string("%s and %s were together for %d rows, %s. Of their attempts %s came from three and %s at the rim, %s.", first, second, n, hedge, percent(F.col("three"), exact=True), percent(F.col("rim"), exact=True), "level"),
        "overclaiming": F.format_string("%s and %s scored exactly %.1f per 100 possessions in %d rows.", first, second, "per_100", n),
        "hallucinating": F.format_string("%s and %s led this group for %d rows, %s of them from three.", first, F.coalesce("intruder", F.lit("Somebody Else")), n, percent(F.col("three"), exact=True)),
    }
    each = F.array(*(F.struct(F.lit(t).alias("template"), texts[t].alias("text")) for t in TEMPLATES))
    return with_intruders(docs).select("doc", F.inline(each))


def checked(rows: DataFrame) -> DataFrame:
    """rows (text and a document's columns) with n_numbers, n_traced and failures, the names of checks that the text fails against the document."""
    text, lower = F.col("text"), F.lower("text")
    measurable = text
    for phrase in UNIT_PHRASES:
        measurable = F.replace(measurable, F.lit(phrase), F.lit(" "))
    facts = F.array(F.col("rows").cast("double"), F.round("per_100", 2), F.round("three", 4), F.round("rim", 4), F.round("mid", 4))
    evidence = F.concat(facts, F.transform(facts, lambda x: F.round(100 * x, 4)))
    near = lambda v: F.exists(evidence, lambda f: F.when(f == 0, F.abs(v) < 1e-9).otherwise(F.abs(v - f) / F.abs(f) <= TOLERANCE))
    value = lambda s: F.regexp_replace(s, "%", "").cast("double")
    traced = F.filter(numbers(measurable), lambda s: near(value(s)) | near(F.when(F.endswith(s, F.lit("%")), value(s) / 100).otherwise(value(s) * 100)))
    stated = stated_direction(text, {f"{w} three": s for w, s in DIRECTIONS.items()})
    fails = {
        "numeric_traceability": F.size(traced) < F.size(numbers(measurable)),
        "zone_vocabulary": says_any(text, NO_ZONES),
        "player_scope": F.size(strangers(text, F.col("names"))) > 0,
        "tier_consistency": F.col("below_floor") & F.exists(F.array(*map(F.lit, POINT_CLAIMS)), lambda p: F.contains(lower, p)),
        "direction": stated.isNotNull() & (stated != F.when(F.col("three") > USUAL_THREES, 1).otherwise(-1)),
    }
    failures = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in fails.items())))
    return rows.withColumn("n_numbers", F.size(numbers(measurable))).withColumn("n_traced", F.size(traced)).withColumn("failures", failures)


def corpus_scores(told: DataFrame, docs: DataFrame) -> DataFrame:
    """(template, n, grounded, traceability, easy, near_miss) of narratives (doc, template, text): the shares that keep to their documents, to others', and
    to their own with one member exchanged. Controls that find most narratives grounded are blind.

    For the easy control document i of n, from 0, is told of document 2 i + 1 modulo n, never itself.
    """
    evidence = [c for c in docs.columns if c != "doc"]
    numbered = row_numbers(docs.select("doc"), "doc", name="__i")
    n = docs.count()
    target = F.pmod(2 * F.col("__i") + 1, F.lit(max(n, 1)))
    other = numbered.select("doc", F.when(target == F.col("__i"), F.pmod(target + 1, F.lit(max(n, 1)))).otherwise(target).alias("__j")).join(numbered.select(F.col("__i").alias("__j"), F.col("doc").alias("__other")), "__j").select("doc", "__other")
    own = told.join(docs, "doc")
    swapped = with_intruders(docs).withColumn("names", F.when(F.col("intruder").isNotNull(), F.concat(F.array("intruder"), F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))))).otherwise(F.col("names"))).drop("intruder")
    easy = told.join(other, "doc").join(docs.select(F.col("doc").alias("__other"), *evidence), "__other").drop("__other")
    sets = {"own": own, "easy": easy, "near_miss": told.join(swapped, "doc")}
    every = None
    for name, rows in sets.items():
        part = checked(rows).select("template", F.lit(name).alias("against"), (F.size("failures") == 0).cast("double").alias("grounded"), F.when(F.col("n_numbers") > 0, F.col("n_traced") / F.col("n_numbers")).otherwise(1.0).alias("traced"))
        every = part if every is None else every.unionByName(part)
    of = lambda name, value: F.avg(F.when(F.col("against") == name, F.col(value)))
    return every.groupBy("template").agg(F.count_if(F.col("against") == "own").alias("n"), of("own", "grounded").alias("grounded"), of("own", "traced").alias("traceability"), of("easy", "grounded").alias("easy"), of("near_miss", "grounded").alias("near_miss"))


def failure_counts(told: DataFrame, docs: DataFrame) -> DataFrame:
    """(template, failure, n) of the checks that narratives fail against their own documents."""
    return checked(told.join(docs, "doc")).select("template", F.explode("failures").alias("failure")).groupBy("template", "failure").agg(F.count("*").alias("n"))
