"""Secret scans by patterns and by sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.llm.common import table

#: Kinds in the order in which spans that start together are listed; patterns of the first three are given and fixed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of the last class is one match, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
#: Strings looked at for entropy: unbroken runs of these characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
WINDOW = 24
#: For each character class: what all of a window's candidate must match, and bits a character from which it is a secret.
CLASSES = {"hexadecimal": (r"^[0-9A-Fa-f]+$", 3.0), "alphanumeric": (r"^[A-Za-z0-9]+$", 3.9), "base64": (r"^[A-Za-z0-9+/_-]+$", 4.0)}
#: Candidates that are no secrets whatever their entropy: one letter case and no digit, numbers, dates and
#: UUIDs, and the example values that documentation uses. No pattern repeats a group: for that Java calls itself once a repeat, and a long run ends the JVM.
ALLOWED = (
    r"^[^0-9A-Z]*+$",
    r"^[^0-9a-z]*+$",
    r"^[0-9_-]++$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|xxxxxx|123456789",
)
#: Paths of words are none either: words of letters, each with a separator behind it, then letters and up to four digits. That is the first
#: two of these, and not the last.
PATH_SHAPE, PATH_JOINT, PATH_GAP = r"^/?[A-Za-z][A-Za-z/_-]*+[0-9]{0,4}$", r"[A-Za-z][/_-]", r"[/_-]{2}"
#: Tokens of a narrower class inside a longer run, each with its class: windows within them are held to that class's bits.
TOKENS = {
    "hexadecimal": r"(?<=[G-Zg-z+/_-])[0-9A-Fa-f]{24,}+|(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}+(?=[G-Zg-z+/_-])",
    "alphanumeric": r"(?<=[+/_-])[A-Za-z0-9]{24,}+|(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+(?=[+/_-])",
}
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_NONE = f"cast(array() as {_SPAN})"


#: Matches whose places are summed up in one go; a text's matches are worked on in stretches of so many, so that time grows in proportion to them.
STRETCH = 200


def _bound(x: Column, f) -> Column:
    """f of x, which is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def matches(text: Column, pattern: str) -> Column:
    """(start, match) of a pattern's leftmost non-overlapping matches, in code points: what split leaves between them gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    zipped = _bound(found, lambda m: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("gap"), m.alias("match")))
    none = F.expr("cast(array() as array<struct<start:int,match:string>>)")

    def placed(part: Column, at: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["gap"])
            return F.struct((start + F.length(x["match"])).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), x["match"].alias("match")))).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def stretches(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pairs), F.lit(STRETCH))
        return F.transform(firsts, lambda i: F.slice(pairs, i, STRETCH))

    def in_order(parts: Column) -> Column:
        sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + F.length(x["gap"]) + F.length(x["match"])))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return _bound(begins, lambda b: F.flatten(F.transform(parts, lambda part, i: placed(part, F.get(b, i)))))

    return _bound(zipped, lambda pairs: F.when(F.size(pairs) > 0, _bound(stretches(pairs), in_order)).otherwise(none))


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of a kind; texts without a match stop at the first look."""
    number = KINDS.index(kind)
    found = matches(text, pattern)
    found = F.filter(found, keep) if keep else found
    as_span = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), (m["start"] + F.length(m["match"])).alias("end")))
    return F.when(text.rlike(pattern), as_span).otherwise(F.expr(_NONE))


def window_spans(chars: Column, least: Column, window: int = WINDOW) -> Column:
    """(low, high) of the stretches that windows of at least `least` bits a character cover.

    One pass: the counts of the window's characters change by the one that enters and the one that leaves, and so does
    the sum of c log2 c, from which the entropy is log2(window) - sum / window.
    """
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    code = lambda c: F.position(c, F.lit(_ALPHABET))  # noqa: E731  from 1
    start = F.struct(F.expr(f"array_repeat(0, {len(_ALPHABET)})").alias("counts"), F.lit(0.0).alias("sum"), F.expr("cast(array() as array<struct<low:int,high:int>>)").alias("out"))

    def moved(state: Column, symbol: Column, by: int) -> Column:
        """(counts, sum) with one more or less of a symbol."""
        count = F.element_at(state["counts"], symbol)
        counts = F.transform(state["counts"], lambda c, i: F.when(i + 1 == symbol, c + by).otherwise(c))
        return F.struct(counts.alias("counts"), (state["sum"] - term(count) + term(count + by)).alias("sum"), state["out"].alias("out"))

    def recorded(state: Column, i: Column) -> Column:
        last = F.try_element_at(state["out"], F.lit(-1))
        hit = (i >= window) & (F.lit(math.log2(window)) - state["sum"] / window >= least)
        one = F.array(F.struct((i - window).alias("low"), i.alias("high")))
        grown = F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(F.struct(last["low"].alias("low"), i.alias("high"))))
        out = F.when(~hit, state["out"]).when(last.isNotNull() & (i - window <= last["high"]), grown).otherwise(F.concat(state["out"], one))
        return F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"), out.alias("out"))

    def step(state: Column, i: Column) -> Column:
        # each transform binds what came before, so that no expression is computed twice
        bind = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
        entered = bind(code(F.element_at(chars, i)), lambda s: moved(state, s, 1))
        left = bind(entered, lambda e: F.when(i > window, bind(code(F.element_at(chars, F.greatest(i - window, F.lit(1)))), lambda s: moved(e, s, -1))).otherwise(e))
        return bind(left, lambda x: recorded(x, i))

    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step)["out"]


def _merged(spans: Column) -> Column:
    """Spans in order, those that meet or overlap as one."""

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], x["end"]).alias("end"))
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wider))
        return F.when(last.isNotNull() & (x["start"] <= last["end"]), grown).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.expr(_NONE), step)


def entropy_spans(text: Column) -> Column:
    """Spans of candidate strings' stretches of high entropy.

    A window belongs to the narrowest class that holds it: a candidate's windows to that of the whole, but those within a
    token of a narrower class to the token's. Candidates and tokens that are allowed are passed over, each for itself.
    """

    def allowed(x: Column) -> Column:
        out = x.rlike(PATH_SHAPE) & x.rlike(PATH_JOINT) & ~x.rlike(PATH_GAP)
        for p in ALLOWED:
            out = x.rlike(p) | out
        return out

    number = KINDS.index("entropy")

    def bits(x: Column) -> Column:
        out = F.lit(float("inf"))
        for pattern, least in reversed(CLASSES.values()):
            out = F.when(x.rlike(pattern), F.lit(least)).otherwise(out)
        return out

    def found(pattern: str, least) -> Column:
        mixed = F.filter(matches(text, pattern), lambda m: ~allowed(m["match"]))
        ready = F.transform(mixed, lambda m: F.struct(m["start"].alias("start"), F.split(m["match"], "").alias("chars"), least(m["match"]).alias("least")))
        spans = F.transform(ready, lambda c: F.transform(window_spans(c["chars"], c["least"]), lambda w: F.struct((c["start"] + w["low"]).alias("start"), F.lit(number).alias("kind"), (c["start"] + w["high"]).alias("end"))))
        return F.when(text.rlike(pattern), F.flatten(spans)).otherwise(F.expr(_NONE))

    every = [found(CANDIDATE, bits)] + [found(p, lambda _, c=c: F.lit(CLASSES[c][1])) for c, p in TOKENS.items()]
    return F.when(text.rlike(CANDIDATE), _merged(F.concat(*every))).otherwise(F.expr(_NONE))


def _outside(span: Column, others: Column) -> Column:
    """What other spans, in order of start, leave of one."""
    piece = lambda low, high: F.array(F.struct(low.alias("start"), span["kind"].alias("kind"), high.alias("end")))
    state = F.struct(span["start"].alias("at"), F.expr(_NONE).alias("out"))

    def step(s: Column, b: Column) -> Column:
        high = F.least(b["start"], span["end"])
        return F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.when(high > s["at"], F.concat(s["out"], piece(s["at"], high))).otherwise(s["out"]).alias("out"))

    return F.aggregate(others, state, step, lambda s: F.when(s["at"] < span["end"], F.concat(s["out"], piece(s["at"], span["end"]))).otherwise(s["out"]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base_spans and spans: arrays of (start, kind, end) in order of start and kind, in code points, ends exclusive.

    kind is a number in KINDS. Base spans are those of the three patterns; spans adds what they leave of
    stretches of high entropy. Null and empty texts have none; texts are scanned whole; rows never meet, so repeats, ties and
    hot keys play no part, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_CHARS
    base = F.concat(_spans(text, ASSIGN, "assign", long_value), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    found = docs.withColumn("base_spans", F.array_sort(base)).withColumn("added_spans", entropy_spans(text))
    apart = F.flatten(F.transform("added_spans", lambda a: _outside(a, F.col("base_spans"))))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", apart))).drop("added_spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Texts with a mark in place of each stretch that spans cover; spans columns go. Texts without spans stay as they are, null ones too."""
    text = F.col(text_col)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], new).otherwise(s["out"]).alias("out"))

    done = F.aggregate("spans", state, step)
    whole = F.transform(F.array(done), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size("spans") > 0, F.element_at(whole, 1)).otherwise(text)).drop("base_spans", "spans")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
