"""Line deduplication: exact copies by hash, near copies by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupwise.llm.common import stored, table

#: Edits (insert, delete, change of a character) within which a line is a near copy.
EDITS = 2
#: Shorter lines, without the spaces around them, are never dropped.
LEAST_CHARS = 20


def segment(i: Column, length: Column, edits: int = EDITS) -> tuple[Column, Column]:
    """(start from 1, size) of segment i, from 1 to edits + 1, of a line; sizes differ by one at most, longer ones come last."""
    parts = edits + 1
    size, shorter = F.floor(length / parts).cast("int"), parts - length % parts
    return 1 + (i - 1) * size + F.greatest(i - 1 - shorter, F.lit(0)), size + F.when(i > shorter, 1).otherwise(0)


def windows(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(characters less, segment, shift) of the substrings that a line looks up: first its own edits + 1 segments.

    If a line is within the edits of one of the same length or up to `edits` less, one of that one's segments stands unchanged in
    it; where it may stand follows from the edits left before and after it (multi-match-aware windows), so only these are looked up.
    """
    every = [(less, i, shift) for less in range(edits + 1) for i in range(1, edits + 2) for shift in range(max(1 - i, less - edits - 1 + i), min(i - 1, less + edits + 1 - i) + 1)]
    return sorted(every, key=lambda w: (w[0] or w[2]) != 0)


def with_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Rows of lines (line, chars) for each key (length, segment number, segment), with its place `at` in windows: those up to `edits` are
    the keys under which the line stands, and it looks up all. One small expression works on a row of each window, which is compiled; one
    expression for all of them is too long to be.
    """
    every = F.array(*(F.struct(F.lit(at).alias("at"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for at, (less, i, shift) in enumerate(windows(edits))))
    raw = F.when(F.octet_length("line") == F.col("chars"), F.col("line").cast("binary"))  # where a character is a byte, parts need no walk from the begin
    rows = lines.select("*", raw.alias("__raw")).select("*", F.explode(every).alias("w"))
    indexed = F.col("chars") - F.col("w.less")
    start, size = segment(F.col("w.i"), indexed, edits)
    start = start + F.col("w.shift")
    # 48 bits: what meets by chance is told apart by its counts and its text
    part = F.when(F.col("__raw").isNotNull(), F.substring(F.col("__raw"), start, size)).otherwise(F.substring(F.col("line"), start, size).cast("binary"))
    key = F.xxhash64(indexed, F.col("w.i"), part).bitwiseAND(F.lit((1 << 48) - 1))
    fits = (indexed >= edits + 1) & (start >= 1) & (start + size - 1 <= F.col("chars"))
    return rows.where(fits).select(*lines.columns, F.col("w.at").alias("at"), key.alias("key"))


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings are within `edits` edits, by a band of 2 * edits + 1 bits that moves along the diagonal.

    Bit k of a column's vectors stands for the row k - edits below the diagonal. A step takes one character of b, the
    bits of the band's characters of a that equal it, and updates the vertical differences (up, down); the distance is
    followed along the lowest diagonal, then along a's last row.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    long_ = lambda x: F.lit(x).cast("bigint")
    band = F.transform(F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("m"), F.length(b).alias("n"))), lambda s: _banded(s, edits, width, full, top, long_))
    near = F.element_at(band, 1) <= edits
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, False).when(a == b, True).when((F.length(a) <= edits) | (F.length(b) <= edits), F.levenshtein(a, b) <= edits).otherwise(near)


def _banded(s: Column, edits: int, width: int, full: int, top: int, long_) -> Column:
    bind = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    m = s["m"]
    begin = F.struct(long_(full & ~((1 << edits) - 1)).alias("up"), long_(0).alias("down"), F.lit(edits).alias("score"))

    def step(state: Column, j: Column) -> Column:
        # the band's rows at column j: j - edits .. j + edits
        bits = [F.when((j + (k - edits) >= 1) & (j + (k - edits) <= m) & (F.get(s["a"], j + (k - edits) - 1) == F.get(s["b"], j - 1)), long_(1 << k)).otherwise(long_(0)) for k in range(width)]
        equal = bits[0]
        for x in bits[1:]:
            equal = equal.bitwiseOR(x)

        def vectors(eq: Column) -> Column:
            up, down = state["up"], state["down"]
            carried = (eq.bitwiseAND(up) + up).bitwiseAND(long_(full)).bitwiseXOR(up)
            return carried.bitwiseOR(eq).bitwiseOR(down)

        def moved(diagonal: Column) -> Column:
            up, down = state["up"], state["down"]
            right_up = down.bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(up)).bitwiseAND(long_(full)))
            right_down = diagonal.bitwiseAND(up)
            next_ = F.shiftright(diagonal, 1)
            new_up = right_down.bitwiseOR(F.bitwise_not(next_.bitwiseOR(right_up)).bitwiseAND(long_(full)))
            # on the lowest diagonal a step costs one unless it is free; on a's last row the horizontal difference counts
            along = F.when(diagonal.bitwiseAND(long_(top)) == 0, 1).otherwise(0)
            row = F.greatest(F.least(m - j + edits, F.lit(width - 1)), F.lit(0))
            bit = F.get(F.array(*(long_(1 << k) for k in range(width))), row)
            across = F.when(right_up.bitwiseAND(bit) != 0, 1).when(right_down.bitwiseAND(bit) != 0, -1).otherwise(0)
            return F.struct(new_up.alias("up"), next_.bitwiseAND(right_up).alias("down"), (state["score"] + F.when(j + edits <= m, along).otherwise(across)).alias("score"))

        return bind(bind(equal, vectors), moved)

    return F.aggregate(F.sequence(F.lit(1), s["n"]), begin, step)["score"]


#: Letters whose counts tell most lines apart before they are compared; any choice gives the same result.
COUNTED_LETTERS = "etaonirdshlcumgw"


def letter_counts(line: Column) -> Column:
    """Counts of some letters modulo 16, four bits each."""
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(COUNTED_LETTERS):
        own = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("bigint") % 16
        out = out.bitwiseOR(F.shiftleft(own, 4 * i))
    return out


def counts_allow(a: Column, b: Column, edits: int = EDITS) -> Column:
    """False only if the counts differ by more than the edits can change them: an edit changes two of them by one, and counts modulo 16 differ by no more than counts."""
    apart = F.lit(0).cast("bigint")
    for i in range(len(COUNTED_LETTERS)):
        of = lambda x, i=i: F.shiftrightunsigned(x, 4 * i).bitwiseAND(F.lit(15).cast("bigint"))
        d = F.abs(of(a) - of(b))
        apart = apart + F.least(d, 16 - d)
    return apart <= 2 * edits


def _shared(a: Column, b: Column, from_end: bool) -> Column:
    """Characters that two strings have in common at their begin or end, by halving steps."""
    part = (lambda x, k: F.right(x, k)) if from_end else (lambda x, k: F.left(x, k))
    most = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int")), lambda k: F.ceil(most / F.pow(F.lit(2.0), k)).cast("int"))

    def step(at: Column, more: Column) -> Column:
        to = F.least(at + more, most)
        return F.when(part(a, to) == part(b, to), to).otherwise(at)

    # a last step of one, as rounding up leaves no gap larger than that
    return F.aggregate(F.concat(steps, F.array(F.lit(1), F.lit(1))), F.lit(0), step)


def ends_allow(a: Column, b: Column, edits: int = EDITS) -> Column:
    """False only if two strings are further apart than two edits: one edit is spent at each end of the part that differs, so what is left of it must agree.

    For other numbers of edits, true.
    """
    if edits != 2:
        return F.lit(True)

    def core(x: Column) -> Column:
        m_a, m_b = F.length(x["a"]), F.length(x["b"])
        rest = lambda s, m, first, last: F.substring(s, F.lit(1 + first), F.greatest(m - first - last, F.lit(0)))
        out = F.lit(False)
        for first_a, first_b, last_a, last_b in ((i, j, k, l) for i in (0, 1) for j in (0, 1) for k in (0, 1) for l in (0, 1) if i | j and k | l):
            out = out | ((m_a - first_a - last_a == m_b - first_b - last_b) & (rest(x["a"], m_a, first_a, last_a) == rest(x["b"], m_b, first_b, last_b)))
        return (F.greatest(m_a, m_b) <= 2) | out

    bind = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    tail = lambda x: F.struct(F.substring(a, x + 1, F.length(a)).alias("a"), F.substring(b, x + 1, F.length(b)).alias("b"))
    cut = lambda t, q: F.struct(F.left(t["a"], F.length(t["a"]) - q).alias("a"), F.left(t["b"], F.length(t["b"]) - q).alias("b"))
    return bind(bind(bind(_shared(a, b, False), tail), lambda t: bind(_shared(t["a"], t["b"], True), lambda q: cut(t, q))), core)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, chars, h, g) of every line, a null text being one empty line; line without the spaces around it, h and g its 128-bit name."""
    every = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "whole"))
    bare = every.select("doc_id", "line_no", F.trim("whole").alias("line"))
    return bare.select("doc_id", "line_no", "line", F.length("line").alias("chars"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no")


#: Lines of one key that a task compares with what looks them up; larger keys are dealt to several tasks.
KEY_LINES = 256
#: A line with more than one in so many of all occurrences is sent to every task: there are no more of them than that.
HOT_LINES = 1000


#: Words of 64 bits of the filter that is sent to tasks, at most: 16 MB with their numbers. Fuller filters pass more, and lose nothing.
FILTER_WORDS = 1_000_000


def _likely_among(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The rows whose column is among the names', and some others: a hashed bitmap of the names, of bounded size, is sent to all tasks.

    So a join with the names that follows shuffles what it needs and little else. It must be an inner one: a semi-join is moved before this.
    """
    bits = 64 * max(1, min(FILTER_WORDS, names.count() // 2))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    word, bit = F.shiftright(at, 6), (at % 64).cast("int")
    one = F.lit(1).cast("bigint")
    words = names.select(word.alias("__word"), F.call_function("shiftleft", one, bit).alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    found = rows.join(F.broadcast(words), word == F.col("__word")).where(F.call_function("shiftrightunsigned", F.col("__bits"), bit).bitwiseAND(one) == 1)
    return found.select(*rows.columns)


def near_lines(counted: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h, g) of the lines within `edits` edits of a line that first occurs before them.

    A key is open if a line stands under it and another one looks it up; that takes the least and largest names a key has, summed
    up before they are shuffled, so a line on a third of all rows is one row a task, and texts stay where they are. Only lines
    with an open key are then gathered, once each, and meet by key; those that counts and ends allow are
    verified inside the join, which gives near pairs alone. Keys of many lines are cut into parts of KEY_LINES.
    """
    stands = F.col("at") <= edits
    of_lines = with_keys(counted, edits).select("h", "g", "at", "key")
    summed = of_lines.groupBy("key").agg(F.min(F.when(stands, F.col("h"))).alias("stands"), F.min("h").alias("least"), F.max("h").alias("most"))
    open_keys = stored(summed.where("stands is not null and least <> most").select("key"), "open-keys")
    open_lines = stored(_likely_among(of_lines, open_keys, "key").join(open_keys, "key").select("h", "g").distinct(), "open-lines")
    first = F.min(F.struct(_place().alias("place"), "line", "chars")).alias("first")
    held = _likely_among(counted, open_lines, "h").join(open_lines, ["h", "g"]).groupBy("h", "g").agg(first)
    held = stored(held.select("h", "g", "first.place", "first.line", "first.chars", letter_counts(F.col("first.line")).alias("counts")), "held-lines")
    looked = with_keys(held, edits).join(open_keys, "key", "left_semi")
    own = F.array(*(F.substring(F.col("line"), *segment(F.lit(i), F.col("chars"), edits)) for i in range(1, edits + 1)))
    parts = looked.where(stands).groupBy("key").agg(F.ceil(F.count("*") / KEY_LINES).cast("int").alias("parts"))
    looked = looked.withColumn("own", own).join(parts, "key")
    side = F.struct("h", "g", "place", "line", "chars", "counts", "own", "at")
    standing = looked.where(stands).select("key", F.pmod(F.col("g"), F.col("parts")).cast("int").alias("part"), side.alias("r"))
    looking = looked.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), side.alias("s"))
    r, s = F.col("r"), F.col("s")
    named = lambda x: F.struct(x["h"], x["g"])
    # lines of one length find each other both ways, and under each segment they share: the first one counts
    before = F.lit(False)
    for i in range(edits):
        before = before | ((F.col("s.at") > i) & (F.col("r.own")[i] == F.col("s.own")[i]))
    once = F.when(r["chars"] == s["chars"], (named(r) < named(s)) & ~before).otherwise(True)
    likely = once & counts_allow(r["counts"], s["counts"], edits) & ends_allow(r["line"], s["line"], edits)
    pairs = standing.join(looking, ["key", "part"]).where(likely & within_edits(r["line"], s["line"], edits))
    later = F.when(s["place"] > r["place"], named(s)).otherwise(named(r))
    return pairs.select(later.alias("later")).distinct().select("later.h", "later.g")


def line_flags(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Each line's doc_id, line_no, chars and drop: exact, near or null.

    A line's first occurrence is that of the least (doc_id, line_no), null ids last. `exact`: the same line, without spaces
    around it, stands elsewhere first. `near`: a line within `edits` edits of it has its first occurrence before its own.
    Lines of fewer than least_chars characters are kept. Lines are told apart by 128 bits of hashes. Repeated
    rows of a doc_id are the same occurrence, and are kept or dropped together.
    """
    return _flagged(docs, edits, least_chars, _lines(docs)).select("doc_id", "line_no", "chars", "drop")


def _dropped(docs: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """The flags of dropped lines alone: doc_id, line_no, h, chars, drop."""
    return _flagged(docs, edits, least_chars, _lines(docs).where(F.col("chars") >= least_chars)).where("drop is not null")


def _flagged(docs: DataFrame, edits: int, least_chars: int, lines: DataFrame) -> DataFrame:
    if least_chars < edits + 1:
        raise ValueError("lines must have a character for each segment")
    counted = _lines(docs).where(F.col("chars") >= least_chars)
    near = stored(near_lines(counted, edits).withColumn("near", F.lit(True)), "near-lines")
    firsts = counted.groupBy("h", "g").agg(F.min(_place()).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    known = stored(firsts.join(near, ["h", "g"], "full").select("h", "g", "first", "copies", F.coalesce("near", F.lit(False)).alias("near")), "known-lines")
    occurrences = known.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    hot = known.where(F.col("copies") > max(occurrences // HOT_LINES, 1)).select(F.col("h").alias("hot_h"), F.col("g").alias("hot_g"), F.struct("first", "near").alias("of_hot"))
    of_hot = lines.drop("line").join(F.broadcast(hot), (F.col("h") == F.col("hot_h")) & (F.col("g") == F.col("hot_g")), "left")
    # rows of hot lines have their answer and are dealt by place
    dealt = of_hot.withColumn("k", F.when(F.col("hot_h").isNull(), F.col("h")).otherwise(F.xxhash64("doc_id", "line_no")))
    found = dealt.join(known.select(F.col("h").alias("k"), "g", F.struct("first", "near").alias("of_known")), ["k", "g"], "left")
    of = F.coalesce("of_hot", "of_known")
    reason = F.when(of["near"], "near").when(of["first"].isNotNull() & (_place() != of["first"]), "exact")
    return found.select("doc_id", "line_no", "h", "chars", reason.alias("drop"))


def line_report(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row a doc_id: n_lines, n_exact, n_near, kept_chars (without spaces around lines) and dropped, the line numbers dropped, comma-joined."""
    count = lambda c: F.count(F.when(c, 1)).alias
    lines = _lines(docs).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.col("chars").cast("long")).alias("chars"))
    gone = _dropped(docs, edits, least_chars).select("doc_id", F.lit(0).cast("long").alias("lines"), (-F.col("chars")).cast("long").alias("chars"), "line_no", "drop")
    both = lines.unionByName(gone, allowMissingColumns=True)
    numbers = F.array_join(F.array_sort(F.collect_list("line_no")).cast("array<string>"), ",")
    return both.groupBy("doc_id").agg(F.sum("lines").alias("n_lines"), count(F.col("drop") == "exact")("n_exact"), count(F.col("drop") == "near")("n_near"), F.sum("chars").alias("kept_chars"), numbers.alias("dropped"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with the dropped lines taken out of text. Other columns stay; texts without such lines stay as they are, null ones too.

    Rows that share a doc_id but not a text lose only lines that they hold at that place themselves. A text all of whose lines are dropped is left empty.
    """
    numbers = F.array_sort(F.collect_set(F.struct("line_no", "h"))).alias("__gone")
    gone = _dropped(docs.select("doc_id", "text"), edits, least_chars).groupBy(F.col("doc_id").alias("__id")).agg(numbers)
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")), "left")
    lines = F.split("text", "\n")

    def kept(x: Column) -> Column:
        # pieces between dropped lines, so that each line is copied once
        at = F.transform(F.filter(F.col("__gone"), lambda g: F.xxhash64(F.trim(F.get(x, g["line_no"]))) == g["h"]), lambda g: g["line_no"])
        cuts = F.concat(F.array(F.lit(-1)), at, F.array(F.size(x)))
        pieces = lambda c: F.transform(F.slice(c, 2, F.size(c)), lambda high, i: F.slice(x, F.get(c, i) + 2, high - F.get(c, i) - 1))
        return F.element_at(F.transform(F.array(cuts), lambda c: F.array_join(F.flatten(pieces(c)), "\n")), 1)

    text = F.when(F.col("__gone").isNotNull() & F.col("text").isNotNull(), F.element_at(F.transform(F.array(lines), kept), 1)).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents),
bare AS (SELECT doc_id, line_no, trim(line, ' ') AS line, length(trim(line, ' ')) AS chars FROM lines),
firsts AS (
  SELECT line, chars, doc_id, line_no FROM (
    SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, line_no) AS rn FROM bare WHERE chars >= {LEAST_CHARS}) t
  WHERE rn = 1),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b
  ON a.chars BETWEEN b.chars - {EDITS} AND b.chars + {EDITS} AND a.line <> b.line
  WHERE (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.line_no < b.line_no)) AND levenshtein(a.line, b.line) <= {EDITS}),
flags AS (
  SELECT l.doc_id, l.line_no, l.chars,
         CASE WHEN n.line IS NOT NULL THEN 'near' WHEN f.line IS NOT NULL AND (f.doc_id <> l.doc_id OR f.line_no <> l.line_no) THEN 'exact' END AS reason
  FROM bare l LEFT JOIN near n ON l.line = n.line LEFT JOIN firsts f ON l.line = f.line)
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN reason = 'exact' THEN 1 END) AS n_exact, count(CASE WHEN reason = 'near' THEN 1 END) AS n_near,
       CAST(coalesce(sum(CASE WHEN reason IS NULL THEN chars END), 0) AS BIGINT) AS kept_chars,
       coalesce(string_agg(CASE WHEN reason IS NOT NULL THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '') AS dropped
FROM flags GROUP BY doc_id
"""
